"""The pipeline's stages against the operators they call."""

from collections import Counter

import pytest

import corpus_pipeline
from shelfmark.llm import rows as row_keys
from shelfmark.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = {r.doc_id for r in stages["quality_rules"](spark, docs, SMALL).collect()}
    assert kept == {r.doc_id for r in queries.op1_host_quality(spark, SMALL).where("kept").collect()}

    first = {r.doc_id for r in stages["near_duplicates"](spark, docs, SMALL).collect()}
    assert first == {r.component_id for r in queries.op3_simhash_near_dedup(spark, SMALL).collect()}

    clean = {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, SMALL).collect()}
    judged = queries.op5_benchmark_decontamination(spark, SMALL).collect()
    assert clean == ids - {r.doc_id for r in judged if r.contaminated}

    scanned = {r.doc_id: r.text for r in stages["secret_scans"](spark, docs, SMALL).collect()}
    found = {r.doc_id for r in queries.op10_secret_scan(spark, SMALL).collect() if r.spans}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i in ids if scanned[i] != before[i]} == found


@pytest.mark.parametrize("rows", [[], [
    (1, "a b c d e f g h i j k l m", "en", "s", 1), (1, "a b c d e f g h i j k l m", "en", "s", 1),
    (None, "a b c d e f g h i j k l m", None, None, None), (None, None, None, None, None),
    (2, "", None, "s", 0),
]])
def test_odd_rows(spark, rows):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema)
    # the near duplicates are the rows of 1 and null, and the two without words
    want = {"quality_rules": 3, "near_duplicates": 2}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == (want.get(name, 5) if rows else 0)


def unrelated(n):
    """Texts of different words, none near another."""
    return [" ".join(f"{w}{7 * k + 3}x{j}" for j in range(30) for w in "abcd") for k in range(n)]


def test_documents_stay_where_ids_are_null_or_repeat(spark):
    ids = [None] * 5 + [7] * 5 + [8]
    texts = unrelated(11)
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)]
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, spark.createDataFrame(rows, schema), SMALL).collect()
    assert Counter(map(tuple, got)) == Counter(rows)
    twice = stage(spark, spark.createDataFrame(rows + rows, schema), SMALL).collect()
    assert Counter(map(tuple, twice)) == Counter(rows)


def test_columns_of_any_name_pass_through(spark):
    extra = ["spans", "n_hex", "uid", "kept", "places", "n_words", "contaminated", "file", "root", "c1"]
    texts = unrelated(4)
    texts[3] += " token=abcdefabcdef1234abcd"
    docs = spark.createDataFrame(
        [(k, t, "en", "s", len(t), *range(len(extra))) for k, t in enumerate(texts)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        + ", ".join(f"{c} int" for c in extra),
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, SMALL)
        assert docs_after.columns == docs.columns
        rows = sorted(docs_after.collect())
        assert [tuple(r[5:]) for r in rows] == [tuple(range(len(extra)))] * 4
        changed = {r.doc_id for r in rows if r.text != texts[r.doc_id]}
        assert changed == ({3} if name == "secret_scans" else set())
        assert all(r.n_chars == len(r.text) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 4


@pytest.mark.parametrize("most", [1 << 20, 0])
@pytest.mark.parametrize("every", [1, 2, 3, 10])
def test_rows_survive_as_decided(spark, monkeypatch, most, every):
    monkeypatch.setattr(row_keys, "MOST_BROADCAST", most)
    df = spark.range(2000).selectExpr("id", "id * 3 as k0", "cast(null as int) as k1", "'x' as kept")
    decided = df.selectExpr("k0", "k1", f"id % {every} = 0 as kept")
    got = row_keys.surviving(df, ["k0", "k1"], decided)
    assert got.columns == ["id", "kept"]
    assert sorted(r.id for r in got.collect()) == list(range(0, 2000, every))


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) > 0
