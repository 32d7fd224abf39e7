"""The audit of filters against applying them one after another in every order."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from shelfmark.llm import interactions
from shelfmark.llm.sql import SQL

LONG = " ".join(f"w{k}" for k in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (None, LONG, "b"),
    (4, None, None), (5, "", ""), (6, "x " * 300, "a"), (7, "X $" * 300, "a"), (8, "ABC", None),
    (9, "", "a"), (9, None, "c"), (10, LONG.upper(), "c"), (11, LONG + " #", "c"), (12, "é ß " * 220, "c"),
    (13, "w " * 400_000, "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (None, 1, 1), (4, None, 1), (6, 1, None), (99, 1, 1)]


def fails(docs, row):
    i, text, _ = docs[row]
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    earlier = any(
        (t or "") == text and i is not None and j is not None and j < i for j, t, _ in docs
    )
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": earlier,
    }


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    verdicts = [fails(docs, row) for row in range(len(docs))]
    result = {}
    for part in {s or "" for _, _, s in docs}:
        rows = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, own in enumerate(order, 1):
                gone = [k for k in rows if k not in left]
                out = [k for k in left if verdicts[k][own]]
                left = [k for k in left if not verdicts[k][own]]
                removed_by[own] += len(out)
                result[part, "".join(order), step] = [
                    len(left), len(out), sum(verdicts[k][own] for k in gone),
                    sum(verdicts[k][own] and sum(verdicts[k].values()) == 1 for k in rows),
                    sum(docs[k][0] in good for k in out), sum(docs[k][0] in toxic for k in out), own,
                ]
        for key, row in result.items():
            if key[0] == part:
                row[-1] = removed_by[row[-1]]
    return {(*k, *v) for k, v in result.items()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    extra = "mask int, digest string, part string, id int, n int, good int"
    docs = spark.createDataFrame([(*d, 1, "d", "p", 2, 3, 4) for d in DOCS], f"doc_id bigint, text string, source string, {extra}")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_every_order(spark, tables):
    from shelfmark.llm import queries

    got = queries.op13_filter_interactions(spark, tables).collect()
    want = brute(DOCS, LABELS)
    assert len(got) == len(want) == 600 * 4 and set(map(tuple, got)) == want


def test_sql_on_odd_rows(spark, tables):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    found = con.sql(SQL["op13_filter_interactions"])
    assert set(found.fetchall()) == brute(DOCS, LABELS)


def test_counters_do_not_overflow(spark):
    most = 2**62
    n = most // 128  # 120 orders of these fit into a 64-bit sum
    rows = [("p", 31, n, most, 0), ("p", 0, n - 1, 0, 0)]
    df = spark.createDataFrame(rows, "part string, mask int, n bigint, n_good bigint, n_toxic bigint")
    got = interactions.interaction_audit(df).collect()
    assert {r.good_lost for r in got if r.step == 1} == {most}
    assert {r.kept for r in got} == {n - 1}
    assert {r.shapley for r in got} == {24 * n}


def test_empty_table(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    assert interactions.filter_interactions(docs.where("false"), labels).count() == 0
    assert interactions.filter_interactions(docs, labels.where("false")).count() == 600 * 4
