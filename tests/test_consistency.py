"""Reports on the given tables agree with each other and with plain counts."""

import pytest
from pyspark.sql import functions as F

import shelfmark as sm
from shelfmark.sources.tables import table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def lineitem(spark):
    return table(spark, FOLDER, "lineitem")


def totals(df, *columns):
    return tuple(df.agg(*[F.sum(c) for c in columns]).first())


def test_every_item_is_in_one_group(lineitem):
    n = lineitem.count()
    assert totals(sm.profile(lineitem, "l_suppkey", "l_partkey"), "n_items") == (n,)
    assert totals(sm.concentration(lineitem, "l_partkey"), "n_items") == (n,)
    assert totals(sm.arrivals(lineitem, "l_shipdate", "7 days"), "n_items") == (n,)
    levels = sm.composition(lineitem, ["l_returnflag", "l_linestatus"])
    assert {tuple(r) for r in levels.groupBy("subtotal").agg(F.sum("n_items")).collect()} == {
        (level, n) for level in range(4)
    }


def test_running_totals_end_at_all_items(lineitem):
    n = lineitem.count()
    for unit in ("day", "month", "year"):
        assert sm.growth(lineitem, "l_shipdate", unit).agg(F.max("total_items")).first()[0] == n
    assert sm.concentration_curve(lineitem, "l_partkey").agg(F.max("cum_items")).first()[0] == n


def test_shares_of_a_parent_make_one(lineitem):
    parents = sm.share(lineitem, ["l_suppkey", "l_linestatus"], "l_suppkey").groupBy("l_suppkey")
    for row in parents.agg(F.sum("share").alias("whole")).collect():
        assert row.whole == pytest.approx(1)


def test_curve_sums_up_the_ranking(lineitem):
    ranking = sm.concentration(lineitem, "l_partkey")
    per_count = ranking.groupBy("n_items").agg(
        F.count(F.lit(1)).alias("n_values"), F.max("cum_items").alias("cum_items")
    )
    curve = sm.concentration_curve(lineitem, "l_partkey").select(per_count.columns)
    assert set(per_count.collect()) == set(curve.collect())


def test_overlap_reports_agree(documents):
    summary = sm.overlap_summary(documents, "source", "text")
    depth = {r.n_parts: r for r in sm.overlap_depth(documents, "source", "text").collect()}
    n_items, n_distinct, n_sole, sole_items, n_shared = totals(
        summary, "n_items", "n_distinct", "n_sole", "sole_items", "n_shared"
    )
    assert n_items == documents.count() == sum(r.n_items for r in depth.values())
    assert n_distinct == sum(r.n_parts * r.n_contents for r in depth.values())
    assert (n_sole, sole_items) == (depth[1].n_contents, depth[1].n_items)
    assert n_shared == n_distinct - n_sole

    distinct = {r.source: r.n_distinct for r in sm.profile(documents, "source", "text").collect()}
    assert distinct == {r.part: r.n_distinct for r in summary.collect()}

    repeated = sm.exact_duplicates(documents, "text", "doc_id")
    copies = totals(repeated, F.col("copies") - 1)[0]
    assert documents.count() - documents.select("text").distinct().count() == copies
    held = sm.Holdings.write(documents, "source", "text").copies()
    columns = ["text_sha256", "copies"]
    assert set(held.select(columns).collect()) == set(repeated.select(columns).collect())


def test_overlap_is_symmetric(documents):
    shared = {
        (r.anchor, r.other): r.n_shared
        for r in sm.overlap_with(documents, "source", "text", ["src0", "src7"]).collect()
    }
    assert shared.get(("src0", "src7")) == shared.get(("src7", "src0"))


def test_missing_and_flagged_items_make_all(spark, documents):
    labels = table(spark, FOLDER, "labels").withColumn("one", F.lit(1))
    gap = sm.coverage_gap(documents, labels, "doc_id", "lang")
    found = sm.flag_rate(documents, labels, "doc_id", "lang", "one")
    n_items, n_missing = totals(gap, "n_items", "n_missing")
    n_flagged, ones = totals(found, "n_flagged", "one")
    assert n_items == documents.count() == n_missing + n_flagged
    assert ones == n_flagged == labels.count()
