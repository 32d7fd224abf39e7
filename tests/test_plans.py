"""The physical plans: what is read, how often, and what is never done."""

import re

import pytest

import __spark_entry__ as contract
import shelfmark as sm

FOLDER = "/root/testdata/sf0.001"
# scans that reading each given table once makes
SCANS = {
    name: 2 if "coverage_gap" in name or "flag_rate" in name else 1
    for name in contract.own_queries()
}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    """The plan that ran, after adaptive execution."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", list(contract.own_queries()))
def test_one_scan_and_no_cross_join(spark, name):
    plan = final(contract.queries()[name](spark, FOLDER))
    # holdings read the index once per use of it
    most = 2 if name.startswith("holdings_s") else SCANS[name]
    assert plan.count("FileScan") <= most
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", list(contract.own_queries()))
def test_only_bounded_rows_meet_in_one_task(spark, name):
    plan = physical(contract.queries()[name](spark, FOLDER))
    if name.startswith("concentration") or name in ("growth_orders_month", "growth_orders_week"):
        # the different counts; the years
        assert plan.count("SinglePartition") == 1
    else:
        assert "SinglePartition" not in plan


def test_only_the_needed_columns_are_read(spark):
    plan = final(contract.queries()["growth_lineitem_day"](spark, FOLDER))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert schema == "l_returnflag:string,l_shipdate:timestamp_ntz"
    assert "PushedFilters: [IsNotNull(l_shipdate)]" in plan


def test_texts_are_digested_before_the_shuffle(spark):
    for name in ("profile_documents", "exact_duplicates_documents", "overlap_with_documents"):
        plan = final(contract.queries()[name](spark, FOLDER))
        for exchange in re.findall(r"Exchange hashpartitioning\((.*), \d+\), ENSURE", plan):
            bare = re.sub(r"unhex\(sha2\(cast\(text#\d+ as binary\), 256\), false\)", "", exchange)
            assert "text#" not in bare


@pytest.fixture
def no_broadcast(spark):
    """As at scale: nothing is small enough, and a skewed partition is soon found."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """300,000 items; a third have the same part, another third the same content."""
    path = str(tmp_path_factory.mktemp("skewed") / "items")
    spark.range(300_000).selectExpr(
        "id",
        "if(id % 3 = 0, 7, id % 5000) as part",
        "if(id % 3 = 1, 0, id) as content",
        "1 as flag",
    ).repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def test_skewed_joins_are_split(skewed, no_broadcast):
    once = skewed.selectExpr("id as part", "flag as other_flag")
    for report in (
        sm.share(skewed, ["part", "id"], "part"),
        sm.overlap_with(skewed.withColumnRenamed("part", "p"), "id", "content", [1, 4]),
        sm.coverage_gap(skewed, once, "part", "id"),
        sm.coverage_gap(skewed, once, "part", "content", fold=False),
        sm.flag_rate(skewed, once, "part", "id", "other_flag"),
        sm.flag_rate(skewed, once, "part", "content", "other_flag", fold=False),
    ):
        assert "SortMergeJoin(skew=true)" in final(report)
