"""

Each query runs an operator over whole tables. ``entry`` is smoke-checked at
sf=0.001, ``queries`` are compared with ``oracle_sql`` at sf=0.01.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import shelfmark as sm  # noqa: E402
from shelfmark.sources.shared import shared_folder  # noqa: E402
from shelfmark.sources.tables import stream_table, table  # noqa: E402

# The operators for training data are a part that the library works without.
llm = None
if importlib.util.find_spec("shelfmark.llm"):
    import corpus_pipeline
    from shelfmark.llm import queries as llm

SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """What each source holds, how much of it is distinct and held there only."""
    return sm.overlap_summary(table(spark, SMOKE_DIR, "documents"), "source", "text")


# --- profile -----------------------------------------------------------------


def profile_documents(spark, d):
    return sm.profile(table(spark, d, "documents"), ["source", "lang"], "text", "n_chars")


def profile_conversations(spark, d):
    turns = table(spark, d, "conversations").withColumn("chars", F.length("text"))
    return sm.profile(turns, "role", "text", "chars")


def profile_lineitem(spark, d):
    # money as decimal: exact whatever the order of addition
    lines = table(spark, d, "lineitem").withColumn(
        "price", F.col("l_extendedprice").cast("decimal(18,2)")
    )
    return sm.profile(
        lines, ["l_returnflag", "l_linestatus"], ["l_partkey", "l_suppkey"], "price"
    ).withColumn("total", F.col("total").cast("double"))


def profile_events(spark, d):
    return sm.profile(table(spark, d, "events"), "event_type", "user_id")


# --- composition and share ---------------------------------------------------


def composition_documents(spark, d):
    return sm.composition(table(spark, d, "documents"), ["source", "lang"], "n_chars")


def composition_orders(spark, d):
    orders = table(spark, d, "orders").withColumn("o_year", F.year("o_orderdate"))
    return sm.composition(orders, ["o_year", "o_orderpriority", "o_orderstatus"])


def composition_lineitem(spark, d):
    return sm.composition(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


def share_documents(spark, d):
    return sm.share(table(spark, d, "documents"), ["source", "lang"], "source")


def share_customers(spark, d):
    return sm.share(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_nationkey")


def share_lineitem(spark, d):
    return sm.share(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], "l_suppkey")


# --- duplicates --------------------------------------------------------------


def exact_duplicates_documents(spark, d):
    return sm.exact_duplicates(table(spark, d, "documents"), "text", "doc_id")


def exact_duplicates_part(spark, d):
    return sm.exact_duplicates(table(spark, d, "part"), ["p_type", "p_size"], "p_partkey")


def exact_duplicates_lineitem(spark, d):
    return sm.exact_duplicates(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey"
    )


# --- overlap -----------------------------------------------------------------


def overlap_with_documents(spark, d):
    # one source's holdings against every other's
    return sm.overlap_with(table(spark, d, "documents"), "source", "text", ["src0"])


def overlap_with_returns(spark, d):
    # of the parts that were returned, how many are in the other states too
    return sm.overlap_with(table(spark, d, "lineitem"), "l_returnflag", "l_partkey", ["R"])


def overlap_depth_documents(spark, d):
    return sm.overlap_depth(table(spark, d, "documents"), "source", "text")


def overlap_depth_suppliers(spark, d):
    return sm.overlap_depth(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


def overlap_summary_documents(spark, d):
    return sm.overlap_summary(table(spark, d, "documents"), "source", "text")


def overlap_summary_suppliers(spark, d):
    return sm.overlap_summary(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


def holdings_summary_documents(spark, d):
    return sm.Holdings.write(table(spark, d, "documents"), "source", "text").summary()


def holdings_copies_documents(spark, d):
    return sm.Holdings.write(table(spark, d, "documents"), "source", "text").copies()


# --- coverage and flags ------------------------------------------------------


def coverage_gap_orders(spark, d):
    return sm.coverage_gap(
        table(spark, d, "orders"),
        table(spark, d, "lineitem"),
        "o_orderkey",
        ["o_orderpriority", "o_orderstatus"],
        other_on="l_orderkey",
        fold=False,
    )


def coverage_gap_documents(spark, d):
    return sm.coverage_gap(
        table(spark, d, "documents"),
        table(spark, d, "labels"),
        "doc_id",
        ["source", "lang"],
        fold=False,
    )


def coverage_gap_users(spark, d):
    # takes a user for the customer of that number: events of users without an order
    return sm.coverage_gap(
        table(spark, d, "events"),
        table(spark, d, "orders"),
        "user_id",
        "event_type",
        other_on="o_custkey",
    )


def flag_rate_orders(spark, d):
    lines = table(spark, d, "lineitem").withColumn(
        "returned", (F.col("l_returnflag") == "R").cast("int")
    )
    return sm.flag_rate(
        table(spark, d, "orders"),
        lines,
        "o_orderkey",
        "o_orderpriority",
        "returned",
        flags_on="l_orderkey",
        fold=False,
    )


def flag_rate_lineitem(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
        (F.col("o_orderstatus") == "F").cast("int").alias("finished"),
    )
    return sm.flag_rate(
        table(spark, d, "lineitem"),
        orders,
        "l_orderkey",
        "l_suppkey",
        ["urgent", "finished"],
        flags_on="o_orderkey",
    )


# --- growth ------------------------------------------------------------------


def growth_orders_month(spark, d):
    return sm.growth(table(spark, d, "orders"), "o_orderdate", "month")


def growth_lineitem_day(spark, d):
    return sm.growth(table(spark, d, "lineitem"), "l_shipdate", "day", "l_returnflag")


def growth_events_hour(spark, d):
    return sm.growth(table(spark, d, "events"), "ts", "hour", "event_type")


def growth_orders_year(spark, d):
    return sm.growth(table(spark, d, "orders"), "o_orderdate", "year", "o_orderpriority")


# --- concentration -----------------------------------------------------------


def concentration_events(spark, d):
    return sm.concentration(table(spark, d, "events"), "user_id")


def concentration_orders(spark, d):
    return sm.concentration(table(spark, d, "orders"), "o_custkey")


def concentration_lineitem(spark, d):
    return sm.concentration(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


def concentration_curve_lineitem(spark, d):
    return sm.concentration_curve(table(spark, d, "lineitem"), "l_partkey")


# --- arrivals ----------------------------------------------------------------


def arrivals_events(spark, d):
    return sm.arrivals(table(spark, d, "events"), "ts", "1 hour", by="event_type")


def arrivals_stream_events(spark, d):
    folder = shared_folder(spark, "arrivals")
    sm.append_arrivals(
        stream_table(spark, d, "events"),
        "ts",
        "6 hours",
        f"{folder}/counts",
        f"{folder}/checkpoint",
        by="event_type",
    ).awaitTermination()
    return sm.read_arrivals(spark, f"{folder}/counts", by="event_type")


def arrivals_compacted_events(spark, d):
    folder = shared_folder(spark, "arrivals")
    sm.append_arrivals(
        stream_table(spark, d, "events"), "ts", "15 minutes", f"{folder}/counts", f"{folder}/checkpoint"
    ).awaitTermination()
    sm.compact_arrivals(spark, f"{folder}/counts")
    return sm.read_arrivals(spark, f"{folder}/counts")


def arrivals_watermark_events(spark, d):
    # complete mode: every window comes out whole, the last ones too; each batch
    # rewrites the table, so the last one written is the result
    folder = shared_folder(spark, "arrivals")
    counts = sm.arrivals(stream_table(spark, d, "events"), "ts", "1 hour", "1 hour")
    query = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts"))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/counts")


# --- nulls, of which the tables have none, made of their values ---------------


def _with_nulls(spark, d):
    known = F.expr("case when source <> 'src3' then text end")
    return table(spark, d, "documents").select(
        F.expr("nullif(source, 'src5')").alias("part"),
        known.alias("text"),
        F.expr("case when lang <> 'de' then doc_id end").alias("key"),
    )


_NULL_DOCS = """SELECT nullif(source, 'src5') AS part, CASE WHEN source <> 'src3' THEN text END AS text,
                       CASE WHEN lang <> 'de' THEN doc_id END AS key FROM documents"""


def nulls_overlap_summary(spark, d):
    return sm.overlap_summary(_with_nulls(spark, d), "part", "text")


def nulls_overlap_with(spark, d):
    return sm.overlap_with(_with_nulls(spark, d), "part", "text", [None, "src0"])


def nulls_overlap_depth(spark, d):
    return sm.overlap_depth(_with_nulls(spark, d), "part", "text")


def nulls_profile(spark, d):
    return sm.profile(_with_nulls(spark, d), "part", "text")


def nulls_coverage_gap(spark, d):
    labels = table(spark, d, "labels")
    return sm.coverage_gap(_with_nulls(spark, d), labels, "key", "part", "doc_id", fold=False)


def nulls_flag_rate(spark, d):
    cost = F.expr("cast(quality + 0.12345678 as decimal(18,8))").alias("cost")
    costs = table(spark, d, "labels").select("doc_id", cost)
    rates = sm.flag_rate(_with_nulls(spark, d), costs, "key", "part", "cost", "doc_id")
    return rates.withColumn("cost", F.col("cost").cast("double"))


def holdings_depth_documents(spark, d):
    return sm.Holdings.write(table(spark, d, "documents"), "source", "text").depth()


def holdings_shared_documents(spark, d):
    held = sm.Holdings.write(table(spark, d, "documents"), "source", "text")
    return held.shared_with(["src0", "src7"])


def growth_orders_week(spark, d):
    return sm.growth(table(spark, d, "orders"), "o_orderdate", "week")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name; each takes (spark, sf_dir)."""
    if llm is None:
        return own_queries()
    return own_queries() | llm.QUERIES | {"pipeline": corpus_pipeline.run}


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of the collection reports."""
    return {
        f.__name__: f
        for f in (
            profile_documents,
            profile_conversations,
            profile_lineitem,
            profile_events,
            composition_documents,
            composition_orders,
            composition_lineitem,
            share_documents,
            share_customers,
            share_lineitem,
            exact_duplicates_documents,
            exact_duplicates_part,
            exact_duplicates_lineitem,
            overlap_with_documents,
            overlap_with_returns,
            overlap_depth_documents,
            overlap_depth_suppliers,
            overlap_summary_documents,
            overlap_summary_suppliers,
            holdings_summary_documents,
            holdings_copies_documents,
            coverage_gap_orders,
            coverage_gap_documents,
            coverage_gap_users,
            flag_rate_orders,
            flag_rate_lineitem,
            growth_orders_month,
            growth_lineitem_day,
            growth_events_hour,
            growth_orders_year,
            concentration_events,
            concentration_orders,
            concentration_lineitem,
            concentration_curve_lineitem,
            arrivals_events,
            arrivals_stream_events,
            arrivals_compacted_events,
            arrivals_watermark_events,
            nulls_overlap_summary,
            nulls_overlap_with,
            nulls_overlap_depth,
            nulls_profile,
            nulls_coverage_gap,
            nulls_flag_rate,
            holdings_depth_documents,
            holdings_shared_documents,
            growth_orders_week,
        )
    }


def _overlap_with_sql(table, part, content, anchors):
    return f"""
        WITH held AS (SELECT DISTINCT {part} AS part, {content} AS content FROM {table})
        SELECT a.part AS anchor, b.part AS other, count(*) AS n_shared
        FROM held a JOIN held b ON a.content = b.content AND a.part <> b.part
        WHERE a.part IN ({anchors})
        GROUP BY a.part, b.part"""


def _overlap_depth_sql(table, part, content):
    return f"""
        SELECT n_parts, count(*) AS n_contents, sum(copies)::bigint AS n_items
        FROM (SELECT {content}, count(DISTINCT {part}) AS n_parts, count(*) AS copies
              FROM {table} GROUP BY {content})
        GROUP BY n_parts"""


def _overlap_summary_sql(table, part, content):
    return f"""
        WITH held AS (
          SELECT {part} AS part, {content} AS content, count(*) AS copies,
                 count(*) OVER (PARTITION BY {content}) AS holders
          FROM {table} GROUP BY {part}, {content})
        SELECT part, sum(copies)::bigint AS n_items, count(*) AS n_distinct,
               count(*) FILTER (holders = 1) AS n_sole,
               coalesce(sum(copies) FILTER (holders = 1), 0)::bigint AS sole_items,
               count(*) FILTER (holders > 1) AS n_shared
        FROM held GROUP BY part"""


def _share_sql(table, group, parent):
    return f"""
        SELECT {parent}, {group}, n_items, parent_items, n_items / parent_items AS share
        FROM (SELECT {parent}, {group}, count(*) AS n_items,
                     sum(count(*)) OVER (PARTITION BY {parent})::bigint AS parent_items
              FROM {table} GROUP BY {parent}, {group})"""


def _growth_sql(table, period, by=None):
    also = f"{by}, " if by else ""
    within = f"PARTITION BY {by} " if by else ""
    return f"""
        SELECT {also}period, n_items,
               sum(n_items) OVER ({within}ORDER BY period)::bigint AS total_items
        FROM (SELECT {also}{period} AS period, count(*) AS n_items
              FROM {table} GROUP BY ALL)"""


def _concentration_sql(table, by):
    return f"""
        SELECT {by}, n_items, rank() OVER (ORDER BY n_items DESC) AS rank,
               sum(n_items) OVER (ORDER BY n_items DESC)::bigint AS cum_items
        FROM (SELECT {by}, count(*) AS n_items FROM {table} GROUP BY {by})"""


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB's SQL, for the queries that SQL can express."""
    return own_sql() if llm is None else own_sql() | llm.SQL


def own_sql() -> dict[str, str]:
    """The collection reports' results in SQL, written the plain way."""
    return {
        "profile_documents": """
            SELECT source, lang, count(*) AS n_items, count(DISTINCT text) AS n_distinct,
                   sum(n_chars)::bigint AS total
            FROM documents GROUP BY source, lang""",
        "profile_conversations": """
            SELECT role, count(*) AS n_items, count(DISTINCT text) AS n_distinct,
                   sum(length(text))::bigint AS total
            FROM conversations GROUP BY role""",
        "profile_lineitem": """
            SELECT l_returnflag, l_linestatus, count(*) AS n_items,
                   count(DISTINCT (l_partkey, l_suppkey)) AS n_distinct,
                   sum(l_extendedprice::decimal(18,2))::double AS total
            FROM lineitem GROUP BY l_returnflag, l_linestatus""",
        "profile_events": """
            SELECT event_type, count(*) AS n_items, count(DISTINCT user_id) AS n_distinct
            FROM events GROUP BY event_type""",
        "composition_documents": """
            SELECT source, lang, grouping(source, lang)::bigint AS subtotal,
                   count(*) AS n_items, sum(n_chars)::bigint AS total
            FROM documents GROUP BY CUBE (source, lang)""",
        "composition_orders": """
            SELECT o_year, o_orderpriority, o_orderstatus,
                   grouping(o_year, o_orderpriority, o_orderstatus)::bigint AS subtotal,
                   count(*) AS n_items
            FROM (SELECT *, year(o_orderdate)::int AS o_year FROM orders)
            GROUP BY CUBE (o_year, o_orderpriority, o_orderstatus)""",
        "composition_lineitem": """
            SELECT l_returnflag, l_linestatus,
                   grouping(l_returnflag, l_linestatus)::bigint AS subtotal,
                   count(*) AS n_items
            FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
        "share_documents": _share_sql("documents", "lang", "source"),
        "share_customers": _share_sql("customer", "c_mktsegment", "c_nationkey"),
        "share_lineitem": _share_sql("lineitem", "l_partkey", "l_suppkey"),
        "exact_duplicates_documents": """
            SELECT sha256(text) AS text_sha256, count(*) AS copies, min(doc_id) AS first_id
            FROM documents GROUP BY text HAVING count(*) > 1""",
        "exact_duplicates_part": """
            SELECT sha256(p_type) AS p_type_sha256, p_size, count(*) AS copies,
                   min(p_partkey) AS first_id
            FROM part GROUP BY p_type, p_size HAVING count(*) > 1""",
        "exact_duplicates_lineitem": """
            SELECT l_orderkey, l_linenumber, count(*) AS copies, min(l_partkey) AS first_id
            FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "overlap_with_documents": _overlap_with_sql("documents", "source", "text", "'src0'"),
        "overlap_with_returns": _overlap_with_sql("lineitem", "l_returnflag", "l_partkey", "'R'"),
        "overlap_depth_documents": _overlap_depth_sql("documents", "source", "text"),
        "overlap_depth_suppliers": _overlap_depth_sql("lineitem", "l_suppkey", "l_partkey"),
        "overlap_summary_documents": _overlap_summary_sql("documents", "source", "text"),
        "overlap_summary_suppliers": _overlap_summary_sql("lineitem", "l_suppkey", "l_partkey"),
        "holdings_summary_documents": _overlap_summary_sql("documents", "source", "text"),
        "holdings_copies_documents": """
            SELECT sha256(text) AS text_sha256, count(*) AS copies,
                   count(DISTINCT source) AS n_parts
            FROM documents GROUP BY text HAVING count(*) > 1""",
        "coverage_gap_orders": """
            SELECT o_orderpriority, o_orderstatus, count(*) AS n_items,
                   count(*) FILTER (NOT EXISTS (
                     SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS n_missing
            FROM orders GROUP BY o_orderpriority, o_orderstatus""",
        "coverage_gap_documents": """
            SELECT source, lang, count(*) AS n_items,
                   count(*) FILTER (l.doc_id IS NULL) AS n_missing
            FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source, lang""",
        "coverage_gap_users": """
            SELECT event_type, count(*) AS n_items,
                   count(*) FILTER (o_custkey IS NULL) AS n_missing
            FROM events LEFT JOIN (SELECT DISTINCT o_custkey FROM orders)
                 ON user_id = o_custkey
            GROUP BY event_type""",
        "flag_rate_orders": """
            SELECT o_orderpriority, count(*) AS n_flagged,
                   sum((l_returnflag = 'R')::int)::bigint AS returned
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey
            GROUP BY o_orderpriority""",
        "flag_rate_lineitem": """
            SELECT l_suppkey, count(*) AS n_flagged,
                   sum((o_orderpriority = '1-URGENT')::int)::bigint AS urgent,
                   sum((o_orderstatus = 'F')::int)::bigint AS finished
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey
            GROUP BY l_suppkey""",
        "growth_orders_month": _growth_sql("orders", "date_trunc('month', o_orderdate)::date"),
        "growth_lineitem_day": _growth_sql("lineitem", "l_shipdate::date", "l_returnflag"),
        "growth_events_hour": _growth_sql("events", "date_trunc('hour', ts)", "event_type"),
        "growth_orders_year": _growth_sql(
            "orders", "date_trunc('year', o_orderdate)::date", "o_orderpriority"
        ),
        "concentration_events": _concentration_sql("events", "user_id"),
        "concentration_orders": _concentration_sql("orders", "o_custkey"),
        "concentration_lineitem": _concentration_sql("lineitem", "l_partkey, l_suppkey"),
        "concentration_curve_lineitem": """
            SELECT n_items, n_values,
                   sum(n_values) OVER (ORDER BY n_items DESC)::bigint AS cum_values,
                   sum(n_values * n_items) OVER (ORDER BY n_items DESC)::bigint AS cum_items
            FROM (SELECT n_items, count(*) AS n_values
                  FROM (SELECT l_partkey, count(*) AS n_items FROM lineitem GROUP BY l_partkey)
                  GROUP BY n_items)""",
        "arrivals_events": """
            SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start,
                   time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
                   event_type, count(*) AS n_items
            FROM events GROUP BY ALL""",
        "arrivals_stream_events": """
            SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start,
                   time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS window_end,
                   event_type, count(*) AS n_items
            FROM events GROUP BY ALL""",
        "arrivals_compacted_events": """
            SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start,
                   time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' AS window_end,
                   count(*) AS n_items
            FROM events GROUP BY ALL""",
        "arrivals_watermark_events": """
            SELECT window_start, window_start + INTERVAL '1 hour' AS window_end,
                   count(*) AS n_items
            FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start FROM events)
            GROUP BY window_start""",
        "nulls_overlap_summary": f"""
            WITH d AS ({_NULL_DOCS}),
            held AS (SELECT part, text, count(*) AS n FROM d GROUP BY part, text),
            parts AS (SELECT text, count(*) AS holders FROM held WHERE text IS NOT NULL GROUP BY text)
            SELECT part, sum(n)::bigint AS n_items, count(held.text) AS n_distinct,
                   count(*) FILTER (holders = 1) AS n_sole,
                   coalesce(sum(n) FILTER (holders = 1), 0)::bigint AS sole_items,
                   count(*) FILTER (holders > 1) AS n_shared
            FROM held LEFT JOIN parts USING (text) GROUP BY part""",
        "nulls_overlap_with": f"""
            WITH held AS (SELECT DISTINCT part, text FROM ({_NULL_DOCS}))
            SELECT a.part AS anchor, b.part AS other, count(*) AS n_shared
            FROM held a JOIN held b ON a.text = b.text AND a.part IS DISTINCT FROM b.part
            WHERE a.part IS NULL OR a.part = 'src0' GROUP BY a.part, b.part""",
        "nulls_overlap_depth": f"""
            WITH held AS (SELECT part, text, count(*) AS n FROM ({_NULL_DOCS})
                          WHERE text IS NOT NULL GROUP BY part, text),
            per AS (SELECT text, count(*) AS n_parts, sum(n) AS n FROM held GROUP BY text)
            SELECT n_parts, count(*) AS n_contents, sum(n)::bigint AS n_items FROM per GROUP BY n_parts""",
        "nulls_profile": f"""
            SELECT part, count(*) AS n_items, count(DISTINCT text) AS n_distinct
            FROM ({_NULL_DOCS}) GROUP BY part""",
        "nulls_coverage_gap": f"""
            SELECT part, count(*) AS n_items, count(*) FILTER (l.doc_id IS NULL) AS n_missing
            FROM ({_NULL_DOCS}) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l
                 ON d.key = l.doc_id GROUP BY part""",
        "nulls_flag_rate": f"""
            SELECT part, count(*) AS n_flagged, sum(l.cost)::double AS cost
            FROM ({_NULL_DOCS}) d JOIN (SELECT doc_id, (quality + 0.12345678)::decimal(18,8) AS cost
                                        FROM labels) l ON d.key = l.doc_id GROUP BY part""",
        "holdings_depth_documents": _overlap_depth_sql("documents", "source", "text"),
        "holdings_shared_documents": _overlap_with_sql("documents", "source", "text", "'src0', 'src7'"),
        "growth_orders_week": """
            WITH w AS (SELECT date_trunc('week', o_orderdate)::date AS period, count(*) AS n_items
                       FROM orders GROUP BY ALL)
            SELECT period, n_items, sum(n_items) OVER (ORDER BY period)::bigint AS total_items FROM w""",
    }
