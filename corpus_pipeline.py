"""From raw documents to packed sequences: the operators one after another.

Each stage takes what the one before it kept, and its decisions take effect.
Nulls, empty texts and repeated rows have the results that the operators'
docstrings define: a stage judges every row, and a row stays or goes by itself
but for near duplicates, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.names import null_safe
from shelfmark.llm import decontaminate, packing, quality, secrets, simhash
from shelfmark.llm.rows import surviving, with_row_keys
from shelfmark.llm.staging import staged
from shelfmark.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither a rule nor their host's verdict rejects."""
    keyed, keys = with_row_keys(docs)
    return surviving(keyed, keys, staged(quality.decisions(keyed, keys), "decided"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest doc_id, of rows that
    share it the first in the table, and of a group without ids its first row."""
    keyed, keys = with_row_keys(docs)
    file, place = keys
    printed = staged(
        keyed.select(
            F.col(file).alias("file"),
            F.col(place).alias("place"),
            F.col("doc_id").alias("id"),
            simhash.fingerprints("text").alias("fp"),
        ),
        "prints",
    )
    groups = simhash.near_duplicates(printed, "id").select(F.col("fp").alias("of"), "root")
    grouped = printed.join(groups, null_safe(printed, groups, [("fp", "of")]))
    grouped = grouped.select("file", "place", "id", F.col("root").alias("group"))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "file", "place"))
    firsts = grouped.groupBy("group").agg(first.alias("first")).select("first.file", "first.place")
    firsts = firsts.toDF("first_file", "first_place")
    decided = grouped.join(
        firsts, null_safe(grouped, firsts, [("file", "first_file"), ("place", "first_place")]), "left"
    ).select("file", "place", F.col("first_place").isNotNull().alias("kept"))
    return surviving(keyed, keys, staged(decided, "decided"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no more of the benchmark than the rule allows."""
    keyed, keys = with_row_keys(docs)
    judged = decontaminate.contamination(
        keyed.select(*keys, "text"), table(spark, sf_dir, "benchmark")
    )
    decided = judged.select(*keys, (~F.col("contaminated")).alias("kept"))
    return surviving(keyed, keys, staged(decided, "decided"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    tagger = secrets.fit_tagger(docs)
    # columns by place, so that none has the name of a result of the scan
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, n_chars = (names[docs.columns.index(c)] for c in ("text", "n_chars"))
    scanned = secrets.secret_scan(docs.toDF(*names), tagger, text)
    length = F.when(F.col("spans") == "", F.col(n_chars)).otherwise(F.length(text))
    scanned = scanned.withColumn(n_chars, length.cast(docs.schema["n_chars"].dataType))
    return scanned.select(*names).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences. Workers
    hold what the other stages left too, so fewer words are kept."""
    pieces = packing.best_fit_packing(packing.token_pieces(docs, kept_words=150_000))
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

# fingerprints, taggers, tokens and packing are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
