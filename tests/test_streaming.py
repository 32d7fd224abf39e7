"""Arrivals of a stream that comes in several files, some of it late."""

import os
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import shelfmark as sm
from shelfmark.functions.periods import as_instant, as_zoneless
from shelfmark.sources.shared import shared_folder

SCHEMA = "id long, at timestamp_ntz, kind string"
NOON = datetime(2024, 5, 1, 12)
# minutes after noon, file by file; the last file reaches back three hours
FILES = [[0, 5, 61], [62, 130, 130], [-180, 3, 200]]


def events(minutes):
    return [(m, NOON + timedelta(minutes=m), "early" if m < 60 else "later") for m in minutes]


@pytest.fixture
def folder(spark, tmp_path):
    return str(tmp_path)


def add_file(spark, folder, minutes):
    spark.createDataFrame(events(minutes), SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{folder}/in"
    )


def open_stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{folder}/in")


def want(files):
    hours = Counter(
        (at.replace(minute=0), kind) for minutes in files for _, at, kind in events(minutes)
    )
    return {(at, at + timedelta(hours=1), kind, n) for (at, kind), n in hours.items()}


def run(spark, folder):
    query = sm.append_arrivals(
        open_stream(spark, folder),
        "at",
        "1 hour",
        f"{folder}/counts",
        f"{folder}/checkpoint",
        by="kind",
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return {tuple(r) for r in sm.read_arrivals(spark, f"{folder}/counts", by="kind").collect()}


def test_late_items_and_later_files_are_added(spark, folder):
    add_file(spark, folder, FILES[0])
    add_file(spark, folder, FILES[1])
    assert run(spark, folder) == want(FILES[:2])
    add_file(spark, folder, FILES[2])
    assert run(spark, folder) == want(FILES)
    # nothing new: nothing is counted twice
    assert run(spark, folder) == want(FILES)


def test_zoneless_times_pass_through_instants(spark):
    times = [datetime(2024, 3, 31, 2, 30, 1, 250_001), datetime(1899, 12, 31, 23, 59, 59, 999_999)]
    df = spark.createDataFrame([(t,) for t in times], "at timestamp_ntz")
    back = df.select(as_zoneless(as_instant(F.col("at"))))
    assert [r[0] for r in back.collect()] == times


def test_lost_commit_is_repeated_not_added(spark, folder):
    for minutes in FILES:
        add_file(spark, folder, minutes)
    assert run(spark, folder) == want(FILES)
    # as if the last batch had written its counts and died before committing
    os.replace(f"{folder}/checkpoint/commits/2", f"{folder}/lost-commit")
    hidden = f"{folder}/checkpoint/commits/.2.crc"
    if os.path.exists(hidden):
        os.replace(hidden, f"{folder}/lost-commit.crc")
    assert run(spark, folder) == want(FILES)
    assert os.path.exists(f"{folder}/checkpoint/commits/2")


def counted(spark, folder):
    return {tuple(r) for r in sm.read_arrivals(spark, f"{folder}/counts", by="kind").collect()}


def test_compaction_changes_no_total(spark, folder):
    for minutes in FILES[:2]:
        add_file(spark, folder, minutes)
    assert run(spark, folder) == want(FILES[:2])
    for _ in range(2):
        sm.compact_arrivals(spark, f"{folder}/counts", by="kind")
        assert counted(spark, folder) == want(FILES[:2])
    read = sm.read_arrivals(spark, f"{folder}/counts", by="kind").inputFiles()
    assert len({os.path.dirname(f) for f in read}) == 1
    # the last batch runs again after it was compacted, then another one comes
    os.replace(f"{folder}/checkpoint/commits/1", f"{folder}/lost-commit")
    hidden = f"{folder}/checkpoint/commits/.1.crc"
    if os.path.exists(hidden):
        os.replace(hidden, f"{folder}/lost-commit.crc")
    assert run(spark, folder) == want(FILES[:2])
    add_file(spark, folder, FILES[2])
    assert run(spark, folder) == want(FILES)
    sm.compact_arrivals(spark, f"{folder}/counts", by="kind")
    assert counted(spark, folder) == want(FILES)


def test_readers_see_committed_batches_only(spark, folder):
    add_file(spark, folder, FILES[0])
    assert run(spark, folder) == want(FILES[:1])
    open_reader = sm.read_arrivals(spark, f"{folder}/counts", by="kind")
    # a batch that died before it committed, and one under way
    torn = open_reader.limit(1)
    torn.write.parquet(f"{folder}/counts/counts/torn")
    assert counted(spark, folder) == want(FILES[:1])
    add_file(spark, folder, FILES[1])
    assert run(spark, folder) == want(FILES[:2])
    assert {tuple(r) for r in open_reader.collect()} == want(FILES[:1])


def test_a_table_without_batches_is_empty(spark, folder):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/in")
    assert run(spark, folder) == set()


# half an hour off UTC; with clock changes
@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "Europe/Berlin"])
def test_watermark_holds_back_open_windows(spark, folder, zone):
    usual = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        watermarked(spark, folder)
    finally:
        spark.conf.set("spark.sql.session.timeZone", usual)


def watermarked(spark, folder):
    for minutes in FILES[:2]:
        add_file(spark, folder, minutes)
    counts = sm.arrivals(open_stream(spark, folder), "at", "1 hour", "10 minutes", "kind")
    query = (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()}
    # watermark 14:00: the hours from 12 and 13 are closed
    assert got == {w for w in want(FILES[:2]) if w[0].hour < 14}


def test_shared_folder_follows_the_session(spark, tmp_path):
    class Session:
        def __init__(self, **settings):
            self.conf = settings

    with pytest.raises(RuntimeError):
        shared_folder(Session(**{"spark.master": "yarn"}), "x")
    named = Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})
    assert shared_folder(named, "x").startswith("hdfs:///shared/x-")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
