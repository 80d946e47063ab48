from __future__ import annotations

import datetime as dt
import random

import pytest

from lumenlake.scratch import finished, new_path
from lumenlake.streaming import progress

START = dt.datetime(2024, 1, 1)
SCHEMA = "scan_id string, current_file string, seq long, ts timestamp"


def log(spark, runs):
    rows = [
        (run, f"{run}-{i}", i, START + dt.timedelta(seconds=i * step))
        for run, (n, step) in runs.items() for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_series_every_tenth_and_last(spark):
    rows = progress.progress_series(log(spark, {"a": (25, 2.0), "b": (1, 1.0)})) \
        .orderBy("scan_id", "step").collect()
    assert [(r.scan_id, r.phase, r.current, r.total, r.current_file) for r in rows] == [
        ("a", "Initializing", 0, 0, None), ("a", "Scanning", 0, 1, None),
        ("a", "Scanning", 1, 25, "Found 25 files"),
        ("a", "Hashing", 1, 25, "a-0"), ("a", "Hashing", 11, 25, "a-10"),
        ("a", "Hashing", 21, 25, "a-20"), ("a", "Hashing", 25, 25, "a-24"),
        ("a", "Complete", 25, 25, None),
        ("b", "Initializing", 0, 0, None), ("b", "Scanning", 0, 1, None),
        ("b", "Scanning", 1, 1, "Found 1 files"), ("b", "Hashing", 1, 1, "b-0"),
        ("b", "Complete", 1, 1, None)]
    first, second, _, last, closing = rows[3:8]
    assert (first.speed, first.eta_seconds, first.eta_text) == (0.0, None, "--:--")
    assert second.speed == 11 / 20 and second.eta_seconds == int(14 / (11 / 20))
    assert (last.percent, last.eta_seconds) == (100, 0)
    assert (closing.speed, closing.eta_seconds, closing.speed_text, closing.percent) == (None, None, None, 100)


def test_run_without_files(spark):
    runs = spark.createDataFrame([("a", 2), ("none", 3)], "scan_id string, folders int")
    rows = progress.progress_series(log(spark, {"a": (1, 1.0)}), runs=runs).orderBy("step").collect()
    assert [(r.phase, r.current, r.total, r.current_file) for r in rows if r.scan_id == "none"] == [
        ("Initializing", 0, 0, None), ("Scanning", 0, 3, None),
        ("Complete", 0, 0, "No media files found")]
    assert [(r.current, r.total) for r in rows if r.scan_id == "a" and r.phase == "Scanning"] == [(0, 2), (2, 1)]


def test_series_splits_big_runs(spark):
    data = log(spark, {"a": (95, 1.0), "b": (12, 1.0)})
    plain = progress.progress_series(data).orderBy("scan_id", "step").collect()
    split = progress.progress_series(data, hot_rows=10).orderBy("scan_id", "step").collect()
    assert plain == split and len(plain) == 11 + 3 + 2 * 4


def test_stream_over_several_batches(spark, tmp_path):
    data = log(spark, {"a": (25, 2.0), "b": (8, 1.0)})
    source = str(tmp_path / "log")
    totals = progress.run_totals(data)
    first = data.filter("seq < 5").coalesce(1)
    first.write.parquet(source)
    feed, checkpoint = new_path(spark, "feed"), new_path(spark, "checkpoint")

    def run():
        stream = spark.readStream.schema(data.schema).parquet(source)
        query = progress.stream_progress(stream, totals, feed, checkpoint, availableNow=True)
        query.awaitTermination()
        latest = progress.read_progress(spark.read.parquet(feed)).orderBy("scan_id").collect()
        return [(r.scan_id, r.phase, r.current, r.total, r.current_file) for r in latest]

    assert run() == [("a", "Hashing", 5, 25, "a-4"), ("b", "Hashing", 5, 8, "b-4")]
    data.filter("seq >= 5 AND scan_id = 'b'").coalesce(1).write.mode("append").parquet(source)
    assert run() == [("a", "Hashing", 5, 25, "a-4"), ("b", "Complete", 8, 8, None)]


@pytest.mark.parametrize("cuts,hot", [([], 1_000_000), ([1, 9, 10, 11, 40], 1_000_000), ([30, 31], 4)])
def test_streamed_records_equal_the_series(spark, tmp_path, cuts, hot):
    """The log cut into batches anywhere; the second half comes after a restart."""
    rnd = random.Random(len(cuts))
    data = log(spark, {"a": (25, 2.0), "b": (8, 0.0), "c": (1, 1.0), "d": (41, 0.5)})
    rows = sorted(data.collect(), key=lambda r: (r.ts, r.seq, rnd.random()))
    source, path, checkpoint = str(tmp_path / "log"), new_path(spark, "records"), new_path(spark, "checkpoint")
    bounds = [0, *cuts, len(rows)]
    for low, high in zip(bounds, bounds[1:]):
        spark.createDataFrame(rows[low:high], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if high in (bounds[len(bounds) // 2], len(rows)):
            stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(source)
            progress.stream_records(
                stream, progress.run_totals(data), path, checkpoint, hot_rows=hot, availableNow=True
            ).awaitTermination()
    wanted = progress.progress_series(data).orderBy("scan_id", "step").collect()
    assert progress.read_records(spark, path).orderBy("scan_id", "step").collect() == wanted
    assert len(finished(spark, f"{path}/state", "batch")) <= 2


def test_compacted_feed(spark, tmp_path):
    data = log(spark, {"a": (12, 2.0), "b": (3, 1.0)})
    source, feed, checkpoint = str(tmp_path / "log"), new_path(spark, "feed"), new_path(spark, "checkpoint")
    totals = progress.run_totals(data)
    assert progress.read_feed(spark, feed) is None
    for k in range(12):
        data.filter(f"seq = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(source)
    progress.stream_progress(stream, totals, feed, checkpoint, compact_every=3, availableNow=True).awaitTermination()
    latest = {r.scan_id: (r.phase, r.current) for r in progress.read_feed(spark, feed).collect()}
    assert latest == {"a": ("Complete", 12), "b": ("Complete", 3)}
    # One snapshot and a bounded number of batches are left, and a compaction can be repeated.
    assert finished(spark, f"{feed}/_snapshots", "upto") == [8, 11]
    assert finished(spark, feed, "batch") == [9, 10, 11]
    progress.compact_feed(spark, feed, 11)
    # An unfinished snapshot is not read.
    (tmp_path / "x").mkdir()
    spark.read.parquet(f"{feed}/_snapshots/upto=8").limit(0).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{feed}/_snapshots/upto=14")
    assert finished(spark, f"{feed}/_snapshots", "upto") == [8, 11]
    assert {r.scan_id: (r.phase, r.current) for r in progress.read_feed(spark, feed).collect()} == latest
