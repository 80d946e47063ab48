"""Progress records of processing runs.

A log has one row per processed file: ``(scan_id, current_file, seq, ts)``, with
``(ts, seq)`` unique within a run.  A run starts with a record for its set-up and
one for the folders it looks through, then says how many files were found, reports
on files, and ends with a record of its own that names no file.

A stream of log rows can be kept as the latest record of every run, or as all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlake.constants import PHASES, PROGRESS_EVERY
from lumenlake.functions.display import eta_seconds, format_eta, format_speed, percent, throughput
from lumenlake.operators.numbering import with_row_number
from lumenlake.operators.skew import HOT_ROWS, attach
from lumenlake.scratch import finished, remove

INITIALIZING, SCANNING, HASHING, COMPLETE = (PHASES[i] for i in (0, 1, 2, 6))
# After so many batches a feed gets a snapshot; batches before the last but one are removed.
COMPACT_EVERY = 100
NOTHING_FOUND = "No media files found"  # Fixed value: message text.

LOG_SCHEMA = "scan_id string, current_file string, seq long, ts timestamp"

PROGRESS_COLUMNS = [
    "scan_id", "step", "phase", "current", "total", "current_file", "speed", "eta_seconds",
    "percent", "speed_text", "eta_text",
]


def _seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def _paced(rows: DataFrame) -> DataFrame:
    """Add ``speed`` and ``eta_seconds`` to ``current, total, start, ts``."""
    current, total = F.col("current"), F.col("total")
    timed = rows.withColumn("speed", throughput(current, _seconds(F.col("start"), F.col("ts"))))
    return timed.withColumn("eta_seconds", eta_seconds(current, total, F.col("speed")))


def _records(rows: DataFrame) -> DataFrame:
    """Progress columns from ``scan_id, step, phase, current, total, current_file, speed, eta_seconds``."""
    return rows.select(
        "scan_id", "step", "phase", "current", "total", "current_file", "speed", "eta_seconds",
        percent(F.col("current"), F.col("total")).alias("percent"),
        F.when(F.col("speed").isNotNull(), format_speed(F.col("speed"))).alias("speed_text"),
        format_eta(F.col("eta_seconds")).alias("eta_text"),
    )


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The log that tasks append to during ``sources.files.build_catalog``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LOG_SCHEMA).json(f"{path}/files")


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """``(scan_id, total)`` of such a log; there once the files are listed."""
    return spark.read.schema("scan_id string, total long").parquet(f"{path}/totals")


def run_totals(log: DataFrame) -> DataFrame:
    """Number of files and start of every run."""
    return log.groupBy("scan_id").agg(F.count("*").alias("total"), F.min("ts").alias("start"))


def _around(totals: DataFrame) -> DataFrame:
    """The records before and after the files of ``totals (scan_id, total, folders)``."""
    def record(step, phase, current, total, text=None) -> Column:
        return F.struct(
            step.cast("long").alias("step"), F.lit(phase).alias("phase"),
            current.cast("long").alias("current"), total.cast("long").alias("total"),
            (F.lit(None) if text is None else text).cast("string").alias("current_file"),
        )

    zero, total, folders = F.lit(0), F.col("total"), F.col("folders")
    found = F.concat(F.lit("Found "), total.cast("string"), F.lit(" files"))
    records = F.when(total == 0, F.array(
        record(zero, INITIALIZING, zero, zero),
        record(F.lit(1), SCANNING, zero, folders),
        record(F.lit(2), COMPLETE, zero, zero, F.lit(NOTHING_FOUND)),
    )).otherwise(F.array(
        record(zero, INITIALIZING, zero, zero),
        record(F.lit(1), SCANNING, zero, folders),
        record(F.lit(2), SCANNING, folders, total, found),
        record(total + 3, COMPLETE, total, total),
    ))
    return totals.select("scan_id", F.inline(records)).withColumns({
        "speed": F.lit(None).cast("double"), "eta_seconds": F.lit(None).cast("long"),
    })


def progress_series(
    log: DataFrame,
    every: int = PROGRESS_EVERY,
    hot_rows: int = HOT_ROWS,
    runs: DataFrame | None = None,
) -> DataFrame:
    """All records of every run, in the order of ``step`` (WIN3).

    Files are reported after the first, every ``every``-th further and the last.
    ``runs`` is ``(scan_id, folders)``: how many folders each run looks through, one
    if not given; a run that is listed there and has no files ends at once.
    """
    totals = run_totals(log)
    placed = with_row_number(log, ["scan_id"], ["ts", "seq"], "current")
    rows = attach(placed, totals, "scan_id", "total", F.col("seq"), hot_rows=hot_rows)
    files = _reported(rows, every)
    if runs is None:
        known = totals.select("scan_id", "total", F.lit(1).alias("folders"))
    else:
        known = runs.join(totals, "scan_id", "left").select(
            "scan_id", F.coalesce("total", F.lit(0)).alias("total"), "folders"
        )
    return _records(files.unionByName(_around(known)))


def _reported(rows: DataFrame, every: int) -> DataFrame:
    """Records of the files that are reported on, from ``scan_id, current, total, start, ts, current_file``."""
    emitted = rows.filter(
        (F.pmod(F.col("current") - 1, F.lit(every)) == 0) | (F.col("current") == F.col("total"))
    )
    return _paced(emitted).select(
        "scan_id", (F.col("current") + 2).alias("step"), F.lit(HASHING).alias("phase"),
        "current", "total", "current_file", "speed", "eta_seconds",
    )


def latest_progress(log: DataFrame, totals: DataFrame) -> DataFrame:
    """Latest progress of every run (STM1), for a batch or a stream of log rows.

    One aggregate per run, combined before the shuffle; the state of a stream is
    one row per run.  ``totals`` is a batch table ``(scan_id, total)``: how many
    files each run has to do.  Once all are done, the closing record is the latest.
    """
    state = log.groupBy("scan_id").agg(
        F.count("*").alias("current"),
        F.min("ts").alias("start"),
        F.max("ts").alias("ts"),
        F.max_by("current_file", F.struct("ts", "seq")).alias("current_file"),
    )
    rows = _paced(state.join(totals.select("scan_id", "total"), "scan_id"))
    done = F.col("current") >= F.col("total")
    return _records(rows.select(
        "scan_id", (F.col("current") + F.when(done, 3).otherwise(2)).alias("step"),
        F.when(done, COMPLETE).otherwise(HASHING).alias("phase"), "current", "total",
        *[F.when(~done, F.col(c)).alias(c) for c in ("current_file", "speed", "eta_seconds")],
    ))


def stream_progress(
    log: DataFrame, totals: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY, **trigger
) -> StreamingQuery:
    """Keep ``path`` up to date with the latest progress of a streamed log.

    Each micro-batch writes the runs that changed to its own folder, so repeating
    a batch after a failure overwrites rather than adds.  Every ``compact_every``
    batches the feed is compacted.  Read it with :func:`read_feed`.  ``trigger`` is
    as for ``DataStreamWriter.trigger``.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % compact_every == 0:
            compact_feed(batch.sparkSession, path, number)

    return (
        latest_progress(log, totals).writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def read_progress(feed: DataFrame) -> DataFrame:
    """The newest record of every run in a written feed (with its ``batch``)."""
    newest = feed.groupBy("scan_id").agg(
        F.max_by(F.struct(*[c for c in PROGRESS_COLUMNS if c != "scan_id"]), "batch").alias("last")
    )
    return newest.select("scan_id", "last.*")


def _feed(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """Rows of the newest complete snapshot up to a batch, and of the batches after it."""
    limit = float("inf") if upto is None else upto
    # Listed before the snapshots: a compaction in between removes only what two snapshots hold.
    batches = [n for n in finished(spark, path, "batch") if n <= limit]
    snapshots = [n for n in finished(spark, f"{path}/_snapshots", "upto") if n <= limit]
    base = snapshots[-1] if snapshots else -1
    parts = [(f"{path}/batch={n}", F.lit(n).cast("long")) for n in batches if n > base]
    if snapshots:
        parts.append((f"{path}/_snapshots/upto={base}", F.col("batch")))
    out = None
    for folder, number in parts:
        rows = spark.read.parquet(folder).withColumn("batch", number)
        out = rows if out is None else out.unionByName(rows)
    return out


def compact_feed(spark: SparkSession, path: str, upto: int) -> None:
    """Write a snapshot of all batches up to ``upto``, from the one before it and the batches since.

    It counts once its write is committed.  What the snapshot before it has replaced is
    removed only now, so that who began to read with that one can finish.
    """
    before = [n for n in finished(spark, f"{path}/_snapshots", "upto") if n < upto]
    newest = _feed(spark, path, upto)
    if newest is None:
        return
    last = newest.groupBy("scan_id").agg(F.max_by(F.struct(*PROGRESS_COLUMNS[1:], "batch"), "batch").alias("last"))
    last.select("scan_id", "last.*").write.mode("overwrite").parquet(f"{path}/_snapshots/upto={upto}")
    if before:
        for n in finished(spark, path, "batch"):
            if n <= before[-1]:
                remove(spark, f"{path}/batch={n}")
        for n in before[:-1]:
            remove(spark, f"{path}/_snapshots/upto={n}")


def read_feed(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest record of every run, from one snapshot and the batches after it; None
    before the first batch."""
    rows = _feed(spark, path)
    return None if rows is None else read_progress(rows)


def stream_records(
    log: DataFrame,
    totals: DataFrame,
    path: str,
    checkpoint: str,
    every: int = PROGRESS_EVERY,
    hot_rows: int = HOT_ROWS,
    **trigger,
) -> StreamingQuery:
    """Append all records of a streamed log to ``path``: those of :func:`progress_series`.

    Rows of a run have to arrive in the order of ``(ts, seq)``, cut into batches anywhere.
    Per run the number of rows so far and the first time are kept as a table per batch;
    rows of a batch are numbered over the cluster from there on, so a run of any size is
    spread over tasks (the state of a keyed operator would hold it in one).  A batch that
    is repeated starts from the state before it and overwrites its own folders.  Read the
    records with :func:`read_records`.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = [n for n in finished(spark, f"{path}/state", "batch") if n < number]
        before = (
            spark.read.parquet(f"{path}/state/batch={kept[-1]}") if kept
            else spark.createDataFrame([], "scan_id string, n long, start timestamp")
        )
        fresh = batch.groupBy("scan_id").agg(F.count("*").alias("n_new"), F.min("ts").alias("first"))
        runs = before.join(fresh, "scan_id", "full").select(
            "scan_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_new", F.lit(0)).alias("n_new"),
            F.coalesce("start", "first").alias("start"),
        )
        state = f"{path}/state/batch={number}"
        runs.select("scan_id", (F.col("n") + F.col("n_new")).alias("n"), "start").write.mode("overwrite").parquet(state)
        touched = runs.filter("n_new > 0").join(totals.select("scan_id", "total"), "scan_id")
        placed = attach(
            with_row_number(batch, ["scan_id"], ["ts", "seq"], "place"), touched, "scan_id", "n_new", F.col("seq"),
            hot_rows=hot_rows,
        ).withColumn("current", F.col("n") + F.col("place"))
        after = F.col("n") + F.col("n_new")
        around = _around(touched.select("scan_id", "total", F.lit(1).alias("folders"))).join(
            touched.select("scan_id", (F.col("n") == 0).alias("_opens"), (after == F.col("total")).alias("_ends")), "scan_id"
        ).filter(F.when(F.col("step") <= 2, F.col("_opens")).otherwise(F.col("_ends"))).drop("_opens", "_ends")
        _records(_reported(placed, every).unionByName(around)).write.mode("overwrite").parquet(
            f"{path}/records/batch={number}"
        )
        for n in kept[:-1]:
            remove(spark, f"{path}/state/batch={n}")

    return (
        log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of complete batches."""
    batches = finished(spark, f"{path}/records", "batch")
    return spark.read.parquet(*[f"{path}/records/batch={n}" for n in batches]).select(*PROGRESS_COLUMNS)
