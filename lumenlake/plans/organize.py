"""Re-layout of a catalogue: destinations, collisions, outcomes, reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.constants import (
    DATE_FORMATS, FOLDER_NO_CAMERA, LOCATION_FOLDERS, PRESETS, PREVIEW_CONFLICTS,
    PREVIEW_FOLDERS, PREVIEW_PER_FOLDER,
)
from lumenlake.functions.classify import type_folder
from lumenlake.functions.dates import capture_day, date_folder
from lumenlake.functions.numbers import div
from lumenlake.functions.text import (
    base_name, join_path, parent_folder, sanitize_folder, type_token,
)
from lumenlake.operators.numbering import with_row_number
from lumenlake.operators.skew import HOT_ROWS, attach
from lumenlake.scratch import finished, store_counted, store_observed

MOVED, COPIED, SKIPPED, FAILED = "moved", "copied", "skipped", "failed"


def strategy_of(spec: str | dict) -> dict:
    """A strategy as ``{"type": ..., ...}``; a text names a preset (DST6).

    Both spellings of the options are understood, e.g. ``format`` and
    ``dateFormat``.
    """
    if isinstance(spec, str):
        spec = PRESETS[spec]
    other = {"dateFormat": "format", "locationGranularity": "granularity", "customPattern": "pattern"}
    return {other.get(name, name): value for name, value in spec.items()}


def expand_pattern(pattern: str) -> Column:
    """Folder pattern with its tokens filled in, one after the other (STR6).

    Date tokens need a capture date, the camera token a camera; without them
    the token stays as it is.  A value may contain a later token.
    """
    date = F.col("date_taken")
    text = F.lit(pattern)
    for token, value in [
        ("{year}", F.year(date).cast("string")),
        ("{month}", F.lpad(F.month(date).cast("string"), 2, "0")),
        ("{day}", F.lpad(F.dayofmonth(date).cast("string"), 2, "0")),
        ("{camera}", sanitize_folder(F.col("camera_model"))),
        ("{type}", type_token(F.col("extension"))),
    ]:
        text = F.replace(text, F.lit(token), F.coalesce(value, F.lit(token)))
    return text


def folder_of(strategy: str | dict, as_of: dt.date | None = None) -> Column:
    """Folder of a file under a strategy, relative to the destination (DST1-DST5)."""
    spec = strategy_of(strategy)
    kind = spec["type"]
    if kind == "byDate":
        style = spec.get("format", DATE_FORMATS[0])
        return date_folder(capture_day(F.col("date_taken"), as_of), style)
    if kind == "byCamera":
        return F.coalesce(sanitize_folder(F.col("camera_model")), F.lit(FOLDER_NO_CAMERA))
    if kind == "byType":
        return type_folder(F.col("extension"))
    if kind == "byLocation":
        return F.lit(LOCATION_FOLDERS[spec["granularity"]])
    if kind == "custom":
        return expand_pattern(spec["pattern"])
    raise ValueError(f"unknown strategy {kind!r}")


def destination_of(
    strategy: str | dict, destination: str, as_of: dt.date | None = None, strict: bool = False
) -> Column:
    """Full destination path of a file.

    A pattern that starts with a slash replaces the destination; ``strict``
    turns such a path, or one that climbs with ``..``, into an error.
    """
    relative = join_path(folder_of(strategy, as_of), F.col("file_name"))
    if strict:
        escapes = relative.startswith("/") | relative.rlike(r"(^|/)\.\.(/|$)")
        relative = F.when(
            escapes, F.raise_error(F.concat(F.lit("leaves the destination: "), relative))
        ).otherwise(relative)
    return join_path(F.lit(destination), relative)


def _operations(
    files: DataFrame, strategy: str | dict, destination: str, as_of: dt.date | None,
    extra: list[str], strict: bool,
) -> DataFrame:
    return files.select(
        "pos", "file_name", F.col("path").alias("source"),
        destination_of(strategy, destination, as_of, strict).alias("destination"), *extra,
    )


def _claims(rows: DataFrame, existing: DataFrame | None, *more: Column) -> DataFrame:
    """Per destination asked for: number of rows, first row, whether it exists.

    Aggregated before anything is joined, so a destination asked for by very
    many rows is one row here.  Destinations of a single row that do not exist
    yet are left out: nothing can go wrong there.
    """
    claims = rows.groupBy("destination").agg(
        F.count("*").alias("n_rows"), F.min("pos").alias("first_pos"), *more
    )
    if existing is None:
        return claims.filter(F.col("n_rows") > 1).withColumn("exists", F.lit(False))
    listed = existing.select("destination").distinct().withColumn("exists", F.lit(True))
    return (
        claims.join(listed, "destination", "left")
        .withColumn("exists", F.coalesce("exists", F.lit(False)))
        .filter((F.col("n_rows") > 1) | F.col("exists"))
    )


def preview(
    files: DataFrame,
    strategy: str | dict,
    destination: str,
    existing: DataFrame | None = None,
    as_of: dt.date | None = None,
    strict: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Planned operations with collisions (PLN2, WIN2, JOI3).

    A row collides when an earlier row has its destination or the destination
    exists.  The preview always says "move".
    """
    rows = _operations(files, strategy, destination, as_of, [], strict)
    claims = _claims(rows, existing)
    return attach(
        rows, claims, "destination", "n_rows", F.col("pos"), how="left", hot_rows=hot_rows
    ).select(
        "pos", "file_name", "source", "destination",
        F.lit("move").alias("operation_type"),
        F.coalesce(F.col("exists") | (F.col("pos") > F.col("first_pos")), F.lit(False))
        .alias("conflict"),
    )


def outcomes(
    files: DataFrame,
    strategy: str | dict,
    destination: str,
    existing: DataFrame | None = None,
    missing: DataFrame | None = None,
    copy: bool = False,
    as_of: dt.date | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What executing the plan would do to each file (PLN3).

    Files go in input order.  A file whose destination is taken is skipped; one
    whose source is missing fails and leaves the destination free.  So a row is
    skipped when the destination exists or an earlier row for it has a source.
    ``missing`` lists missing sources as ``(pos)``.
    """
    if missing is None:
        found = files.withColumn("has_source", F.lit(True))
    else:
        gone = missing.select("pos").distinct().withColumn("gone", F.lit(True))
        found = files.join(gone, "pos", "left").withColumn("has_source", F.col("gone").isNull())
    rows = _operations(found, strategy, destination, as_of, ["has_source"], False)
    claims = _claims(
        rows, existing, F.min(F.when(F.col("has_source"), F.col("pos"))).alias("taken_at")
    )
    state = attach(
        rows, claims, "destination", "n_rows", F.col("pos"), how="left", hot_rows=hot_rows
    )
    taken = F.coalesce(F.col("exists"), F.lit(False)) | F.coalesce(
        F.col("taken_at") < F.col("pos"), F.lit(False)
    )
    verb = "copy" if copy else "move"
    # The message texts.
    return state.select(
        "pos", "file_name",
        F.when(taken, SKIPPED).when(~F.col("has_source"), FAILED)
        .otherwise(COPIED if copy else MOVED).alias("outcome"),
        F.when(taken, F.concat(
            F.lit("Destination already exists for "), F.col("file_name"), F.lit(" - skipping")
        )).when(~F.col("has_source"), F.concat(
            F.lit(f"Failed to {verb} "), F.col("file_name"), F.lit(": source not found")
        )).alias("message"),
    )


def outcome_summary(rows: DataFrame, destination: str, task_id: str) -> DataFrame:
    """One row of counts for an executed plan (AGG10)."""
    kind = F.col("outcome")
    return rows.agg(
        F.count_if(kind == MOVED).alias("files_moved"),
        F.count_if(kind == COPIED).alias("files_copied"),
        F.count("message").alias("n_errors"),
    ).select(
        F.lit(task_id).alias("task_id"), "files_moved", "files_copied", "n_errors",
        F.lit(destination).alias("destination_path"),
    )


def error_lists(rows: DataFrame, chunk: int = 1000) -> DataFrame:
    """All messages in input order, as lists of at most ``chunk`` (ARR3)."""
    failed = rows.filter(F.col("message").isNotNull()).select("pos", "message")
    placed = with_row_number(failed, [], ["pos"], "place").withColumn(
        "chunk_no", div(F.col("place") - 1, chunk)
    )
    return placed.groupBy("chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "message"))).getField("message")
        .alias("errors")
    )


def conflict_summary(plan: DataFrame) -> DataFrame:
    """One row: files in the plan, folders, files that would overwrite (AGG11, AGG12)."""
    by_folder = plan.groupBy(parent_folder(F.col("destination")).alias("folder")).agg(
        F.count("*").alias("n_files"), F.count_if("conflict").alias("n_conflicts")
    )
    return by_folder.agg(
        F.coalesce(F.sum("n_files"), F.lit(0)).cast("long").alias("total_files"),
        F.count("*").alias("n_folders"),
        F.coalesce(F.sum("n_conflicts"), F.lit(0)).cast("long").alias("would_overwrite"),
    )


def first_conflicts(plan: DataFrame, n: int = PREVIEW_CONFLICTS) -> DataFrame:
    """The first few colliding files, and how many more there are (LIM3)."""
    conflicts, total = store_counted(plan.filter("conflict").select("pos", "file_name"), "conflicts")
    return conflicts.orderBy("pos").limit(n).withColumn(
        "n_more", F.lit(max(total - n, 0)).cast("long")
    )


def folder_counts(plan: DataFrame) -> DataFrame:
    """Operations per destination folder (AGG11)."""
    return plan.groupBy(parent_folder(F.col("destination")).alias("folder")).agg(
        F.count("*").alias("n_files"), F.min("pos").alias("first_pos")
    )


def folder_report(
    plan: DataFrame, folders: int = PREVIEW_FOLDERS, per_folder: int = PREVIEW_PER_FOLDER
) -> DataFrame:
    """First folders of a plan with their first operations (LIM2, WIN6, STR9).

    ``n_more`` is the number of operations of the folder not shown,
    ``more_folders`` the number of folders not shown.  The first operations of a
    folder are found per task before the shuffle (Spark's window group limit).
    """
    counts = folder_counts(plan)
    shown = counts.orderBy("first_pos").limit(folders)
    in_order = Window.partitionBy("folder").orderBy("pos")
    first = (
        plan.withColumn("folder", parent_folder(F.col("destination")))
        .join(F.broadcast(shown), "folder")  # at most `folders` rows
        .withColumn("place", F.row_number().over(in_order))
        .filter(F.col("place") <= per_folder)
    )
    n_folders = counts.agg(F.count("*").alias("n"))
    return first.select(
        "folder", "place", "pos",
        base_name(F.col("source")).alias("source_name"),
        base_name(F.col("destination")).alias("destination_name"),
        "n_files",
        F.greatest(F.col("n_files") - per_folder, F.lit(0)).alias("n_more"),
        F.greatest(n_folders.scalar() - folders, F.lit(0)).alias("more_folders"),
    )


def write_layout(
    files: DataFrame, strategy: str | dict, path: str, as_of: dt.date | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write catalogue rows under the folders of a strategy (SNK1).

    By-date layouts get ``year``, ``month``, ``day`` directories, all others one
    ``folder`` directory.  Rows are rebalanced by folder: small folders come from
    one task, big ones are split, and few small files result.
    """
    _write_parts(files, _parts(strategy, as_of), path, mode)


def _parts(strategy: str | dict, as_of: dt.date | None) -> dict[str, Column]:
    spec = strategy_of(strategy)
    if spec["type"] != "byDate" or spec.get("format") == "flatDate":
        return {"folder": folder_of(spec, as_of)}
    day = capture_day(F.col("date_taken"), as_of)
    parts = {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)}
    depth = {"yearMonthDay": 3, "yearMonth": 2, "yearOnly": 1}[spec.get("format", DATE_FORMATS[0])]
    return dict(list(parts.items())[:depth])


def _write_parts(files: DataFrame, parts: dict[str, Column], path: str, mode: str) -> None:
    placed = files.select("*", *[value.alias(name) for name, value in parts.items()])
    placed.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts).parquet(path)


def layout_destinations(spark: SparkSession, path: str) -> DataFrame | None:
    """``(pos, destination)`` of the rows a layout holds, None if it holds none."""
    commits = finished(spark, f"{path}/manifest", "commit")
    return spark.read.parquet(*[f"{path}/manifest/commit={n}" for n in commits]) if commits else None


def read_layout(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows a layout holds, with ``destination`` and the columns of its folders.

    Only rows of committed runs are read; what a run that failed has left is not.
    """
    commits = finished(spark, f"{path}/manifest", "commit")
    if not commits:
        return None
    return spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/commit={n}" for n in commits])


def execute_layout(
    files: DataFrame,
    strategy: str | dict,
    path: str,
    destination: str,
    missing: DataFrame | None = None,
    copy: bool = False,
    as_of: dt.date | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Carry out a plan as a layout table at ``path``; gives the :func:`outcomes`.

    Destinations that the layout holds already exist, so a run that is repeated skips
    everything and adds nothing.  A run writes its rows under a number of their own,
    then the list of their destinations; the latter's commit is what makes the run
    part of the layout.  A run that fails before that leaves the layout as it was, and
    the next one replaces what it left.  One run at a time may write to a layout.
    """
    spark = files.sparkSession
    commits = finished(spark, f"{path}/manifest", "commit")
    number = commits[-1] + 1 if commits else 1
    done = F.col("outcome").isin(MOVED, COPIED)
    result, seen = store_observed(
        outcomes(files, strategy, destination, layout_destinations(spark, path), missing, copy, as_of, hot_rows),
        "outcomes", n_done=F.count_if(done),
    )
    if seen["n_done"]:
        rows = files.join(result.filter(done).select("pos"), "pos", "left_semi").withColumn(
            "destination", destination_of(strategy, destination, as_of)
        )
        target = f"{path}/rows/commit={number}"
        _write_parts(rows, _parts(strategy, as_of), target, "overwrite")
        spark.read.parquet(target).select("pos", "destination").write.mode("overwrite").parquet(
            f"{path}/manifest/commit={number}"
        )
    return result
