"""Metadata tags as rows, projected to catalogue columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import TAG_DATE, TAG_HEIGHT, TAG_MODEL, TAG_WIDTH
from lumenlake.functions.dates import parse_capture_time


def project_tags(tags: DataFrame) -> DataFrame:
    """Tag rows ``(path, tag, value)`` to one row per file (NUL2).

    Every file with a tag of whatever name has a row, if of nulls: its metadata
    could be read.  Values are turned into numbers and times before grouping,
    which leaves little text to carry.
    """
    def of(tag: str, value):
        return F.when(F.col("tag") == tag, value)

    value = F.col("value")
    return (
        tags.groupBy("path")
        .agg(
            F.max(of(TAG_DATE, parse_capture_time(value))).alias("date_taken"),
            F.max(of(TAG_WIDTH, value.try_cast("long"))).alias("width"),
            F.max(of(TAG_HEIGHT, value.try_cast("long"))).alias("height"),
            F.max(of(TAG_MODEL, value)).alias("camera_model"),
        )
    )


def with_metadata(files: DataFrame, tags: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """Fill capture date, size and camera from tags (NUL1).

    ``decoded`` is ``(path, width, height)`` from reading the picture itself.  It
    fills in a missing width or height, each on its own, but only for files whose
    metadata could be read (some tag, of any name); others keep nulls.
    """
    known = project_tags(tags)
    if decoded is not None:
        sizes = decoded.select(
            "path", F.col("width").cast("long").alias("w2"), F.col("height").cast("long").alias("h2")
        )
        known = known.join(sizes, "path", "left").select(
            "path", "date_taken", F.coalesce("width", "w2").alias("width"),
            F.coalesce("height", "h2").alias("height"), "camera_model",
        )
    filled = ["date_taken", "width", "height", "camera_model"]
    return files.drop(*filled).join(known, "path", "left").select(*files.columns)
