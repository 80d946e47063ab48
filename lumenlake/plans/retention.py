"""Which copy to keep, what to delete, what remains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import NAME_MATCH


def keep_best(members: DataFrame) -> DataFrame:
    """The file to keep in every group, as ``(group_id, ..., best_pos)`` (WIN1).

    It comes with the groups (``Duplicates.best``); this is the same from members.
    """
    return members.groupBy("group_id", "duplicate_type", "n_files").agg(
        F.max("best_pos").alias("best_pos")
    )


def mark_best(members: DataFrame) -> DataFrame:
    """Members with ``is_best``."""
    return members.withColumn("is_best", F.col("pos") == F.col("best_pos"))


def redundant(members: DataFrame) -> DataFrame:
    """All but the best of every group (FIL7)."""
    return mark_best(members).filter(~F.col("is_best"))


def files_to_delete(members: DataFrame) -> DataFrame:
    """Distinct ``(pos, id, path, file_size)`` of redundant files; name matches are
    never deleted (PLN1).

    A file redundant in two groups is listed once (set union, not toggling).
    """
    safe = members.filter(F.col("duplicate_type") != NAME_MATCH)
    return redundant(safe).groupBy("pos").agg(
        *[F.first(c).alias(c) for c in ("id", "path", "file_size")]
    )


def deletion_plan(files: DataFrame, doomed: DataFrame) -> DataFrame:
    """Rows of the files to delete (JOI2)."""
    return files.join(doomed.select("pos"), "pos", "left_semi")


def after_deletion(files: DataFrame, doomed: DataFrame) -> DataFrame:
    """The catalogue without the deleted files (JOI4)."""
    return files.join(doomed.select("pos"), "pos", "left_anti")
