"""Operations on key sets and source roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_keys(df: DataFrame, key: str = "id") -> DataFrame:
    """Distinct keys (SET4)."""
    return df.select(key).distinct()


def add_keys(chosen: DataFrame, more: DataFrame) -> DataFrame:
    """Set union (SET5)."""
    return chosen.union(more.select(*chosen.columns)).distinct()


def toggle_keys(chosen: DataFrame, toggled: DataFrame) -> DataFrame:
    """Symmetric difference: keys present in exactly one of the sets (SET6).

    One grouping over both sides instead of two set differences.
    """
    key = chosen.columns[0]
    sides = chosen.select(key, F.lit(1).alias("side")).union(
        toggled.select(F.col(toggled.columns[0]), F.lit(2))
    )
    return (
        sides.groupBy(key)
        .agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        .filter(F.col("lo") == F.col("hi"))
        .select(key)
    )


def mark(files: DataFrame, keys: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Flag the rows whose key is in the set (JOI5)."""
    flags = keys.select(key).distinct().withColumn(name, F.lit(True))
    return files.join(flags, key, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )


def add_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    """Append the roots not there yet, keeping the order given by ``pos`` (SET1).

    Both inputs are ``(pos, root)``; appended roots follow the present ones.
    """
    last = roots.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    fresh = (
        more.groupBy("root").agg(F.min("pos").alias("pos"))
        .join(roots.select("root"), "root", "left_anti")
    )
    shifted = fresh.select((F.col("pos") + last.scalar() + 1).alias("pos"), "root")
    return roots.select("pos", "root").unionByName(shifted)


def remove_root(roots: DataFrame, root: str) -> DataFrame:
    """All roots but one (FIL8)."""
    return roots.filter(F.col("root") != root)


def append_batch(files: DataFrame, batch: DataFrame) -> DataFrame:
    """Bag union of two catalogue batches; nothing is removed (SET2)."""
    return files.unionByName(batch)
