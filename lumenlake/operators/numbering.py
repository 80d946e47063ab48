"""Row numbers over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.scratch import store

_PART = "__part"
_SEQ = "__seq"
_SHIFT = "__shift"


def with_row_number(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "row_number"
) -> DataFrame:
    """Add 1, 2, 3, ... within ``groups`` in ``order``; group plus order is unique.

    A window would send a whole group to one task.  Here the rows are sorted
    over the cluster by range (a big group spans many ranges) and written; a
    second step counts the rows of each (range, group) and adds up the counts of
    the ranges before it.  That small table has at most ranges + groups rows.
    """
    ordered = (
        df.sort(*groups, *order)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_SEQ, F.monotonically_increasing_id())
    )
    written = store(ordered, "numbered")
    runs = written.groupBy(*groups, _PART).agg(
        F.count("*").alias("__n"), F.min(_SEQ).alias("__first")
    )
    before = (
        Window.partitionBy(*groups).orderBy(_PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = runs.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col(_PART).alias("__p"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias(_SHIFT),
    )
    on = F.col(_PART) == F.col("__p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return written.join(shifts, on).select(
        *df.columns, (F.col(_SEQ) + F.col(_SHIFT)).alias(name)
    )
