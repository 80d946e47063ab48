"""Connected components of a table of pairs.

Rounds of two contractions (Kiveris et al., SoCC 2014): every row is linked to the
smallest row it knows, first from its larger neighbours, then from its smaller ones.
Each round is written; the number of rounds grows with the logarithm of the longest
path.  Rows with very many pairs are split by :func:`skew.attach`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.skew import HOT_ROWS, attach
from lumenlake.scratch import drop_table, store_observed


def _linked(arcs: DataFrame, hot_rows: int) -> DataFrame:
    """Arcs ``(u, v)`` with ``m``, the smallest of u and its v's."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return attach(arcs, least, "u", "n", F.col("v"), hot_rows=hot_rows)


def components(pairs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(pos, component)`` of every row of ``pairs (lo, hi)``; a component is named by
    its smallest row.  ``lo < hi`` holds for every pair."""
    links, seen, before = pairs.select("lo", "hi"), None, None
    while seen is None or seen != before:
        before = seen
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        large = _linked(both, hot_rows).filter("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        small = _linked(large, hot_rows)
        small = small.filter("v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).unionByName(
            small.select(F.col("m").alias("lo"), F.col("u").alias("hi"))
        ).distinct()
        old = links
        links, seen = store_observed(
            small, "links", n=F.count(F.lit(1)), mix=F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))
        )
        if before is not None:
            drop_table(old)
    return links.select(F.col("hi").alias("pos"), F.col("lo").alias("component")).unionByName(
        links.select(F.col("lo").alias("pos"), F.col("lo").alias("component")).distinct()
    )
