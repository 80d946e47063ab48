"""Attach per-key values to rows when some keys hold very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.numbers import div
from lumenlake.scratch import store_observed

# Rows of one key that a single task should meet.  Keys above it are split.
HOT_ROWS = 1_000_000
# Split keys are broadcast up to this many (counted); beyond it they are joined.
BROADCAST_KEYS = 10_000

_SALT = "__salt"
_PARTS = "__parts"


def attach(
    rows: DataFrame,
    values: DataFrame,
    key: str,
    count: str,
    spread: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``values``, which has one row per ``key``.

    ``count`` is the column of ``values`` with the number of rows of the key.
    ``values`` is computed once and written; while it is, the keys with more than
    ``hot_rows`` rows are counted.  Without any, this is a plain join.  Else each
    such key is split into parts: its value row is copied once per part, and its
    rows pick a part by a hash of ``spread`` (something that varies within the
    key).  ``rows`` is read and shuffled once.
    """
    hot_rows = int(hot_rows)
    values, seen = store_observed(
        values, "values", n_hot=F.count_if(F.col(count) > hot_rows)
    )
    if not seen["n_hot"]:
        return rows.join(values, key, how)
    parts = F.greatest(div(F.col(count) + (hot_rows - 1), hot_rows), F.lit(1).cast("long"))
    hot = values.filter(F.col(count) > hot_rows).select(key, parts.alias(_PARTS))
    if seen["n_hot"] <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    copies = values.withColumn(
        _SALT, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    )
    salted = rows.join(hot, key, "left").withColumn(
        _SALT,
        F.when(F.col(_PARTS).isNull(), F.lit(0).cast("long"))
        .otherwise(F.pmod(F.xxhash64(spread), F.col(_PARTS))),
    ).drop(_PARTS)
    return salted.join(copies, [key, _SALT], how).drop(_SALT)
