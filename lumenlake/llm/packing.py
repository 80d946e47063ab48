"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into full sequences and a
remainder.  Pieces are dealt to shards by a hash of their id; each shard is
packed by itself, longest pieces first, so a task holds a bounded number of
lengths and never a text.  The number of shards follows from the number of
pieces, which keeps a shard near :data:`SHARD_PIECES` at every size.

A piece goes to the open bin with the smallest sufficient room.  If none has
room, the length to open is the one with the least cost per token that it can
still be filled with, given the pieces that remain; in the end each bin shrinks
to the smallest permitted length that holds its contents.

The cost of a sequence is its length plus a share that grows with the square of
its length (attention), plus a fixed part.

Null texts count as empty; every document has at least its end marker, so none
is lost.  Rows that repeat an id are packed as they come, told apart by ``copy``
within their shard.  An id that would fill more than a shard by itself, null
included, is dealt out row by row.  Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import text_or_empty
from lumenlake.scratch import store_counted

LENGTHS = (1024, 2048, 4096, 8192)
SHARD_PIECES = 20_000
FIXED_COST = 16.0
#: Length at which the quadratic share of the cost equals the linear one.
QUADRATIC_AT = 65_536.0


def cost(length: int) -> float:
    return FIXED_COST + length + length * length / QUADRATIC_AT


def byte_length(text_column: str = "text") -> Column:
    """Tokens of a byte-level model: the bytes and one end marker."""
    return F.octet_length(text_or_empty(text_column)).cast("long") + 1


def pack(sizes: np.ndarray, lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each piece; ``sizes`` are in descending
    order and none exceeds the largest permitted length."""
    lengths = sorted(lengths)
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # after[k]: tokens of pieces k.. ; pieces are sorted, so those that fit a room are a suffix.
    after = np.concatenate((np.cumsum(sizes[::-1])[::-1], [0]))
    ascending = -sizes
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    for k in range(n):
        size = int(sizes[k])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            best = None
            for length in lengths:
                if length >= size:
                    left = length - size
                    first = max(k + 1, int(np.searchsorted(ascending, -left)))
                    fill = size + min(left, int(after[first]))
                    price = cost(length) / fill
                    if best is None or price < best[0]:
                        best = price, length
            room, b = best[1], len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    final = np.array(lengths)[np.searchsorted(lengths, used)] if n else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if n else final


def pieces(docs: DataFrame, id_column: str, length: Column, largest: int) -> DataFrame:
    """``doc_id, piece, n_tokens``."""
    sized = docs.select(F.col(id_column).alias("doc_id"), length.cast("long").alias("n"))
    last = F.ceil(F.col("n") / largest).cast("long") - 1
    zero = F.lit(0).cast("long")
    numbered = sized.select("doc_id", "n", F.explode(F.sequence(zero, F.greatest(last, zero))).alias("piece"))
    return numbered.select(
        "doc_id", "piece", F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("n_tokens")
    )


def best_fit_pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    length: Column | None = None,
    lengths: Sequence[int] = LENGTHS,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """``doc_id, piece, copy, shard, bin, bin_length, bin_offset, n_tokens``: where
    each piece lies.  ``length`` is the number of tokens of a row (at least one);
    by default those of a byte-level model.  A bin is one sequence, identified by
    shard and bin.
    """
    largest = max(lengths)
    cut, n = store_counted(
        pieces(docs, id_column, byte_length() if length is None else length, largest), "pieces"
    )
    shards = -(-n // shard_pieces) or 1
    id_type = cut.schema["doc_id"].dataType.simpleString()
    # Row numbers are those of the written table, so a repeated task deals alike.
    numbered = cut.withColumn("row", F.monotonically_increasing_id())
    crowded, n_crowded = store_counted(
        cut.groupBy("doc_id", "piece").count().filter(F.col("count") > shard_pieces)
        .select(F.col("doc_id").alias("id"), F.col("piece").alias("part"), F.lit(True).alias("crowded")),
        "crowded",
    )
    salt = F.lit(0).cast("long")
    if n_crowded:
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("piece") == F.col("part"))
        numbered = numbered.join(crowded, same, "left")
        salt = F.when(F.col("crowded"), F.col("row")).otherwise(salt)
    dealt = numbered.select(
        *cut.columns, F.pmod(F.xxhash64("doc_id", "piece", salt), F.lit(shards).cast("long")).alias("shard")
    )
    permitted = tuple(lengths)

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, final = pack(rows.column("n_tokens").to_numpy(), permitted)
        copies: Counter = Counter()
        copy = []
        for key in zip(rows.column("doc_id").to_pylist(), rows.column("piece").to_pylist()):
            copy.append(copies[key])
            copies[key] += 1
        return pa.table({
            "doc_id": rows.column("doc_id"), "piece": rows.column("piece"), "copy": pa.array(copy, pa.int64()),
            "shard": rows.column("shard"), "bin": bins, "bin_length": final, "bin_offset": offsets,
            "n_tokens": rows.column("n_tokens"),
        })

    return dealt.groupBy("shard").applyInArrow(
        one,
        f"doc_id {id_type}, piece long, copy long, shard long, bin long, bin_length long, "
        "bin_offset long, n_tokens long",
    )
