"""Shards by fixed virtual slots and a versioned map from slots to shards.

A record's virtual slot is a hash of its id, size and text checksum, modulo a
number of slots that never changes.  Bytes and rows are added up per slot, and a
table says which shard each slot belongs to.  Rebalancing edits that table only:
heavy shards give up slots, light ones take them, until the shards' bytes are near
equal; every other slot stays where it was.  Each edit is a further version in its
own folder, so earlier layouts can be read again.

The law is ``bytes``.  A slot is never split: shards are as equal as the slots
allow, which thousands of slots make a small part of a shard unless one slot (one
very long record, or rows equal in id, size and checksum) outweighs a whole shard.
Equal texts are no group here: copies have ids of their own and are dealt like
other records.

Null texts have no bytes, so their size is 1.  A null id is an id like any other.
Repeated rows fall into the same slot and are all numbered.  Within a shard rows
are numbered by virtual slot, id, checksum and size; equal rows in any order.
Empty tables give no rows.  Only the columns named are read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.common import text_or_empty
from lumenlake.operators.numbering import with_row_number
from lumenlake.scratch import new_path, store

SLOTS = 16_384
SHARDS = 16
#: Exchanges of single slots between shards after slots were moved.
MOST_EXCHANGES = 10_000

MAP_SCHEMA = "virtual_slot int, shard int, slot_bytes long, slot_rows long, version int"


def virtual_slot(n_slots: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n_slots)).cast("int")


def slotted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n_slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every row."""
    text = text_or_empty(text_column)
    sized = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sized.withColumn("virtual_slot", virtual_slot(n_slots, "doc_id", "size", "text_crc32"))


def slot_sizes(rows: DataFrame, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot; the table collected has a row per slot."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    sizes, counts = np.zeros(n_slots, np.int64), np.zeros(n_slots, np.int64)
    for r in found:
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["b"], r["n"]
    return sizes, counts


def even_map(n_slots: int, shards: int) -> np.ndarray:
    """The first version: slots dealt out in turn, whatever they hold."""
    return np.arange(n_slots) % shards


def _loads(shard_of: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    return np.bincount(shard_of, weights=sizes, minlength=shards).astype(np.int64)


def _released(shard_of: np.ndarray, sizes: np.ndarray, target: float) -> list[int]:
    """Slots that shards above ``target`` can give up without falling below it."""
    loads = _loads(shard_of, sizes, int(shard_of.max()) + 1)
    free = []
    for slot in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        shard, size = shard_of[slot], int(sizes[slot])
        if size and loads[shard] - size >= target:
            loads[shard] -= size
            free.append(slot)
    return free


def _exchange(shard_of: np.ndarray, sizes: np.ndarray, heavy: int, light: int, gap: int) -> bool:
    """Move a slot from ``heavy`` to ``light``, or swap two, so that they come closer."""
    mine, theirs = np.flatnonzero(shard_of == heavy), np.flatnonzero(shard_of == light)
    theirs = theirs[np.argsort(sizes[theirs], kind="stable")]
    # A swap with "nothing" is a plain move.
    small = np.concatenate(([0], sizes[theirs]))
    at = np.clip(np.searchsorted(small, sizes[mine] - gap / 2), 0, len(small) - 1)
    best = None
    for shift in (0, -1):
        k = np.clip(at + shift, 0, len(small) - 1)
        step = sizes[mine] - small[k]
        off = np.where((step > 0) & (step < gap), np.abs(2 * step - gap), np.iinfo(np.int64).max)
        i = int(np.argmin(off)) if len(off) else -1
        if i >= 0 and off[i] < np.iinfo(np.int64).max and (best is None or off[i] < best[0]):
            best = int(off[i]), int(mine[i]), int(k[i])
    if best is None:
        return False
    shard_of[best[1]] = light
    if best[2]:
        shard_of[theirs[best[2] - 1]] = heavy
    return True


def rebalanced(shard_of: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """An edited map whose shards hold nearly equal bytes.

    Shards above the mean give up their largest slots that fit the surplus, the
    largest of these first go to the lightest shards, and then the heaviest or the
    lightest shard exchanges single slots with another for as long as that brings
    the two closer.
    """
    edited = shard_of.copy()
    free = _released(edited, sizes, sizes.sum() / shards)
    edited[free] = shards
    loads = _loads(edited, sizes, shards + 1)[:shards]
    heap = [(int(n), shard) for shard, n in enumerate(loads)]
    heapq.heapify(heap)
    for slot in free:
        load, shard = heapq.heappop(heap)
        edited[slot] = shard
        heapq.heappush(heap, (load + int(sizes[slot]), shard))
    for _ in range(MOST_EXCHANGES):
        loads = _loads(edited, sizes, shards)
        order = np.argsort(loads, kind="stable").tolist()
        # The heaviest shard with the lightest partner that can help it, or else the lightest with the heaviest.
        pairs = [(order[-1], light) for light in order[:-1]] + [(heavy, order[0]) for heavy in order[-2:0:-1]]
        if not any(_exchange(edited, sizes, h, l, int(loads[h] - loads[l])) for h, l in pairs):
            break
    return edited


def grown(shard_of: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """An edited map with one more shard, number ``shards``, which is the only one that takes slots."""
    edited = shard_of.copy()
    target = sizes.sum() / (shards + 1)
    taken = 0
    for slot in _released(edited, sizes, target):
        if taken + int(sizes[slot]) <= target:
            edited[slot] = shards
            taken += int(sizes[slot])
    return edited


def save_map(
    spark: SparkSession, path: str, version: int, shard_of: np.ndarray, sizes: np.ndarray, counts: np.ndarray
) -> None:
    """Store a version; a version that is there already is never written over."""
    rows = [
        (slot, int(shard), int(b), int(n)) for slot, (shard, b, n) in enumerate(zip(shard_of, sizes, counts))
    ]
    schema = MAP_SCHEMA.rsplit(",", 1)[0]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, np.ndarray] | None:
    """``version`` (the newest by default) of a stored map, None if there is none.  A row per slot is collected."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == version).select("virtual_slot", "shard").collect()
    if not rows:
        return None
    shard_of = np.zeros(len(rows), np.int64)
    for r in rows:
        shard_of[r["virtual_slot"]] = r["shard"]
    return version, shard_of


def shard_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shards: int = SHARDS,
    n_slots: int = SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``.

    ``slot`` is the row's place in its shard.  With a ``map_path`` that holds a map,
    its newest version is the one edited, and its number of slots holds; else an even
    map is stored as the first version.  A version that needs no edit is used as it is.
    """
    spark = docs.sparkSession
    map_path = map_path or new_path(spark, "slot-map")
    known = load_map(spark, map_path)
    if known is not None:
        n_slots = len(known[1])
    rows = slotted(docs, id_column, text_column, n_slots).withColumn("_row", F.monotonically_increasing_id())
    rows = store(rows, "slotted")
    sizes, counts = slot_sizes(rows, n_slots)
    if known is None:
        known = 1, even_map(n_slots, shards)
        save_map(spark, map_path, 1, known[1], sizes, counts)
    version, before = known
    after = rebalanced(np.where(before < shards, before, before % shards), sizes, shards)
    if (after != before).any():
        version += 1
        save_map(spark, map_path, version, after, sizes, counts)
    # One row per slot, so this side is bounded by the fixed number of slots.
    used = spark.read.schema(MAP_SCHEMA).parquet(map_path).filter(F.col("version") == version)
    placed = rows.join(F.broadcast(used.select("virtual_slot", "shard")), "virtual_slot")
    numbered = with_row_number(placed, ["shard"], ["virtual_slot", "doc_id", "text_crc32", "size", "_row"], "place")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )
