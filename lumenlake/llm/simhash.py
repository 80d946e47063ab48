"""SimHash near-duplicates by an inverted index over byte positions.

A fingerprint is seen as eight (position, byte) entries.  Two fingerprints that
differ in at most four bits share at least four entries.  The index holds
combinations of positions chosen so that any four shared positions contain one
of them (a Turan system), because single bytes have only 256 values and their
lists would grow with the square of the input.  Inside a list, shared bytes are
tallied per pair, pairs with at least four are kept, and the bits decide.

Lists report a spanning forest of their links, never all pairs: a fingerprint
already reached is not compared again.  Lists above :data:`LIST_ROWS` are dealt
out in blocks, and every pair of blocks is one group, so all pairs still meet.

Nulls count as empty texts; texts without words have fingerprint zero and link
like any other.  Ids may be null (they never name a component unless all ids in
it are null) or repeat.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import per_text, text_or_empty
from lumenlake.scratch import store, store_counted

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Bytes that must agree: at most MAX_BITS of the eight can differ.
MIN_SHARED = 8 - MAX_BITS
LIST_ROWS = 4096
#: Texts are cut at white space into pieces of about this many bytes.
PIECE = 1 << 20


def _shingles(data: bytes) -> Iterator[bytes]:
    """Shingles of the words; all words as one shingle if there are too few."""
    tail: list[bytes] = []
    at, any_full = 0, False
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = tail + data[at:end].split()
        at = end
        if len(words) >= SHINGLE:
            any_full = True
            line = b" ".join(words)
            ends = list(accumulate(map(len, words)))
            for i in range(len(words) - SHINGLE + 1):
                first = ends[i] - len(words[i]) + i
                last = ends[i + SHINGLE - 1] + i + SHINGLE - 1
                yield line[first:last]
        tail = words[max(0, len(words) - SHINGLE + 1):] if any_full else words
    if not any_full and tail:
        yield b" ".join(tail)


def fingerprint(data: bytes) -> int:
    """Unsigned 64-bit SimHash; a bit is set if more than half of the hashes have it."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []

    def tally() -> None:
        nonlocal ones, n
        rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones = ones + np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        hashes.clear()

    for shingle in _shingles(data.lower()):
        hashes.append(digest(shingle, SEED))
        if len(hashes) == PIECE:
            tally()
    if hashes:
        tally()
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint's bits as a signed long."""

    def make() -> Callable[[bytes], tuple]:
        return lambda data: (int(np.uint64(fingerprint(data)).astype(np.int64)),)

    return per_text(docs, id_column, text_or_empty(text_column).cast("binary"), "fp long", make)


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions of which any four positions contain one."""
    if width == 2:  # inside three groups
        groups = ((0, 1, 2), (3, 4, 5), (6, 7))
        return [p for g in groups for p in combinations(g, 2)]
    if width == 3:  # inside a group, or two of a group and one of the next
        groups = ((0, 1, 2), (3, 4, 5), (6, 7))
        mixed = [
            tuple(sorted((*two, one)))
            for k, g in enumerate(groups)
            for two in combinations(g, 2)
            for one in groups[(k + 1) % 3]
        ]
        return [p for g in groups for p in combinations(g, 3)] + mixed
    if width == 4:
        return list(combinations(range(8), 4))
    raise ValueError("width must be 2, 3 or 4")


def index_width(n: int) -> int:
    """Positions per entry so that lists stay short: about 16 random members at most.
    Any width finds the same links."""
    return 2 if n <= 1 << 20 else 3 if n <= 1 << 28 else 4


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected within one list."""
    links: list[tuple[int, int]] = []
    open_ = np.arange(len(fp))
    while len(open_) > 1:
        front, open_ = [int(open_[0])], open_[1:]
        while front and len(open_):
            x = front.pop()
            differ = fp[open_] ^ fp[x]
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = shared >= MIN_SHARED
            near[near] = np.bitwise_count(differ[near]) <= MAX_BITS
            if near.any():
                hit = open_[near]
                links += [(x, int(y)) for y in hit]
                front += hit.tolist()
                open_ = open_[~near]
    return links


def _links_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by list; a list may continue in the next batch."""

    def emit(keys, fp):
        cut = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        bounds = np.concatenate(([0], cut, [len(fp)]))
        a, b = [], []
        for k in np.flatnonzero(np.diff(bounds) > 1):
            members = fp[bounds[k]:bounds[k + 1]]
            for x, y in _forest(members.view(np.uint64)):
                a.append(members[x])
                b.append(members[y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in ("part", "key", "i", "j")], axis=1)
        fp = batch.column("fp").to_numpy()
        if held is not None:
            keys, fp = (np.concatenate(x) for x in zip(held, (keys, fp)))
        same = np.all(keys == keys[-1], axis=1)
        last = 0 if same.all() else len(fp) - int(np.argmin(same[::-1]))
        if last:
            yield emit(keys[:last], fp[:last])
        held = keys[last:], fp[last:]
    if held is not None:
        yield emit(*held)


def links(prints: DataFrame, width: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that span every component."""
    entry = []
    for number, positions in enumerate(position_sets(width)):
        key = F.lit(0).cast("long")
        for slot, p in enumerate(positions):
            byte = F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
            key = key.bitwiseOR(F.shiftleft(byte, 8 * slot))
        entry.append(F.struct(F.lit(number).cast("long").alias("part"), key.alias("key")))
    entries = prints.select("fp", F.explode(F.array(*entry)).alias("e")).select("e.part", "e.key", "fp")
    long = (
        entries.groupBy("part", "key").count().filter(F.col("count") > list_rows)
        .select("part", "key", F.ceil(F.col("count") / list_rows).alias("blocks"))
    )
    spread = (
        entries.join(long, ["part", "key"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    keys = ["part", "key", "i", "j"]
    dealt = spread.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_links_of_lists, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of ``edges (a, b)`` with the smallest node it reaches.

    Alternates the large-star and the small-star step until nothing changes; the
    number of rounds grows with the logarithm of the longest chain.  Each round
    is written out, so a lost executor repeats one round only.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        out = joined if small else joined.filter(F.col("v") > F.col("u"))
        moved = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if small:
            moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return moved.filter(F.col("u") != F.col("v")).distinct()

    pairs = store(
        edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )

    def signature(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = signature(pairs)
    while True:
        pairs = store(star(star(pairs, small=False), small=True), "star")
        after = signature(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int | None = None,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row."""
    found = store(fingerprints(docs, id_column, text_column), "fingerprints")
    prints, n = store_counted(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    reach = components(links(prints.select("fp"), width or index_width(n), list_rows))
    rooted = prints.join(reach, prints["fp"] == reach["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # Both sides are written tables, so a fingerprint that many rows share can be split.
    roots = store(rooted.join(named, "root").select("fp", "component_id"), "roots")
    return found.join(roots, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
