"""Phrase collocations by prefix-free parsing.

A text becomes a row of tokens: its words, lower-cased in A-Z, and a break wherever
one or more separators stand.  Wherever the hash of a window of tokens is divisible
by a fixed number, a chunk ends and the next begins; both hold the window, so chunks
overlap by it.  As triggers depend on content only, copied passages give the same
chunks in whatever text they stand.  The distinct chunks of all texts, with how often
each occurs, are the dictionary.  Phrases are counted inside distinct chunks, weighted
by that number; a phrase belongs to the chunk in which it starts before the closing
window, so that what overlaps is counted once.  The window is one word shorter than
the longest phrase, so each phrase lies whole in the chunk it belongs to.

The dictionary is dealt to blocks of a bounded size.  First each block reports the
hashes of its word pairs; sums over blocks show which pairs can be frequent (hashes
that collide only let more through).  Each block then learns which of its own pairs
these are and lists single words, those pairs, and longer phrases all of whose pairs
are among them.  No infrequent long phrase is ever written out, and no task holds
more than a block of the dictionary and its own pairs.

Null texts are empty, null languages are ``und`` and join texts that say ``und``.
Words are whatever is not a space, a tab or a separator, of any length.  Rows that
repeat a text count again; ids are not read.  Empty tables and texts without words
give no rows.  Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import large_text, text_or_empty
from lumenlake.operators.numbering import with_row_number
from lumenlake.operators.skew import attach
from lumenlake.scratch import store

LONGEST = 3
LEAST = 10
TOP = 2000
#: A longer phrase with at least this many hundredths of its part's count covers the part.
COVERED_PERCENT = 50
#: One window in so many ends a chunk.
TRIGGER = 16
#: Text parsed at a time, and dictionary text per block.
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 6 << 20
#: Blocks that a task visits one after another: a few up to this many tasks, more beyond.
#: Spark adds up the phrases of a task's blocks before it shuffles them.
FEW_BLOCKS = 4
MANY_TASKS = 1000
BLOCKS_PER_TASK = 32

BREAK = "."
_BREAKS = r"[.,;:!?\x0A-\x0D][\x20\x09.,;:!?\x0A-\x0D]*"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(_MIX[0])
    return h ^ (h >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _encoded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _tokens(texts: pa.Array, window: int) -> tuple[pa.Array, np.ndarray]:
    """Tokens of all texts in a row, and where each text's begin; a window of breaks ends each text."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), _BREAKS, f" {BREAK} ")
    breaks = [pa.scalar(BREAK, texts.type)] * window
    closed = pc.binary_join_element_wise(pc.ascii_trim_whitespace(marked), *breaks, pa.scalar(" ", texts.type))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(closed))
    return lists.flatten(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()


def parse(langs: pa.Array, texts: pa.Array, longest: int = LONGEST, trigger: int = TRIGGER) -> pa.Table:
    """``lang, chunk, n``: the distinct chunks of some texts."""
    window = longest - 1
    flat, bounds = _tokens(large_text([texts]), window)
    ids, words = _encoded(flat)
    known = _hashes(words)[ids]
    # Windows that start in the last tokens of a text would leave it; nothing starts there.
    total = len(ids)
    rolled = np.zeros(total, np.uint64)
    for k in range(window):
        rolled[: total - k] += known[k:] * np.uint64(_MIX[k % len(_MIX)] + 2 * k)
    opens = _mixed(rolled) % np.uint64(trigger) == 0
    ends = bounds[1:] - window
    for k in range(window):
        opens[ends + k] = False
    filled = ends > bounds[:-1]
    opens[bounds[:-1][filled]] = True
    starts = np.flatnonzero(opens)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    stops = np.minimum(np.append(starts[1:], total), ends[doc]) + window
    lengths = stops - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), flat.take(pa.array(take)))
    table = pa.table({"lang": langs.take(pa.array(doc)), "chunk": pc.binary_join(lists, pa.scalar(" ", flat.type))})
    counted = table.group_by(["lang", "chunk"]).aggregate([([], "count_all")])
    return counted.rename_columns(["lang", "chunk", "n"]).select(["lang", "chunk", "n"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about :data:`SLICE_BYTES` of text, a text at least."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def chunks(docs: DataFrame, lang_column: str, text_column: str, longest: int, trigger: int) -> DataFrame:
    """``lang, chunk, n`` of all texts, combined within slices of a task."""
    source = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        text_or_empty(text_column).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = parse(part.column("lang"), part.column("text"), longest, trigger)
                yield from found.cast(pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("n", pa.int64())])).to_batches(
                    max_chunksize=50_000
                )

    return source.mapInArrow(run, "lang string, chunk string, n long")


class Block:
    """Tokens of some distinct chunks, where phrases start in them and where pairs of words are."""

    def __init__(self, table: pa.Table, longest: int):
        lists = pc.split_pattern(large_text(table.column("chunk").chunks), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        self.ids, self.words = _encoded(lists.flatten())
        lengths = np.diff(bounds)
        self.chunk = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.chunk_lang, self.langs = _encoded(table.column("lang").combine_chunks())
        self.chunk_n = table.column("n").to_numpy().astype(np.int64)
        is_word = pc.not_equal(self.words, BREAK).to_numpy(zero_copy_only=False)[self.ids]
        # What starts in the closing window counts in the next chunk.
        self.own = np.ones(len(self.ids), bool)
        for k in range(1, longest):
            self.own[bounds[1:] - k] = False
        self.start = np.flatnonzero(is_word & self.own)
        paired = is_word[:-1] & is_word[1:]
        paired[bounds[1:-1] - 1] = False
        self.pairs = np.flatnonzero(paired)

    def weight(self, at: np.ndarray) -> np.ndarray:
        """How often what starts at these places is to be counted."""
        return np.where(self.own[at], self.chunk_n[self.chunk[at]], 0)

    def pair_hashes(self) -> np.ndarray:
        words, langs = _hashes(self.words), _hashes(self.langs)
        i = self.pairs
        mixed = _mixed(langs[self.chunk_lang[self.chunk[i]]] + words[self.ids[i]] * np.uint64(_MIX[1]))
        return _mixed(mixed + words[self.ids[i + 1]] * np.uint64(_MIX[2])).view(np.int64)

    def counted(self, at: np.ndarray, length: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, words and weight of the distinct phrases of ``length`` words that start at ``at``."""
        lang = self.chunk_lang[self.chunk[at]]
        group, first = lang.astype(np.int64), np.arange(len(at))
        for k in range(length):
            key = group * np.int64(len(self.words)) + self.ids[at + k]
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
        weight = np.zeros(len(first), np.int64)
        np.add.at(weight, group, self.weight(at))
        at = at[first]
        parts = [self.words.take(pa.array(self.ids[at + k])) for k in range(length)]
        phrase = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", self.words.type))
        return self.langs.take(pa.array(lang[first])), phrase, weight


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def frequent_phrases(
    docs: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    trigger: int = TRIGGER,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``lang, phrase, words, f``: every single word, and every phrase of 2 to ``longest``
    words that occurs ``least`` times in its language; ``f`` is exact for all of them."""
    total = docs.agg(F.sum(F.octet_length(text_or_empty(text_column)).cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    tasks = max(min(-(-n_blocks // FEW_BLOCKS), MANY_TASKS), n_blocks // BLOCKS_PER_TASK)
    dealt = chunks(docs, lang_column, text_column, longest, trigger).withColumn(
        "block", F.pmod(F.xxhash64("lang", "chunk"), F.lit(n_blocks)).cast("int")
    )
    # Dealt by block alone, so that adding up a chunk's copies and both visits to a block share one shuffle.
    dictionary = dealt.repartition(tasks, "block").groupBy("block", "lang", "chunk").agg(F.sum("n").alias("n"))

    def pairs(table: pa.Table) -> pa.Table:
        block = Block(table, longest)
        keys, weights = _summed(block.pair_hashes(), block.weight(block.pairs))
        number = pa.repeat(table.column("block")[0], len(keys))
        return pa.table({"block": number, "pair": keys, "n": weights})

    def phrases(table: pa.Table, known: pa.Table) -> pa.Table:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])
        if not table.num_rows:
            return schema.empty_table()
        block = Block(table, longest)
        linked = np.zeros(len(block.ids), bool)
        linked[block.pairs] = np.isin(block.pair_hashes(), known.column("pair").to_numpy())
        out, at = [], block.start
        for length in range(1, longest + 1):
            if length > 1:
                at = at[linked[at + length - 2]]
            out.append((length, block.counted(at, length)))
        return pa.concat_tables(
            pa.table({
                "lang": lang.cast(pa.string()), "phrase": phrase.cast(pa.string()),
                "words": pa.repeat(pa.scalar(length, pa.int32()), len(f)), "f": f,
            }, schema=schema)
            for length, (lang, phrase, f) in out
        )

    per_pair = Window.partitionBy("pair")
    counted = dictionary.groupBy("block").applyInArrow(pairs, "block int, pair long, n long")
    frequent = counted.withColumn("total", F.sum("n").over(per_pair)).filter(F.col("total") >= least).select("block", "pair")
    listed = dictionary.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(
        phrases, "lang string, phrase string, words int, f long"
    )
    return listed.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(
        (F.col("words") == 1) | (F.col("f") >= least)
    )


def _parts(phrases: DataFrame) -> DataFrame:
    """Every way to cut a phrase in two: ``lang, phrase, words, a, k, left, right``."""
    split = phrases.withColumn("_w", F.split("phrase", " "))
    cut = split.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    return cut.select(
        "lang", "phrase", "words", "a", "k",
        F.expr("array_join(slice(_w, 1, k), ' ')").alias("left"),
        F.expr("array_join(slice(_w, k + 1, words - k), ' ')").alias("right"),
    )


def _with_count(rows: DataFrame, frequent: DataFrame, side: str, name: str, least: int, longest: int) -> DataFrame:
    """Add the count of the phrase in column ``side``.  A phrase that occurs f times is
    the same side of at most ``f / least`` frequent phrases of each length."""
    values = frequent.select(
        F.struct("lang", F.col("phrase").alias(side)).alias("_key"), F.col("f").alias(name),
        F.expr(f"f div {least} * {longest}").alias("_uses"),
    )
    keyed = rows.withColumn("_key", F.struct("lang", side))
    return attach(keyed, values, "_key", "_uses", F.col("phrase")).drop("_key", "_uses")


def collocations(
    docs: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    covered_percent: int = COVERED_PERCENT,
    trigger: int = TRIGGER,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    The score is that of a phrase's weakest cut (the earlier one of equal cuts).
    Phrases inside a longer frequent phrase that is nearly as frequent are left out.
    Equal scores rank by count, then by the phrase's bytes.
    """
    counts = store(
        frequent_phrases(docs, lang_column, text_column, longest, least, trigger, block_bytes), "phrases"
    )
    frequent = counts.filter(F.col("f") >= least)
    phrases = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = _with_count(_parts(phrases), frequent, "left", "l", least, longest)
    cuts = _with_count(cuts, frequent, "right", "r", least, longest)
    ratio = F.expr(
        "(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)))"
        " div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    )
    scored = cuts.withColumn("score", ratio).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    inner = (
        phrases.filter("words > 2").withColumn("_w", F.split("phrase", " "))
        .withColumn("_m", F.explode(F.expr("sequence(2, words - 1)")))
        .withColumn("_i", F.explode(F.expr("sequence(1, words - _m + 1)")))
        .groupBy("lang", F.expr("array_join(slice(_w, _i, _m), ' ')").alias("phrase")).agg(F.max("a").alias("longer"))
    )
    uncovered = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered_percent)
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = with_row_number(
        uncovered.withColumns({"_s": -F.col("score"), "_a": -F.col("a")}), ["lang"], ["_s", "_a", "phrase"], "rank"
    )
    totals = counts.filter("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
