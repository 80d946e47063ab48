"""Ranked lexical search on K2-treaps of the term-document grid.

Documents are taken in ranges of a bounded size.  For each range the task builds a
grid with a row per term and a column per document; a filled cell holds the impact
of the term in the document.  The grid is cut into quarters again and again down to
single cells.  Of these squares only those are kept that have two or more filled
quarters, or are a single filled cell (a compressed quadtree), each with the largest
impact inside.  Rows that no item asks for would never be visited and are left out.

For an item, the row paths of its terms go down together: a state is a stretch of
documents with, for each term, the smallest kept square around the term's row and
that stretch.  The weighted sum of the squares' maxima bounds every score in the
stretch.  States with the largest bounds are opened first, in small batches; a state
ends when its bound cannot enter the item's best list any more, and at single cells
the bound is the score.  The list is carried from range to range within a task, so
later ranges are mostly cut off near the top.  At most ``top`` rows per item leave a
task, and the rest is a ranking of those.

Counts of the corpus and of each term's documents come from a pass before that, over
all documents.  Items are taken in blocks of a bounded size, each against all documents.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with
A-Z lower-cased.  Null or empty texts have none; such documents are not counted and
such items get no rows.  Every row is a document and every row of the items an item,
also where ids repeat.  Equal scores rank by id, a null id last.  Without documents or
items there are no rows.  Only the columns named are read.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import large_text, text_or_empty

TOP = 10
#: Text of the documents of one grid, and of the items of one block.
RANGE_BYTES = 16 << 20
ITEM_BYTES = 16 << 20
#: States opened at a time.
BATCH = 48

_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text number and term number of each term occurrence, and the distinct terms."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), _GAPS, " ")
    lists = pc.split_pattern(pc.ascii_trim(spaced, " "), " ")
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    filled = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[ids]
    return text[filled], ids[filled], coded.dictionary


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers at every second place."""
    x = x.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Compressed quadtree over filled cells; each square knows its largest impact.

    ``depth`` is how often the grid was cut to get the square, ``code`` the quarters
    taken on the way (two bits each: row half, column half), ``child`` the kept square
    in each quarter or -1.  The last square is the root.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_rows: int, n_columns: int):
        self.height = h = max(1, int(max(n_rows, n_columns) - 1).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        codes, tops = [code[order].astype(np.int64)], [impacts[order].astype(np.int64)]
        n = len(order)
        depths, children = [np.full(n, h, np.int64)], [np.full((n, 4), -1, np.int32)]
        current, current_code, current_top, total = np.arange(n), codes[0], tops[0], n
        for depth in range(h - 1, -1, -1):
            if len(current) <= 1:
                break
            cell = current_code >> (2 * (h - depth))
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            size = np.diff(np.append(first, len(current)))
            several = size > 1
            if not several.any():
                continue
            number = np.cumsum(several) - 1
            run = np.repeat(np.arange(len(first)), size)
            inside = several[run]
            child = np.full((int(several.sum()), 4), -1, np.int32)
            quarter = (current_code >> (2 * (h - depth - 1))) & 3
            child[number[run[inside]], quarter[inside]] = current[inside]
            top = np.maximum.reduceat(current_top, first)
            codes.append(current_code[first][several])
            tops.append(top[several])
            depths.append(np.full(len(child), depth, np.int64))
            children.append(child)
            current = np.where(several, total + number, current[first])
            current_code, current_top = current_code[first], top
            total += len(child)
        self.code, self.top = np.concatenate(codes), np.concatenate(tops)
        self.depth, self.child = np.concatenate(depths), np.concatenate(children)
        # Square -1 is an empty one.
        self.top = np.append(self.top, 0)

    def below(self, at: np.ndarray, squares: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squares of both halves of some stretches: ``(states, terms)`` to ``(states, 2, terms)``.
        ``at`` is how deep each stretch lies, ``rows`` the terms' rows."""
        shift = (self.height - 1 - at)[:, None]
        quarter = (((rows[None, :] >> shift) & 1) << 1)[:, None, :] + np.arange(2)[None, :, None]
        node = squares[:, None, :]
        here = self.depth[node] == at[:, None, None]
        on_way = ((self.code[node] >> (2 * shift)[:, None, :]) & 3) == quarter
        next_square = np.where(here, self.child[node, quarter], np.where(on_way, node, -1))
        return np.where(node < 0, -1, next_square)

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer every column that may enter ``best`` to it, the most promising first."""
        if not len(self.code):
            return
        h = self.height
        squares = np.full((1, len(rows)), len(self.code) - 1)
        at, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int((weights * self.top[squares[0]]).sum())])
        while len(bound):
            if len(bound) > BATCH:
                chosen = np.zeros(len(bound), bool)
                chosen[np.argpartition(-bound, BATCH)[:BATCH]] = True
            else:
                chosen = np.ones(len(bound), bool)
            opened = self.below(at[chosen], squares[chosen], rows)
            opened = opened.reshape(-1, len(rows))
            new_bound = (weights[None, :] * self.top[opened]).sum(axis=1)
            new_at = np.repeat(at[chosen] + 1, 2)
            new_column = (column[chosen][:, None] * 2 + np.arange(2)[None, :]).ravel()
            single = (new_at == h) & (new_bound > 0)
            for k in np.flatnonzero(single)[np.lexsort((new_column[single], -new_bound[single]))].tolist():
                best.offer(int(new_bound[k]), int(new_column[k]))
            stay = np.flatnonzero(~chosen)
            more = np.flatnonzero(new_at < h)
            bound = np.concatenate((bound[stay], new_bound[more]))
            at = np.concatenate((at[stay], new_at[more]))
            column = np.concatenate((column[stay], new_column[more]))
            squares = np.concatenate((squares[stay], opened[more]))
            # Columns are in the order of ids: of equal scores, an earlier column comes first.
            open_ = (bound > best.floor) | ((bound == best.floor) & ((column << (h - at)) < best.before))
            if not open_.all():
                bound, at, column, squares = bound[open_], at[open_], column[open_], squares[open_]


class Best:
    """An item's best documents so far: ``kept`` has (-score, (id is null, id))."""

    def __init__(self, top: int):
        self.top, self.kept = top, []
        self.ids: list = []
        self.floor, self.before = 0, 0

    def enter(self, ids: list) -> None:
        """Columns are now those of a range with these ids, in ascending order."""
        self.ids = ids
        self._set_floor()

    def _set_floor(self) -> None:
        if len(self.kept) < self.top:
            self.floor, self.before = 0, 0
            return
        score, last = self.kept[-1]
        self.floor = -score
        low, high = 0, len(self.ids)
        while low < high:
            middle = (low + high) // 2
            if self.ids[middle] < last:
                low = middle + 1
            else:
                high = middle
        self.before = low

    def offer(self, score: int, column: int) -> None:
        entry = -score, self.ids[column]
        if len(self.kept) < self.top or entry < self.kept[-1]:
            insort(self.kept, entry)
            del self.kept[self.top:]
            self._set_floor()


def _range_parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of consecutive documents, about ``limit`` bytes of text at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(lengths[at:]), limit - size, side="right"))
            end = min(batch.num_rows, at + max(fits, 0 if held else 1))
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(lengths[at:end].sum())
            if end < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
            at = end
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(held)
    return table.column("doc_id").combine_chunks(), large_text(table.column("text").chunks)


def _statistics(source: DataFrame, terms: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each of ``terms`` the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, documents, words = np.zeros(len(terms), np.int64), 0, 0
        for _, texts in _range_parts(batches, RANGE_BYTES):
            text, ids, found = terms_of(texts)
            words += len(ids)
            documents += int((np.diff(text) > 0).sum() + 1) if len(text) else 0
            known = pc.index_in(found, terms).fill_null(-1).to_numpy(zero_copy_only=False)[ids]
            asked = known >= 0
            pairs = np.unique(text[asked] * np.int64(len(terms)) + known[asked])
            holding += np.bincount(pairs % len(terms), minlength=len(terms))
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(holding[some], documents)),
             pa.array(np.append(np.zeros(len(some), np.int64), words))], ["term", "docs", "words"],
        )

    counted = source.mapInArrow(run, "term int, docs long, words long").groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("words").alias("words")
    )
    holding, documents, words = np.zeros(len(terms), np.int64), 0, 0
    for r in counted.collect():  # a row per term of the block
        if r["term"] < 0:
            documents, words = r["docs"], r["words"]
        else:
            holding[r["term"]] = r["docs"]
    return documents, words, holding


def weight(n_documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """Impact of a term that occurs ``tf`` times in a document of ``n`` terms."""
    m = 100 - 90 + (90 * n * n_documents) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def grid(texts: pa.Array, place: np.ndarray, terms: pa.Array, n_documents: int, n_terms: int) -> Treap:
    """Treap of some documents; ``place`` is each one's column, a term's row its number."""
    text, ids, found = terms_of(texts)
    n = np.bincount(text, minlength=len(texts))
    known = pc.index_in(found, terms).fill_null(-1).to_numpy(zero_copy_only=False)[ids]
    asked = known >= 0
    cells, tf = np.unique(text[asked] * np.int64(len(terms)) + known[asked], return_counts=True)
    text, row = np.divmod(cells, len(terms))
    return Treap(row, place[text], impacts(tf, n[text], n_documents, n_terms), len(terms), len(texts))


def _search_block(source: DataFrame, items: list, top: int, id_type: str) -> DataFrame:
    """``_no, item_id, score, doc_id``: at most ``top`` rows per item and task."""
    spark = source.sparkSession
    text, ids, found = terms_of(pa.array([r["text"] for r in items], pa.large_string()))
    n_documents, n_terms, holding = _statistics(source, found)
    # Frequent terms get neighbouring rows, so that their full squares lie together.
    order = np.argsort(-holding, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    terms = found.take(pa.array(order))
    weights = np.array([weight(n_documents, int(holding[k])) for k in order], np.int64)
    wanted: dict[int, np.ndarray] = {}
    for no in range(len(items)):
        rows = np.unique(rank[ids[text == no]])
        rows = rows[holding[order[rows]] > 0]
        if len(rows):
            wanted[no] = rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {no: Best(top) for no in wanted}
        for doc_ids, texts in _range_parts(batches, RANGE_BYTES):
            by_id = pc.sort_indices(doc_ids, null_placement="at_end")
            place = np.empty(len(doc_ids), np.int64)
            place[by_id.to_numpy()] = np.arange(len(doc_ids))
            ordered = [(i is None, i) for i in doc_ids.take(by_id).to_pylist()]
            treap = grid(texts, place, terms, n_documents, n_terms)
            for no, rows in wanted.items():
                best[no].enter(ordered)
                treap.search(rows, weights[rows], best[no])
        listed = [(no, -s, key[1]) for no, b in best.items() for s, key in b.kept]
        columns = zip(*listed) if listed else ([], [], [])
        kinds = pa.int32(), pa.int64(), source_type
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], ["_no", "score", "doc_id"]
        )

    source_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    if not wanted:
        return spark.createDataFrame([], f"_no int, score long, doc_id {id_type}")
    return source.mapInArrow(run, f"_no int, score long, doc_id {id_type}")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    top: int = TOP,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a score above 0.

    Ids of documents may be whole numbers or strings.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_column].dataType.simpleString()
    item_type = items.schema[item_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    asked = items.select(F.col(item_column).alias("item_id"), text_or_empty(item_text_column).alias("text"))
    total = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // item_bytes))
    best_first = Window.partitionBy("_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    parts = []
    for block in range(n_blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        if not own:
            continue
        found = _search_block(source, own, top, id_type)
        names = spark.createDataFrame([(no, r["item_id"]) for no, r in enumerate(own)], f"_no int, item_id {item_type}")
        ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= top)
        parts.append(ranked.join(names, "_no").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
