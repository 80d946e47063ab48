from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import search
from lumenlake.llm.queries import ORACLE, op11_search
from tests.conftest import SF
from tests.oracle import compare, connect


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            n = sum(c.values())
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1):
            rows.append((item, rank, doc, -score))
    return sorted(rows, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_and_sql(spark):
    assert compare(op11_search(spark, SF), connect(SF), ORACLE["op11_search"]) is None


def made(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "É", "x-y", "a\x00b", "日本", "Z"]
    def text(k):
        return "".join(words[int(rnd.random() ** 2 * len(words))] + rnd.choice([" ", ", ", "\n", "_"]) for _ in range(k))
    docs = [(i, text(rnd.randint(0, 60)) if rnd.random() < 0.95 else None) for i in rnd.sample(range(10 * n), n)]
    docs += docs[: n // 5] + [(i + 100_000, t) for i, t in docs[: n // 5]] + [(None, "w1 w2"), (None, "w1 w2")]
    return docs, [(k, text(rnd.randint(0, 20))) for k in range(30)] + [(3, "w1"), (None, "w2 w2"), (50, None), (51, "none")]


@pytest.mark.parametrize("options", [{}, {"top": 1}, {"top": 1000}, {"item_bytes": 300}])
@pytest.mark.parametrize("limit", [search.RANGE_BYTES, 3000, 1])
def test_same_as_plain(spark, options, limit, monkeypatch):
    if limit == 1 and options:
        pytest.skip("grids of one document: tried once")
    monkeypatch.setattr(search, "RANGE_BYTES", limit)
    docs, items = made(2, 150)
    clash = {c: F.lit("clash") for c in ("rank", "score", "_no", "term", "words")}
    got = search.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash).repartition(3),
        spark.createDataFrame(items, "item_id long, text string").withColumns(clash), **options,
    )
    assert found(got) == plain(docs, items, options.get("top", 10))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 90), st.floats(0, 1), st.integers(1, 6))
def test_treap_finds_the_best_columns(seed, n_rows, n_columns, share, top):
    rnd = np.random.default_rng(seed)
    cells = rnd.integers(1, 5, (n_rows, n_columns)) * (rnd.random((n_rows, n_columns)) < share)
    rows, columns = np.nonzero(cells)
    treap = search.Treap(rows, columns, cells[rows, columns], n_rows, n_columns)
    kept = len(treap.code)
    assert kept <= max(0, 2 * len(rows) - 1) and (not kept or treap.top[-2] == cells.max())
    asked = np.flatnonzero(rnd.random(n_rows) < 0.3)
    weights = rnd.integers(0, 4, len(asked))
    best = search.Best(top)
    best.enter([(False, c) for c in range(n_columns)])
    if len(asked):
        treap.search(asked, weights, best)
    scores = (weights[:, None] * cells[asked]).sum(axis=0)
    wanted = sorted((-int(s), (False, c)) for c, s in enumerate(scores) if s > 0)[:top]
    assert best.kept == wanted


def test_bounds_cut_off_most_documents():
    """One document holds the item; few stretches are opened to find it."""
    rnd = np.random.default_rng(1)
    cells = (rnd.random((64, 4096)) < 0.02) * rnd.integers(1, 100, (64, 4096))
    cells[:, 1234] = 100
    rows, columns = np.nonzero(cells)
    treap = search.Treap(rows, columns, cells[rows, columns], 64, 4096)
    opened = []
    below = treap.below
    treap.below = lambda at, squares, r: opened.append(len(at)) or below(at, squares, r)
    best = search.Best(1)
    best.enter([(False, c) for c in range(4096)])
    treap.search(np.arange(20), np.ones(20, np.int64), best)
    assert best.kept == [(-2000, (False, 1234))] and sum(opened) < 1200


def test_edges(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    none, some = spark.createDataFrame([], docs), spark.createDataFrame([(1, "a")], docs)
    asks = spark.createDataFrame([(1, "a b")], items)
    assert found(search.rank_documents(none, asks)) == []
    assert found(search.rank_documents(some, spark.createDataFrame([], items))) == []
    assert found(search.rank_documents(spark.createDataFrame([(1, None), (2, "., -")], docs), asks)) == []
    rows = [(1, "a " * 300_000), (2, "b" * 1_000_000 + " a"), (3, "b")]
    assert found(search.rank_documents(spark.createDataFrame(rows, docs), asks)) == plain(rows, [(1, "a b")])
