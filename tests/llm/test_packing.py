from __future__ import annotations

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import packing
from lumenlake.llm.queries import op3_packing
from tests.conftest import SF
from tests.llm.brute import rows_of


def check_bins(rows, lengths):
    bins = defaultdict(list)
    for r in rows:
        bins[(r["shard"], r["bin"])].append(r)
    for content in bins.values():
        content.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in content:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        size = content[0]["bin_length"]
        assert all(r["bin_length"] == size for r in content)
        assert size == min(x for x in lengths if x >= at)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_bins_hold_their_pieces(sizes):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    bins, offsets, final = packing.pack(sizes, (4, 8, 16))
    rows = [
        {"shard": 0, "bin": b, "bin_offset": o, "n_tokens": int(s), "bin_length": int(f)}
        for b, o, s, f in zip(bins, offsets, sizes, final)
    ]
    check_bins(rows, (4, 8, 16))


def test_best_fit_takes_the_tightest_room():
    # Rooms of 6 and 3 are open when 3 comes: it fills the tighter one.
    bins, _, final = packing.pack(np.array([13, 10, 3, 1]), (16,))
    assert bins.tolist() == [0, 1, 0, 1] and final.tolist() == [16] * 4


def test_opens_the_cheapest_length_and_shrinks():
    # A lone small piece opens the small length; many pieces share larger ones.
    assert packing.pack(np.array([100]), (128, 4096))[2].tolist() == [128]
    assert packing.pack(np.array([100] * 40), (128, 4096))[2].max() == 4096
    assert packing.pack(np.array([3000, 200]), (256, 4096))[2].tolist() == [4096, 4096]


def test_query_keeps_every_token(spark):
    rows = op3_packing(spark, SF).collect()
    check_bins(rows, packing.LENGTHS)
    total = defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    assert total == {i: len((t or "").encode()) + 1 for i, t in rows_of("documents", SF, "doc_id, text")}
    assert sum(r["n_tokens"] for r in rows) > 0.9 * sum(
        {(r["shard"], r["bin"]): r["bin_length"] for r in rows}.values()
    )


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x" * 20000), (2, "")], "doc_id long, text string")
    docs = docs.withColumn("shard", F.lit("clash"))
    rows = packing.best_fit_pack(docs, shard_pieces=2).collect()
    check_bins(rows, packing.LENGTHS)
    assert sum(r["n_tokens"] for r in rows) == 1 + 1 + 20001 + 1
    assert sorted(r["copy"] for r in rows if r["doc_id"] == 1) == [0, 1]
    assert packing.best_fit_pack(docs.limit(0)).count() == 0


def test_an_id_beyond_a_shard_is_dealt_out(spark):
    docs = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("abc").alias("text"))
    rows = packing.best_fit_pack(docs, shard_pieces=100).collect()
    check_bins(rows, packing.LENGTHS)
    assert len(rows) == 900 and len({(r["doc_id"], r["shard"], r["copy"]) for r in rows}) == 900
    shards = [r["shard"] for r in rows if r["doc_id"] is None]
    assert len(shards) == 300 and max(map(shards.count, set(shards))) < 100
