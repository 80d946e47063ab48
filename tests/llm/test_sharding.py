from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import sharding
from lumenlake.llm.queries import op12_sharding
from lumenlake.scratch import new_path
from tests.conftest import SF
from tests.llm.brute import rows_of


def plain_slot(doc_id, text, n_slots):
    data = (text or "").encode()
    h = 42
    for v in (doc_id, len(data) + 1, zlib.crc32(data)):
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return (h - 2**64 if h >= 2**63 else h) % n_slots


def check(rows, docs, shards, n_slots):
    """What the law, the slots and the numbering promise, for ``docs (doc_id, text)``."""
    wanted = sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_slot(i, t, n_slots)) for i, t in docs
    )
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.virtual_slot) for r in rows) == wanted
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in rows)
    home, places, load = {}, defaultdict(list), [0] * shards
    for r in rows:
        assert home.setdefault(r.virtual_slot, r.shard) == r.shard
        places[r.shard].append((r.slot, r.virtual_slot, str(r.doc_id)))
        load[r.shard] += r["size"]
    for own in places.values():
        own.sort()
        assert [p[0] for p in own] == list(range(len(own)))
        assert [p[1] for p in own] == sorted(p[1] for p in own)
    return load


def test_query(spark):
    load = check(op12_sharding(spark, SF).collect(), rows_of("documents", SF, "doc_id, text"), 16, sharding.SLOTS)
    assert max(load) - min(load) <= 0.001 * sum(load) / 16


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=200), st.integers(1, 9))
def test_edited_maps(sizes, shards):
    sizes = np.array(sizes, dtype=np.int64)
    before = sharding.even_map(len(sizes), shards)
    after = sharding.rebalanced(before, sizes, shards)
    assert after.min() >= 0 and after.max() < shards
    load = np.bincount(after, weights=sizes, minlength=shards)
    # No single slot could still move from the heaviest to the lightest shard.
    gap = load.max() - load.min()
    heavy = sizes[(after == load.argmax()) & (sizes > 0)]
    assert gap == 0 or not ((heavy < gap).any())
    more = sharding.grown(after, sizes, shards)
    assert ((more == after) | (more == shards)).all()
    assert sizes[more == shards].sum() <= sizes.sum() / (shards + 1)
    # A balanced map is left alone.
    assert (sharding.rebalanced(after, sizes, shards) == after).all()


def test_growth_takes_its_share():
    sizes = np.random.default_rng(5).integers(1, 1000, 4096)
    even = sharding.rebalanced(sharding.even_map(4096, 16), sizes, 16)
    more = sharding.grown(even, sizes, 16)
    load = np.bincount(more, weights=sizes, minlength=17)
    assert load.max() - load.min() < 0.02 * load.mean()
    assert 0.98 / 17 < sizes[more != even].sum() / sizes.sum() <= 1 / 17
    assert (more != even).mean() <= 1 / 17


def test_versions_are_edited_not_replaced(spark):
    path = new_path(spark, "map")
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(300)], "doc_id long, text string")
    first = sharding.shard_documents(docs, shards=4, n_slots=64, map_path=path).collect()
    assert {r.map_version for r in first} == {2}
    assert (sharding.load_map(spark, path, 1)[1] == sharding.even_map(64, 4)).all()
    again = sharding.shard_documents(docs, shards=4, n_slots=9, map_path=path).collect()
    assert sorted(again) == sorted(first)
    heavier = docs.unionByName(spark.createDataFrame([(1000, "y" * 900)], docs.schema))
    check(sharding.shard_documents(heavier, shards=4, map_path=path).collect(), [
        *((i, "x" * (i % 7)) for i in range(300)), (1000, "y" * 900)], 4, 64)
    before, after = sharding.load_map(spark, path, 2)[1], sharding.load_map(spark, path)
    assert after[0] == 3 and 0 < (before != after[1]).sum() < 64
    held = spark.read.parquet(f"{path}/version=3").agg(F.sum("slot_bytes"), F.sum("slot_rows")).first()
    assert tuple(held) == (300 + sum(i % 7 for i in range(300)) + 901, 301)


def test_edges(spark):
    docs = [(1, "a"), (1, "a"), (1, "a"), (1, "b"), (None, None), (None, "long " * 50_000), (2, ""), (3, "ü€")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("size", "shard", "slot", "virtual_slot", "_row", "law")})
    check(sharding.shard_documents(frame, shards=3, n_slots=8).collect(), docs, 3, 8)
    assert sharding.shard_documents(frame.limit(0)).collect() == []
