from __future__ import annotations

import itertools
import random

import pytest

import lumenlake.operators.near as near
from lumenlake.operators.leaders import leader_clusters
from lumenlake.operators.near import (
    Bands, _ball, best_radii, choose_bands, close_shares, fit_bands, flip_masks, near_pairs,
)
from lumenlake.scratch import store
from tests.models import leaders, signed


def hashes(seed: int, n: int, centres: int, flips: int) -> list[tuple[int, int]]:
    rnd = random.Random(seed)
    cs = [rnd.getrandbits(64) for _ in range(centres)]
    out: set[int] = set()
    while len(out) < n:
        h = cs[int(rnd.random() ** 2 * centres)]
        for _ in range(rnd.randint(0, flips)):
            h ^= 1 << rnd.randrange(64)
        out.add(signed(h))
    order = list(out)
    rnd.shuffle(order)
    return [(h, i * 3 + 1) for i, h in enumerate(order)]


def table(spark, rows):
    return store(spark.createDataFrame(rows, "h long, pos long").repartition(5), "in")


@pytest.mark.parametrize("t,options", [
    (10, {}),
    (18, {}),
    (0, {}),
    (10, {"hot_bucket": 20}),
    (10, {"hot_bucket": 20, "stage_pairs": 2000, "min_stage": 64}),
    (10, {"stage_tests": 40_000, "min_stage": 64}),
    (3, {"hot_bucket": 5}),
])
def test_same_leaders_as_sequential(spark, t, options):
    rows = hashes(7, 300, 6, 12)
    got = {r.pos: r.leader for r in leader_clusters(table(spark, rows), t, **options).collect()}
    assert got == leaders(rows, t)


@pytest.mark.parametrize("patient_rounds", [1, 100])
def test_chain_is_not_one_cluster(spark, patient_rounds):
    h, rows = 0, []
    for i in range(24):
        rows.append((signed(h), i))
        for b in range(6):
            h ^= 1 << ((i * 6 + b) % 61)
    expected = leaders(rows, 10)
    assert len(set(expected.values())) > 3
    got = leader_clusters(table(spark, rows), 10, patient_rounds=patient_rounds)
    assert {r.pos: r.leader for r in got.collect()} == expected


@pytest.mark.parametrize("block_pairs", [1, 7, 40])
def test_long_chain_in_blocks(spark, block_pairs):
    h, rows = 0, []
    for i in range(90 if block_pairs > 1 else 24):
        rows.append((signed(h), i))
        for b in range(3):
            h ^= 1 << ((i * 3 + b) % 61)
    got = leader_clusters(table(spark, rows), 4, patient_rounds=0, block_pairs=block_pairs)
    assert {r.pos: r.leader for r in got.collect()} == leaders(rows, 4)


def test_three_rows_not_transitive(spark):
    rows = [(0, 1), (0xFF, 2), (0xFFFF, 3)]
    got = leader_clusters(table(spark, rows), 10).collect()
    assert [(r.pos, r.leader) for r in got] == [(2, 1)]


def test_single_and_empty(spark):
    assert leader_clusters(table(spark, [(5, 9)]), 10).collect() == []
    empty = spark.createDataFrame([], "h long, pos long")
    assert leader_clusters(empty, 10).collect() == []


def brute(rows, t):
    out = {}
    for i, (a, p) in enumerate(rows):
        for b, q in rows[i + 1:]:
            distance = ((a ^ b) & (2 ** 64 - 1)).bit_count()
            if distance <= t:
                out[(min(p, q), max(p, q))] = distance
    return out


@pytest.mark.parametrize("m,t,hot,tests", [
    (4, 10, None, 0), (4, 10, 15, 0), (3, 7, 30, 0), (11, 10, None, 0), (11, 10, 20, 0),
    (7, 18, 25, 0), (4, 10, 15, 5e6), (4, 10, 2, 0), (5, 18, 3, 0), (3, 10, 25, 0),
])
def test_pairs_once_and_complete(spark, m, t, hot, tests):
    rows = hashes(m, 160, 4, 11)
    df = table(spark, rows)
    got = near_pairs(df, df, t, Bands(m, t, tests), same_input=True, hot_bucket=hot).collect()
    assert len(got) == len({(r.lo, r.hi) for r in got})
    assert {(r.lo, r.hi): r.distance for r in got} == brute(rows, t)


@pytest.mark.parametrize("crowded", [0, 60])
def test_cutting_and_splitting_small_buckets_adds_bounded_rows(spark, monkeypatch, crowded):
    rnd, seen = random.Random(5), []
    split = near._split_crowded

    def counted(*args):
        out = split(*args)
        seen.extend(side.count() for side in out)
        return out

    monkeypatch.setattr(near, "_split_crowded", counted)
    monkeypatch.setattr(near, "_CUT_ROWS", 0, raising=False)
    spread = {rnd.getrandbits(64) for _ in range(1000)}
    dense = {(7 << 40) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(crowded) if a < b}
    rows = [(signed(h), k) for k, h in enumerate(spread | dense)]
    df = table(spark, rows)
    got = near_pairs(df, df, 10, Bands(6, 10), same_input=True, hot_bucket=1).collect()
    assert {(r.lo, r.hi): r.distance for r in got} == brute(rows, 10) and len(got) == len(brute(rows, 10))
    # 6 rows of the index and 70 of the probe per hash; as many again cut, and all of them twice.
    assert seen[0] <= len(rows) * (6 + 70) and seen[1] <= 4 * len(rows) * 70


def test_pairs_between_two_sides(spark):
    rows = hashes(3, 160, 4, 11)
    probe, index = rows[:60], rows[60:]
    got = near_pairs(
        table(spark, index), table(spark, probe), 10, Bands(4, 10), same_input=False, hot_bucket=10
    ).collect()
    early = {p for _, p in probe}
    expected = {k for k in brute(rows, 10) if (k[0] in early) != (k[1] in early)}
    assert sorted((r.lo, r.hi) for r in got) == sorted(expected)


def test_band_plans():
    for m in range(3, 33):
        assert sum(Bands(m, 10).widths) == 64
    assert len(flip_masks(16, 2)) == 1 + 16 + 120
    assert choose_bands(1000, 1000, 10).m > choose_bands(10 ** 8, 10 ** 8, 10).m
    for n in (10 ** 7, 10 ** 8, 10 ** 9):
        for t in (4, 10, 18):
            bands = choose_bands(n, n, t)
            assert max(_ball(w, bands.inner_radius) for w in bands.widths) <= 5000


@pytest.mark.parametrize("radii,hot", [
    ((3, 4, -1, 9), None), ((18, -1, -1, -1), None), ((4, 3, 4, 4), None), ((0, 17, -1, -1), None), ((3, 4, 4, 4), 20),
    ((9, -1, 8, -1), 5),
])
def test_uneven_radii_find_the_same_pairs(spark, radii, hot):
    assert sum(r + 1 for r in radii) >= 19
    rows = hashes(5, 120, 4, 14)
    df = table(spark, rows)
    got = near_pairs(df, df, 18, Bands(4, 18, 0, radii), same_input=True, hot_bucket=hot).collect()
    assert len(got) == len({(r.lo, r.hi) for r in got})
    assert {(r.lo, r.hi): r.distance for r in got} == brute(rows, 18)


def test_best_radii_are_the_cheapest_that_suffice():
    rnd = random.Random(2)
    for _ in range(40):
        m, t = rnd.randint(1, 4), rnd.randint(0, 7)
        costs = [[0.0] + sorted(rnd.random() * 100 for _ in range(rnd.randint(3, 8))) for _ in range(m)]
        wanted = min((
            sum(own[s] for own, s in zip(costs, steps))
            for steps in itertools.product(*(range(len(own)) for own in costs)) if sum(steps) >= t + 1
        ), default=None)
        radii = best_radii(costs, t)
        assert (wanted is None) == (not radii)
        if radii:
            assert sum(r + 1 for r in radii) >= t + 1 or sum(min(r + 1, t + 1) for r in radii) >= t + 1
            assert sum(own[r + 1] for own, r in zip(costs, radii)) == pytest.approx(wanted)


def test_fitted_bands_test_fewer_candidates_on_skewed_bits(spark, monkeypatch):
    """Half of the bits are nearly constant; pairs within 18 bits, as tested and as found."""
    rnd = random.Random(8)
    rows = []
    for i in range(3000):
        h = rnd.getrandbits(32)
        for b in range(32, 64):
            h |= (rnd.random() < 0.03) << b
        rows.append((signed(h), i))
    df = table(spark, [(h, p) for h, p in dict(rows).items()])
    monkeypatch.setattr(near, "_FIT_TESTS", 0)
    n = df.count()
    plain, fitted = choose_bands(n, n, 18), fit_bands(df, n, n, 18)

    def tested(bands):
        shares = close_shares([h for h, _ in rows], bands)
        return sum(own[r] for own, r in zip(shares, bands.radii) if r >= 0) * n * n / 2

    before, after = tested(plain), tested(fitted)
    print(f"candidate tests at t=18: {before:.0f} before, {after:.0f} fitted, bands {plain.radii} and {fitted.radii}")
    assert after < 0.7 * before
    small = [r for r in rows if r[1] < 400]
    part = table(spark, small)
    got = near_pairs(part, part, 18, fitted, same_input=True, hot_bucket=None).collect()
    assert {(r.lo, r.hi): r.distance for r in got} == brute(small, 18)
