from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import lumenlake.operators.components as components_module
import lumenlake.operators.settle as module
from lumenlake.operators.components import components
from lumenlake.operators.leaders import _followers
from lumenlake.operators.settle import circuit_values, reduce_part, taken_rows
from lumenlake.scratch import store


def sequential(pairs):
    later = {}
    for lo, hi in sorted(pairs):
        later.setdefault(lo, []).append(hi)
    gone = set()
    for lo in sorted(later):
        if lo not in gone:
            gone.update(later[lo])
    return gone


def graph(seed, n, degree):
    rnd = random.Random(seed)
    return sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(n * degree // 2)})


def table(spark, pairs):
    return store(spark.createDataFrame(pairs, "lo long, hi long").repartition(3), "in")


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40), st.integers(1, 8), st.lists(st.integers(0, 40), max_size=4))
def test_contracted_parts_hold_the_same_circuit(seed, n, degree, cuts):
    """Parts reduced by themselves and solved together give the sequential result."""
    pairs = graph(seed, n, degree)
    rows = sorted((hi, lo, False) for lo, hi in pairs)
    bounds = [-1, *sorted(cuts), n]
    left, resolved = [], []
    for a, b in zip(bounds, bounds[1:]):
        part = [r for r in rows if a < r[0] <= b]
        for kind, v, u, neg in reduce_part(*(list(zip(*part)) or [(), (), ()]), False):
            (left if kind else resolved).append((v, u, neg))
    named = {u for _, u, _ in left + resolved if u is not None}
    left += [(v, u, not neg) for v, u, neg in resolved if v in named and (u is not None or not neg)]
    left.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    value = {v: neg for _, v, u, neg in reduce_part(*(list(zip(*left)) or [(), (), ()]), True)}
    for v, u, neg in resolved:
        value[v] = neg if u is None else value.get(u, True) != neg
    assert {v for v, leads in value.items() if not leads} == sequential(pairs)


@pytest.mark.parametrize("n,degree,block", [(300, 3, 60), (120, 12, 40), (400, 1, 3)])
def test_same_as_sequential(spark, n, degree, block):
    pairs = graph(n + degree, n, degree)
    got = [r.pos for r in taken_rows(table(spark, pairs), len(pairs), block).collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(pairs)


def test_circuit_that_does_not_shrink(spark):
    pairs = graph(5, 80, 30)
    system = store(table(spark, pairs).selectExpr("hi AS v", "lo AS u", "false AS neg"), "in")
    values = circuit_values(system, len(pairs), 150).collect()
    assert {r.v for r in values if not r.neg} == sequential(pairs)


def test_components(spark):
    pairs = graph(3, 400, 1) + [(1000, 1000 + k) for k in range(1, 60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for lo, hi in pairs:
        a, b = sorted((find(lo), find(hi)))
        root[b] = a
    for hot in (1_000_000, 7):
        got = components(table(spark, pairs), hot_rows=hot).collect()
        assert len(got) == len(root) and {r.pos: r.component for r in got} == {x: find(x) for x in root}


def counted(monkeypatch):
    """Names of the tables written by the settlement."""
    names = []
    for owner in (module, components_module):
        for name in ("store", "store_counted", "store_observed"):
            if hasattr(owner, name):
                write = getattr(owner, name)
                monkeypatch.setattr(
                    owner, name, lambda df, table, *a, _w=write, **k: names.append(table) or _w(df, table, *a, **k)
                )
    return names


def odd_rows(gone, step):
    """The links of a chain that are taken are every second one."""
    row = gone.selectExpr(
        "count(*) AS n", "count(distinct pos) AS d", f"count_if((pos div {step}) % 2 = 1) AS odd"
    ).first()
    assert row.n == row.d == row.odd == 200_000


def test_steps_do_not_grow_with_the_pairs(spark, monkeypatch):
    """One chain of 400,000 links in parts of 200,000 and of 5,000."""
    names = counted(monkeypatch)
    pairs = store(spark.range(400_000, numPartitions=8).selectExpr("id AS lo", "id + 1 AS hi"), "in")
    odd_rows(taken_rows(pairs, 400_000, 200_000), 1)
    few = list(names)
    names.clear()
    odd_rows(taken_rows(pairs, 400_000, 5_000), 1)
    assert names == few and len(few) <= 5


def test_many_chains_settle_side_by_side(spark, monkeypatch):
    """10,000 chains of 40 links each; neighbours lie further apart in the order than a part is long."""
    names = counted(monkeypatch)
    pairs = store(spark.range(390_000, numPartitions=8).selectExpr("id AS lo", "id + 10000 AS hi"), "in")
    odd_rows(taken_rows(pairs, 390_000, 5_000), 10_000)
    assert 0 < names.count("links") <= 12 and len([x for x in names if x != "links"]) <= 8


def test_rounds_then_settlement(spark):
    pairs = graph(11, 500, 4)
    for patient in (0, 2):
        got = {r.pos for r in _followers(table(spark, pairs), len(pairs), patient, 50).collect()}
        assert got == sequential(pairs)
