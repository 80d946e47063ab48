"""Who is taken, for pairs that the parallel rounds left open (ITR1).

A row leads unless one of its earlier neighbours leads: it is the NOR of them, and
the pairs are a circuit in the order of the rows.  It is settled in three ways:

* The order is cut into parts that are contracted side by side.  Walking a part, a
  row whose open neighbours come down to one row outside is that row or its opposite;
  one that has a leader among its neighbours, or both a row and its opposite, is
  taken.  Only rows that depend on two or more others remain, and the rows that parts
  refer to.  This is repeated until one block holds what is left; the results are
  then handed down again.  A chain comes down to one row per part.
* What does not shrink this way, such as many chains whose links lie far apart in the
  order, is split into its components.  Those that fit into a block are dealt to
  tasks, many small ones together, and each is walked in order.
* Larger components that do not shrink are settled block after block in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.components import components
from lumenlake.operators.skew import attach
from lumenlake.scratch import store, store_counted, store_observed

#: A contraction has to leave at most this share of the rows to be worth repeating.
SHRINKS = 0.5

_RESOLVED, _GATE = 0, 1
# v, in terms of u: u or its opposite (neg); without u, neg is the value itself.
_OUT = "kind int, v long, u long, neg boolean"
_ARROW_OUT = pa.schema([("kind", pa.int32()), ("v", pa.int64()), ("u", pa.int64()), ("neg", pa.bool_())])


def reduce_part(vs: Sequence[int], us: Sequence[int | None], negs: Sequence[bool], whole: bool) -> list[tuple]:
    """Walk rows ``v = NOR of (u xor neg)``, sorted by v; ``u < v``.

    With ``whole`` nothing outside is open: a row without inputs of its own leads.
    Gives ``(kind, v, u, neg)``: resolved rows, or the inputs of rows that stay.
    """
    value: dict[int, tuple[int | None, bool]] = {}
    out: list[tuple] = []
    k, n = 0, len(vs)
    while k < n:
        v, inputs, taken = vs[k], {}, False
        while k < n and vs[k] == v:
            u, neg = us[k], negs[k]
            k += 1
            if u is not None:
                root, sign = value.get(u, (None, True) if whole else (u, False))
                u, neg = root, sign != neg
            if u is None:
                taken |= neg
            elif inputs.setdefault(u, neg) != neg:
                taken = True
        if taken or not inputs:
            value[v] = None, not taken
        elif len(inputs) == 1:
            (root, sign), = inputs.items()
            value[v] = root, not sign
        else:
            value[v] = v, False
            out += [(_GATE, v, u, neg) for u, neg in inputs.items()]
            continue
        out.append((_RESOLVED, v, *value[v]))
    return out


def _walk(table: pa.Table, whole: bool) -> pa.Table:
    table = table.select(["v", "u", "neg"]).sort_by([("v", "ascending"), ("u", "ascending")])
    rows = reduce_part(*(table.column(c).to_pylist() for c in ("v", "u", "neg")), whole)
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW_OUT)], schema=_ARROW_OUT)


def _in_groups(system: DataFrame, key: str) -> DataFrame:
    """Values ``(v, neg)`` of independent, complete groups."""
    walked = system.groupBy(key).applyInArrow(lambda table: _walk(table, True), _OUT)
    return walked.select("v", "neg")


def _in_parts(system: DataFrame, parts: int) -> DataFrame:
    """Consecutive parts of the order, each contracted by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from _walk(pa.Table.from_batches(held), False).to_batches()

    return system.repartitionByRange(parts, "v").mapInArrow(run, _OUT)


def _definitions(level: DataFrame) -> DataFrame:
    """What is still open after a contraction: inputs of rows that stay, and what the
    rows are that some part refers to."""
    gates = level.filter(f"kind = {_GATE}").select("v", "u", "neg")
    named = level.filter("u IS NOT NULL").select(F.col("u").alias("v")).distinct()
    known = level.filter(f"kind = {_RESOLVED} AND (u IS NOT NULL OR NOT neg)").join(named, "v", "left_semi")
    return gates.unionByName(known.select("v", "u", (~F.col("neg")).alias("neg")))


def _handed_down(level: DataFrame, values: DataFrame) -> DataFrame:
    """Values of all rows of a level, given those of what it left open."""
    resolved = level.filter(f"kind = {_RESOLVED}")
    aliases = resolved.filter("u IS NOT NULL").select("v", "u", "neg")
    # Whatever nothing defines has no earlier neighbour, so it leads.
    roots = aliases.groupBy("u").agg(F.count("*").alias("uses")).join(
        values.select(F.col("v").alias("u"), F.col("neg").alias("leads")), "u", "left"
    ).select("u", "uses", F.coalesce("leads", F.lit(True)).alias("leads"))
    told = attach(aliases, roots, "u", "uses", F.col("v")).select("v", (F.col("leads") != F.col("neg")).alias("neg"))
    stayed = values.join(level.filter(f"kind = {_GATE}").select("v").distinct(), "v", "left_semi")
    return resolved.filter("u IS NULL").select("v", "neg").unionByName(told).unionByName(stayed.select("v", "neg"))


def _in_order(system: DataFrame, n: int, block_pairs: int) -> DataFrame:
    """Block after block; each one's values are put into the rows after it."""
    found: list[DataFrame] = []
    while n:
        head, rest = system, None
        if n > block_pairs:
            share = block_pairs / n / 2
            cut = system.agg(F.percentile_approx("v", share, int(min(10_000_000, max(10_000, 20 / share))))).first()[0]
            head, rest = system.filter(F.col("v") <= cut), system.filter(F.col("v") > cut)
        values = store(_in_groups(head.withColumn("part", F.lit(0)), "part"), "settled")
        found.append(values)
        if rest is None:
            break
        told = values.select(F.col("v").alias("u"), F.col("neg").alias("leads"))
        rest = rest.join(told, "u", "left").select(
            "v", F.when(F.col("leads").isNull(), F.col("u")).alias("u"),
            F.when(F.col("leads").isNull(), F.col("neg")).otherwise(F.col("leads") != F.col("neg")).alias("neg"),
        )
        system, n = store_counted(rest.filter("u IS NOT NULL OR neg"), "open")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _by_component(system: DataFrame, n: int, block_pairs: int) -> DataFrame:
    """Values of a circuit whose small components are walked side by side."""
    member = components(system.filter("u IS NOT NULL").select(F.col("u").alias("lo"), F.col("v").alias("hi")))
    per_row = system.groupBy("v").agg(F.count("*").alias("uses")).join(
        member.select(F.col("pos").alias("v"), "component"), "v", "left"
    ).select("v", "uses", F.coalesce("component", "v").alias("component"))
    placed = store(attach(system, per_row, "v", "uses", F.col("u")).select("v", "u", "neg", "component"), "placed")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    small = F.col("n") <= block_pairs
    sized, seen = store_observed(
        attach(placed, sizes, "component", "n", F.col("v")), "sized",
        n_small=F.count_if(small), n_large=F.count_if(~small),
    )
    # Components of an eighth of a block and more are groups of their own; the others share
    # groups of a quarter of a block on average.
    shared = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-4 * seen["n_small"] // block_pairs))))
    alone = F.col("n") * 8 >= block_pairs
    part = F.struct(alone.alias("alone"), F.when(alone, F.col("component")).otherwise(shared).alias("number"))
    values = store(_in_groups(sized.filter(small).select("v", "u", "neg", part.alias("part")), "part"), "settled")
    if seen["n_large"]:
        large = sized.filter(~small).select("v", "u", "neg")
        values = values.unionByName(_in_order(large, seen["n_large"], block_pairs))
    return values


def circuit_values(system: DataFrame, n: int, block_pairs: int) -> DataFrame:
    """``(v, neg)``: whether each row of a circuit ``(v, u, neg)`` of ``n`` rows leads.
    A row left without open inputs on the way is not listed; it leads."""
    levels: list[DataFrame] = []
    shrinks = True
    while n > block_pairs and shrinks:
        # The cut is by sampled ranges, so parts are made half as large as they may be.
        level = store(_in_parts(system, -(-2 * n // block_pairs)), "contracted")
        levels.append(level)
        before = n
        system, n = store_counted(_definitions(level), "open")
        shrinks = n <= before * SHRINKS
    if n > block_pairs:
        values = _by_component(system, n, block_pairs)
    else:
        values = store(_in_groups(system.withColumn("part", F.lit(0)), "part"), "settled")
    for level in reversed(levels):
        values = store(_handed_down(level, values), "settled")
    return values


def taken_rows(pairs: DataFrame, n_pairs: int, block_pairs: int) -> DataFrame:
    """``(pos)`` of the rows that an earlier row takes, for a stored table ``pairs (lo, hi)``."""
    system = pairs.select(F.col("hi").alias("v"), F.col("lo").alias("u"), F.lit(False).alias("neg"))
    return circuit_values(system, n_pairs, block_pairs).filter("NOT neg").select(F.col("v").alias("pos"))
