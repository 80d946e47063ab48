"""Join of 64-bit hashes that differ in at most ``t`` bits.

Catalyst can only plan such a condition as a nested loop.  The rewrite follows
multi-index hashing (Norouzi, Punjani & Fleet, CVPR 2012): cut the 64 bits into
``m`` bands; two hashes within ``t`` bits agree within ``t div m`` bits on some
band.  One side is listed under its band values, the other under every value
within that radius, and an equi-join finds the candidates.

Bands need not have one radius: radii that add up to ``t - m + 1`` suffice, and a
radius of -1 leaves a band out (general pigeonhole; Qin et al., ICDE 2018).  At
large ``t`` and on skewed bits :func:`fit_bands` picks them by how often hashes of a
drawn sample come close on each band.

No pair is found twice: only the first band that is close enough may report it,
which the join condition checks, so no ``distinct`` over pairs is needed.

A band value shared by very many hashes (dark or bright picture areas) would
make one huge bucket.  Such a bucket is cut again by a second band: the pair
must also agree within ``t div (m - 1)`` bits on one of the other bands.  What is
still too large then is split: each part of the index meets a copy of the probe.

Cutting and splitting multiply rows.  Where a caller wants them below
:data:`HOT_BUCKET`, the most crowded buckets are cut, as far as that adds no more rows
than the join has anyway, and lists are split into parts no shorter than the list that
a probe row meets on average, which at most doubles the probe.  Which buckets are cut
or split makes no difference to the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.scratch import store, store_counted

# Hashes under one band value from which the bucket is cut by a second band, whatever that adds.
HOT_BUCKET = 20_000

# Rows that cutting smaller buckets may always add, and steps per doubling of bucket sizes.
_CUT_ROWS = 1_000_000
_SIZE_STEPS = 16

# Cost of shuffling one row, in units of testing one candidate pair.
_ROW_COST = 20

# Candidate pairs per task.  Joins with fewer in all keep Spark's own partitioning;
# beyond that the count is set here, since AQE sizes tasks by bytes and these
# tasks are heavy in tests and light in bytes.
_TESTS_PER_TASK = 100_000_000
_FEW_TESTS = 1_000_000
_MOST_TASKS = 100_000

# Flips listed per band at most, first or second; wider balls are not worth listing.
_MAX_FLIPS = 5_000

# Share of entries that a cost estimate takes to be under hot band values.
_HOT_SHARE = 0.001

# Bits of a band value (64 bits in 3 bands or more) and of a band code.
_VALUE_BITS = 22
_CODE_BITS = 28


@dataclass(frozen=True)
class Bands:
    """A cut of 64 bits into ``m`` bands, for threshold ``t``."""

    m: int
    t: int
    tests: float = 0.0
    """Candidate pairs to expect, when known."""
    own_radii: tuple[int, ...] | None = None
    """A radius per band, -1 to leave it out; the same for all if not given."""

    @property
    def widths(self) -> list[int]:
        base, extra = divmod(64, self.m)
        return [base + 1] * extra + [base] * (self.m - extra)

    @property
    def shifts(self) -> list[int]:
        out, at = [], 0
        for width in self.widths:
            out.append(at)
            at += width
        return out

    @property
    def radii(self) -> list[int]:
        return list(self.own_radii or [self.t // self.m] * self.m)

    @property
    def inner_radius(self) -> int:
        """Radius on a second band once one band is used up."""
        return self.t // (self.m - 1)

    def value(self, h: str, band: int) -> str:
        """SQL text of the band's value in the hash expression ``h``."""
        return f"(shiftrightunsigned({h}, {self.shifts[band]}) & {(1 << self.widths[band]) - 1}L)"

    def code(self, band: int, value: str) -> str:
        """SQL text of band number and value as one number, at least 1."""
        return f"({value} + {(band << _VALUE_BITS) + 1}L)"


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(min(radius, width) + 1))


def flip_masks(width: int, radius: int) -> list[int]:
    """All words of ``width`` bits with at most ``radius`` set."""
    return [
        sum(1 << b for b in bits)
        for k in range(min(radius, width) + 1)
        for bits in combinations(range(width), k)
    ]


def choose_bands(n_index: int, n_probe: int, t: int) -> Bands:
    """The number of bands with the least shuffled rows plus tested pairs."""
    best, best_cost = None, None
    for m in range(3, 33):
        bands = Bands(m, t)
        balls = [_ball(w, r) for w, r in zip(bands.widths, bands.radii)]
        inner = [_ball(w, bands.inner_radius) for w in bands.widths]
        if max(balls + inner) > _MAX_FLIPS:
            continue
        rows = n_index * m + n_probe * sum(balls) * (1 + _HOT_SHARE * sum(inner))
        share = sum(b / 2.0 ** w for b, w in zip(balls, bands.widths))
        tests = float(n_index) * n_probe * share
        cost = _ROW_COST * rows + tests
        if best_cost is None or cost < best_cost:
            best, best_cost = Bands(m, t, tests), cost
    return best or Bands(32, t)


# Hashes drawn to see how close hashes come on each band, and the tests from which that pays.
_FIT_ROWS = 2_000
_FIT_TESTS = 100_000_000


def best_radii(costs: list[list[float]], t: int) -> list[int]:
    """Radii with the least total cost among those that find all pairs within ``t`` bits;
    ``costs[band][r + 1]`` is the cost of radius r.  Radii plus one have to add up to t + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for reach, (cost, radii) in best.items():
            for step, price in enumerate(own):
                to = min(reach + step, t + 1)
                if to not in after or cost + price < after[to][0]:
                    after[to] = cost + price, [*radii, step - 1]
        best = after
    return best[t + 1][1] if t + 1 in best else []


def close_shares(drawn: Sequence[int], bands: Bands) -> list[list[float]]:
    """Per band, the share of pairs of drawn hashes within 0, 1, 2, ... bits of each other there."""
    h = np.array(drawn, dtype=np.int64).view(np.uint64)
    first, second = np.triu_indices(len(h), 1)
    out = []
    for shift, width in zip(bands.shifts, bands.widths):
        values = (h >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        counts = np.bincount(np.bitwise_count(values[first] ^ values[second]), minlength=width + 1)
        out.append((np.cumsum(counts) / max(1, len(first))).tolist())
    return out


def fit_bands(hashes: DataFrame, n_index: int, n_probe: int, t: int) -> Bands:
    """Bands and radii by what the hashes are like.

    The draw is at most :data:`_FIT_ROWS` hashes, taken to the driver; it only shapes the
    plan, never the pairs.  Where few tests are to be expected anyway, nothing is drawn.
    """
    plain = choose_bands(n_index, n_probe, t)
    if plain.tests <= _FIT_TESTS:
        return plain
    drawn = [r["h"] for r in hashes.select("h").orderBy(F.xxhash64("h"), "h").limit(_FIT_ROWS).collect()]
    best, best_cost = plain, None
    for m in range(3, 33):
        bands = Bands(m, t)
        if max(_ball(w, bands.inner_radius) for w in bands.widths) > _MAX_FLIPS:
            continue
        shares = close_shares(drawn, bands)
        tests = [[float(n_index) * n_probe * x for x in own] for own in shares]
        costs = [
            [0.0] + [
                _ROW_COST * (n_index + n_probe * _ball(w, r)) + own[r]
                for r in range(w + 1) if _ball(w, r) <= _MAX_FLIPS
            ]
            for w, own in zip(bands.widths, tests)
        ]
        radii = best_radii(costs, t)
        if not radii:
            continue
        cost = sum(own[r + 1] for own, r in zip(costs, radii))
        if best_cost is None or cost < best_cost:
            expected = sum(own[r] for own, r in zip(tests, radii) if r >= 0)
            best, best_cost = Bands(m, t, expected, tuple(radii)), cost
    return best


def _mask_table(spark: SparkSession, bands: Bands, radii: list[int], name: str) -> DataFrame:
    """``name, masks``: what to flip on each band, and nothing on band -1.  At most
    ``_MAX_FLIPS`` values per band if the bands were chosen here."""
    listed = {key: flip_masks(*key) for key in set(zip(bands.widths, radii)) if key[1] >= 0}
    rows = [(b, listed[key]) for b, key in enumerate(zip(bands.widths, radii)) if key[1] >= 0]
    return F.broadcast(spark.createDataFrame([*rows, (-1, [0])], f"{name} int, masks array<bigint>"))


def _first_close(bands: Bands, radii: list[int], skip: str | None = None) -> str:
    """Number of the first band on which the difference ``h_a ^ h_b`` is small enough."""
    cases = []
    for band, radius in enumerate(radii):
        if radius < 0:
            continue
        close = f"bit_count({bands.value('h_a ^ h_b', band)}) <= {radius}"
        if skip is not None:
            close += f" AND {skip} <> {band}"
        cases.append(f"WHEN {close} THEN {band}")
    return "CASE " + " ".join(cases) + " END"


def _band_rows(df: DataFrame, bands: Bands, flips: bool) -> DataFrame:
    """One row per hash and band, or per hash, band and flipped value."""
    listed = ",".join(
        f"struct({b} AS band, {bands.value('h', b)} AS value)" for b, r in enumerate(bands.radii) if r >= 0
    )
    rows = df.selectExpr("h", "pos", f"inline(array({listed}))")
    value = "value"
    if flips and max(bands.radii) > 0:
        masks = _mask_table(df.sparkSession, bands, bands.radii, "band")
        rows = rows.join(masks, "band").selectExpr("h", "pos", "band", "value", "explode(masks) AS mask")
        value = "(value ^ mask)"
    return rows.selectExpr(
        "h", "pos", "band", f"{value} + shiftleft(CAST(band AS BIGINT), {_VALUE_BITS}) + 1 AS code"
    )


def _cut_hot(rows: DataFrame, hot: DataFrame, bands: Bands, flips: bool) -> DataFrame:
    """Replace rows under a hot band value by rows under value pairs."""
    second = ",".join(
        f"struct({b} AS band2, {bands.value('h', b)} AS value2)" for b in range(bands.m)
    )
    cut = rows.join(hot, "code", "left").selectExpr(
        "h", "pos", "band", "code",
        f"inline(CASE WHEN hot THEN filter(array({second}), x -> x.band2 <> band) "
        "ELSE array(struct(-1 AS band2, 0L AS value2)) END)",
    )
    radii = [bands.inner_radius if flips else 0] * bands.m
    masks = _mask_table(rows.sparkSession, bands, radii, "band2")
    return cut.join(masks, "band2").selectExpr(
        "h", "pos", "band", "band2", "code", "value2", "explode(masks) AS mask"
    ).selectExpr(
        "h", "pos", "band", "band2",
        f"shiftleft(code, {_CODE_BITS}) + CASE WHEN band2 < 0 THEN 0L ELSE "
        f"(value2 ^ mask) + shiftleft(CAST(band2 AS BIGINT), {_VALUE_BITS}) + 1 END AS key",
    )


def _worth_cutting(hot: DataFrame, probe: DataFrame, bands: Bands) -> DataFrame:
    """The most crowded of ``hot (code, count)``: all above :data:`HOT_BUCKET`, and others
    as long as the rows that cutting them adds stay below the rows there are.

    Probe rows per code follow from the counts per band value, without listing them by row.
    """
    masks = _mask_table(hot.sparkSession, bands, bands.radii, "band")
    met = (
        _band_rows(probe, bands, flips=False).groupBy("band", "code").agg(F.count("*").alias("n"))
        .join(masks, "band").selectExpr("n", "band", "code", "explode(masks) AS mask")
        .groupBy(F.expr("((code - 1) ^ mask) + 1").alias("code")).agg(F.sum("n").alias("n"))
    )
    flips = sum(_ball(w, bands.inner_radius) for w in bands.widths)
    added = F.col("count") * (bands.m - 1) + F.col("n") * flips
    sizes = (
        met.join(hot, "code", "left")
        .groupBy(F.floor(F.log2("count") * _SIZE_STEPS).alias("step"))
        .agg(F.sum("n").alias("n"), F.sum(added).alias("added"), F.min("count").alias("least"))
        .collect()  # a row per step of bucket sizes
    )
    room = max(_CUT_ROWS, sum(row["n"] for row in sizes))
    least = HOT_BUCKET + 1
    for row in sorted((row for row in sizes if row["least"] is not None), key=lambda row: -row["least"]):
        room -= row["added"]
        if room < 0:
            break
        least = min(least, row["least"])
    return hot.filter(F.col("count") >= least)


def _part_size(crowded: DataFrame, probe: DataFrame, hot_bucket: int) -> int:
    """Length of the parts of crowded lists: what is asked for, or the mean length that a
    probe row meets if that is more, up to :data:`HOT_BUCKET`."""
    if hot_bucket >= HOT_BUCKET:
        return hot_bucket
    met = probe.groupBy("key").agg(F.count("*").alias("n")).join(crowded, "key")
    mean = met.agg(F.sum(F.col("n").cast("double") * F.col("count")) / F.sum("n")).first()[0]
    return max(hot_bucket, min(int(mean or 0), HOT_BUCKET))


def _split_crowded(
    index: DataFrame, probe: DataFrame, hot_bucket: int
) -> tuple[DataFrame, DataFrame]:
    """Add ``part``: index rows of a key with too many are dealt to parts, probe rows
    are copied to each of them, so every pair still meets once."""
    crowded, n = store_counted(
        index.groupBy("key").count().filter(F.col("count") > hot_bucket), "crowded",
    )
    zero = F.lit(0).cast("long")
    if not n:
        return index.withColumn("part", zero), probe.withColumn("part", zero)
    size = _part_size(crowded, probe, hot_bucket)
    crowded = crowded.filter(F.col("count") > size).select(
        "key", F.ceil(F.col("count") / size).cast("long").alias("parts")
    )
    one = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = index.join(crowded, "key", "left").withColumn("part", F.pmod(F.xxhash64("pos"), one))
    copied = probe.join(crowded, "key", "left").withColumn("part", F.explode(F.sequence(zero, one - 1)))
    return dealt.drop("parts"), copied.drop("parts")


def near_pairs(
    index: DataFrame,
    probe: DataFrame,
    t: int,
    bands: Bands,
    same_input: bool,
    hot_bucket: int | None = HOT_BUCKET,
) -> DataFrame:
    """Pairs ``(lo, hi, distance)`` of hashes within ``t`` bits, one from each side.

    Inputs are ``(h, pos)`` with distinct ``h``.  With ``same_input`` both sides
    are one set and each unordered pair comes once; otherwise the sides are
    disjoint and ``lo`` is the probe's row, ``hi`` the index's.  ``hot_bucket``
    None skips the search for hot buckets, for inputs too small to have one.
    """
    left = _band_rows(index, bands, flips=False)
    right = _band_rows(probe, bands, flips=True)
    n_hot = 0
    if hot_bucket is not None:
        hot, n_hot = store_counted(
            left.groupBy("code").count().filter(F.col("count") > hot_bucket), "hot",
        )
    if n_hot:
        if hot_bucket < HOT_BUCKET:
            hot = _worth_cutting(hot, probe, bands)
        hot = hot.select("code", F.lit(True).alias("hot"))
        left = store(_cut_hot(left, hot, bands, False), "index")
        left, right = _split_crowded(left, _cut_hot(right, hot, bands, True), hot_bucket)
    else:
        left, right = (
            side.select(
                "h", "pos", "band", F.lit(-1).alias("band2"), F.col("code").alias("key"),
                F.lit(0).cast("long").alias("part"),
            )
            for side in (left, right)
        )
    a = left.select(
        F.col("key").alias("key_a"), F.col("part").alias("part_a"), F.col("h").alias("h_a"),
        F.col("pos").alias("pos_a"), "band", "band2",
    )
    b = right.select(
        F.col("key").alias("key_b"), F.col("part").alias("part_b"), F.col("h").alias("h_b"),
        F.col("pos").alias("pos_b"),
    )
    if bands.tests > _FEW_TESTS:
        cores = index.sparkSession.sparkContext.defaultParallelism
        tasks = min(max(cores, int(bands.tests / _TESTS_PER_TASK)), _MOST_TASKS)
        a, b = a.repartition(tasks, "key_a", "part_a"), b.repartition(tasks, "key_b", "part_b")
    on = f"key_a = key_b AND part_a = part_b AND bit_count(h_a ^ h_b) <= {t}"
    if same_input:
        on += " AND pos_a < pos_b"
    first = f"({_first_close(bands, bands.radii)}) = band"
    if n_hot:
        first += f" AND (band2 = -1 OR ({_first_close(bands, [bands.inner_radius] * bands.m, 'band')}) = band2)"
    lo, hi = ("pos_a", "pos_b") if same_input else ("pos_b", "pos_a")
    # The test for the first band is long, and few candidates get that far.  The
    # generator keeps the optimizer from moving it into the join, whose inner
    # loop has to stay small enough for the JIT compiler.
    return (
        a.join(b, F.expr(on))
        .selectExpr("inline(array(struct(h_a, h_b, pos_a, pos_b, band, band2)))")
        .filter(first)
        .selectExpr(
            f"{lo} AS lo", f"{hi} AS hi", "CAST(bit_count(h_a ^ h_b) AS INT) AS distance"
        )
    )


def bucket_work(hashes: DataFrame, bands: Bands) -> int:
    """Upper estimate of the candidate pairs of a self-join, from bucket sizes."""
    per_band = (
        _band_rows(hashes, bands, flips=False)
        .groupBy("band", "code").count()
        .groupBy("band").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("work"))
        .collect()  # one row per band
    )
    return int(sum(
        row["work"] * _ball(bands.widths[row["band"]], bands.radii[row["band"]]) for row in per_band
    ))
