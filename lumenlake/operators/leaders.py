"""Greedy leader clustering of 64-bit hashes, in input order (ITR1).

The sequential rule: walk the rows in order; a row not yet taken becomes a
leader and takes every later free row within ``t`` bits of it.  The leaders are
the lexicographically first maximal independent set of the "within t bits"
graph, and every other row belongs to its lowest leading neighbour.  That set
can be found in a few parallel rounds (Blelloch, Fineman & Shun, SPAA 2012).

Two things keep the work down where many hashes lie close together:

* Rows are settled in stages, a prefix of the order at a time.  The leaders of
  a prefix take their neighbours out of all later rows first, so the pairs
  inside a dense region are never listed; only the region's first rows are
  paired up.  A stage's size follows from measured bucket sizes and density.
* Inside a stage only still undecided pairs go to the next round.  Long chains
  settle one link per round; after a few rounds what is left is contracted in parts
  of the order side by side, or walked component by component (:mod:`settle`).

Each stage and round is written to the scratch folder, so lost executors do not
repeat earlier ones.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.near import HOT_BUCKET, bucket_work, choose_bands, fit_bands, near_pairs
from lumenlake.operators.settle import taken_rows
from lumenlake.scratch import store, store_counted

# Pairs one stage may list, and candidate pairs it may test, by estimate.
STAGE_PAIRS = 50_000_000
STAGE_TESTS = 1_000_000_000_000

# Rows drawn to estimate how many pairs there are.  The draw only sizes stages.
ESTIMATE_ROWS = 20_000

# A stage never gets smaller than this many rows.
MIN_STAGE = 4_096

# After this many rounds the remainder is settled in parts ...
PATIENT_ROUNDS = 6
# ... of about this many pairs at most.
BLOCK_PAIRS = 200_000


def leader_clusters(
    hashes: DataFrame,
    t: int,
    n_hashes: int | None = None,
    stage_pairs: int = STAGE_PAIRS,
    stage_tests: int = STAGE_TESTS,
    min_stage: int = MIN_STAGE,
    hot_bucket: int = HOT_BUCKET,
    patient_rounds: int = PATIENT_ROUNDS,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """``(pos, leader)`` for every row of ``hashes`` that is not a leader itself.

    ``hashes`` is ``(h, pos)`` with distinct ``h`` and distinct ``pos``.  It is
    read several times, so it should be a stored table.
    """
    rest = hashes.select("h", "pos")
    left = rest.count() if n_hashes is None else n_hashes
    taken: list[DataFrame] = []
    while left > 1:
        cut = _stage_end(rest, left, t, stage_pairs, stage_tests, min_stage)
        if cut is None:
            stage, later, n_stage = rest, None, left
        else:
            stage = rest.filter(F.col("pos") <= cut)
            later = rest.filter(F.col("pos") > cut)
            n_stage = stage.count()

        bands = fit_bands(stage, n_stage, n_stage, t)
        pairs, n_pairs = store_counted(
            near_pairs(
                stage, stage, t, bands, same_input=True,
                hot_bucket=hot_bucket if n_stage > hot_bucket else None,
            ).select("lo", "hi"),
            "pairs",
        )
        followers = _followers(pairs, n_pairs, patient_rounds, block_pairs)
        inside = store(
            pairs.join(followers.select(F.col("pos").alias("lo")), "lo", "left_anti")
            .groupBy(F.col("hi").alias("pos")).agg(F.min("lo").alias("leader")),
            "inside",
        )
        taken.append(inside)
        if later is None:
            break

        n_later = left - n_stage
        leading = stage.join(inside.select("pos"), "pos", "left_anti")
        bands = fit_bands(leading, n_later, n_stage, t)
        claimed = store(
            near_pairs(
                later, leading, t, bands, same_input=False,
                hot_bucket=hot_bucket if left > hot_bucket else None,
            ).groupBy(F.col("hi").alias("pos")).agg(F.min("lo").alias("leader")),
            "claimed",
        )
        taken.append(claimed)
        rest, left = store_counted(
            later.join(claimed.select("pos"), "pos", "left_anti"), "rest"
        )

    if not taken:
        return hashes.select("pos", F.col("pos").alias("leader")).limit(0)
    result = taken[0]
    for more in taken[1:]:
        result = result.unionByName(more)
    return result


def _stage_end(
    rest: DataFrame, n: int, t: int, stage_pairs: int, stage_tests: int, min_stage: int
) -> int | None:
    """Last ``pos`` of the next stage, or None when all rows fit into one."""
    bands = choose_bands(n, n, t)
    if n <= min_stage or (n * n <= 2 * stage_pairs and n * n * bands.m <= stage_tests):
        return None
    share, cut, stage = 1.0, None, rest
    while n * share > min_stage:
        excess = max(
            bucket_work(stage, bands) / stage_tests,
            _expected_pairs(stage, n * share, t) / stage_pairs,
        )
        if excess <= 1:
            break
        share = max(share * min(0.5, 1 / sqrt(excess)), min_stage / n)
        accuracy = int(min(1_000_000, max(10_000, 20 / share)))
        cut = rest.agg(F.percentile_approx("pos", share, accuracy)).first()[0]
        stage = rest.filter(F.col("pos") <= cut)
    return cut


def _expected_pairs(stage: DataFrame, n: float, t: int) -> float:
    """Number of pairs in a stage, scaled up from a draw of its rows."""
    share = min(1.0, ESTIMATE_ROWS / n)
    drawn = stage.sample(share, seed=1)
    bands = choose_bands(ESTIMATE_ROWS, ESTIMATE_ROWS, t)
    found = near_pairs(drawn, drawn, t, bands, same_input=True, hot_bucket=None).count()
    return found / share ** 2


def _followers(
    pairs: DataFrame, n_pairs: int, patient_rounds: int, block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """Rows of a stage that are taken by an earlier row, as ``(pos)``.

    Per round: a row with no undecided earlier neighbour leads; its neighbours
    are taken; pairs with a taken row drop out.  Each round's result is written.
    """
    found: list[DataFrame] = []
    open_pairs, n_open, rounds = pairs, n_pairs, 0
    while n_open:
        if rounds >= patient_rounds:
            found.append(taken_rows(open_pairs, n_open, block_pairs))
            break
        newly = store(_round(open_pairs), "taken")
        found.append(newly)
        open_pairs, n_open = store_counted(
            open_pairs
            .join(newly.select(F.col("pos").alias("hi")), "hi", "left_anti")
            .join(newly.select(F.col("pos").alias("lo")), "lo", "left_anti"),
            "open",
        )
        rounds += 1
    if not found:
        return pairs.select(F.col("hi").alias("pos")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _round(open_pairs: DataFrame) -> DataFrame:
    """Neighbours of the rows that no undecided row comes before."""
    leads = open_pairs.select("lo").distinct().join(
        open_pairs.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti"
    )
    return open_pairs.join(leads, "lo", "left_semi").select(F.col("hi").alias("pos")).distinct()

