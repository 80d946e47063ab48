"""Toxicity by class-conditional Kneser-Ney models.

Words are runs of letters, seen as letters between a start and an end mark.  Each
class has counts of :data:`ORDER`-letter sequences from labelled rows; what a class
has not seen falls back, after absolute discounting, to one shared model, whose
continuation counts come from all documents.  A word's evidence is the difference
of its two log-likelihoods.  A text's evidence is length-normalised: the mean over
all its words, and the means over its one, three and six most toxic ones, so that
an abusive passage counts however long the text around it is.  A logistic curve,
fitted on labelled rows that gave no counts, turns that into a score.

Bounds: at most :data:`SAMPLE_ROWS` labelled ids per class are used, chosen by a
hash, with one row each; the model holds their sequences only and is what the driver collects and
sends to the workers.  Everything else covers all documents.

Nulls count as empty texts.  Texts without letters get the base rate as score.
Without labels of both classes, that is every text's score.  Ids may be null
(never labelled) or repeat; every input row gives one row.  Of labelled rows that
share an id, the smallest text is learnt from; an id labelled both ways is toxic.
Equal hashes at the edge of the sample are taken by id; equal texts score alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import digest_of, held, per_text, text_or_empty
from lumenlake.scratch import store

ORDER = 8
DISCOUNT = 0.75
SAMPLE_ROWS = 3000
#: One labelled row in so many calibrates instead of being counted.
CALIBRATE = 4
#: With fewer such rows of a class, all sampled rows calibrate.
LEAST_CALIBRATION = 5
THRESHOLD = 0.7
CACHE = 300_000
GRAM_CACHE = 400_000
START, END = "^", "$"
TOP = (1, 3, 6)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str) -> list[str]:
    """Sequences of ORDER letters that end in each letter of the word and in its end."""
    marked = START * (ORDER - 1) + word + END
    return [marked[i:i + ORDER] for i in range(len(word) + 1)]


def distinct_grams(docs: DataFrame, text: Column) -> DataFrame:
    """All different sequences of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()
        grams: set[str] = set()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string())], ["gram"])
            grams.clear()
            words.clear()
            return batch

        for batch in batches:
            for value in batch.column(0).to_pylist():
                new = set(words_of(value)) - words
                words |= new
                for w in new:
                    grams.update(grams_of(w))
                if len(grams) > GRAM_CACHE:
                    yield out()
        if grams:
            yield out()

    return docs.select(text.alias("text")).mapInArrow(run, "gram string").distinct()


def shared_model(grams: DataFrame) -> DataFrame:
    """``gram, shared``: for sequences of ORDER - 1 letters, the interpolated
    Kneser-Ney probability of the last letter.  Counts are numbers of different
    letters found before a sequence; a level is derived from the one above it."""
    levels: dict[int, DataFrame] = {}
    above = grams
    for size in range(ORDER - 1, 0, -1):
        level = above.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        levels[size] = above = store(level, f"grams-{size}")
    lower: DataFrame | None = None
    for size in range(1, ORDER):
        # A context is followed by as many rows as there are letters.
        near = Window.partitionBy("context")
        rows = levels[size].withColumn("context", F.expr(f"substring(gram, 1, {size - 1})"))
        if size == 1:
            # Few rows: one per letter.
            total = rows.agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).first()
            lower = levels[1].select("gram", (F.col("n") / F.lit(float(total["total"] or 1))).alias("shared"))
        else:
            rows = rows.select(
                "gram", "n", F.expr("substring(gram, 2)").alias("rest"),
                F.sum("n").over(near).alias("total"), F.count("*").over(near).alias("kinds"),
            )
            below = lower.select(F.col("gram").alias("rest"), F.col("shared").alias("below"))
            lower = rows.join(below, "rest").select(
                "gram",
                (
                    (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("below"))
                    / F.col("total")
                ).alias("shared"),
            )
        if size == ORDER - 1:
            return lower
        lower = store(lower, f"shared-{size}")
    raise AssertionError


class Model(NamedTuple):
    seen: dict[str, float]  # evidence of a sequence
    unseen: dict[str, float]  # of any other sequence after this context
    scale: list[tuple[float, float]]  # mean and deviation of the features
    weights: list[float]
    base: float


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.cache: dict[str, float] = {}

    def word(self, word: str) -> float:
        seen, unseen = self.model.seen, self.model.unseen
        total = 0.0
        for gram in grams_of(word):
            value = seen.get(gram)
            total += unseen.get(gram[:-1], 0.0) if value is None else value
        return total

    def features(self, text: str) -> list[float]:
        words = words_of(text)
        if not words:
            return []
        cache = self.cache
        missing = set(words).difference(cache)
        if len(cache) + len(missing) > CACHE:
            cache.clear()
            missing = set(words)
        for w in missing:
            cache[w] = self.word(w)
        values = np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))
        most = min(max(TOP), len(values))
        top = np.sort(np.partition(values, len(values) - most)[len(values) - most:])[::-1]
        return [float(values.mean()), *(float(top[:k].sum() / k) for k in TOP), math.log(len(words))]

    def score(self, text: str) -> float:
        found = self.features(text)
        if not found or not self.model.weights:
            return self.model.base
        z = self.model.weights[0]
        for x, (mean, deviation), w in zip(found, self.model.scale, self.model.weights[1:]):
            z += w * (x - mean) / deviation
        return round(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), 9)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[tuple[float, float]], list[float]]:
    """Ridge-penalised logistic regression by Newton steps."""
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / deviation]
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        hessian = a.T @ (a * (weight * p * (1 - p))[:, None]) + np.eye(len(w))
        w += np.linalg.solve(hessian, a.T @ (weight * (y - p)) - w)
    return list(zip(mean.tolist(), deviation.tolist())), w.tolist()


def is_held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Bounded choice of labelled ids, and the number there are of each class."""
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))
    )
    known = store(known, "labelled")
    # A limit over an order keeps so many rows per task before they meet.
    chosen = [
        known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for k in (0, 1)
    ]
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)) == 0
    return chosen[0].unionByName(chosen[1]).withColumn("calibrates", calibrates), counts


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs (doc_id, text)``, ``labels (doc_id, toxic)``; see the module."""
    spark = docs.sparkSession
    chosen, counts = _sample(labels)
    n = sum(counts.values())
    base = (counts.get(1, 0) + 0.5) / (n + 1)
    if len(counts) < 2:
        return Model({}, {}, [], [], base)
    # At most 2 * SAMPLE_ROWS ids, one row each.
    listed = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "calibrates")
    sample = store(listed.agg(F.min("text").alias("text")), "tox-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, found = [], []
            for tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = [g for w in words_of(text) for g in grams_of(w)]
                found += new
                tags += [tag] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(found, pa.string())], ["toxic", "gram"])

    counted = (
        sample.filter("NOT calibrates").select(F.col("toxic").cast("long").alias("toxic"), "text")
        .mapInArrow(words, "toxic long, gram string").groupBy("gram")
        .agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1"))
    )
    counted = store(counted.withColumn("context", F.expr(f"substring(gram, 1, {ORDER - 1})")), "class-grams")
    contexts = store(
        counted.groupBy("context").agg(
            F.sum("n0").alias("t0"), F.sum("n1").alias("t1"),
            F.count_if(F.col("n0") > 0).alias("k0"), F.count_if(F.col("n1") > 0).alias("k1"),
        ),
        "class-contexts",
    )
    back = [F.when(F.col(f"t{k}") > 0, DISCOUNT * F.col(f"k{k}") / F.col(f"t{k}")).otherwise(1.0) for k in (0, 1)]
    shared = shared_model(store(distinct_grams(docs, F.col("text")), "grams"))
    keyed = counted.withColumn("rest", F.expr("substring(gram, 2)")).join(contexts, "context")
    p = [
        F.when(F.col(f"t{k}") > 0, F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{k}")).otherwise(0.0)
        + back[k] * F.col("shared")
        for k in (0, 1)
    ]
    scored = keyed.join(shared.withColumnRenamed("gram", "rest"), "rest").select("gram", F.log(p[1] / p[0]).alias("v"))
    after = contexts.select("context", F.log(back[1] / back[0]).alias("v"))

    def table(df: DataFrame) -> dict[str, float]:
        found = df.toArrow()
        return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))

    model = Model(table(scored), table(after), [], [], base)
    probe = spark.sparkContext.broadcast(model)

    def make() -> Callable[[str], tuple]:
        scorer = Scorer(probe.value)
        return lambda text: (scorer.features(text),)

    def measured(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        chosen = part.select("doc_id", F.col("toxic").cast("long").alias("toxic"), "text")
        rows = per_text(chosen, "doc_id", F.col("text"), "x array<double>", make, keep="toxic").collect()
        rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["doc_id"], r["x"]))
        return np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)

    x, y = measured(sample.filter("calibrates"))
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_CALIBRATION:
        x, y = measured(sample)  # too few labels to set rows aside
    if len(set(y.tolist())) < 2:
        return Model({}, {}, [], [], base)
    # Classes count as they occur, not as they were sampled.
    share = {k: counts[k] / n / max((y == k).mean(), 1e-9) for k in (0, 1)}
    scale, weights = _logistic(x, y, np.where(y == 1, share[1], share[0]))
    return model._replace(scale=scale, weights=weights)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic"
) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).alias("toxic"))
    model = fit(source, known)
    shared = spark.sparkContext.broadcast(model)
    content = digest_of("scorer", model)

    def make() -> Callable[[str], tuple]:
        scorer = held(content, lambda: Scorer(shared.value))
        return lambda text: (scorer.score(text),)

    scored = per_text(source, "doc_id", F.col("text"), "score double", make)
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
