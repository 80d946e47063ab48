from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import toxicity
from lumenlake.llm.common import table
from lumenlake.llm.queries import op8_toxicity
from tests.conftest import SF

LARGER = SF.replace("sf0.001", "sf0.01")


def test_held_out_rows(spark):
    ids = [0, 1, 2, 17, 123456789, -5]
    rows = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long")
    got = [r[0] for r in rows.select(toxicity.is_held_out(F.col("doc_id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 == 1 for i in ids] + [False]


def plain_shared(words: set[str]) -> dict[str, float]:
    """Interpolated Kneser-Ney over the different sequences of all words."""
    level = {g for w in words for g in toxicity.grams_of(w)}
    counts = {}
    for size in range(toxicity.ORDER - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in level)
        level = set(counts[size])
    p = {g: n / sum(counts[1].values()) for g, n in counts[1].items()}
    for size in range(2, toxicity.ORDER):
        total, kinds = defaultdict(int), Counter()
        for g, n in counts[size].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        p = {
            g: (max(n - 0.75, 0) + 0.75 * kinds[g[:-1]] * p[g[1:]]) / total[g[:-1]] for g, n in counts[size].items()
        }
    return p


def test_shared_model_against_plain_version(spark):
    texts = ["Idiot idiots, the other", "there; théâtre mother", "", None, "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    grams = toxicity.distinct_grams(docs, F.coalesce("text", F.lit("")))
    got = {r["gram"]: r["shared"] for r in toxicity.shared_model(grams).collect()}
    expected = plain_shared({w for t in texts for w in toxicity.words_of(t or "")})
    assert got.keys() == expected.keys()
    assert all(got[g] == pytest.approx(expected[g]) for g in expected)


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in op8_toxicity(spark, LARGER).collect()}
    assert len(rows) == table(spark, LARGER, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    held = [(rows[r["doc_id"]], r["toxic"]) for r in table(spark, LARGER, "labels").collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    toxic = [r["score"] for r, y in held if y == 1]
    clean = [r["score"] for r, y in held if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.85
    assert sum(s >= 0.7 for s in clean) <= 0.02 * len(clean)
    assert sum(s >= 0.7 for s in toxic) >= 0.4 * len(toxic)


def test_labels_of_held_out_rows_play_no_part(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn(
        "toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a, b = (toxicity.score_toxicity(docs, x).collect() for x in (labels, turned))
    assert sorted(a) == sorted(b)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(
        [(1, None, 1), (1, "bad words", 1), (2, "", 0), (None, "good words", 0)], "doc_id long, text string, toxic int"
    )
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    alone = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in alone}) == 1 and {r["predicted"] for r in alone} == {0}


def test_sample_is_a_bounded_choice_of_ids_with_one_row_each(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 5)
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    chosen, counts = toxicity._sample(labels)
    hashed = spark.range(60).select("id", F.xxhash64("id")).collect()
    free = [r for r in hashed if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    wanted = {k: sorted((r[1], r[0]) for r in free if r[0] % 2 == k)[:5] for k in (0, 1)}
    assert {(r["doc_id"], r["toxic"]) for r in chosen.collect()} == {(i, k) for k in wanted for _, i in wanted[k]}
    assert counts == {k: sum(r[0] % 2 == k for r in free) for k in (0, 1)}
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Window" not in plan


def test_a_hot_labelled_id_is_learnt_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y, w: seen.append(len(x)) or ([(0.0, 1.0)] * 5, [0.0] * 6))
    texts = [(i, f"text number {chr(97 + i % 26)} of class {'bad' if i % 2 else 'good'}") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    for copies in (1, 200):
        docs = spark.createDataFrame(texts + texts[:2] * (copies - 1), "doc_id long, text string")
        toxicity.fit(docs, labels)
    assert seen[0] == seen[1] > 0


def test_very_long_text_counts_whole(spark):
    labels = table(spark, SF, "labels")
    docs = table(spark, SF, "documents").select("doc_id", "text")
    long = "the house and the water " * 100_000
    extra = spark.createDataFrame([(-1, long), (-2, long + long), (-3, long)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.unionByName(extra), labels).collect()}
    assert got[-1] == got[-3] and 0 <= got[-2] <= 1
