"""From documents to packed sequences, in stages that are each written and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import exact, language, packing, pii, simhash
from lumenlake.llm.common import table
from lumenlake.scratch import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; ``lang`` becomes that language.

    Only the exceptions are joined: ids that go, and ids whose language is not the
    declared one.  Rows that share an id go if all of them are rejected.
    """
    found = language.detect(docs, declared="lang", address="source")
    per_id = found.groupBy("doc_id").agg(
        F.max("kept").alias("_kept"), F.min(F.when(F.col("kept"), F.col("lang"))).alias("_lang"),
        F.min("declared").alias("low"), F.max("declared").alias("high"),
    )
    odd = per_id.filter("NOT _kept OR _lang <> low OR low <> high")
    changes = store(odd.select(F.col("doc_id").alias("_id"), "_kept", "_lang"), "stage-lang")
    joined = docs.join(changes, docs["doc_id"].eqNullSafe(changes["_id"]), "left").filter(
        F.coalesce(changes["_kept"], F.lit(True))
    )
    stated = language.declared_language(docs["lang"])
    return joined.select(
        *[F.coalesce(changes["_lang"], stated).alias("lang") if c == "lang" else docs[c] for c in docs.columns]
    )


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document that names it.

    Only the ids that go are joined.  Rows that share an id stay if one of them
    names a group; rows without an id cannot be told apart and stay.
    """
    per_id = simhash.near_duplicates(docs).groupBy("doc_id").agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("names")
    )
    gone = store(per_id.filter("NOT names").select(F.col("doc_id").alias("_id")), "stage-near")
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii", redact_pii),
    ("packing", pack),
]

#: Fingerprints, language scores and best-fit bins are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
