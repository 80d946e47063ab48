"""Exact duplicates by a stateful stream.

A stream of arrivals (digest, id, length, locator) feeds a keyed aggregate whose
state lives on disk (RocksDB) and never expires.  Per digest it retains the
smallest id seen, the locator of that row's content and the number of arrivals.
Aggregation combines within each task before the shuffle, so a text that a third
of all rows share is a few rows per task.  The checkpoint lets a later run go on
with new arrivals only.

A digest that was hit more than once is only a proposal: the texts of its rows
are compared in full with the text found at the locator.  Rows whose bytes differ
go to a further round under a digest of their own, until no row is left; any
digest gives right results, a better one fewer rounds.

Texts are equal when identical after turning each run of ASCII white space into
one space; nulls count as empty.  Rows that share id and text are one document
listed several times: all listings are returned with the same values and all are
counted.  A null id is larger than any other.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.common import WHITE, text_or_empty
from lumenlake.scratch import new_path, store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A partition is closed after its task: kept open, each holds some 4 MB of disk.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # Partitions of one executor share this much native memory.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalized(text_column: str) -> Column:
    return F.regexp_replace(text_or_empty(text_column), WHITE, " ")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def update_state(spark: SparkSession, arrivals: str, schema, checkpoint: str, out: str) -> int:
    """Run what has newly arrived in the folder ``arrivals`` through the keyed state.

    Every digest touched gives a row in ``out/batch=N``: digest, first id with its
    length and locator, and the arrivals so far.  A batch that is repeated after a
    failure overwrites its own folder.  Returns the number of batches run.
    """
    batches: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "octets", "locator")
    seen = (
        spark.readStream.schema(schema).parquet(arrivals).groupBy("key")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("arrived"))
    )
    with _settings(spark, STATE_SETTINGS):
        (
            seen.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
        )
    return len(batches)


def latest(spark: SparkSession, out: str, id_type: str) -> DataFrame:
    """Per digest, the state as of the last batch that touched it."""
    first = f"first struct<none: boolean, doc_id: {id_type}, octets: bigint, locator: string>"
    rows = spark.read.schema(f"key string, {first}, arrived long, batch long").parquet(out)
    state = rows.groupBy("key").agg(F.max_by(F.struct("first", "arrived"), "batch").alias("s"))
    return state.select(
        "key",
        F.col("s.first.doc_id").alias("keep_id"),
        F.col("s.first.locator").alias("keep_locator"),
        F.col("s.arrived").alias("arrived"),
    )


def _other_bytes(rows: DataFrame, arrived: DataFrame, groups: DataFrame) -> DataFrame:
    """Of ``rows (key, doc_id, text_sha256, text)``, those that share a digest but not
    the bytes of the row that the state retains for it.

    The ids of hits come from the arrivals; only texts with such an id are moved, and
    each is compared with the text that the retained row's id locates.
    """
    hit = groups.filter("arrived > 1").select("key", "keep_id")
    ids = store(arrived.join(hit, "key").select("doc_id").distinct(), "dedup-ids")
    named = rows.join(ids.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    hits = store(named.join(hit, "key"), "dedup-hits")
    located = hits.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    texts = store(located.groupBy("key").agg(F.min("text").alias("keep_text")), "dedup-texts")
    return store(hits.join(texts, "key").filter("text != keep_text").drop("keep_id", "keep_text"), "dedup-other")


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, keep_locator``: one row per
    input row.  ``digest`` maps the normalised text to a string; SHA-256 by default.
    """
    spark = docs.sparkSession
    text = normalized(text_column)
    sha = F.sha2(text.cast("binary"), 256)
    columns = [
        (sha if digest is None else digest(text)).alias("key"),
        F.col(id_column).alias("doc_id"),
        sha.alias("text_sha256"),
    ]
    octets = F.octet_length("text").cast("long").alias("octets")
    locator = F.concat_ws("#", F.input_file_name(), F.col(id_column).cast("string")).alias("locator")
    rows = docs.select(*columns, text.alias("text"))
    arrivals = docs.select(*columns, F.octet_length(text).cast("long").alias("octets"), locator)

    parts: list[DataFrame] = []
    while True:
        source = new_path(spark, "dedup-arrivals")
        arrivals.write.parquet(source)
        arrived = spark.read.schema(arrivals.schema).parquet(source)
        out = new_path(spark, "dedup-seen")
        if not update_state(spark, source, arrivals.schema, new_path(spark, "dedup-state"), out):
            return arrived.select(
                "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                F.lit(True).alias("kept"), "text_sha256", F.col("locator").alias("keep_locator"),
            )
        id_type = arrivals.schema["doc_id"].dataType.simpleString()
        groups = store(latest(spark, out, id_type), "dedup-groups")
        other = _other_bytes(rows, arrived, groups)
        collided = not other.isEmpty()
        if collided:
            # Those rows leave their groups and are settled in a further round.
            less = other.groupBy("key").agg(F.count("*").alias("less"))
            groups = groups.join(less, "key", "left").withColumn(
                "arrived", F.col("arrived") - F.coalesce("less", F.lit(0))
            )
            same = [arrived[c].eqNullSafe(other[c]) for c in ("key", "doc_id", "text_sha256")]
            arrived = arrived.join(other, same, "left_anti")
        parts.append(
            arrived.join(groups, "key").select(
                "doc_id", "keep_id", F.col("arrived").alias("group_size"),
                F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "keep_locator",
            )
        )
        if not collided:
            break
        rows = other
        arrivals = other.select(
            "key", "doc_id", "text_sha256", octets, F.col("doc_id").cast("string").alias("locator")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    decided = store(exact_duplicates(docs, id_column, text_column).select("doc_id", "text_sha256", "kept"), "dedup-kept")
    per_id = decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays"))
    # Ids with one row that stays, nearly all as a rule, are in no join's list.
    apart = store(per_id.filter("n > 1 OR NOT stays").select(F.col("doc_id").alias("_id"), "stays"), "dedup-apart")
    out = docs.join(apart, docs[id_column].eqNullSafe(apart["_id"]), "left_anti")
    several = apart.filter("stays").select("_id")
    if several.isEmpty():
        return out
    # Rows that share an id are told apart by their texts.
    own = "_own"
    while own in docs.columns:
        own += "_"
    keep = decided.filter("kept").join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").distinct()
    shared = docs.join(several, docs[id_column].eqNullSafe(several["_id"]), "left_semi")
    shared = shared.withColumn(own, F.sha2(normalized(text_column).cast("binary"), 256))
    on = shared[id_column].eqNullSafe(keep["doc_id"]) & (shared[own] == keep["text_sha256"])
    return out.unionByName(shared.join(keep, on, "left_semi").dropDuplicates([id_column, own]).drop(own))
