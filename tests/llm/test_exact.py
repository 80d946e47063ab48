from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.llm import exact
from lumenlake.scratch import new_path


def _by_id(df):
    return sorted(tuple(r)[:4] for r in df.collect())


ROWS = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (4, "a b"), (1, None), (3, ""), (6, " "), (8, "x")]
WANTED = [
    (1, 1, 2, True), (2, 2, 3, True), (3, 1, 2, False), (4, 4, 1, True), (5, 2, 3, False), (6, 6, 1, True),
    (8, 8, 1, True), (9, 2, 3, False),
]


def test_groups(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("key", F.lit("clash"))
    assert _by_id(exact.exact_duplicates(docs)) == WANTED


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for digest in (lambda t: F.lit("same"), lambda t: F.length(t).cast("string")):
        assert _by_id(exact.exact_duplicates(docs, digest=digest)) == WANTED


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "a", "k"), (1, "a", "k"), (2, "a", "k"), (None, "b", "k"), (None, "c", "k"), (7, "c", "k")],
        "doc_id long, text string, _own string",
    )
    found = [tuple(r)[:4] for r in exact.exact_duplicates(docs).collect()]
    assert sorted(map(str, found)) == sorted(map(str, [
        (1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (None, None, 1, True), (None, 7, 2, False), (7, 7, 2, True),
    ]))
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, "a", "k"), (None, "b", "k"), (7, "c", "k")]))
    assert exact.exact_duplicates(docs.limit(0)).count() == 0
    assert exact.drop_duplicates(docs.limit(0)).count() == 0


def test_state_goes_on_with_new_arrivals(spark):
    schema = "key string, doc_id long, octets long, locator string"
    folder, state, out = (new_path(spark, n) for n in ("in", "state", "seen"))
    spark.createDataFrame([("k", 5, 1, "f#5"), ("m", 6, 1, "f#6")], schema).write.parquet(folder)
    parsed = spark.read.parquet(folder).schema
    exact.update_state(spark, folder, parsed, state, out)
    spark.createDataFrame([("k", 3, 1, "f#3")], schema).write.mode("append").parquet(folder)
    assert exact.update_state(spark, folder, parsed, state, out) >= 1
    got = {r["key"]: (r["keep_id"], r["arrived"], r["keep_locator"]) for r in exact.latest(spark, out, "bigint").collect()}
    assert got == {"k": (3, 2, "f#3"), "m": (6, 1, "f#6")}


def test_only_ids_that_go_are_joined(spark):
    long = "a long text of many words " * 50_000
    rows = [(i, f"text {i % 90}", "k") for i in range(100)] + [(200, long, "k"), (201, long + "x", "k"), (202, long, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = exact.drop_duplicates(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" not in plan and "sha2" not in plan
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(90), 200, 201]


def test_ids_shared_by_texts_that_stay_and_go(spark):
    rows = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "c"), (None, "c"), (None, "d"), (None, "d"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("clash"))
    found = sorted(map(str, (tuple(r)[:2] for r in exact.drop_duplicates(docs).collect())))
    assert found == sorted(map(str, [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)]))
