"""Library statistics, previews, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.constants import PREVIEW_FILES, PREVIEW_HASHES
from lumenlake.functions.classify import scan_category
from lumenlake.functions.display import format_megabytes, format_size
from lumenlake.functions.numbers import div
from lumenlake.functions.text import hash_prefix
from lumenlake.operators.numbering import with_row_number


def library_stats(files: DataFrame) -> DataFrame:
    """Files, bytes and hashed files of a library (AGG7)."""
    return files.agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        F.count("md5_hash").alias("n_hashed"),
    ).withColumn("total_size", format_size(F.col("total_bytes")))


def hash_coverage(files: DataFrame) -> DataFrame:
    """How many files have which digest (AGG8)."""
    return files.agg(
        F.count("*").alias("n_files"),
        F.count("sha256_hash").alias("with_sha256"),
        F.count("md5_hash").alias("with_md5"),
    )


def category_summary(files: DataFrame) -> DataFrame:
    """Images and videos by the scan lists, with total size (AGG9)."""
    return (
        files.withColumn("category", scan_category(F.col("extension")))
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count("*").alias("n_files"), F.sum("file_size").alias("total_bytes"))
        .withColumn("total_size", format_megabytes(F.col("total_bytes")))
    )


def preview_hashes(files: DataFrame, n: int = PREVIEW_HASHES) -> DataFrame:
    """First files with the start of their digest (LIM1, STR10)."""
    return (
        files.select("pos", "file_name", hash_prefix(F.col("sha256_hash")).alias("hash_prefix"))
        .orderBy("pos").limit(n)
    )


def preview_files(files: DataFrame, n: int = PREVIEW_FILES) -> DataFrame:
    """First files with their size; ``n_more`` counts the files not shown (LIM4)."""
    total = files.agg(F.count("*").alias("n"))
    return (
        files.select("pos", "path", "file_size").orderBy("pos").limit(n)
        .withColumn("n_more", F.greatest(total.scalar() - n, F.lit(0)))
    )


def pages(files: DataFrame, size: int) -> DataFrame:
    """Rows with page number and place on the page, both from 0 (WIN5)."""
    placed = with_row_number(files, [], ["pos"], "place")
    index = F.col("place") - 1
    return placed.withColumn("page", div(index, size)).withColumn(
        "slot", F.pmod(index, F.lit(size))
    ).drop("place")


def write_pages(files: DataFrame, path: str) -> None:
    """Store rows in the order of ``pos`` so that any page can be read by itself.

    The rows are sorted by range over the cluster; each range is a folder, and each row
    keeps its place in its range.  A small table says which row number each range begins
    with; it has a row per range.
    """
    ordered = files.sort("pos").withColumns({
        "range_no": F.spark_partition_id(),
        "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
    })
    ordered.write.partitionBy("range_no").parquet(f"{path}/rows")
    counts = files.sparkSession.read.parquet(f"{path}/rows").groupBy("range_no").agg(F.count("*").alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{path}/offsets")


def read_page(spark: SparkSession, path: str, page: int, size: int) -> DataFrame:
    """One page of stored rows, with ``page`` and ``slot`` as :func:`pages` gives them; a
    negative page counts from the end.  Only ranges that the page touches are read."""
    offsets = spark.read.parquet(f"{path}/offsets")
    if page < 0:
        total = offsets.agg(F.sum("n")).first()[0] or 0
        page += -(-total // size)
    low = page * size
    # At most ``size`` ranges, as none is empty.
    touched = offsets.filter((F.col("first") < low + size) & (F.col("first") + F.col("n") > low)).collect()
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("range_no").isin([r["range_no"] for r in touched]))
    wanted, number = F.lit(False), F.lit(None).cast("long")
    for r in touched:
        own = F.col("range_no") == r["range_no"]
        wanted = wanted | (own & F.col("place").between(low - r["first"], low + size - 1 - r["first"]))
        number = F.when(own, F.col("place") + r["first"]).otherwise(number)
    return rows.filter(wanted).withColumns({
        "page": F.lit(page).cast("long"), "slot": number - low,
    }).drop("range_no", "place")


def select_range(files: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows from one file to another in input order, either way round (WIN4).

    ``ends`` holds the ids of the two files.
    """
    bounds = files.join(ends.select("id"), "id", "left_semi").agg(
        F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    return files.filter(
        (F.col("pos") >= bounds.select("low").scalar())
        & (F.col("pos") <= bounds.select("high").scalar())
    )
