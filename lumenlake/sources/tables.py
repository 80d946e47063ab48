"""Catalogues and logs derived from the driver tables.

The tables hold no media files, so the missing attributes are functions of the
row's own columns, the same ones the oracle SQL uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.constants import TAG_DATE, TAG_HEIGHT, TAG_MODEL, TAG_WIDTH
from lumenlake.functions.hashing import md5_hex, sha256_hex
from lumenlake.functions.numbers import div
from lumenlake.session import use_utc
from lumenlake.sources.files import gate_hashes, metadata_candidates

# Fixed values, shared with the oracle SQL.
EXTENSIONS = [
    "jpg", "jpeg", "png", "heic", "tif", "raw", "cr2", "nef", "mp4", "mov", "3gp", "webm",
    "txt", "pdf",
]
CAMERAS = ["Canon EOS 5D", "NIKON: D850", "A/B\\C*?", "  Pixel 8  ", "???", None]
HASH_NOISE = [0x0, 0xFF, 0xFFFF, 0x1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, k: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(k, F.lit(len(values))).cast("int"))


def media_docs(spark: SparkSession, sf_dir: str, hash_limit: int | None = None) -> DataFrame:
    """A catalogue over ``documents``: one file per document."""
    k = F.col("doc_id")
    ext = _pick(EXTENSIONS, k)
    name = F.concat(
        F.when(F.pmod(div(k, 70), F.lit(2)) == 0, "IMG_").otherwise("img_"),
        F.lpad(F.pmod(k, F.lit(70)).cast("string"), 4, "0"), F.lit("."), ext,
    )
    family = F.conv(F.substring(F.md5(div(k, 4).cast("string")), 1, 16), 16, -10).cast("long")
    known = F.pmod(k, F.lit(7)) != 0
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        k.alias("pos"),
        k.cast("string").alias("id"),
        F.concat(
            F.lit("/media/"), F.col("source"), F.lit("/"), k.cast("string"), F.lit("/"), name
        ).alias("path"),
        name.alias("file_name"),
        F.octet_length(text).cast("long").alias("file_size"),
        ext.alias("extension"),
        md5_hex(text).alias("md5_hash"),
        sha256_hex(text).alias("sha256_hash"),
        family.bitwiseXOR(_pick(HASH_NOISE, k).cast("long")).alias("perceptual_hash"),
        F.when(
            F.pmod(k, F.lit(5)) != 0,
            F.timestamp_seconds(F.lit(1704067200) + k * 3600),
        ).alias("date_taken"),
        F.when(known, F.lit(640) + F.pmod(k, F.lit(100))).cast("long").alias("width"),
        F.when(known, F.lit(480) + F.pmod(k, F.lit(50))).cast("long").alias("height"),
        _pick(CAMERAS, k).alias("camera_model"),
        F.lit(False).alias("is_blurry"),
        F.lit(False).alias("is_burst_leader"),
        F.current_timestamp().alias("indexed_at"),
        text.alias("content"),
    )
    if hash_limit is not None:
        rows = gate_hashes(rows, F.col("content"), hash_limit)
    return rows.drop("content")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, quality, toxic)`` of the documents that carry labels."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pos"), "quality", "toxic"
    )


def existing_destinations(
    spark: SparkSession, sf_dir: str, files: DataFrame, destination: Column
) -> DataFrame:
    """Manifest of files already laid out: those of the documents labelled good."""
    good = labelled(spark, sf_dir).filter(F.col("quality") == 1).select("pos")
    return files.join(good, "pos", "left_semi").select(destination.alias("destination"))


def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are gone: those of the documents labelled toxic."""
    return labelled(spark, sf_dir).filter(F.col("toxic") == 1).select("pos")


def tag_rows(files: DataFrame) -> DataFrame:
    """Tag rows ``(path, tag, value)`` of the files whose metadata is read.

    Some also have a tag that the catalogue does not use, and some only that one.
    """
    usual, other = F.pmod("pos", F.lit(11)) != 0, F.pmod("pos", F.lit(3)) == 0
    values = F.array(
        _tag(TAG_DATE, F.when(usual, F.date_format("date_taken", "yyyy:MM:dd HH:mm:ss"))),
        _tag(TAG_WIDTH, F.when(usual, F.col("width").cast("string"))),
        _tag(TAG_HEIGHT, F.when(usual, F.col("height").cast("string"))),
        _tag(TAG_MODEL, F.when(usual, F.col("camera_model"))),
        _tag("Software", F.when(~usual | other, F.lit("1.0"))),
    )
    return (
        metadata_candidates(files).select("path", F.inline(values))
        .filter(F.col("value").isNotNull())
    )


def _tag(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("tag"), value.alias("value"))


def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 grids over ``embeddings``: components scaled from -1..1 to 0..255."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pos"),
        F.col("vec_id").cast("string").alias("id"),
        F.transform(
            "embedding",
            lambda v: F.floor(
                (F.greatest(F.least(v.cast("double"), F.lit(1.0)), F.lit(-1.0)) + 1.0) * 127.5
            ).cast("int"),
        ).alias("cells"),
    )


def pixel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16x16 picture per vector, as pixel rows."""
    xs = F.sequence(F.lit(0), F.lit(15))
    grid = vector_cells(spark, sf_dir).select(
        "id", "cells", F.explode(xs).alias("x")
    ).select("id", "cells", "x", F.explode(xs).alias("y"))
    at = F.shiftright("y", 1) * 8 + F.shiftright("x", 1)
    return grid.select(
        "id", F.lit(16).alias("width"), F.lit(16).alias("height"), "x", "y",
        (F.get("cells", at) + F.pmod(F.col("x") + F.col("y"), F.lit(2)) * 4).alias("luma"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processing log over ``events``: one run per event type."""
    return table(spark, sf_dir, "events").select(*run_log_columns())


def run_log_columns() -> list[Column]:
    return [
        F.col("event_type").alias("scan_id"),
        F.col("event_id").cast("string").alias("current_file"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
    ]
