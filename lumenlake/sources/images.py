"""Pictures decoded by Spark's own image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators.grid import image_grids, perceptual_hashes


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """``(path, width, height, n_channels, data)`` of readable pictures."""
    return (
        spark.read.format("image").option("dropInvalid", "true")
        .option("recursiveFileLookup", "true").load(root)
        .select(
            F.regexp_replace("image.origin", "^file:/+", "/").alias("path"),
            F.col("image.width").alias("width"),
            F.col("image.height").alias("height"),
            F.col("image.nChannels").alias("n_channels"),
            F.col("image.data").alias("data"),
        )
    )


def hash_images(images: DataFrame) -> DataFrame:
    """``(path, perceptual_hash)`` of decoded pictures."""
    grids = image_grids(images).withColumnRenamed("path", "id")
    return perceptual_hashes(grids).withColumnRenamed("id", "path")
