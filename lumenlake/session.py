"""Session set-up and the settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that make sense from one machine to a large cluster.  The first
# shuffle count is deliberately high and AQE merges what turns out small.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Sort-merge joins whose partitions turn out small become hash joins.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "lumenlake", **settings: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; master and sizes come from the caller
    (``spark-submit`` or keyword settings such as ``master="local[8]"``)."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    master = settings.pop("master", None)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Catalogue timestamps are UTC; calendar parts are taken in session time."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
