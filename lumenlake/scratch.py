"""Intermediate tables in the cluster's shared folder.

Jobs that run in steps write each step as Parquet and read it back.  That cuts
the lineage (a lost executor costs a re-read, not a re-run of every step),
keeps column pruning for the next step, and fixes the row order and row numbers
of a step once and for all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_roots: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables, removed when its JVM ends.

    The place is the session's ``spark.checkpoint.dir``, else the folder set with
    ``SparkContext.setCheckpointDir``, else one beside the warehouse.  The last is
    refused on a cluster if it lies on a machine's own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"
        if not is_shared(spark.sparkContext.master, shared):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    root = f"{shared.rstrip('/')}/lumenlake-{spark.sparkContext.applicationId}"
    if root not in _roots:
        system, folder = _at(spark, root)
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _roots.add(root)
    return root


def is_shared(master: str, path: str) -> bool:
    """Whether all machines of ``master`` see one and the same ``path``."""
    one_machine = master == "local" or master.startswith("local[")
    return one_machine or ("://" in path and not path.startswith("file:"))


def finished(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers n, ascending, of the complete tables ``path/key=n``: those whose write was committed."""
    system, folder = _at(spark, path)
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    numbers = [int(name[len(key) + 1:]) for name in names if name.startswith(f"{key}=")]
    return sorted(n for n in numbers if system.exists(_at(spark, f"{path}/{key}={n}/_SUCCESS")[1]))


def remove(spark: SparkSession, path: str) -> None:
    system, folder = _at(spark, path)
    system.delete(folder, True)


def _at(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame over the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def store_observed(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """:func:`store`, with aggregates taken while writing."""
    seen = Observation()
    stored = store(df.observe(seen, *[value.alias(k) for k, value in facts.items()]), name)
    return stored, seen.get


def store_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """:func:`store`, with the number of rows counted while writing."""
    stored, seen = store_observed(df, name, n=F.count(F.lit(1)))
    return stored, seen["n"]


def drop_table(stored: DataFrame) -> None:
    """Delete a table of :func:`store` that no later step reads."""
    system, folder = _at(stored.sparkSession, stored.scratch_path)
    system.delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables once results are saved."""
    system, folder = _at(spark, scratch_root(spark))
    system.delete(folder, True)
