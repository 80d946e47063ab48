"""Exact, same-name and similar groups in a catalogue.

Groups and their members are flat tables, so a group may be of any size.
Members are found by attaching the small group table to the rows, with big
groups split over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import EXACT, NAME_MATCH, SIMILAR, SIMILARITY_THRESHOLD
from lumenlake.functions.classify import is_image
from lumenlake.functions.numbers import div
from lumenlake.functions.text import name_key
from lumenlake.operators.leaders import leader_clusters
from lumenlake.operators.numbering import with_row_number
from lumenlake.operators.skew import HOT_ROWS, attach
from lumenlake.scratch import store_counted

GROUP_COLUMNS = [
    "group_id", "duplicate_type", "hash", "n_files", "wasted_space", "removable_count",
]
MEMBER_COLUMNS = [
    "group_id", "duplicate_type", "n_files", "max_size", "best_pos",
    "pos", "id", "path", "file_name", "file_size", "date_taken",
]
# The file to keep in a group, as a mergeable aggregate.
BEST_COLUMNS = ["first", "latest"]


@dataclass(frozen=True)
class Duplicates:
    """Result of :func:`find_duplicates`.  Members are joined up when asked for."""

    groups: DataFrame
    best: DataFrame
    """``group_id, duplicate_type, n_files, best_pos``: the file to keep."""
    totals: DataFrame
    files: DataFrame
    images: SimilarImages

    @property
    def members(self) -> DataFrame:
        """Files of all groups."""
        return self.deletable.unionByName(name_members(self.files))

    @property
    def deletable(self) -> DataFrame:
        """Files of the groups from which files may be deleted: not of same-name groups."""
        return exact_members(self.files).unionByName(similar_members(self.files, self.images))


def _sizes() -> list:
    size, back = F.col("file_size"), -F.col("pos")
    return [
        F.count("*").alias("n_files"),
        F.sum(size).alias("total_size"),
        F.max(size).alias("max_size"),
        # Of the files of the greatest size: the first, and the first of the latest date.
        F.max(F.struct(size.alias("size"), back.alias("back"), F.col("date_taken").alias("day"))).alias("first"),
        F.max(F.struct(size.alias("size"), F.col("date_taken").alias("day"), back.alias("back"))).alias("latest"),
    ]


def best_pos() -> Column:
    """The file to keep (WIN1).

    The rule is a walk in input order: a larger file wins; at equal size a later
    one wins only if both have a capture date and its date is later.  So among the
    files of the greatest size: if the first has no date it stays, else the first
    one with the latest date wins.
    """
    kept = F.when(F.col("first.day").isNull(), F.col("first.back")).otherwise(F.col("latest.back"))
    return -kept


def _described(
    grouped: DataFrame, kind: str, group_id, digest, removable, *more: str
) -> DataFrame:
    """Group rows: everything but the largest file counts as wasted (AGG3)."""
    return grouped.select(
        group_id.alias("group_id"),
        F.lit(kind).alias("duplicate_type"),
        digest.cast("string").alias("hash"),
        "n_files",
        (F.col("total_size") - F.col("max_size")).alias("wasted_space"),
        removable.cast("long").alias("removable_count"),
        "max_size",
        best_pos().alias("best_pos"),
        "key",
        *more,
    )


def _exact(files: DataFrame) -> DataFrame:
    grouped = (
        files.filter(F.col("sha256_hash").isNotNull())
        .groupBy(F.col("sha256_hash").alias("key")).agg(*_sizes())
        .filter(F.col("n_files") > 1)
    )
    return _described(
        grouped, EXACT, F.concat(F.lit("exact:"), F.col("key")), F.col("key"),
        F.col("n_files") - 1,
    )


def _same_name(files: DataFrame) -> DataFrame:
    # The distinct count first reduces to (name, content) pairs over all tasks,
    # so a name shared by very many files is no bottleneck.
    grouped = (
        files.groupBy(name_key(F.col("file_name")).alias("key"))
        .agg(*_sizes(), F.countDistinct("sha256_hash").alias("contents"))
        .filter((F.col("n_files") > 1) & (F.col("contents") > 1))
    )
    return _described(
        grouped, NAME_MATCH, F.concat(F.lit("name:"), F.col("key")), F.lit(None), F.lit(0)
    )


def exact_groups(files: DataFrame) -> DataFrame:
    """Files with the same SHA-256, two or more (AGG1)."""
    return _exact(files).select(*GROUP_COLUMNS)


def name_groups(files: DataFrame) -> DataFrame:
    """Files with the same name, letter case aside, and more than one content (AGG2)."""
    return _same_name(files).select(*GROUP_COLUMNS)


def similarity_candidates(files: DataFrame) -> DataFrame:
    """Images that have a perceptual hash (FIL5)."""
    return files.filter(F.col("perceptual_hash").isNotNull() & is_image(F.col("extension")))


def distinct_hashes(files: DataFrame) -> DataFrame:
    """One row per perceptual hash, at the place of its first file.

    Copies of a hash see the same neighbours, so they always end up in the group
    of the first one; clustering distinct hashes loses nothing.
    """
    return files.groupBy(F.col("perceptual_hash").alias("h")).agg(
        F.min("pos").alias("pos"), *_sizes()
    )


@dataclass(frozen=True)
class SimilarImages:
    """Groups of similar images (with their number of distinct hashes), and the
    hashes that belong to each."""

    groups: DataFrame
    hashes: DataFrame


def cluster_images(
    files: DataFrame, threshold: int = SIMILARITY_THRESHOLD, **options
) -> SimilarImages:
    """Leader clustering of the candidate images (ITR1, AGG4)."""
    hashes, n = store_counted(distinct_hashes(similarity_candidates(files)), "distinct")
    follows = leader_clusters(hashes, threshold, n, **options)
    led = hashes.join(follows, "pos", "left").withColumn(
        "leader", F.coalesce("leader", "pos")
    )
    grouped = (
        led.groupBy(F.col("leader").alias("key")).agg(
            F.sum("n_files").alias("n_files"),
            F.sum("total_size").alias("total_size"),
            F.max("max_size").alias("max_size"),
            *[F.max(c).alias(c) for c in BEST_COLUMNS],
            F.count("*").alias("n_hashes"),
        )
        .filter(F.col("n_files") > 1)
    )
    groups = _described(
        grouped, SIMILAR, F.concat(F.lit("similar:"), F.col("key").cast("string")),
        F.lit(None), F.col("n_files") - 1, "n_hashes",
    )
    return SimilarImages(
        groups,
        led.select("h", F.col("leader").alias("key"), F.col("n_files").alias("n_copies")),
    )


def similar_groups(
    files: DataFrame, threshold: int = SIMILARITY_THRESHOLD, **options
) -> DataFrame:
    """Images around a leader, two or more."""
    return cluster_images(files, threshold, **options).groups.select(*GROUP_COLUMNS)


def exact_members(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    groups = _exact(files).withColumnRenamed("key", "sha256_hash")
    return attach(
        files.filter(F.col("sha256_hash").isNotNull()), groups, "sha256_hash", "n_files",
        F.col("pos"), hot_rows=hot_rows,
    ).select(*MEMBER_COLUMNS)


def name_members(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return attach(
        files.withColumn("key", name_key(F.col("file_name"))), _same_name(files),
        "key", "n_files", F.col("pos"), hot_rows=hot_rows,
    ).select(*MEMBER_COLUMNS)


def similar_members(
    files: DataFrame, images: SimilarImages, hot_rows: int = HOT_ROWS
) -> DataFrame:
    grouped = attach(
        images.hashes, images.groups, "key", "n_hashes", F.col("h"), hot_rows=hot_rows
    ).withColumnRenamed("h", "perceptual_hash")
    return attach(
        similarity_candidates(files), grouped, "perceptual_hash", "n_copies",
        F.col("pos"), hot_rows=hot_rows,
    ).select(*MEMBER_COLUMNS)


def best_of_groups(groups: DataFrame) -> DataFrame:
    """``group_id, duplicate_type, n_files, best_pos`` of described groups."""
    return groups.select("group_id", "duplicate_type", "n_files", "best_pos")


def totals(groups: DataFrame) -> DataFrame:
    """One row: wasted bytes of exact and similar groups, group counts (AGG5, AGG6).

    Name matches do not count as waste; a file in both an exact and a similar
    group counts in both.
    """
    kind = F.col("duplicate_type")
    return groups.agg(
        F.coalesce(F.sum(F.when(kind != NAME_MATCH, F.col("wasted_space"))), F.lit(0))
        .cast("long").alias("total_wasted_space"),
        F.count("*").alias("total_groups"),
        F.count_if(kind == EXACT).alias("exact_groups"),
        F.count_if(kind == SIMILAR).alias("similar_groups"),
        F.count_if(kind == NAME_MATCH).alias("name_groups"),
    )


def of_type(rows: DataFrame, kind: str | None) -> DataFrame:
    """Groups or members of one kind, or all (FIL6)."""
    return rows if kind in (None, "all") else rows.filter(F.col("duplicate_type") == kind)


def find_duplicates(
    files: DataFrame, threshold: int = SIMILARITY_THRESHOLD, **options
) -> Duplicates:
    """The three kinds of groups with members and totals (DUP1, SET3)."""
    images = cluster_images(files, threshold, **options)
    parts = [g.select(*GROUP_COLUMNS, "best_pos") for g in (_exact(files), images.groups, _same_name(files))]
    groups = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return Duplicates(groups.select(*GROUP_COLUMNS), best_of_groups(groups), totals(groups), files, images)


def nested_groups(members: DataFrame, chunk: int = 1000) -> DataFrame:
    """Members as lists in input order, at most ``chunk`` per row (ARR1).

    A group longer than that continues in further rows (``chunk_no`` 0, 1, ...),
    so no group has to fit into one row.
    """
    ranked = with_row_number(members, ["group_id"], ["pos"], "place")
    numbered = ranked.withColumn("chunk_no", div(F.col("place") - 1, chunk))
    return numbered.groupBy("group_id", "duplicate_type", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "file_name", "file_size")))
        .alias("files")
    )


def flatten_groups(nested: DataFrame) -> DataFrame:
    """One row per file of nested groups (ARR2)."""
    return nested.select("group_id", "duplicate_type", "chunk_no", F.inline("files"))
