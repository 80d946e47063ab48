"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.constants import PRESETS
from lumenlake.functions import classify, display, text
from lumenlake.functions.dates import parse_capture_time
from lumenlake.functions.hashing import average_hash, hex16
from lumenlake.operators import keysets
from lumenlake.operators.grid import perceptual_hashes, reduce_grid, resample_grid
from lumenlake.operators.leaders import leader_clusters
from lumenlake.operators.near import HOT_BUCKET, choose_bands, near_pairs
from lumenlake.operators.tags import project_tags, with_metadata
from lumenlake.plans import duplicates as dup
from lumenlake.plans import organize, retention, stats
from lumenlake.schema import MEDIA_FILE, from_json_rows, to_json_rows, with_defaults
from lumenlake.scratch import new_path, store, store_counted
from lumenlake.sources import tables
from lumenlake.sources.files import build_catalog, gated_tags, metadata_candidates, write_files
from lumenlake.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(2024, 6, 15)
DESTINATION = "/library"
GATE = 20_000
TAG_GATE = 2_000
SCAN_GATE = 3_000
PATTERN = "{year}/{month}-{day}/{camera}/{type}"
ROOTED_PATTERN = "/archive/{type}/{year}"
VECTOR_THRESHOLD = 18
DENSE = {"hot_bucket": 16, "patient_rounds": 1, "block_pairs": 500}
PAGE = 48
CHUNK = 25

QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    """Register under the function's name, less a trailing underscore."""
    QUERIES[query.__name__.rstrip("_")] = query
    return query


docs = tables.media_docs


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as a stored table, for queries that read it several times:
    contents are hashed once, later steps read the few columns they need."""
    return store(docs(spark, sf_dir), "catalog")


# Duplicates -----------------------------------------------------------------

@register
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.exact_groups(docs(spark, sf_dir))


@register
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.name_groups(docs(spark, sf_dir)).drop("hash")


@register
def gated_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.exact_groups(docs(spark, sf_dir, GATE))


@register
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docs(spark, sf_dir).filter(F.col("perceptual_hash").isNotNull())
    hashes, n = store_counted(dup.distinct_hashes(files).select("h", "pos"), "distinct")
    return near_pairs(
        hashes, hashes, 10, choose_bands(n, n, 10), same_input=True,
        hot_bucket=HOT_BUCKET if n > HOT_BUCKET else None,
    )


@register
def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.similar_groups(docs(spark, sf_dir)).drop("hash")


@register
def similar_groups_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same groups by way of second bands, split lists and blocks, as dense inputs take it."""
    return dup.similar_groups(docs(spark, sf_dir), **DENSE).drop("hash")


@register
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = (
        tables.vector_cells(spark, sf_dir)
        .select(average_hash(F.col("cells")).alias("h"), "pos")
        .groupBy("h").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    )
    hashes, n = store_counted(hashes, "vectors")
    follows = leader_clusters(hashes, VECTOR_THRESHOLD, n)
    return (
        hashes.join(follows, "pos", "left")
        .groupBy(F.coalesce("leader", "pos").alias("leader"))
        .agg(F.sum("n").alias("n_files"))
        .filter(F.col("n_files") > 1)
    )


@register
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.find_duplicates(catalog(spark, sf_dir)).groups


@register
def duplicate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.find_duplicates(catalog(spark, sf_dir)).totals


@register
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = dup.find_duplicates(catalog(spark, sf_dir)).members
    return dup.flatten_groups(dup.nested_groups(members, CHUNK))


@register
def name_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = dup.find_duplicates(catalog(spark, sf_dir)).members
    return dup.of_type(members, "nameMatch").select("group_id", "pos", "file_name", "file_size")


# Hashes ---------------------------------------------------------------------

@register
def gated_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, GATE).select("pos", "file_size", "md5_hash", "sha256_hash")


@register
def hash_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hash_coverage(docs(spark, sf_dir, GATE))


@register
def hash_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.preview_hashes(docs(spark, sf_dir))


@register
def average_hash_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.vector_cells(spark, sf_dir).select(
        "pos", hex16(average_hash(F.col("cells"))).alias("phash")
    )


@register
def grid_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = reduce_grid(tables.pixel_grid(spark, sf_dir))
    return grids.select("id", F.posexplode("cells").alias("cell", "mean"))


@register
def grid_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = reduce_grid(tables.pixel_grid(spark, sf_dir))
    return perceptual_hashes(grids).select("id", hex16(F.col("perceptual_hash")).alias("phash"))


@register
def lanczos_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture's grid by Lanczos resampling."""
    grids = resample_grid(tables.pixel_grid(spark, sf_dir))
    return grids.select("id", F.posexplode("cells").alias("cell", "value"))


@register
def lanczos_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average hashes of the resampled grids."""
    grids = resample_grid(tables.pixel_grid(spark, sf_dir))
    return perceptual_hashes(grids).select("id", hex16(F.col("perceptual_hash")).alias("phash"))


# Classification and statistics ----------------------------------------------

@register
def classify_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.file_name(F.col("path"))
    ext = text.extension(name)
    return docs(spark, sf_dir).select(
        "pos", name.alias("name"), ext.alias("ext"),
        text.name_key(name).alias("name_key"),
        classify.is_media(ext).alias("is_media"),
        classify.is_image(ext).alias("is_image"),
        classify.is_video(ext).alias("is_video"),
        classify.type_folder(ext).alias("type_folder"),
    )


@register
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.category_summary(docs(spark, sf_dir))


@register
def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.library_stats(docs(spark, sf_dir, GATE))


@register
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(
        "pos",
        display.format_size(F.col("file_size")).alias("size_text"),
        display.format_size(F.col("file_size") * F.col("pos") * 1000).alias("scaled_text"),
        display.format_megabytes(F.col("file_size")).alias("mb_text"),
        display.format_dimensions(F.col("width"), F.col("height")).alias("dimensions"),
        display.format_day(F.col("date_taken")).alias("day"),
        display.format_eta(F.col("file_size")).alias("eta_text"),
    )


@register
def file_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.preview_files(docs(spark, sf_dir))


@register
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pages(docs(spark, sf_dir).select("pos", "file_name"), PAGE)


@register
def page_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and the last page of stored rows, each read by itself."""
    path = new_path(spark, "pages")
    stats.write_pages(docs(spark, sf_dir).select("pos", "file_name"), path)
    return stats.read_page(spark, path, 1, PAGE).unionByName(stats.read_page(spark, path, -1, PAGE))


@register
def range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the largest to the smallest file, whichever comes first."""
    files = docs(spark, sf_dir)
    order = F.struct("file_size", "pos")
    ends = files.agg(
        F.array(F.max_by("id", order), F.min_by("id", order)).alias("ids")
    ).select(F.explode("ids").alias("id"))
    return stats.select_range(files, ends).select("pos", "file_name")


# Retention ------------------------------------------------------------------

@register
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup.find_duplicates(catalog(spark, sf_dir)).best


@register
def best_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = dup.exact_members(catalog(spark, sf_dir))
    return retention.mark_best(members).select("group_id", "pos", "file_size", "is_best")


@register
def deletion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog(spark, sf_dir)
    doomed = retention.files_to_delete(dup.find_duplicates(files).deletable)
    return retention.deletion_plan(files, doomed).select("pos", "path", "file_size")


@register
def catalog_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog(spark, sf_dir)
    doomed = retention.files_to_delete(dup.find_duplicates(files).deletable)
    return retention.after_deletion(files, doomed).select("pos", "path", "file_size")


@register
def marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog(spark, sf_dir)
    chosen = keysets.all_keys(retention.redundant(dup.exact_members(files)))
    return keysets.mark(files, chosen, "selected").select("pos", "id", "selected")


def _image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keysets.all_keys(metadata_candidates(docs(spark, sf_dir)))


def _copied_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keysets.all_keys(dup.exact_members(catalog(spark, sf_dir)))


@register
def toggle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keysets.toggle_keys(_image_ids(spark, sf_dir), _copied_ids(spark, sf_dir))


@register
def union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keysets.add_keys(_image_ids(spark, sf_dir), _copied_ids(spark, sf_dir))


# Source roots and batches ---------------------------------------------------

@register
def root_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of the English documents, then those of the others, less one."""
    rows = tables.table(spark, sf_dir, "documents").select(
        F.col("source").alias("root"), "doc_id", "lang"
    )

    def roots(of: DataFrame) -> DataFrame:
        return of.groupBy("root").agg(F.min("doc_id").alias("pos")).select("pos", "root")

    joined = keysets.add_roots(
        roots(rows.filter(F.col("lang") == "en")), roots(rows.filter(F.col("lang") != "en"))
    )
    return keysets.remove_root(joined, "src3")


@register
def append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue plus a batch of bare rows from ``pages``."""
    files = with_defaults(docs(spark, sf_dir))
    batch = with_defaults(tables.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pos"), F.col("url").alias("path"),
        F.octet_length("html").alias("file_size"),
    ))
    return keysets.append_batch(files, batch).select(
        "pos", "id", "path", "file_name", "file_size", "extension", "md5_hash", "width",
        "is_blurry", "is_burst_leader",
    )


@register
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_json_rows(to_json_rows(with_defaults(docs(spark, sf_dir))), MEDIA_FILE)
    return rows.select(
        "pos", "id", "path", "file_name", "file_size", "sha256_hash",
        hex16(F.col("perceptual_hash")).alias("phash"),
        F.date_format("date_taken", "yyyy-MM-dd HH:mm:ss").alias("taken"),
        "width", "camera_model", "is_blurry",
    )


@register
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups as camel-case JSON documents."""
    return to_json_rows(dup.exact_groups(docs(spark, sf_dir)))


# Layout ---------------------------------------------------------------------

def _destinations(strategy) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select(
            "pos", organize.destination_of(strategy, DESTINATION, AS_OF).alias("destination")
        )
    return query


DESTINATIONS = {
    "dest_by_date_ymd": {"type": "byDate", "format": "yearMonthDay"},
    "dest_by_date_ym": {"type": "byDate", "dateFormat": "yearMonth"},
    "dest_by_date_y": {"type": "byDate", "format": "yearOnly"},
    "dest_by_date_flat": {"type": "byDate", "format": "flatDate"},
    "dest_by_camera": {"type": "byCamera"},
    "dest_by_type": {"type": "byType"},
    "dest_custom": {"type": "custom", "pattern": PATTERN},
    "dest_custom_rooted": {"type": "custom", "customPattern": ROOTED_PATTERN},
}
QUERIES.update({name: _destinations(spec) for name, spec in DESTINATIONS.items()})


def _labelled_destinations(spark: SparkSession, sf_dir: str, specs: dict) -> DataFrame:
    """Destinations under several strategies in one pass over the files."""
    each = F.array(*[
        F.struct(
            F.lit(label).alias("strategy"),
            organize.destination_of(spec, DESTINATION, AS_OF).alias("destination"),
        )
        for label, spec in specs.items()
    ])
    return docs(spark, sf_dir).select("pos", F.inline(each))


@register
def dest_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_destinations(spark, sf_dir, {
        level: {"type": "byLocation", "granularity": level}
        for level in ["country", "city", "exact"]
    })


@register
def dest_by_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_destinations(spark, sf_dir, PRESETS)


BY_CAMERA = {"type": "byCamera"}


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.existing_destinations(
        spark, sf_dir, docs(spark, sf_dir), organize.destination_of(BY_CAMERA, DESTINATION)
    )


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.preview(
        docs(spark, sf_dir), BY_CAMERA, DESTINATION, _existing(spark, sf_dir)
    )


def _outcomes(spark: SparkSession, sf_dir: str, copy: bool = False) -> DataFrame:
    return organize.outcomes(
        docs(spark, sf_dir), BY_CAMERA, DESTINATION, _existing(spark, sf_dir),
        tables.missing_sources(spark, sf_dir), copy=copy,
    )


@register
def organize_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@register
def organize_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@register
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.outcome_summary(_outcomes(spark, sf_dir, copy=True), DESTINATION, "task-1")


@register
def error_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = organize.error_lists(_outcomes(spark, sf_dir), CHUNK)
    return lists.select("chunk_no", F.concat_ws("|", "errors").alias("errors"))


@register
def conflict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.conflict_summary(_plan(spark, sf_dir))


@register
def first_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.first_conflicts(_plan(spark, sf_dir))


@register
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.folder_counts(_plan(spark, sf_dir))


@register
def folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.folder_report(organize.preview(
        docs(spark, sf_dir), {"type": "byDate", "format": "yearMonthDay"}, DESTINATION,
        as_of=AS_OF,
    ))


@register
def layout_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "layout")
    strategy = {"type": "byDate", "format": "yearMonth"}
    organize.write_layout(with_defaults(docs(spark, sf_dir)), strategy, path, AS_OF)
    return spark.read.parquet(path).groupBy("year", "month").agg(
        F.count("*").alias("n_files"), F.sum("file_size").alias("total_bytes")
    )


@register
def layout_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout carried out twice: outcomes of both runs, and what the table then holds."""
    path, files = new_path(spark, "layout"), with_defaults(docs(spark, sf_dir))
    runs = [organize.execute_layout(files, {"type": "byType"}, path, DESTINATION) for _ in range(2)]
    counts = [
        run.groupBy("outcome").agg(F.count("*").alias("n_files")).select(F.lit(k).alias("run"), "outcome", "n_files")
        for k, run in enumerate(runs, 1)
    ]
    held = organize.read_layout(spark, path).agg(F.count("*").alias("n_files"))
    return counts[0].unionByName(counts[1]).unionByName(
        held.select(F.lit(2).alias("run"), F.lit("held").alias("outcome"), "n_files")
    )


# Metadata -------------------------------------------------------------------

@register
def parse_capture_time_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in good and bad forms, then parsed."""
    day = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    form = F.pmod(F.col("o_orderkey"), F.lit(7))
    written = (
        F.when(form == 1, F.concat(day, F.lit(".250+02:00")))
        .when(form == 2, F.translate(day, ": ", "-T"))
        .when(form == 3, F.concat(F.substring(day, 1, 5), F.lit("13"), F.substring(day, 8, 12)))
        .when(form == 4, F.concat(F.lit("\t "), day, F.lit("  ")))
        .when(form == 5, F.substring(day, 1, 18))
        .when(form == 6, F.concat(F.substring(day, 1, 17), F.lit("60")))
        .otherwise(day)
    )
    return tables.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format(parse_capture_time(written), "yyyy-MM-dd HH:mm:ss").alias("taken"),
    )


@register
def tag_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_tags(tables.tag_rows(docs(spark, sf_dir))).select(
        "path", F.date_format("date_taken", "yyyy-MM-dd HH:mm:ss").alias("taken"),
        "width", "height", "camera_model",
    )


@register
def gated_tag_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the images below a limit that some documents reach."""
    files = docs(spark, sf_dir)
    tags = gated_tags(files, tables.tag_rows(files), TAG_GATE)
    return project_tags(tags).select(
        "path", F.date_format("date_taken", "yyyy-MM-dd HH:mm:ss").alias("taken"),
        "width", "height", "camera_model",
    )


@register
def metadata_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows filled from tags; picture sizes stand in for missing ones."""
    files = docs(spark, sf_dir)
    bare = with_defaults(files.drop("date_taken", "width", "height", "camera_model"))
    decoded = files.select(
        "path", F.length("file_name").alias("width"), F.length("path").alias("height")
    )
    return with_metadata(bare, tables.tag_rows(files), decoded).select(
        "pos", F.date_format("date_taken", "yyyy-MM-dd HH:mm:ss").alias("taken"),
        "width", "height", "camera_model",
    )


# Progress -------------------------------------------------------------------

def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("speed", F.round("speed", 6))


@register
def progress_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(progress.progress_series(tables.run_log(spark, sf_dir)))


@register
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream, the written feed read back."""
    log = tables.run_log(spark, sf_dir)
    events = tables.table(spark, sf_dir, "events")
    feed, checkpoint = new_path(spark, "feed"), new_path(spark, "stream")
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        .select(*tables.run_log_columns())
    )
    query = progress.stream_progress(
        stream, progress.run_totals(log), feed, checkpoint, availableNow=True
    )
    query.awaitTermination()
    return _rounded(progress.read_feed(spark, feed))


@register
def progress_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream, all records read back."""
    log = tables.run_log(spark, sf_dir)
    events = tables.table(spark, sf_dir, "events")
    path, checkpoint = new_path(spark, "records"), new_path(spark, "stream")
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        .select(*tables.run_log_columns())
    )
    progress.stream_records(stream, progress.run_totals(log), path, checkpoint, availableNow=True).awaitTermination()
    return _rounded(progress.read_records(spark, path))


# Folders --------------------------------------------------------------------

@register
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of the table files themselves, contents hashed."""
    return build_catalog(spark, [sf_dir], extensions=["parquet"]).select(
        "pos", "file_name", "file_size", "extension", "md5_hash", "sha256_hash"
    )


@register
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a file of its own, and the folder catalogued."""
    folder = new_path(spark, "files")
    lines = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    write_files(lines, "doc_id", "text", folder)
    found = build_catalog(spark, [folder], hash_limit=SCAN_GATE, extensions=["txt"])
    return found.select(
        F.regexp_extract("path", "/doc_id=([0-9]+)/", 1).cast("long").alias("doc_id"),
        "file_size", "extension", "md5_hash", "sha256_hash",
        F.col("indexed_at").isNotNull().alias("indexed"),
    )
