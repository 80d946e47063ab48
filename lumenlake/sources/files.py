"""Catalogue of the files below some folders.

Folders are listed in tasks, one directory level per round: a table of directories
gives a table of their files and subdirectories, which is written, and so on until
no directory is left.  No file name passes through the driver.  Contents are read
in tasks too, in blocks, and only of files below the digest limit.

A folder of any size is listed in pages, so a task holds one page of names.  On disks
the listing takes names and kinds only; the sizes of media files are asked for
afterwards, by as many tasks as their number calls for.  A store that can list a range
of names (:class:`KeyRangeStore`) has large folders listed by many tasks: one that has
read its pages hands back the rest of its range, cut into ranges for the next round.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import json
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.constants import HASH_LIMIT, META_LIMIT, SCAN_IMAGE, SCAN_VIDEO
from lumenlake.functions.classify import is_image
from lumenlake.functions.hashing import md5_hex, sha256_hex
from lumenlake.functions.text import extension, file_name
from lumenlake.operators.numbering import with_row_number
from lumenlake.operators.tags import with_metadata
from lumenlake.schema import with_defaults
from lumenlake.scratch import store, store_observed

MEDIA_EXTENSIONS = SCAN_IMAGE + SCAN_VIDEO
MOST_TASKS = 100_000
BLOCK = 1 << 20
BYTES_PER_TASK = 128 << 20

# Names a task holds at a time, and pages of a range it lists before it hands back the rest.
PAGE = 10_000
PAGES_PER_TASK = 100
# Sizes asked for by one task.
SIZES_PER_TASK = 100_000
# Directories or ranges listed by one task, once every core has some of them.
DIRS_PER_TASK = 1_000
TASKS_PER_CORE = 4

_ENTRY = (
    "root_no int, root string, inner string, is_dir boolean, length long, trail array<string>, "
    "after string, before string"
)
_ARROW_ENTRY = pa.schema([
    ("root_no", pa.int32()), ("root", pa.string()), ("inner", pa.string()), ("is_dir", pa.bool_()),
    ("length", pa.int64()), ("trail", pa.list_(pa.string())), ("after", pa.string()), ("before", pa.string()),
])


class KeyRangeStore(Protocol):
    """A store whose folders can be listed from any name on, as object stores can."""

    def page(self, folder: str, after: str | None, limit: int) -> list[tuple[str, bool, int]]:
        """At most ``limit`` entries ``(name, is_dir, length)`` of a folder, in the order of
        their names' code points, from the first name after ``after`` on."""


Stores = Mapping[str, Callable[[], KeyRangeStore]]


def _place(root: str) -> tuple[str, str]:
    """What comes before a path inside the root's file system, and the path of the root."""
    if root.startswith("file:"):
        root = "/" + root[len("file:"):].lstrip("/")
    if "://" not in root:
        return "", os.path.abspath(root)
    inner = fs.FileSystem.from_uri(root)[1]
    scheme, rest = root.split("://", 1)
    return f"{scheme}://{rest.split('/', 1)[0]}", inner if inner.startswith("/") else f"/{inner}"


def _system(prefix: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(f"{prefix}/")[0] if prefix else fs.LocalFileSystem()


def _on_disk(inner: str, trail: list[str]) -> Iterator[tuple]:
    """``inner, is_dir, length, trail`` of a directory's entries, lengths left open.

    Links are followed unless they lead to a directory on the way to themselves.
    What cannot be read, or has a name that is no text, gives nothing.
    """
    try:
        scan = os.scandir(inner)
    except OSError:
        return
    with scan:
        while True:
            try:
                entry = next(scan, None)
                if entry is None:
                    return
                entry.path.encode()
                if entry.is_dir():
                    real = os.path.realpath(entry.path)
                    real.encode()
                    if real not in trail:
                        yield entry.path, True, 0, [*trail, real]
                elif entry.is_file():
                    yield entry.path, False, None, []
            except UnicodeError:
                continue
            except OSError:
                return


def _in_system(system: fs.FileSystem, inner: str, trail: list[str]) -> Iterator[tuple]:
    """The same for other file systems, which tell lengths at once."""
    try:
        entries = system.get_file_info(fs.FileSelector(inner))
    except OSError:
        return
    for entry in entries:
        if entry.type == fs.FileType.File:
            yield entry.path, False, entry.size, []
        elif entry.type == fs.FileType.Directory and entry.path not in trail:
            yield entry.path, True, 0, [*trail, entry.path]


# Names are compared as numbers of this many digits; a digit is a printable ASCII character.
_DIGITS, _FIRST, _LAST = 8, 0x20, 0x7E


def _number(text: str) -> int:
    out = 0
    for k in range(_DIGITS):
        digit = min(max(ord(text[k]), _FIRST), _LAST) - _FIRST if k < len(text) else 0
        out = out * (_LAST - _FIRST + 1) + digit
    return out


def _text(number: int) -> str:
    out = ""
    for _ in range(_DIGITS):
        number, digit = divmod(number, _LAST - _FIRST + 1)
        out = chr(digit + _FIRST) + out
    return out


def key_cuts(after: str, before: str | None) -> list[str]:
    """Names strictly between two, in ascending order: evenly spread ones, and ones that
    come ever closer to the lower, as what is left may lie at any scale above it."""
    shared = os.path.commonprefix([after, before]) if before is not None else ""
    low = _number(after[len(shared):])
    high = _number(before[len(shared):]) if before is not None else _number(chr(_LAST) * _DIGITS)
    span = max(high - low, 0)
    steps = {span * k // 16 for k in range(1, 16)} | {span >> k for k in range(1, span.bit_length())}
    cuts = {shared + _text(low + step) for step in steps}
    return sorted(c for c in cuts if after < c and (before is None or c < before))


def _in_store(store: KeyRangeStore, row: dict, size: int, pages: int) -> Iterator[tuple]:
    """Entries after the name ``after`` up to ``before``; what is left after some pages comes as ranges."""
    inner, after, before = row["inner"], row["after"], row["before"]
    for _ in range(pages):
        entries = store.page(inner, after, size)
        for name, is_dir, length in entries:
            if before is not None and name > before:
                return
            yield f"{inner.rstrip('/')}/{name}", is_dir, length, [], None, None
        if len(entries) < size:
            return
        after = entries[-1][0]
    bounds = [after, *key_cuts(after, before), before]
    for low, high in zip(bounds, bounds[1:]):
        yield inner, True, 0, [], low, high


def _entries(row: dict, systems: dict, stores: Stores, size: int, pages: int) -> Iterator[tuple]:
    prefix = row["root"]
    scheme = prefix.split("://", 1)[0]
    if scheme in stores:
        if prefix not in systems:
            systems[prefix] = stores[scheme]()
        yield from _in_store(systems[prefix], row, size, pages)
        return
    if prefix:
        try:
            if prefix not in systems:
                systems[prefix] = _system(prefix)
        except OSError:
            return
        found = _in_system(systems[prefix], row["inner"], row["trail"])
    else:
        found = _on_disk(row["inner"], row["trail"])
    for entry in found:
        yield *entry, None, None


def _lister(stores: Stores, size: int = PAGE, pages: int = PAGES_PER_TASK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("inner", "is_dir", "length", "trail", "after", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, object] = {}
        page: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                for entry in _entries(row, systems, stores, size, pages):
                    page.append({"root_no": row["root_no"], "root": row["root"], **dict(zip(names, entry))})
                    if len(page) == size:
                        yield pa.RecordBatch.from_pylist(page, schema=_ARROW_ENTRY)
                        page = []
        yield pa.RecordBatch.from_pylist(page, schema=_ARROW_ENTRY)

    return run


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths of files on disk; those that are gone meanwhile are left out."""
    for batch in batches:
        lengths = []
        for path in batch.column("path").to_pylist():
            try:
                lengths.append(os.stat(path).st_size)
            except OSError:
                lengths.append(None)
        sized = batch.set_column(2, "length", pa.array(lengths, pa.int64()))
        yield sized.filter(sized.column("length").is_valid())


def _roots(roots: Sequence[str], stores: Stores) -> list[tuple]:
    """The roots as entries; those that are neither file nor folder, or cannot be read, are left out."""
    out = []
    for number, root in enumerate(roots):
        if "://" in root and root.split("://", 1)[0] in stores:
            scheme, rest = root.split("://", 1)
            host, _, inner = rest.partition("/")
            out.append((number, f"{scheme}://{host}", f"/{inner}", True, 0, [], None, None))
            continue
        prefix, inner = _place(root)
        try:
            info = _system(prefix).get_file_info(inner)
        except OSError:
            continue
        if info.type == fs.FileType.File:
            out.append((number, prefix, inner, False, info.size, [], None, None))
        elif info.type == fs.FileType.Directory:
            trail = [inner if prefix else os.path.realpath(inner)]
            out.append((number, prefix, inner, True, 0, trail, None, None))
    return out


def scan_media(
    spark: SparkSession,
    roots: Sequence[str],
    extensions: Sequence[str] = MEDIA_EXTENSIONS,
    stores: Stores | None = None,
    page: int = PAGE,
    pages_per_task: int = PAGES_PER_TASK,
) -> DataFrame:
    """Media files below the roots as ``(root_no, path, length)`` (SRC1, FIL1).

    File contents are not read.  A file below two roots is listed for each.
    Names may start with any character, and files may be empty.  Roots or folders
    that are missing or unreadable give no rows.  ``stores`` maps a scheme of addresses
    to what makes a :class:`KeyRangeStore` in a task; roots under it are folders.
    """
    if not roots:
        raise ValueError("no folders given")
    stores = dict(stores or {})
    media = extension(file_name(F.col("inner"))).isin(list(extensions))
    open_size = ~F.col("is_dir") & F.col("length").isNull() & media
    level = spark.createDataFrame(_roots(roots, stores), _ENTRY)
    levels, n, n_open = [level], level.filter("is_dir").count(), 0
    while n:
        # A directory or range is a unit of work though its row is a few bytes; many
        # share a task, which costs more to start and to write than a small folder.
        tasks = max(spark.sparkContext.defaultParallelism * TASKS_PER_CORE, n // DIRS_PER_TASK)
        dealt = level.filter("is_dir").repartition(min(n, tasks, MOST_TASKS), "root_no", "inner", "after")
        level, seen = store_observed(
            dealt.mapInArrow(_lister(stores, page, pages_per_task), _ENTRY), "listing",
            n_dirs=F.count_if("is_dir"), n_open=F.count_if(open_size),
        )
        levels.append(level)
        n, n_open = seen["n_dirs"], n_open + seen["n_open"]
    found = _union([x.filter("NOT is_dir") for x in levels]).filter(media).select(
        "root_no", F.concat("root", "inner").alias("path"), "length"
    )
    if not n_open:
        return found
    tasks = max(min(n_open, spark.sparkContext.defaultParallelism), n_open // SIZES_PER_TASK)
    asked = found.filter("length IS NULL").repartition(min(tasks, MOST_TASKS), "path")
    sized = asked.mapInArrow(_sized, "root_no int, path string, length long")
    return found.filter("length IS NOT NULL").unionByName(store(sized, "sized"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def write_files(rows: DataFrame, key: str, text: str, folder: str) -> None:
    """Texts as files ``folder/key=value/part-n.txt``, a line per row, empty where it is null;
    rows of a partition with one key share a file.

    Tasks write by themselves: Spark's writer sets modes by a process per file on disks, and
    moves all folders one by one in the driver.  A file gets its name once it is
    whole, the same one whenever its task is repeated.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        prefix, inner = _place(folder)
        system, name = _system(prefix), f"part-{task.partitionId():06d}.txt"
        hidden = f"{name}.{task.taskAttemptId()}.tmp"
        lines = ((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for value, group in itertools.groupby(lines, lambda line: line[0]):
            place = f"{inner}/{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
            system.create_dir(place, recursive=True)
            with system.open_output_stream(f"{place}/{hidden}", compression=None) as out:
                for _, line in group:
                    out.write(f"{line or ''}\n".encode())
            system.move(f"{place}/{hidden}", f"{place}/{name}")
        yield pa.RecordBatch.from_pylist([], schema=pa.schema([("n", pa.int64())]))

    prefix, inner = _place(folder)
    _system(prefix).create_dir(inner, recursive=True)
    ordered = rows.select(key, text).sortWithinPartitions(key)
    ordered.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


@dataclass(frozen=True)
class RunLog:
    """Where a run says what it has done so far: a folder that all machines share.

    Tasks append a file of lines ``scan_id, current_file, seq, ts`` whenever they have
    done some more files.  Lines are written under another name first, so readers see
    whole files only; a task that is repeated writes the same files again.
    """

    path: str
    scan_id: str
    every: int = 100

    def append(self, part: int, at: int, files: list[str]) -> None:
        prefix, folder = _place(f"{self.path}/files")
        system, name = _system(prefix), f"part-{part:06d}-{at:010d}.json"
        system.create_dir(folder, recursive=True)
        now = dt.datetime.now(dt.timezone.utc).isoformat()
        lines = [
            json.dumps({"scan_id": self.scan_id, "current_file": file, "seq": (part << 33) + at + k, "ts": now})
            for k, file in enumerate(files)
        ]
        with system.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            out.write("\n".join([*lines, ""]).encode())
        system.move(f"{folder}/_{name}", f"{folder}/{name}")


_DIGESTS = pa.schema([("path", pa.string()), ("md5_hash", pa.string()), ("sha256_hash", pa.string())])


def digests(
    files: DataFrame, total_bytes: int, hash_limit: int | None = None, log: RunLog | None = None
) -> DataFrame:
    """``path, md5_hash, sha256_hash`` of ``files (path)``; nulls for unreadable ones.

    With a ``log``, files also have ``length`` and ``n``, how often they are listed: those
    of ``hash_limit`` and more are not opened, and every file is logged ``n`` times.
    """
    size = log.every if log else 1000

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, fs.FileSystem] = {}
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                rows = batch.slice(first, size).to_pylist()
                found = []
                for row in rows:
                    small = not log or row["length"] < hash_limit
                    found.append((row["path"], *(_digest(systems, row["path"]) if small else (None, None))))
                if log:
                    done = [row["path"] for row in rows for _ in range(row["n"])]
                    log.append(part, at, done)
                    at += len(done)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], schema=_DIGESTS)

    tasks = min(max(total_bytes // BYTES_PER_TASK, files.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
    dealt = files.select("path", *(["length", "n"] if log else [])).repartition(int(tasks), "path")
    if log:
        # In the same order whenever a task is repeated.
        dealt = dealt.sortWithinPartitions("path")
    return dealt.mapInArrow(read, "path string, md5_hash string, sha256_hash string")


def _digest(systems: dict[str, fs.FileSystem], path: str) -> tuple[str | None, str | None]:
    prefix, inner = "", path
    if "://" in path:
        scheme, rest = path.split("://", 1)
        host, _, inner = rest.partition("/")
        prefix, inner = f"{scheme}://{host}", f"/{inner}"
    md5, sha = hashlib.md5(), hashlib.sha256()
    try:
        if prefix not in systems:
            systems[prefix] = _system(prefix)
        with systems[prefix].open_input_stream(inner, compression=None) as file:
            while block := file.read(BLOCK):
                md5.update(block)
                sha.update(block)
    except OSError:
        return None, None
    return md5.hexdigest(), sha.hexdigest()


def _row_columns() -> list[Column]:
    """Catalogue columns that follow from path and size (SRC2)."""
    name = file_name(F.col("path"))
    return [
        F.sha2(F.concat_ws("\u0000", F.col("root_no").cast("string"), F.col("path")), 256)
        .alias("id"),
        F.col("path"),
        name.alias("file_name"),
        F.col("length").alias("file_size"),
        extension(name).alias("extension"),
    ]


def build_catalog(
    spark: SparkSession,
    roots: Sequence[str],
    tags: DataFrame | None = None,
    hash_limit: int = HASH_LIMIT,
    meta_limit: int = META_LIMIT,
    extensions: Sequence[str] = MEDIA_EXTENSIONS,
    stores: Stores | None = None,
    log: RunLog | None = None,
) -> DataFrame:
    """Full catalogue of the media files below the roots (SRC3, SRC4).

    Contents are read once per path, however many roots list it, and only of files
    under ``hash_limit``: the size test sits on the listing, so larger files are
    never opened.  The digests are then joined to the listing, which keeps every
    file: a larger or unreadable one just has no digests.  ``pos`` follows root and
    path order.  With a ``log``, tasks tell of every file of the catalogue as they go;
    its records follow from ``streaming.progress`` while this runs.
    """
    listed = scan_media(spark, roots, extensions, stores)
    small = F.col("length") < hash_limit
    paths = listed.groupBy("path").agg(F.max("length").alias("length"), F.count("*").alias("n"))
    paths, seen = store_observed(
        paths if log else paths.filter(small), "to-hash",
        n_bytes=F.sum(F.when(small, F.col("length"))), n_files=F.sum("n"),
    )
    if log:
        totals = spark.createDataFrame([(log.scan_id, seen["n_files"] or 0)], "scan_id string, total long")
        totals.write.mode("append").parquet(f"{log.path}/totals")
    hashed = store(digests(paths, seen["n_bytes"] or 0, hash_limit, log), "digests")
    placed = with_row_number(listed, [], ["root_no", "path"], "place")
    rows = placed.join(hashed, "path", "left").select(
        (F.col("place") - 1).alias("pos"), *_row_columns(), "md5_hash", "sha256_hash"
    )
    catalog = with_defaults(rows)
    if tags is None:
        return catalog
    return with_metadata(catalog, gated_tags(catalog, tags, meta_limit))


def metadata_candidates(files: DataFrame, meta_limit: int = META_LIMIT) -> DataFrame:
    """Images small enough to have their metadata read (FIL4)."""
    return files.filter(is_image(F.col("extension")) & (F.col("file_size") < meta_limit))


def gated_tags(files: DataFrame, tags: DataFrame, meta_limit: int = META_LIMIT) -> DataFrame:
    """Tag rows of files whose metadata is read at all."""
    allowed = metadata_candidates(files, meta_limit).select("path").distinct()
    return tags.join(allowed, "path", "left_semi")


def gate_hashes(files: DataFrame, content: Column, hash_limit: int = HASH_LIMIT) -> DataFrame:
    """Digests of a content column for rows under the limit, nulls for the rest (FIL3)."""
    small = F.col("file_size") < hash_limit
    return files.withColumn("md5_hash", F.when(small, md5_hex(content))).withColumn(
        "sha256_hash", F.when(small, sha256_hex(content))
    )
