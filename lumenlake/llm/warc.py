"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own.  Writing tasks put one file each into a
folder; only files named in the written manifest count, so what a lost attempt
left behind is never read.

The reader deals out byte ranges.  A task looks for the gzip magic from the start
of its range, takes a candidate for a record only if it inflates to WARC headers
with the mandatory fields, and owns the records that start inside the range, to
whose end it reads on.  After a record the next one follows at once, so bytes
inside a record are looked at for the magic only when a range starts there.

Of equal payloads of at least :data:`LEAST_BYTES` bytes the row with the smallest
id is stored, the others are revisits that refer to it; smaller ones are always
stored.  Nulls count as empty payloads.  A null id is never referred to and its
row is a response.  Rows that repeat an id and a payload are all responses if the
id is the smallest.  An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import text_or_empty
from lumenlake.operators.skew import attach
from lumenlake.scratch import new_path, store

LEAST_BYTES = 100
#: Size of the filter of revisits, 16 MB at most however many there are, in maps of so many bits.
FILTER_BITS = 1 << 27
BITMAP_BITS = 1 << 15
MAGIC = b"\x1f\x8b\x08"
RANGE = 8 << 20
MOST_TASKS = 100_000
LEVEL = 4
BLOCK = 1 << 16
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
_RECORD_ID = re.compile(r"<urn:x-row:(-?\d*)>")


def _name(number: int | None) -> str:
    return f"<urn:x-row:{'' if number is None else number}>"


def _number(name: str | None) -> int | None:
    found = _RECORD_ID.fullmatch(name or "")
    return int(found[1]) if found and found[1] else None


def build_record(number, uri, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One gzip member."""
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _name(number),
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Bytes": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    if uri:
        fields["WARC-Target-URI"] = re.sub(r"[\r\n]", " ", uri)
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(refers_to)}
    body = HTTP if revisit else HTTP + payload
    fields["Content-Length"] = str(len(body))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items())
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + head + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _bit() -> Column:
    return F.pmod(F.xxhash64("page_id", "digest"), F.lit(FILTER_BITS))


def find_revisits(rows: DataFrame) -> DataFrame:
    """``page_id, digest, first`` of the rows that revisit another one, each once; stored.

    Only ids and digests are shuffled; a payload that a third of the rows have is split.
    """
    large = F.col("page_id").isNotNull() & (F.col("octets") >= LEAST_BYTES)
    ids = store(rows.filter(large).select("page_id", "digest"), "payload-ids")
    shared = (
        ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n"))
        .filter(F.col("first") < F.col("last")).drop("last")
    )
    met = attach(ids, shared, "digest", "n", F.col("page_id")).filter(F.col("page_id") != F.col("first"))
    return store(met.select("page_id", "digest", "first").distinct(), "revisits")


def flag_revisits(rows: DataFrame, revisits: DataFrame) -> DataFrame:
    """``rows`` with ``known``: true for all revisits, and for rows whose bit one of them shares.

    The filter is broadcast and has :data:`FILTER_BITS` bits in all.
    """
    place = _bit() % BITMAP_BITS
    part = F.floor(_bit() / BITMAP_BITS).alias("part")
    bitmaps = store(revisits.groupBy(part).agg(F.bitmap_construct_agg(place).alias("bits")), "revisit-filter")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))
    known = known & F.col("page_id").isNotNull() & (F.col("octets") >= LEAST_BYTES)
    return rows.select("*", part).join(F.broadcast(bitmaps), "part", "left").select(*rows.columns, known.alias("known"))


def plan_records(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """Payloads with their digest and the id of the row that stores them.

    Rows that a filter of the revisits doesn't know are responses and stay in the task
    that read them; only the others are joined by id with the revisits, which decide.
    """
    payload = text_or_empty(html_column).cast("binary")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("octets"),
    )
    revisits = find_revisits(rows)
    tested = flag_revisits(rows, revisits)
    columns = ["page_id", "url", "payload", "digest"]
    alone = tested.filter("NOT known").select(
        *columns, F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to")
    )
    met = tested.filter("known").join(revisits, ["page_id", "digest"], "left").select(
        *columns, F.col("first").isNotNull().alias("revisit"), F.col("first").alias("refers_to")
    )
    return alone.unionByName(met)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` below ``folder``; the manifest ``path, length, records``, stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_folder(folder)
        path, out, length, n = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                member = build_record(
                    row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"]
                )
                out.write(member)
                length, n = length + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "records": [n]})

    return store(records.mapInArrow(write, "path string, length long, records long"), "manifest")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of archives that others wrote; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")


class _Source:
    """A window of a file that grows on demand."""

    def __init__(self, file, start: int, length: int) -> None:
        self.file, self.start = file, start
        file.seek(start)
        self.data = bytearray(file.read(length))

    def grow(self) -> bool:
        self.file.seek(self.start + len(self.data))
        more = self.file.read(BLOCK)
        self.data += more
        return bool(more)


def _inflate(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The record that starts at ``at`` and where it ends, or None if none does."""
    unpack, out, fed, checked = zlib.decompressobj(31), bytearray(), at, False
    try:
        while not unpack.eof:
            if fed >= len(source.data) and not source.grow():
                return None
            block = bytes(source.data[fed:fed + BLOCK])
            out += unpack.decompress(block)
            fed += len(block)
            if not checked and len(out) >= len(VERSION):
                if not out.startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    return (bytes(out), fed - len(unpack.unused_data)) if checked else None


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block; None unless they are those of a record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if any(m not in fields for m in MANDATORY) or not fields["content-length"].isdigit():
        return None
    length = int(fields["content-length"])
    return (fields, rest[:length]) if len(rest) >= length else None


def records_in_range(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``offset, headers, block`` of records that start in ``[start, end)``."""
    source = _Source(file, start, end - start + len(MAGIC) - 1)
    at = 0
    while True:
        at = source.data.find(MAGIC, at)
        if at < 0 or start + at >= end:
            return
        member = _inflate(source, at)
        parsed = parse_record(member[0]) if member else None
        if parsed is None:
            at += 1
            continue
        yield start + at, *parsed
        at = member[1]
        if at > RANGE:  # what lies behind is not needed again
            source.start += at
            start += at
            del source.data[:at]
            at = 0
        while len(source.data) < at + len(MAGIC) and start + at < end and source.grow():
            pass


def read_archives(files: DataFrame, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """``path, record_offset, page_id, record_type, refers_to, url, payload_bytes,
    payload_digest, payload`` of every record of ``files (path, length)``."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.filter("length > 0").select("path", "length", F.explode(starts).alias("start")).select(
        "path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end")
    )
    schema = T.StructType.fromDDL(
        "path string, record_offset long, page_id long, record_type string, refers_to long, url string, "
        "payload_bytes long, payload_digest string, payload binary"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(schema)
        system, _ = _open_folder(folder)
        for batch in batches:
            for piece in batch.to_pylist():
                at, path = system, piece["path"]
                if re.match(r"[a-z][a-z0-9+.-]*:/", path):
                    at, path = _open_folder(path)
                rows, held = [], 0
                with at.open_input_file(path) as file:
                    for offset, fields, block in records_in_range(file, piece["start"], piece["end"]):
                        rows.append(_row(piece["path"], offset, fields, block))
                        held += len(block)
                        if held > RANGE:
                            yield pa.RecordBatch.from_pylist(rows, schema=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=names)

    # A range is a unit of work though its row is a few bytes: the number of tasks is
    # given, or rows so small would all be merged into one.
    tasks = min(max(ranges.count(), 1), MOST_TASKS)
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, schema)


def _row(path: str, offset: int, fields: dict[str, str], block: bytes) -> dict:
    kind = fields["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "revisit":
        n, digest, payload = int(fields.get("x-payload-bytes", 0)), stated, None
    else:
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if stated and stated != digest:
            raise ValueError(f"{path} at {offset}: payload does not match its digest")
    return {
        "path": path, "record_offset": offset, "page_id": _number(fields["warc-record-id"]), "record_type": kind,
        "refers_to": _number(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"),
        "payload_bytes": n, "payload_digest": digest, "payload": payload,
    }


def archive_round_trip(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Write all rows as records, then read the archives back."""
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_archives(plan_records(pages, id_column, url_column, html_column), folder)
    return read_archives(manifest, folder)
