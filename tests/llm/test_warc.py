from __future__ import annotations

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import warc
from lumenlake.llm.queries import ORACLE, op5_warc
from lumenlake.scratch import new_path
from tests.conftest import SF
from tests.llm.brute import sha
from tests.oracle import compare, connect


def _file(n: int) -> tuple[bytes, list[int]]:
    pick = random.Random(n)
    data, starts = b"", []
    for i in range(n):
        payload = pick.randbytes(pick.randrange(3000)) + warc.MAGIC * pick.randrange(3)
        starts.append(len(data))
        data += warc.build_record(i, "http://x/é", payload, sha(payload), None, False)
    return data, starts


@pytest.mark.parametrize("step", [1, 7, 100, 4096, 10**9])
def test_ranges_own_the_records_that_start_in_them(step):
    data, starts = _file(12 if step > 1 else 2)
    step = min(step, len(data))
    found = []
    for start in range(0, len(data), step):
        end = min(start + step, len(data))
        part = [at for at, _, _ in warc.records_in_range(io.BytesIO(data), start, end)]
        assert all(start <= at < end for at in part)
        found += part
    assert found == starts


def test_false_magic_other_gzip_and_torn_ends_are_no_records():
    good = warc.build_record(1, None, b"p" * 200, sha(b"p" * 200), None, False)
    noise = warc.MAGIC + b"junk" + gzip.compress(b"not a record") + gzip.compress(b"WARC/1.1\r\nno: fields\r\n\r\n")
    data = noise + good + noise + good[: len(good) // 2]
    assert [at for at, _, _ in warc.records_in_range(io.BytesIO(data), 0, len(data))] == [len(noise)]


def test_small_windows(monkeypatch):
    data, starts = _file(30)
    monkeypatch.setattr(warc, "RANGE", 500)
    assert [at for at, _, _ in warc.records_in_range(io.BytesIO(data), 0, len(data))] == starts


def test_query_same_as_sql(spark):
    con = connect(SF)
    assert compare(op5_warc(spark, SF), con, ORACLE["op5_warc"]) is None
    con.close()


LONG = "é" * 60


def test_revisits_nulls_and_repeats(spark):
    pages = spark.createDataFrame(
        [(4, "u4", LONG), (2, None, LONG), (9, "u9", LONG), (2, "u2", LONG), (None, "n", LONG), (5, "s", "tiny"),
         (6, "s", "tiny"), (7, "e", None), (8, "line\r\nbreak", "\r\n\r\nx" * 50)],
        "page_id long, url string, html string",
    ).withColumn("digest", F.lit("clash"))
    rows = warc.archive_round_trip(pages).collect()
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in rows)
    assert got == sorted([
        ("2", "response", "None", 120), ("2", "response", "None", 120), ("4", "revisit", "2", 120),
        ("9", "revisit", "2", 120), ("None", "response", "None", 120), ("5", "response", "None", 4),
        ("6", "response", "None", 4), ("7", "response", "None", 0), ("8", "response", "None", 250),
    ])
    assert {r["payload_digest"] for r in rows if r["page_id"] in (2, 4, 9)} == {sha(LONG)}
    assert next(bytes(r["payload"]) for r in rows if r["page_id"] == 8) == b"\r\n\r\nx" * 50
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 8, 1 << 17])
def test_filter_of_revisits_decides_nothing(spark, monkeypatch, bits):
    """Bits that rows share send more of them through the join; records stay the same."""
    monkeypatch.setattr(warc, "FILTER_BITS", bits)
    random.seed(3)
    texts = {n: f"<p>{random.randrange(150)}</p>" * random.choice((2, 30)) for n in range(400)}
    first: dict[str, int] = {}
    for n, text in texts.items():
        first.setdefault(text, n)
    pages = spark.createDataFrame([(n, "u", t) for n, t in texts.items()], "page_id long, url string, html string")
    records = warc.plan_records(pages.repartition(5), "page_id", "url", "html").collect()
    got = {r["page_id"]: (r["revisit"], r["refers_to"], bytes(r["payload"])) for r in records}
    assert len(records) == 400
    assert got == {
        n: (True, first[t], t.encode()) if len(t) >= 100 and first[t] != n else (False, None, t.encode())
        for n, t in texts.items()
    }


def test_only_revisits_are_joined(spark):
    """Of 3,000 rows, 100 revisit: all are known to the filter, and next to none of the others."""
    rows = spark.range(3000).selectExpr(
        "id AS page_id", "cast(if(id % 30 = 7, 7, id) AS string) AS digest", "200 AS octets"
    )
    revisits = warc.find_revisits(rows)
    assert {(r["page_id"], r["first"]) for r in revisits.collect()} == {(n, 7) for n in range(37, 3000, 30)}
    known = {r["page_id"] for r in warc.flag_revisits(rows, revisits).filter("known").collect()}
    assert known >= set(range(37, 3000, 30))
    assert len(known) <= 102


def test_archives_can_be_listed_and_split(spark):
    folder = new_path(spark, "archives")
    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 400) AS html")
    manifest = warc.write_archives(warc.plan_records(pages.repartition(3), "page_id", "url", "html"), folder)
    assert manifest.agg(F.sum("records")).first()[0] == 300
    read = warc.read_archives(warc.list_archives(spark, folder), folder, range_bytes=1000)
    assert sorted(r["page_id"] for r in read.select("page_id").collect()) == list(range(300))
