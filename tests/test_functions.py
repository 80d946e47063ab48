from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenlake.functions import classify, display, hashing, text
from lumenlake.functions.dates import capture_day, date_folder, parse_capture_time


def apply(spark, values, schema, expr):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_media_extensions(spark):
    names = ["test.jpg", "test.JPG", "test.png", "test.heic", "test.mp4", "test.MOV", "test.avi",
             "test.txt", "test.pdf", "test"]
    got = apply(spark, names, "s string", classify.is_media(text.extension(F.col("s"))))
    assert got == [True] * 7 + [False] * 3


def test_scan_list_is_wider_than_type_list(spark):
    exts = ["raw", "cr2", "3gp", "jpg", "JPG", "webm", "txt", ""]
    e = F.col("s")
    assert apply(spark, exts, "s string", classify.is_media(e)) == [True] * 6 + [False] * 2
    assert apply(spark, exts, "s string", classify.type_folder(e)) == [
        "Other", "Other", "Other", "Images", "Images", "Videos", "Other", "Other"]
    assert apply(spark, exts, "s string", classify.scan_category(e)) == [
        "image", "image", "video", "image", "image", "video", None, None]


def test_names_and_extensions(spark):
    paths = ["/a/b.JPG", "/a/.jpg", "/a/a.", "/a/a.tar.GZ", "noext", "/a/b/", "/a/..", ""]
    p = F.col("s")
    assert apply(spark, paths, "s string", text.file_name(p)) == [
        "b.JPG", ".jpg", "a.", "a.tar.GZ", "noext", "b", "", ""]
    assert apply(spark, paths, "s string", text.extension(text.file_name(p))) == [
        "jpg", "", "", "gz", "", "", "", ""]


def test_sanitize_folder(spark):
    values = ["A/B\\C*?", "NIKON: D850", "\t Pixel 8  ", "???", "   ", '"<>|']
    assert apply(spark, values, "s string", text.sanitize_folder(F.col("s"))) == [
        "A_B_C__", "NIKON_ D850", "Pixel 8", "___", "", "____"]


def test_join_path(spark):
    pairs = [("/lib", "a/b"), ("/lib/", "a"), ("", "a"), ("/lib", "/etc/x"), ("", "/x"), ("a", "")]
    got = apply(spark, pairs, "l string, r string", text.join_path(F.col("l"), F.col("r")))
    assert got == ["/lib/a/b", "/lib/a", "a", "/etc/x", "/x", "a/"]


def test_parent_and_base(spark):
    paths = ["/a/b/c.jpg", "/x.jpg", "x.jpg", "d\\e\\f.jpg", "/d\\e.jpg", "a/b\\c"]
    assert apply(spark, paths, "s string", text.parent_folder(F.col("s"))) == [
        "/a/b", "", "", "", "/d", "a"]
    assert apply(spark, paths, "s string", text.base_name(F.col("s"))) == [
        "c.jpg", "x.jpg", "x.jpg", "f.jpg", "e.jpg", "c"]


def test_format_size(spark):
    values = [0, 1, 512, 1023, 1024, 1280, 1536, 1024 ** 2 - 1, 1024 ** 2, 1024 ** 3 * 5 // 2,
              1024 ** 4, 1024 ** 5 - 1, 3 * 1024 ** 5]
    assert apply(spark, values, "n long", display.format_size(F.col("n"))) == [
        "0 B", "1 B", "512 B", "1023 B", "1 KB", "1.3 KB", "1.5 KB", "1024 KB", "1 MB", "2.5 GB",
        "1 TB", "1024 TB", "3072 TB"]


def test_format_eta(spark):
    values = [None, 0, 5, 59, 60, 61, 3599, 3600, 3661, 36061]
    assert apply(spark, values, "n long", display.format_eta(F.col("n"))) == [
        "--:--", "--:--", "0:05", "0:59", "1:00", "1:01", "59:59", "1:00:00", "1:01:01", "10:01:01"]


def test_rates(spark):
    pairs = [(10, 0.0), (10, 4.0)]
    speed = display.throughput(F.col("n"), F.col("t"))
    assert apply(spark, pairs, "n long, t double", speed) == [0.0, 2.5]
    eta = display.eta_seconds(F.col("n"), F.lit(21), speed)
    assert apply(spark, pairs, "n long, t double", eta) == [None, 4]
    shares = [(0, 0), (1, 8), (1, 3), (3, 3), (57, 200)]
    got = apply(spark, shares, "a long, b long", display.percent(F.col("a"), F.col("b")))
    assert got == [0, 13, 33, 100, 28]
    assert apply(spark, [2.25], "x double", display.format_speed(F.col("x"))) == ["2.3 files/sec"]
    assert apply(spark, [1572864], "n long", display.format_megabytes(F.col("n"))) == ["1.50 MB"]


def test_dimensions(spark):
    pairs = [(640, 480), (0, 480), (None, 480), (640, None)]
    got = apply(spark, pairs, "w long, h long", display.format_dimensions(F.col("w"), F.col("h")))
    assert got == ["640×480", None, None, None]


@pytest.mark.parametrize("value,expected", [
    ("2024:03:22 14:30:45", "2024-03-22 14:30:45"),
    ("invalid", None),
    ("", None),
    (None, None),
    ("2024-03-22T14:30:45", "2024-03-22 14:30:45"),
    ("2024:03:22 14:30:45.123+02:00", "2024-03-22 14:30:45"),
    ("  2024:03:22 14:30:45\t", "2024-03-22 14:30:45"),
    ("2024:13:22 14:30:45", None),
    ("2024:02:30 14:30:45", None),
    ("2024:02:29 23:59:59", "2024-02-29 23:59:59"),
    ("2024:03:22 14:30:60", None),
    ("2024:03:22 24:30:00", None),
    ("2024:03:22 14:30:4", None),
    ("2024: 3:22 14:30:45", None),
    ("2024:+3:22 14:30:45", "2024-03-22 14:30:45"),
    ("2024é03:22 14:30:45", None),
])
def test_parse_capture_time(spark, value, expected):
    out = F.date_format(parse_capture_time(F.col("s")), "yyyy-MM-dd HH:mm:ss")
    assert apply(spark, [value], "s string", out) == [expected]


def test_date_folders(spark):
    day = [dt.datetime(2024, 3, 5, 23, 59), None]
    as_of = dt.date(2023, 1, 2)
    for style, expected in [
        ("yearMonthDay", ["2024/03/05", "2023/01/02"]), ("yearMonth", ["2024/03", "2023/01"]),
        ("yearOnly", ["2024", "2023"]), ("flatDate", ["2024-03-05", "2023-01-02"]),
    ]:
        got = apply(spark, day, "d timestamp", date_folder(capture_day(F.col("d"), as_of), style))
        assert got == expected


def test_digests(spark):
    content = [b"test content for hashing", b""]
    md5 = apply(spark, content, "c binary", hashing.md5_hex(F.col("c")))
    sha = apply(spark, content, "c binary", hashing.sha256_hex(F.col("c")))
    assert [len(x) for x in md5] == [32, 32] and [len(x) for x in sha] == [64, 64]
    assert md5[1] == "d41d8cd98f00b204e9800998ecf8427e"


def test_hamming_and_similar(spark):
    pairs = [(0b0000, 0b0000), (0b0000, 0b1111), (0b1010, 0b0101), (-1, 0), (-2 ** 63, 0)]
    a, b = F.col("a"), F.col("b")
    assert apply(spark, pairs, "a long, b long", hashing.hamming(a, b)) == [0, 4, 4, 64, 1]
    assert apply(spark, [(10, 10)], "a long, b long", hashing.similar(a, b, 0)) == [True]
    assert apply(spark, [(10, 11)], "a long, b long", hashing.similar(a, b, 1)) == [True]
    assert apply(spark, [(10, 11)], "a long, b long", hashing.similar(a, b, 0)) == [False]


def test_average_hash(spark):
    flat = [7] * 64
    one = [0] * 63 + [255]
    ramp = list(range(64))
    got = apply(spark, [(flat,), (one,), (ramp,)], "c array<int>",
                hashing.hex16(hashing.average_hash(F.col("c"))))
    mean = sum(ramp) // 64
    expected = sum(1 << i for i, v in enumerate(ramp) if v > mean)
    assert got == ["0" * 16, "8" + "0" * 15, f"{expected:016x}"]
