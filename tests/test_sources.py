from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import random
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import grid
from lumenlake.operators.grid import image_grids, reduce_grid, resample_grid
from lumenlake.operators.tags import project_tags, with_metadata
from lumenlake.schema import MEDIA_FILE, from_json_rows, to_json_rows, with_defaults
from lumenlake.scratch import new_path
from lumenlake.sources import files as src
from lumenlake.sources.images import hash_images, read_images
from lumenlake.streaming import progress


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "lib"
    contents = {
        "a.JPG": b"one", "b/c.png": b"one", "b/d.mp4": b"x" * 100, "b/e.mp4": b"x" * 99,
        "b/notes.txt": b"no", "z.nef": b"", "plain": b"no",
    }
    for name, data in contents.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    return root


def test_scan_lists_media_only(spark, folder):
    rows = src.scan_media(spark, [str(folder)]).collect()
    assert sorted(r.path.removeprefix(str(folder) + "/") for r in rows) == [
        "a.JPG", "b/c.png", "b/d.mp4", "b/e.mp4", "z.nef"]


def test_empty_files_with_odd_names(spark, tmp_path):
    names = ["a b.jpg", "c+d.png", "50%.jpg", "ü.jpg"]
    for i, name in enumerate(names):
        (tmp_path / name).write_bytes(b"x" * (i % 2))
    rows = src.build_catalog(spark, [str(tmp_path)]).collect()
    assert sorted(r.file_name for r in rows) == sorted(names)
    assert {r.file_size: len(r.sha256_hash) for r in rows} == {0: 64, 1: 64}
    assert len({r.sha256_hash for r in rows}) == 2


def test_scan_of_overlapping_roots_lists_twice(spark, folder):
    assert src.scan_media(spark, [str(folder), str(folder / "b")]).count() == 8
    with pytest.raises(ValueError):
        src.scan_media(spark, [])
    with pytest.raises(ValueError):
        src.build_catalog(spark, [])


def test_scan_keeps_all_names_and_bears_bad_roots(spark, tmp_path):
    for name in ("a.jpg", "_DSC0001.jpg", ".x.jpg", "_roll/b.jpg", ".hidden/c.jpg", "ok/d.jpg", "ok/empty.jpg"):
        file = tmp_path / "lib" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"" if "empty" in name else b"x")
    (tmp_path / "lib/ok/up").symlink_to(tmp_path / "lib")
    (tmp_path / "lib/ok/gone.jpg").symlink_to(tmp_path / "nowhere.jpg")
    (tmp_path / "lib/link.jpg").symlink_to(tmp_path / "lib/a.jpg")
    (tmp_path / "lib/again").symlink_to(tmp_path / "lib/_roll")
    roots = [str(tmp_path / "missing"), str(tmp_path / "lib"), f"file://{tmp_path}/lib/a.jpg"]
    rows = src.scan_media(spark, roots).collect()
    lib = str(tmp_path / "lib") + "/"
    assert sorted((r.root_no, r.path.removeprefix(lib), r.length) for r in rows) == [
        (1, ".hidden/c.jpg", 1), (1, ".x.jpg", 1), (1, "_DSC0001.jpg", 1), (1, "_roll/b.jpg", 1), (1, "a.jpg", 1),
        (1, "again/b.jpg", 1), (1, "link.jpg", 1), (1, "ok/d.jpg", 1), (1, "ok/empty.jpg", 0), (2, "a.jpg", 1)]
    assert src.scan_media(spark, [str(tmp_path / "missing")]).count() == 0


def test_files_that_vanish_have_no_digests(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / "gone.jpg"),)], "path string")
    assert [tuple(r)[1:] for r in src.digests(rows, 0).collect()] == [(None, None)]


def test_catalog(spark, folder):
    cat = src.build_catalog(spark, [str(folder)], hash_limit=100)
    assert cat.schema.names == MEDIA_FILE.names
    rows = {r.file_name: r for r in cat.collect()}
    assert [r.file_name for r in cat.orderBy("pos").collect()] == [
        "a.JPG", "c.png", "d.mp4", "e.mp4", "z.nef"]
    assert sorted(r.pos for r in rows.values()) == [0, 1, 2, 3, 4]
    assert rows["a.JPG"].extension == "jpg"
    assert rows["a.JPG"].sha256_hash == hashlib.sha256(b"one").hexdigest()
    assert rows["c.png"].md5_hash == hashlib.md5(b"one").hexdigest()
    assert rows["d.mp4"].sha256_hash is None and rows["d.mp4"].file_size == 100
    assert rows["e.mp4"].sha256_hash is not None
    assert rows["z.nef"].file_size == 0 and rows["z.nef"].sha256_hash is not None
    assert not rows["a.JPG"].is_blurry and rows["a.JPG"].date_taken is None


def test_progress_while_the_catalogue_is_built(spark, folder, monkeypatch):
    """Tasks' log holds every row of the catalogue; records are there before the build ends."""
    log = src.RunLog(new_path(spark, "log"), "run", every=2)
    paths = {"feed": new_path(spark, "feed"), "state": new_path(spark, "checkpoint")}
    seen = []
    number = src.with_row_number

    def numbered(*args):
        stream = progress.read_log(spark, log.path, stream=True)
        totals = progress.read_totals(spark, log.path)
        progress.stream_progress(stream, totals, *paths.values(), availableNow=True).awaitTermination()
        seen.extend(progress.read_feed(spark, paths["feed"]).collect())
        return number(*args)

    monkeypatch.setattr(src, "with_row_number", numbered)
    roots = [str(folder), str(folder / "b")]
    rows = src.build_catalog(spark, roots, hash_limit=100, log=log).collect()
    assert len(rows) == 8 and [(r.scan_id, r.phase, r.current, r.total) for r in seen] == [("run", "Complete", 8, 8)]
    logged = progress.read_log(spark, log.path).collect()
    assert sorted(r.current_file for r in logged) == sorted(r.path for r in rows)
    assert len({r.seq for r in logged}) == 8
    assert {r.file_name: r.sha256_hash for r in rows}["d.mp4"] is None
    last = progress.progress_series(progress.read_log(spark, log.path)).filter("phase = 'Complete'").first()
    assert (last.current, last.total) == (8, 8)


def test_catalog_ids_are_unique_and_stable(spark, folder):
    roots = [str(folder), str(folder / "b")]
    first = {r.id for r in src.build_catalog(spark, roots).collect()}
    again = {r.id for r in src.build_catalog(spark, roots).collect()}
    assert len(first) == 8 and first == again


def test_catalog_of_a_folder_without_media(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("nothing")
    assert src.build_catalog(spark, [str(tmp_path)]).count() == 0


def test_catalog_takes_tags_of_small_images_only(spark, folder):
    tags = spark.createDataFrame([
        (str(folder / "a.JPG"), "DateTimeOriginal", "2024:03:22 14:30:45"),
        (str(folder / "b/c.png"), "Model", "too big"),
        (str(folder / "b/d.mp4"), "Model", "not an image"),
    ], "path string, tag string, value string")
    (folder / "b/c.png").write_bytes(b"y" * 50)
    rows = {r.file_name: r for r in
            src.build_catalog(spark, [str(folder)], tags=tags, meta_limit=50).collect()}
    assert rows["a.JPG"].date_taken == dt.datetime(2024, 3, 22, 14, 30, 45)
    assert rows["c.png"].camera_model is None
    assert rows["d.mp4"].camera_model is None


def test_size_gates_are_strict(spark):
    df = spark.createDataFrame([(49, "jpg"), (50, "jpg"), (49, "mp4")], "file_size long, extension string")
    kept = src.metadata_candidates(df, 50).collect()
    assert [(r.file_size, r.extension) for r in kept] == [(49, "jpg")]
    hashed = src.gate_hashes(df, F.lit("abc"), 50).orderBy("file_size", "extension").collect()
    assert [r.md5_hash is None for r in hashed] == [False, False, True]


def test_metadata_fallback(spark):
    tags = spark.createDataFrame([
        ("p1", "PixelXDimension", "640"), ("p1", "Model", "Cam"), ("p1", "Other", "x"),
        ("p2", "Other", "only"), ("p3", "PixelXDimension", "bad"),
    ], "path string, tag string, value string")
    decoded = spark.createDataFrame(
        [("p1", 1, 2), ("p2", 3, 4), ("p3", 5, 6)], "path string, width int, height int")
    files = with_defaults(spark.createDataFrame(
        [(0, "p1"), (1, "p2"), (2, "p3")], "pos long, path string"))
    rows = with_metadata(files, tags, decoded).orderBy("pos").collect()
    assert [(r.width, r.height, r.camera_model) for r in rows] == [
        (640, 2, "Cam"), (3, 4, None), (5, 6, None)]
    assert project_tags(tags).count() == 3
    untagged = tags.filter("path <> 'p2'")
    assert with_metadata(files, untagged, decoded).filter("path = 'p2'").first().width is None


def test_json_form(spark):
    files = with_defaults(spark.createDataFrame(
        [(0, "f", -1, dt.datetime(2024, 1, 2, 3, 4, 5, 6)), (1, "g", None, None),
         (2, "h", 2 ** 63 - 1, None), (3, "i", -2 ** 63, None)],
        "pos long, id string, perceptual_hash long, date_taken timestamp"))
    docs = to_json_rows(files)
    first = json.loads(docs.collect()[0].json)
    assert first["perceptualHash"] == 2 ** 64 - 1
    assert first["dateTaken"] == "2024-01-02T03:04:05.000006Z"
    assert first["isBurstLeader"] is False and first["cameraModel"] is None
    back = from_json_rows(docs)
    assert back.schema.names == MEDIA_FILE.names
    keep = ["pos", "id", "perceptual_hash", "date_taken", "file_size"]
    assert back.select(*keep).orderBy("pos").collect() == files.select(*keep).orderBy("pos").collect()


def test_defaults(spark):
    row = with_defaults(spark.createDataFrame([(7, 3)], "pos long, file_size int")).first()
    assert (row.pos, row.id, row.file_size, row.is_blurry, row.width) == (7, "", 3, False, None)
    assert row.indexed_at is not None
    with pytest.raises(ValueError):
        with_defaults(spark.createDataFrame([("x",)], "id string"))


def picture(width, height, luma):
    """A grey PNG."""
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))
    lines = b"".join(
        b"\0" + bytes(v for x in range(width) for v in [luma(x, y)] * 3) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) \
        + chunk(b"IEND", b"")


@pytest.mark.parametrize("width,height", [(16, 16), (20, 11), (8, 8), (5, 3), (9, 4)])
def test_picture_hash_equals_pixel_table_hash(spark, tmp_path, width, height):
    def luma(x, y):
        return (x * 37 + y * 91 + x * y * 13) % 256
    (tmp_path / "p.png").write_bytes(picture(width, height, luma))
    (tmp_path / "broken.png").write_bytes(b"not a picture")
    images = read_images(spark, str(tmp_path))
    decoded = image_grids(images, "box").collect()
    assert [(r.width, r.height) for r in decoded] == [(width, height)]
    pixels = spark.createDataFrame(
        [("p", width, height, x, y, luma(x, y)) for x in range(width) for y in range(height)],
        "id string, width int, height int, x int, y int, luma int")
    cells = reduce_grid(pixels).first().cells
    assert len(cells) == 64
    assert decoded[0].cells == cells
    assert hash_images(images).count() == 1
    sharp = image_grids(images).collect()[0].cells
    assert sharp == resample_grid(pixels).first().cells


def plain_lanczos(plane, width, height):
    """Separable resampling in floating point, columns first."""
    def line(values):
        n, out = len(values), []
        scale = max(n / 8, 1)
        for c in range(8):
            def weight(i):
                t = (i + 0.5 - (c + 0.5) * n / 8) / scale
                if abs(t) >= 3:
                    return 0.0
                if abs(t) < 1e-12:
                    return 1.0
                return math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3)
            weights = [weight(i) for i in range(n)]
            out.append(sum(w * v for w, v in zip(weights, values)) / sum(weights))
        return out
    columns = [line([plane[y][x] for y in range(height)]) for x in range(width)]
    rows = [line([columns[x][r] for x in range(width)]) for r in range(8)]
    return [min(max(v, 0.0), 255.0) for row in rows for v in row]


def test_resampled_cells_equal_plain_lanczos(spark):
    rnd = random.Random(4)
    sizes = [(1, 1), (3, 9), (8, 8), (16, 5), (33, 20), (64, 50), (101, 7)]
    pictures = {f"p{k}": (w, h, [[[rnd.choice([0, 255, rnd.randrange(256)]) for _ in range(3)] for _ in range(w)]
                                 for _ in range(h)]) for k, (w, h) in enumerate(sizes)}
    rows = [(k, w, h, x, y, *data[y][x]) for k, (w, h, data) in pictures.items() for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(rows, "id string, width int, height int, x int, y int, r int, g int, b int")
    images = spark.createDataFrame(
        [(k, w, h, 3, bytearray(v for line in data for px in line for v in reversed(px))) for k, (w, h, data) in pictures.items()],
        "path string, width int, height int, n_channels int, data binary")
    decoded = {r.path: r.cells for r in image_grids(images).collect()}
    grids = {r.id: r.cells for r in resample_grid(pixels, ("r", "g", "b")).collect()}
    for one in range(3):
        name = "rgb"[one]
        found = {r.id: r.cells for r in resample_grid(pixels.withColumnRenamed(name, "luma")).collect()}
        for k, (w, h, data) in pictures.items():
            wanted = plain_lanczos([[px[one] for px in line] for line in data], w, h)
            assert all(abs(a - b) <= 0.501 for a, b in zip(found[k], wanted)), (k, name)
            pictures[k][2][0][0].append(found[k])
    for k, (w, h, data) in pictures.items():
        red, green, blue = data[0][0][3:]
        assert decoded[k] == grids[k] == [
            (2126 * r + 7152 * g + 722 * b) // 10000 for r, g, b in zip(red, green, blue)]


def whole_lanczos(plane, width, height):
    """The same in whole numbers; missing pixels are left out, null ones count with their weight only."""
    down, across = grid._weights(height), grid._weights(width)
    out = []
    for row in range(8):
        line = {}
        for x in range(width):
            known = [(int(down[row][y]), plane[x, y]) for y in range(height) if (x, y) in plane and down[row][y]]
            if known:
                d = sum(w for w, _ in known)
                values = [w * v for w, v in known if v is not None]
                line[x] = (2 * grid._STEP * sum(values) + d) // (2 * d) if values else None
        for col in range(8):
            known = [(int(across[col][x]), v) for x, v in line.items() if across[col][x]]
            values = [w * v for w, v in known if v is not None]
            if values:
                d = grid._STEP * sum(w for w, _ in known)
                out.append(min(max((2 * sum(values) + d) // (2 * d), 0), 255))
            elif known:
                out.append(None)
    return out


def test_resampling_makes_no_row_per_sample_and_cell(spark):
    rnd = random.Random(6)
    sizes = [(16, 16), (3, 9), (40, 5), (9, 33)]
    planes = [{(x, y): rnd.choice([None, 0, 255, rnd.randrange(256)]) for x in range(w) for y in range(h) if rnd.random() < 0.9}
              for w, h in sizes]
    rows = [(f"p{k}", *sizes[k], x, y, v) for k, plane in enumerate(planes) for (x, y), v in plane.items()]
    rnd.shuffle(rows)
    pixels = spark.createDataFrame(rows, "id string, width int, height int, x int, y int, luma int").repartition(3)
    grids = resample_grid(pixels)
    assert {r.id: r.cells for r in grids.collect()} == {
        f"p{k}": whole_lanczos(plane, *sizes[k]) for k, plane in enumerate(planes)}
    plan = grids._jdf.queryExecution().optimizedPlan().toString()
    # Samples are summed up before anything is listed by cell.
    assert plan.rindex("Aggregate [") > plan.rindex("Generate ")


def test_flat_folder_is_listed_in_pages(tmp_path):
    for k in range(250):
        (tmp_path / f"{k:04d}.jpg").write_bytes(b"x" * (k % 3))
    (tmp_path / "sub").mkdir()
    row = {"root_no": 0, "root": "", "inner": str(tmp_path), "is_dir": True, "length": 0,
           "trail": [str(tmp_path)], "after": None, "before": None}
    batch = pa.RecordBatch.from_pylist([row], schema=src._ARROW_ENTRY)
    pages = list(src._lister({}, 40)(iter([batch])))
    assert len(pages) == 7 and max(p.num_rows for p in pages) == 40
    files = [r for p in pages for r in p.to_pylist() if not r["is_dir"]]
    # Sizes come in a step of their own.
    assert len(files) == 250 and all(r["length"] is None for r in files)


def test_sizes_are_asked_for_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "SIZES_PER_TASK", 10)
    for k in range(120):
        (tmp_path / f"{k}.jpg").write_bytes(b"x" * k)
        (tmp_path / f"{k}.txt").write_bytes(b"x")
    rows = src.scan_media(spark, [str(tmp_path)]).collect()
    assert sorted(r.length for r in rows) == list(range(120))


def test_many_small_folders_share_tasks(spark, tmp_path, monkeypatch):
    tasks, write = [], src.store_observed

    def observed(df, name, **facts):
        if name == "listing":
            tasks.append(df.rdd.getNumPartitions())
        return write(df, name, **facts)

    monkeypatch.setattr(src, "store_observed", observed)
    for k in range(150):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "a.jpg").write_bytes(b"x" * k)
    assert sorted(r.length for r in src.scan_media(spark, [str(tmp_path)]).collect()) == list(range(150))
    assert len(tasks) == 2 and max(tasks) <= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_files_written_by_tasks_equal_those_of_spark(spark, tmp_path, scheme):
    rows = spark.createDataFrame(
        [(1, "a"), (2, None), (3, ""), (1, "é\nb"), (None, "n"), (4, "c\r"), (1, None)], "k long, t string").coalesce(1)
    src.write_files(rows, "k", "t", f"{scheme}{tmp_path}/ours")
    src.write_files(rows, "k", "t", f"{scheme}{tmp_path}/ours")
    rows.write.partitionBy("k").text(f"{tmp_path}/theirs")

    def held(root):
        return {f.parent.name: sorted(f.read_bytes().split(b"\n")) for f in root.rglob("*") if f.is_file() and f.suffix == ".txt"}

    assert held(tmp_path / "ours") == held(tmp_path / "theirs") and len(held(tmp_path / "ours")) == 5
    assert len([f for f in (tmp_path / "ours").rglob("*") if f.is_file()]) == 5


def test_large_folders_of_a_store_are_listed_by_many_tasks(spark, monkeypatch):
    ranges = []
    write = src.store_observed

    def observed(*args, **facts):
        stored, seen = write(*args, **facts)
        ranges.append(seen["n_dirs"])
        return stored, seen

    monkeypatch.setattr(src, "store_observed", observed)

    class Fake:
        """Two folders; one holds 3,000 names, some of them not ASCII."""

        def names(self, folder):
            if folder == "/lake/in/flat":
                return sorted([f"img_{k:05d}.jpg" for k in range(2990)] + [f"é{k}.png" for k in range(9)] + ["img_"])
            return ["a.jpg", "flat", "~.jpg"] if folder == "/lake/in" else []

        def page(self, folder, after, limit):
            rest = [n for n in self.names(folder) if after is None or n > after]
            return [(n, n == "flat", len(n)) for n in rest[:limit]]

    listed = src.scan_media(spark, ["fake://bucket/lake/in"], stores={"fake": Fake}, page=50, pages_per_task=2)
    rows = listed.collect()
    wanted = {f"fake://bucket/lake/in/{n}" for n in ["a.jpg", "~.jpg"]} | {
        f"fake://bucket/lake/in/flat/{n}" for n in Fake().names("/lake/in/flat") if "." in n}
    assert len(rows) == len(wanted) and {r.path for r in rows} == wanted
    assert all(r.length == len(r.path.rsplit("/", 1)[1]) for r in rows)
    # 30 tasks' worth of names: many ranges a round, and few rounds.
    assert max(ranges) >= 16 and len(ranges) <= 12


@pytest.mark.parametrize("after,before", [
    ("a", None), ("img_00100", "img_00900"), ("a", "a!"), ("é1", "é9"), ("", "b"), ("x" * 20, "x" * 20 + "y"), ("zz", None),
])
def test_cuts_lie_between(after, before):
    cuts = src.key_cuts(after, before)
    assert cuts == sorted(set(cuts)) and all(after < c and (before is None or c < before) for c in cuts)
    if after == "img_00100":
        assert len(cuts) > 16
