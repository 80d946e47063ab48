from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenlake.scratch import new_path
from lumenlake.operators import keysets
from lumenlake.operators.numbering import with_row_number
from lumenlake.operators.skew import attach
from lumenlake.plans import duplicates as dup
from lumenlake.plans import organize, retention, stats
from lumenlake.scratch import store
from lumenlake.schema import with_defaults
from tests import models

DAY = dt.datetime(2024, 1, 1)


def catalog(spark, rows):
    """Rows as dicts with any catalogue columns; pos defaults to the order."""
    full = [{"pos": i, "id": f"f{i}", **row} for i, row in enumerate(rows)]
    schema = (
        "pos long, id string, path string, file_name string, file_size long, extension string, "
        "sha256_hash string, md5_hash string, perceptual_hash long, date_taken timestamp, "
        "camera_model string"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return with_defaults(spark.createDataFrame(
        [tuple(row.get(n, "" if n in ("path", "file_name", "extension") else None) for n in names)
         for row in full], schema,
    ))


def f(name, size, sha, **more):
    return {"file_name": name, "path": f"/in/{name}", "file_size": size, "sha256_hash": sha, **more}


def test_exact_groups_ignore_missing_digests(spark):
    files = catalog(spark, [
        f("a", 0, "zero"), f("b", 0, "zero"), f("c", 5, None), f("d", 5, None), f("e", 9, "one"),
    ])
    rows = dup.exact_groups(files).collect()
    assert [(r.hash, r.n_files, r.wasted_space, r.removable_count) for r in rows] == [
        ("zero", 2, 0, 1)]


def test_name_groups_need_two_contents(spark):
    files = catalog(spark, [
        f("A.jpg", 10, "x"), f("a.JPG", 4, "y"), f("a.jpg", 1, None),
        f("same.jpg", 3, "z"), f("SAME.jpg", 3, "z"),
        f("one.jpg", 3, "q"), f("One.jpg", 3, None),
    ])
    rows = dup.name_groups(files).collect()
    assert [(r.group_id, r.n_files, r.wasted_space, r.removable_count) for r in rows] == [
        ("name:a.jpg", 3, 5, 0)]


def test_similar_groups_skip_videos_and_spread_copies(spark):
    files = catalog(spark, [
        f("a", 10, "1", perceptual_hash=0, extension="jpg"),
        f("b", 7, "2", perceptual_hash=0, extension="mp4"),
        f("c", 5, "3", perceptual_hash=0xFF, extension="png"),
        f("d", 4, "4", perceptual_hash=0xFF, extension="png"),
        f("e", 3, "5", perceptual_hash=0xFFFF, extension="png"),
        f("g", 3, "6", perceptual_hash=None, extension="png"),
    ])
    found = dup.find_duplicates(files)
    rows = dup.of_type(found.groups, "similar").collect()
    assert [(r.group_id, r.n_files, r.wasted_space) for r in rows] == [("similar:0", 3, 9)]
    members = dup.of_type(found.members, "similar").orderBy("pos").collect()
    assert [r.pos for r in members] == [0, 2, 3]


def test_empty_input_has_zero_totals(spark):
    found = dup.find_duplicates(catalog(spark, []))
    assert found.groups.count() == 0
    total = found.totals.first()
    assert (total.total_wasted_space, total.total_groups) == (0, 0)


def test_nested_groups_keep_order_and_everything(spark):
    files = catalog(spark, [f(f"n{i}", 1, "same") for i in range(23)])
    nested = dup.nested_groups(dup.exact_members(files), chunk=10)
    rows = nested.orderBy("chunk_no").collect()
    assert [len(r.files) for r in rows] == [10, 10, 3]
    assert [x.pos for r in rows for x in r.files] == list(range(23))
    assert dup.flatten_groups(nested).count() == 23


@pytest.mark.parametrize("hot_rows", [3, 10 ** 6])
def test_keep_best_is_the_sequential_rule(spark, hot_rows):
    rnd = random.Random(3)
    rows, groups = [], {}
    for i in range(600):
        key = f"g{int(rnd.random() ** 3 * 80)}"
        date = rnd.choice([None, None, 1, 2, 3])
        size = rnd.choice([5, 6, 6, 6])
        rows.append(f(f"n{i}", size, key,
                      date_taken=None if date is None else DAY + dt.timedelta(days=date)))
        groups.setdefault(key, []).append({"pos": i, "size": size, "date": date})
    files = catalog(spark, rows)
    members = dup.exact_members(files, hot_rows=hot_rows)
    expected = {f"exact:{k}": models.best(v)["pos"] for k, v in groups.items() if len(v) > 1}
    got = {r.group_id: r.best_pos for r in retention.keep_best(members).collect()}
    assert got == expected
    doomed = retention.files_to_delete(members)
    gone = {p["pos"] for k, v in groups.items() if len(v) > 1 for p in v} - set(expected.values())
    assert {r.pos for r in doomed.collect()} == gone
    left = retention.after_deletion(files, doomed)
    assert left.count() == len(rows) - len(gone)
    assert retention.deletion_plan(files, doomed).count() == len(gone)


def test_name_matches_are_never_deleted(spark):
    files = catalog(spark, [f("a", 1, "x"), f("A", 2, "y")])
    found = dup.find_duplicates(files)
    members = found.members
    assert members.count() == 2 and found.deletable.count() == 0 and found.best.count() == 1
    assert retention.files_to_delete(members).count() == 0


@pytest.mark.parametrize("hot_rows", [4, 10 ** 6])
def test_layout_follows_the_sequential_rules(spark, hot_rows):
    rnd = random.Random(11)
    rows, plain = [], []
    for i in range(500):
        camera = rnd.choice(["A", "A", "A", "B", "C?", None])
        name = f"n{rnd.randrange(40)}.jpg"
        folder = {"C?": "C_", None: "Unknown"}.get(camera, camera)
        rows.append(f(name, 1, None, camera_model=camera))
        plain.append((f"/lib/{folder}/{name}", rnd.random() < 0.7))
    files = catalog(spark, rows)
    listed = {f"/lib/A/n{i}.jpg" for i in range(0, 40, 3)}
    existing = spark.createDataFrame([(d,) for d in listed] * 2, "destination string")
    missing = spark.createDataFrame(
        [(i,) for i, (_, there) in enumerate(plain) if not there], "pos long")
    strategy = {"type": "byCamera"}

    plan = organize.preview(files, strategy, "/lib", existing, hot_rows=hot_rows)
    ours = plan.orderBy("pos").collect()
    assert [r.destination for r in ours] == [d for d, _ in plain]
    assert [r.conflict for r in ours] == models.conflicts([d for d, _ in plain], listed)

    done = organize.outcomes(files, strategy, "/lib", existing, missing, hot_rows=hot_rows)
    assert [r.outcome for r in done.orderBy("pos").collect()] == models.execute(plain, listed)
    summary = organize.outcome_summary(done, "/lib", "t").first()
    assert summary.files_moved + summary.n_errors == 500 and summary.files_copied == 0
    lists = organize.error_lists(done, 50).orderBy("chunk_no").collect()
    messages = [r.message for r in done.orderBy("pos").collect() if r.message]
    assert [m for r in lists for m in r.errors] == messages


def test_failed_row_leaves_its_destination_free(spark):
    files = catalog(spark, [f("a.jpg", 1, None), f("a.jpg", 1, None), f("a.jpg", 1, None)])
    missing = spark.createDataFrame([(0,)], "pos long")
    rows = organize.outcomes(files, {"type": "byType"}, "/lib", missing=missing, copy=True) \
        .orderBy("pos").collect()
    assert [r.outcome for r in rows] == ["failed", "copied", "skipped"]
    assert rows[0].message.startswith("Failed to copy a.jpg")
    assert rows[2].message == "Destination already exists for a.jpg - skipping"


def destination(spark, row, strategy, dest="/lib", **more):
    df = catalog(spark, [row])
    return df.select(organize.destination_of(strategy, dest, **more).alias("d")).first().d


def test_custom_patterns(spark):
    dated = f("x.jpg", 1, None, extension="jpg", date_taken=dt.datetime(2024, 3, 5),
              camera_model="Cam {type}")
    bare = f("x.jpg", 1, None, extension="jpg")
    pattern = {"type": "custom", "pattern": "{year}/{month}/{day}/{camera}/{type}"}
    assert destination(spark, dated, pattern) == "/lib/2024/03/05/Cam JPG/JPG/x.jpg"
    assert destination(spark, bare, pattern) == "/lib/{year}/{month}/{day}/{camera}/JPG/x.jpg"
    rooted = {"type": "custom", "customPattern": "/abs/"}
    assert destination(spark, bare, rooted) == "/abs/x.jpg"
    assert destination(spark, bare, {"type": "custom", "pattern": ""}) == "/lib/x.jpg"
    with pytest.raises(Exception, match="leaves the destination"):
        destination(spark, bare, rooted, strict=True)
    with pytest.raises(Exception, match="leaves the destination"):
        destination(spark, bare, {"type": "custom", "pattern": "a/../../b"}, strict=True)


def test_camera_folders(spark):
    by_camera = {"type": "byCamera"}
    assert destination(spark, f("x", 1, None), by_camera) == "/lib/Unknown/x"
    assert destination(spark, f("x", 1, None, camera_model="  "), by_camera) == "/lib/x"
    assert destination(spark, f("x", 1, None, camera_model=" A:B\t"), by_camera) == "/lib/A_B/x"


def test_presets_and_unknown_strategies(spark):
    row = f("x.mov", 1, None, extension="mov", date_taken=dt.datetime(2024, 3, 5))
    assert destination(spark, row, "By File Type") == "/lib/Videos/x.mov"
    assert destination(spark, row, "By Date (Year/Month)") == "/lib/2024/03/x.mov"
    where = {"type": "byLocation", "locationGranularity": "exact"}
    assert destination(spark, row, where) == "/lib/ByGPS/x.mov"
    with pytest.raises(ValueError):
        destination(spark, row, {"type": "byMood"})


@pytest.mark.parametrize("strategy,parts", [
    ({"type": "byDate", "format": "yearMonth"}, ["year", "month"]),
    ({"type": "byType"}, ["folder"]),
])
def test_layout_write(spark, tmp_path, strategy, parts):
    files = catalog(spark, [
        f(f"n{i}", i, None, extension="jpg" if i % 2 else "txt",
          date_taken=DAY + dt.timedelta(days=40 * (i % 3))) for i in range(30)
    ])
    out = str(tmp_path / "layout")
    organize.write_layout(files, strategy, out)
    back = spark.read.parquet(out)
    assert back.count() == 30
    assert set(parts) <= set(back.columns)
    assert back.select(*parts).distinct().count() == (2 if parts == ["folder"] else 3)


def test_folder_report_counts_what_it_leaves_out(spark):
    files = catalog(spark, [f(f"n{i}", 1, None, camera_model=f"c{i % 13}") for i in range(65)])
    plan = organize.preview(files, {"type": "byCamera"}, "/lib")
    rows = organize.folder_report(plan).collect()
    assert len(rows) == 30
    assert {(r.n_files, r.n_more, r.more_folders) for r in rows} == {(5, 2, 3)}
    assert {r.folder for r in rows} == {f"/lib/c{i}" for i in range(10)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_splits_big_keys_without_losing_rows(spark, how):
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    if how == "left":
        counts = counts.filter("key <> 'k1'")
    got = attach(rows, counts, "key", "n", F.col("id"), how=how, hot_rows=100)
    assert got.columns.count("key") == 1
    assert got.count() == 2000
    assert got.select("id").distinct().count() == 2000
    plain = rows.join(counts, "key", how)
    assert got.select("id", "key", "n", "last").exceptAll(
        plain.select("id", "key", "n", "last")).count() == 0


def test_row_numbers(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("g"),
        F.xxhash64("id").alias("o"),
    ).repartition(6)
    ours = {r.id: r.n for r in with_row_number(df, ["g"], ["o"], "n").collect()}
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append((r.o, r.id))
    expected = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert ours == expected
    whole = with_row_number(df, [], ["o"], "n").agg(
        F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(whole) == (1, 5000, 5000)


def test_pages_and_ranges(spark):
    files = catalog(spark, [f(f"n{i}", i, None, pos=i * 10) for i in range(23)])
    rows = stats.pages(files, 5).orderBy("pos").collect()
    assert [(r.page, r.slot) for r in rows] == [(i // 5, i % 5) for i in range(23)]
    for pair in [("f4", "f9"), ("f9", "f4")]:
        ends = spark.createDataFrame([(p,) for p in pair], "id string")
        assert stats.select_range(files, ends).count() == 6


def test_statistics(spark):
    files = catalog(spark, [
        f("a", 1024, "s", md5_hash="m", extension="jpg"), f("b", 512, None, extension="raw"),
        f("c", 10, "s", extension="3gp"), f("d", 7, None, extension="txt"),
    ])
    lib = stats.library_stats(files).first()
    assert (lib.n_files, lib.total_bytes, lib.n_hashed, lib.total_size) == (4, 1553, 1, "1.5 KB")
    cover = stats.hash_coverage(files).first()
    assert (cover.with_sha256, cover.with_md5) == (2, 1)
    kinds = {r.category: (r.n_files, r.total_bytes) for r in stats.category_summary(files).collect()}
    assert kinds == {"image": (2, 1536), "video": (1, 10)}
    empty = stats.library_stats(catalog(spark, [])).first()
    assert (empty.n_files, empty.total_bytes, empty.total_size) == (0, 0, "0 B")
    assert [r.hash_prefix for r in stats.preview_hashes(files, 2).collect()] == ["s", None]
    assert {r.n_more for r in stats.preview_files(files, 3).collect()} == {1}


def test_key_sets(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "id string")
    b = spark.createDataFrame([("y",), ("z",)], "id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(keysets.all_keys(a)) == ["x", "y"]
    assert ids(keysets.add_keys(a, b)) == ["x", "y", "z"]
    assert ids(keysets.toggle_keys(a, b)) == ["x", "z"]
    files = spark.createDataFrame([("x",), ("z",)], "id string")
    assert {r.id: r.sel for r in keysets.mark(files, a, "sel").collect()} == {"x": True, "z": False}


def test_roots(spark):
    have = spark.createDataFrame([(0, "/a"), (1, "/b")], "pos long, root string")
    more = spark.createDataFrame([(0, "/b"), (1, "/c"), (2, "/a/"), (3, "/c")], "pos long, root string")
    got = keysets.add_roots(have, more).orderBy("pos")
    assert [r.root for r in got.collect()] == ["/a", "/b", "/c", "/a/"]
    none = spark.createDataFrame([], "pos long, root string")
    assert [r.root for r in keysets.add_roots(none, more).orderBy("pos").collect()] == [
        "/b", "/c", "/a/"]
    assert [r.root for r in keysets.remove_root(got, "/b").orderBy("pos").collect()] == [
        "/a", "/c", "/a/"]


def test_scratch_is_emptied(spark, tmp_path):
    from lumenlake import scratch

    files = store(catalog(spark, [f("a", 1, "x"), f("b", 2, "x")]), "files")
    dup.exact_members(files).write.parquet(str(tmp_path / "out"))
    root = scratch.scratch_root(spark)
    assert spark.read.parquet(files.scratch_path).count() == 2
    scratch.drop_table(files)
    scratch.drop_scratch(spark)
    system, folder = scratch._at(spark, root)
    assert not system.exists(folder)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_scratch_follows_the_setting_or_the_context(spark, tmp_path):
    from lumenlake import scratch

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        shared = f"file:{tmp_path}"
    assert scratch.scratch_root(spark).startswith(f"{shared.rstrip('/')}/")
    assert store(spark.range(3), "some").count() == 3


def test_a_stored_page_reads_its_ranges_only(spark):
    path = new_path(spark, "pages")
    files = spark.range(3, 4003, 2, numPartitions=7).selectExpr("id * id AS pos", "concat('f', id) AS file_name")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stats.write_pages(files, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    wanted = {}
    for r in stats.pages(files, 48).collect():
        wanted.setdefault(r.page, []).append(tuple(r))
    for page in (0, 5, 21, 41):
        read = stats.read_page(spark, path, page, 48)
        assert sorted(map(tuple, read.collect())) == sorted(wanted[page])
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*range_no", plan) and "Exchange" not in plan
    assert 7 <= spark.read.parquet(f"{path}/offsets").count() <= 8
    assert sorted(map(tuple, stats.read_page(spark, path, -1, 48).collect())) == sorted(wanted[max(wanted)])
    assert stats.read_page(spark, path, 1000, 48).count() == 0
