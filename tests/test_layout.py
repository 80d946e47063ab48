from __future__ import annotations

import datetime as dt

import pytest

from lumenlake.plans import organize
from lumenlake.schema import with_defaults
from lumenlake.scratch import finished, is_shared, new_path


def files(spark, rows):
    return with_defaults(spark.createDataFrame(
        [(p, f"/in/{p}/{name}", name, name.rsplit(".", 1)[1], dt.datetime(2024, 1, day)) for p, name, day in rows],
        "pos long, path string, file_name string, extension string, date_taken timestamp"))


def counts(outcomes):
    return {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()}


@pytest.mark.parametrize("strategy", [{"type": "byType"}, {"type": "byDate", "format": "yearMonthDay"}])
def test_repeated_run_adds_nothing(spark, strategy):
    path = new_path(spark, "layout")
    first = files(spark, [(1, "a.jpg", 1), (2, "b.jpg", 2), (3, "a.jpg", 1), (4, "c.mp4", 3), (5, "d.jpg", 4)])
    missing = spark.createDataFrame([(5,)], "pos long")
    assert organize.read_layout(spark, path) is None
    assert counts(organize.execute_layout(first, strategy, path, "/out", missing)) == {"moved": 3, "skipped": 1, "failed": 1}
    assert counts(organize.execute_layout(first, strategy, path, "/out", missing)) == {"skipped": 4, "failed": 1}
    held = organize.read_layout(spark, path)
    assert sorted(r.pos for r in held.collect()) == [1, 2, 4] and set(first.columns) < set(held.columns)
    # The file that was missing comes back, with a new one.
    more = first.unionByName(files(spark, [(6, "e.png", 5)]))
    assert counts(organize.execute_layout(more, strategy, path, "/out", copy=True)) == {"copied": 2, "skipped": 4}
    assert sorted(r.pos for r in organize.read_layout(spark, path).collect()) == [1, 2, 4, 5, 6]
    assert finished(spark, f"{path}/manifest", "commit") == [1, 2]


def test_run_that_fails_leaves_no_half_result(spark, monkeypatch):
    path = new_path(spark, "layout")
    rows = files(spark, [(k, f"{k}.jpg", 1) for k in range(20)])
    organize.execute_layout(rows.filter("pos < 5"), {"type": "byType"}, path, "/out")
    write = organize._write_parts

    def fails(placed, parts, target, mode):
        write(placed.filter("pos % 2 = 0"), parts, target, mode)
        raise RuntimeError("lost")

    monkeypatch.setattr(organize, "_write_parts", fails)
    with pytest.raises(RuntimeError):
        organize.execute_layout(rows, {"type": "byType"}, path, "/out")
    assert organize.read_layout(spark, path).count() == 5
    monkeypatch.undo()
    assert counts(organize.execute_layout(rows, {"type": "byType"}, path, "/out")) == {"moved": 15, "skipped": 5}
    assert sorted(r.pos for r in organize.read_layout(spark, path).collect()) == list(range(20))


def test_scratch_on_a_cluster_is_shared():
    assert is_shared("local[8]", "file:/tmp/x") and is_shared("local", "/tmp/x")
    assert not is_shared("spark://host:7077", "file:/tmp/x") and not is_shared("yarn", "/tmp/x")
    assert not is_shared("local-cluster[3,2,1024]", "/tmp/x") and is_shared("yarn", "hdfs://a/x")
