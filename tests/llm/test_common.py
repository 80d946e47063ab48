from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from lumenlake.llm.common import digest_of, held, per_text


def built(spark, content: str, tasks: int) -> dict[int, set[str]]:
    """Per worker process, which objects its tasks were given."""

    def make():
        name = held(content, lambda: uuid.uuid4().hex)
        return lambda text: (os.getpid(), name)

    rows = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("doc_id"))
    found: dict[int, set[str]] = {}
    for r in per_text(rows, "doc_id", F.lit("x"), "pid long, name string", make).collect():
        found.setdefault(r["pid"], set()).add(r["name"])
    return found


def test_tables_outlive_a_task_and_never_serve_another_content(spark):
    once, again = (built(spark, "first", 64) for _ in range(2))
    assert len(once) < 64 and all(len(names) == 1 for names in once.values())
    both = once.keys() & again.keys()
    assert both and all(once[pid] == again[pid] for pid in both)
    other = built(spark, "second", 64)
    assert all(len(names) == 1 for names in other.values())
    assert not set().union(*other.values()) & set().union(*once.values(), *again.values())


def test_digests_tell_contents_apart():
    assert digest_of("codec", {b"a": 1}, "x") == digest_of("codec", {b"a": 1}, "x")
    assert len({digest_of("codec", {b"a": n}, p) for n in (1, 2) for p in "xy"}) == 4
