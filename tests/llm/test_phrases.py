from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import phrases
from lumenlake.llm.queries import ORACLE, op13_phrases
from tests.conftest import SF
from tests.oracle import compare, connect


def plain_counts(docs, longest=3):
    f = Counter()
    for lang, text in docs:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang, tuple(words[i:i + m])] += 1
    return f


def plain(docs, longest=3, least=10, top=2000):
    f = plain_counts(docs, longest)
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), b in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = lang, words[i:i + m]
                if 100 * b >= 50 * candidates[part]:
                    covered.add(part)
    rows = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in covered:
            cuts = [(1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    total = Counter()
    for (lang, words), a in f.items():
        total[lang] += a if len(words) == 1 else 0
    return sorted(
        (lang, rank, p.decode(), -a, left, right, total[lang], -s)
        for lang, own in rows.items() for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)
    )


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_query_and_sql(spark):
    con = connect(SF)
    assert compare(op13_phrases(spark, SF), con, ORACLE["op13_phrases"]) is None


def made(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "É", "a'b", "x" * 300, " ", "\x1c"]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r"]) for _ in range(rnd.randint(0, 80)))
        rows.append((rnd.choice(["en", "und", None, "", "a b"]), text if rnd.random() < 0.95 else None))
    return rows + rows[: n // 4]


@pytest.mark.parametrize("options", [
    {}, {"trigger": 1}, {"trigger": 1000, "block_bytes": 500}, {"trigger": 3, "block_bytes": 2000, "top": 7},
    {"longest": 5, "least": 4}, {"longest": 2, "trigger": 2},
])
def test_same_as_plain(spark, options):
    rows = made(3, 120)
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns(
        {c: F.lit("clash") for c in ("phrase", "n", "block", "chunk", "f", "score", "_w", "_key", "rank")})
    limits = {k: v for k, v in options.items() if k in ("longest", "least", "top")}
    assert found(phrases.collocations(frame.repartition(5), **options)) == plain(rows, **limits)


def test_hot_parts_are_split(spark, monkeypatch):
    import lumenlake.operators.skew as skew

    monkeypatch.setattr(phrases, "attach", lambda *a: skew.attach(*a, hot_rows=3))
    rows = made(4, 100)
    assert found(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"))) == plain(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab .,\t\nÉ", max_size=60), max_size=6), st.integers(1, 5), st.integers(2, 4))
def test_each_phrase_is_counted_once(texts, trigger, longest):
    """Counts inside weighted chunks are those of the texts."""
    docs = [("en", t) for t in texts]
    found = Counter()
    if texts:
        table = phrases.parse(pa.array(["en"] * len(texts)), pa.array(texts), longest, trigger)
        if table.num_rows:
            block = phrases.Block(table, longest)
            tokens = [block.words[i].as_py() for i in block.ids]
            for at in block.start:
                for m in range(1, longest + 1):
                    words = tuple(tokens[at:at + m])
                    if phrases.BREAK not in words:
                        found["en", words] += int(block.weight(np.array([at]))[0])
    assert found == plain_counts(docs, longest)


def test_slices_of_a_batch_are_parsed_alike(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 40)
    texts = ["Là où À. É", "ü" * 30, "", "ß b C à", "x. É é"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(["fr"] * 100), pa.array(texts)], ["lang", "text"])
    parts = [phrases.parse(p.column("lang"), p.column("text")) for p in phrases._slices(batch)]
    assert len(parts) > 20
    apart, whole = Counter(), Counter()
    for table in parts:
        for r in table.to_pylist():
            apart[r["chunk"]] += r["n"]
    for r in phrases.parse(batch.column("lang"), batch.column("text")).to_pylist():
        whole[r["chunk"]] += r["n"]
    assert apart == whole


def test_copies_share_their_chunks():
    rnd = random.Random(1)
    passage = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(600))
    one = phrases.parse(pa.array(["en"]), pa.array([f"{passage} end"]))
    two = phrases.parse(pa.array(["en"] * 2), pa.array([f"{passage} end", f"start here {passage} other"]))
    assert two.num_rows <= one.num_rows + 4
    assert max(two.column("n").to_pylist()) >= 2


def test_edges(spark):
    schema = "doc_id long, lang string, text string"
    assert found(phrases.collocations(spark.createDataFrame([], schema))) == []
    blank = spark.createDataFrame([(1, None, None), (2, "en", ""), (3, "en", " .,\n\t!? "), (None, "en", "one")], schema)
    assert found(phrases.collocations(blank)) == []
    long_rows = [("en", "same " * 200_000), ("en", "y" * 1_000_000), (None, "A b. " * 20_000), ("und", "a b")]
    frame = spark.createDataFrame(long_rows, "lang string, text string")
    assert found(phrases.collocations(frame)) == plain(long_rows)


def test_large_counts_stay_exact(spark):
    frame = spark.createDataFrame(
        [(10**12, 10**12 + 7, 10**13 + 9)], "a long, l long, r long"
    ).selectExpr(
        "(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)))"
        " div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0))) AS s")
    assert frame.first()["s"] == 10**6 * 10**24 // ((10**12 + 7) * (10**13 + 9))
