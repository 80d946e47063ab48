from __future__ import annotations

import math
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from lumenlake.llm import quality
from lumenlake.llm.queries import PIECES, op10_quality
from tests.conftest import SF
from tests.llm.brute import base_quality, rows_of

MODEL = public_tokenizers.path(PIECES)


def test_repeated_words_against_brute_force():
    pick = random.Random(2)
    for _ in range(400):
        words = [pick.choice("abc") * pick.randrange(1, 2 + _ % 3) for _ in range(pick.randrange(60))]
        assert quality.repeated_words([w.encode() for w in words]) == base_quality(" ".join(words))[4], words


@pytest.mark.parametrize("text", ["", "\n\n", "a\na\n a\na", "x # * $ % & | < > y", "a\x0bb\x0cc\rd", "a b", "é\x1cü x\n\x1c\n\x1c"])
def test_base_counts(text):
    with open(MODEL, "rb") as f:
        measured = quality.Meter(f.read()).measure(text)
    assert measured[:5] == base_quality(text)


def test_query_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in op10_quality(spark, SF).collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    documents = rows_of("documents", SF, "doc_id, text, lang")
    assert len(rows) == len(documents)
    for doc_id, text, lang in documents:
        r = rows[doc_id]
        base = base_quality(text)
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["base_failed"] and r["kept"])
        ids = [i for w in (text or "").encode().split() for i in pieces.encode(w.decode())]
        assert r["n_tokens"] == len(ids)
        counts = Counter(ids).values()
        if len(ids) > 1:
            entropy = -sum(c / len(ids) * math.log(c / len(ids)) for c in counts) / math.log(len(ids))
            assert r["evenness"] == pytest.approx(entropy, abs=1e-5)
            assert r["chars_per_token"] == pytest.approx(base[1] / len(ids), abs=1e-5)
    fine = [r for r in rows.values() if not r["base_failed"]]
    assert sum(r["kept"] for r in fine) >= 0.9 * len(fine)


def test_foreign_bytes_are_rejected_and_edges(spark):
    fine = [(i, " ".join(random.Random(i).choices("the and of to in is with water house great".split(), k=150)) + f" {i}", "en") for i in range(80)]
    odd = [(500, " ".join(chr(0x13000 + i) for i in range(60)), "en")]
    edges = [(600, None, None), (600, "", "en"), (None, "short text", None)]
    docs = spark.createDataFrame(fine + odd + edges, "doc_id long, text string, lang string")
    rows = quality.fertility_rules(docs, MODEL).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 84
    assert got[500]["byte_share"] > 0.5 and not got[500]["base_failed"] and not got[500]["kept"]
    assert not got[600]["kept"] and not got[None]["kept"]
    assert quality.fertility_rules(docs.limit(0), MODEL).count() == 0
    assert {r["band"] for r in quality.fertility_rules(docs, MODEL, language_column=None).collect()} >= {"LATIN"}


def test_the_script_is_that_of_all_words():
    with open(MODEL, "rb") as f:
        meter = quality.Meter(f.read())
    text = " ".join("слово" if i % 2 == 0 and i % 6 else "word" for i in range(128))
    glossary = " ".join(["слово", "word", "word"] * 128 + ["слово"] * 3)
    every_other = " ".join("слово" if i % 2 == 0 else "word" for i in range(128)) + " word"
    for t in (text, glossary, every_other):
        assert meter.measure(t)[-1] == "LATIN"
    assert meter.measure("12 - слово " + "с" * 100)[-1] == "CYRILLIC" and meter.measure("1 2")[-1] == ""


def plain_fences(rows: list[dict]) -> dict[str, tuple[float, float]]:
    """Outer fences of each measure around the quartiles of its steps."""
    fences = {}
    for m, (step, least) in quality.STEPS.items():
        steps = sorted(math.floor(r[m] / step) for r in rows)
        q1, q3 = (steps[math.ceil(len(steps) * q) - 1] for q in (0.25, 0.75))
        spread = max((q3 - q1 + 1) * step * quality.WIDE, least)
        fences[m] = (q1 * step - spread, (q3 + 1) * step + spread)
    return fences


def test_bands_and_verdicts_against_plain_version(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spoken = quality.F.when(docs["doc_id"] % 3 == 0, docs["lang"])
    extra = [(-i, "junk", " ".join(["water"] * 3 + [f"w{i}", "x" * i] * 12)) for i in range(1, 60)] + [(-99, "rare", "ᚠ" * 900)]
    docs = docs.select("doc_id", spoken.alias("lang"), "text").unionByName(
        spark.createDataFrame(extra, "doc_id long, lang string, text string")
    )
    rows = [r.asDict() for r in quality.measures(docs, MODEL, "doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: r for r in quality.fertility_rules(docs, MODEL).collect()}
    groups: dict[tuple, list[dict]] = {}
    for r in rows:
        r["band"] = r["spoken"] or r["script"] or ""
        r["size"] = len(f"{r['n_tokens']:b}")
        if r["n_tokens"]:
            for key in {(r["band"], r["size"]), (r["band"], 0), ("", r["size"]), ("", 0)}:
                groups.setdefault(key, []).append(r)
    fences = {k: plain_fences(g) for k, g in groups.items() if len(g) >= quality.LEAST_TEXTS or k == ("", 0)}
    verdicts = set()
    for r in rows:
        order = [("", r["size"]), ("", 0)]
        if r["band"]:
            order = [(r["band"], r["size"]), (r["band"], 0), *order]
        f = next(fences[k] for k in order if k in fences)
        fits = not r["n_tokens"] or (
            f["chars_per_token"][0] <= r["chars_per_token"] <= f["chars_per_token"][1]
            and r["byte_share"] <= f["byte_share"][1] and r["evenness"] >= f["evenness"][0]
        )
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert got[r["doc_id"]]["kept"] == (fits and not failed), r
        verdicts.add((fits, failed))
    assert len(got) == len(rows) and len(verdicts) >= 3


def test_short_texts_are_judged_too(spark):
    fine = [(i, " ".join(random.Random(i).choices("the and of to in is with water house great".split(), k=24)), "en") for i in range(200)]
    odd = [(500, " ".join(f"{chr(0x13000 + i)}" for i in range(24)), "en")]
    docs = spark.createDataFrame(fine + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.fertility_rules(docs, MODEL).collect()}
    assert got[500]["n_words"] == 24 and not got[500]["base_failed"] and not got[500]["kept"]
    assert sum(got[i]["kept"] for i in range(200)) == 200


def test_clashing_columns_long_texts_and_repeated_rows(spark):
    long = "the house and the great water of all in it " * 60_000
    names = ["band", "size", "f", "f1", "n", "measure", "step", "script", "spoken", "n_tokens", "kept", "_text", "low_evenness"]
    rows = [(1, long, "en"), (1, long, "en"), (2, "short", "en"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumns({c: quality.F.lit("clash") for c in names})
    got = sorted(quality.fertility_rules(docs, MODEL).collect())
    assert [r["doc_id"] for r in got] == [1, 1, 2, 3] and got[0] == got[1]
    assert got[0]["n_words"] == 10 * 60_000 == got[0]["n_repeat_words"] and got[0]["base_failed"]
    assert got[3]["n_tokens"] == 0 and not got[3]["kept"]
