from __future__ import annotations

import random

import pytest

from lumenlake.llm import pii
from lumenlake.llm.queries import op1_pii
from tests.conftest import SF
from tests.llm.brute import base_spans, rows_of, sha


def ours(text: str) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in pii.spans(text) if k in pii.BASE)


@pytest.mark.parametrize("text", [
    "", "@", "a@b", "a@b.c", "a@b.c@d.e", "a@b@c.d", "x a@b.c_d@e.f y", "@a.b", "..a@b..c", "a@b.c.", "é@b.c",
    "1.2.3.4", "1.2.3", "256.1.1.1", "1.2.3.4.5.6.7.8", "01.002.3.4 9", "1.2.3.400",
    "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111 5", "1  2", "378282246310005",
    "+49 30 1234567", "+1 (555) 010-9999.", "+12345", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++49 30 1234567",
])
def test_base_spans(text):
    assert ours(text) == base_spans(text)


def test_random_texts_agree_with_the_patterns():
    pick = random.Random(5)
    for _ in range(3000):
        text = "".join(pick.choice("a@.1 2+-()%_é5") for _ in range(pick.randrange(40)))
        assert ours(text) == base_spans(text), text


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "1.1." * 100_000, "a" * 300_000 + "@", "1 " * 200_000, "a@" * 200_000):
        pii.spans(text)


def test_checksums_and_context():
    iban = "DE89 3704 0044 0532 0130 00"
    assert [s[2] for s in pii.spans(f"to {iban} now") if s[2] == "iban"] == ["iban"]
    assert not [s for s in pii.spans("to DE88 3704 0044 0532 0130 00") if s[2] == "iban"]
    assert pii.spans("his ssn is 123-45-6789")[0][2] == "ssn"
    assert not pii.spans("part 123-45-6789 here")
    plain, helped = pii.spans("1.2.3.4")[0][3], pii.spans("server ip 1.2.3.4")[0][3]
    assert helped > plain > pii.spans("version 1.2.3.4")[0][3]


def test_mask():
    assert pii.mask("mail a@b.cd now") == "mail <EMAIL> now"
    assert pii.mask("nothing") == "nothing" and pii.mask("") == ""


def test_query_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in op1_pii(spark, SF).collect()}
    for doc_id, text in rows_of("documents", SF, "doc_id, text"):
        expected = base_spans(text)
        assert rows[doc_id]["base_sha256"] == sha(expected)
        for kind in pii.BASE:
            assert rows[doc_id][f"n_{kind}"] == sum(s.startswith(kind + ":") for s in expected.split(","))
        assert set(filter(None, expected.split(","))) <= set(rows[doc_id]["spans"].split(","))


def test_edges(spark):
    schema = "doc_id long, text string, spans string, n_chars int"
    docs = spark.createDataFrame([(1, None, "x", 3), (1, "", "x", None), (None, "a@b.cd", None, 6)], schema)
    rows = pii.find_pii(docs).collect()
    assert sorted(r["n_email"] for r in rows) == [0, 0, 1]
    masked = {tuple(r) for r in pii.mask_pii(docs).collect()}
    assert masked == {(1, None, "x", 3), (1, "", "x", 0), (None, "<EMAIL>", None, 7)}
    assert pii.find_pii(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,found", [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
    ("GB82WEST12345698765432 2024", ["GB82WEST12345698765432"]),
    ("GB82 WEST 1234 5698 7654 32 USD 500", ["GB82 WEST 1234 5698 7654 32"]),
    ("DE89370400440532013000 GB82WEST12345698765432", ["DE89370400440532013000", "GB82WEST12345698765432"]),
    ("AB12 DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
    ("CI93CI0080111301134291200589 ABIDJAN", ["CI93CI0080111301134291200589"]),
    ("DE89370400440532013000X", []), ("DE8937040044053201300", []),
])
def test_ibans_end_where_their_country_says(text, found):
    assert [text[s:e] for s, e, kind, _ in pii.spans(text) if kind == "iban"] == found
    assert pii.mask(text).count("<IBAN>") == len(found)


def test_runs_of_iban_starts_are_linear():
    for text in ("DE89 " * 60_000, "XX00 " * 60_000, "A" * 300_000, "XX00" + " A" * 150_000):
        pii.spans(text)
