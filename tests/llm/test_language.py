from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.llm import language
from lumenlake.llm.common import table
from lumenlake.llm.queries import op6_language
from tests.conftest import SF


def test_buckets():
    assert len(language.buckets(b"")) == 0 and len(language.buckets(b"12 !?")) == 0
    assert language.buckets(b"Abc, 12 DEF").tolist() == language.buckets(b"abc def").tolist()
    assert language.buckets("é".encode() * 50_000).max() < language.BUCKETS


def test_evidence_columns(spark):
    rows = spark.createDataFrame(
        [("https://u@a.example.de:80/x?y", '<!doctype html><HTML class=x LANG="De-at">'), ("src1", "<html>"), (None, None)],
        "a string, h string",
    )
    host = language.address_host(F.col("a"))
    got = rows.select(host, language.address_suffix(host), language.markup_language(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("a.example.de", "de", "de"), ("src1", "", ""), (None, "", None)]


def test_every_document_has_a_row_and_clean_ones_stay(spark):
    rows = op6_language(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert sum(r["kept"] for r in rows) == len(rows)
    assert sum(r["lang"] == r["declared"] for r in rows) >= 0.97 * len(rows)


def test_pages_by_markup_suffix_and_host(spark):
    pages = table(spark, SF, "pages")
    rows = language.detect(
        pages, "page_id", F.regexp_replace("html", "<[^>]*>", " "), language.markup_language("html"), "url"
    ).collect()
    assert sum(r["lang"] == r["declared"] for r in rows) >= 0.95 * len(rows)


def test_wrong_declaration_loses_against_text_and_absent_one_is_filled(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    turned = docs.withColumn(
        "lang", F.when(F.col("doc_id") % 10 == 0, F.when(F.col("lang") == "en", "de").otherwise("en"))
        .when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("lang")),
    )
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.detect(turned, declared="lang", address="source").collect()
    odd = [r for r in rows if r["doc_id"] % 10 < 2]
    assert sum(r["lang"] == truth[r["doc_id"]] for r in odd) >= 0.85 * len(odd)


def test_a_host_decides_what_the_text_leaves_open(spark):
    german = [(i, "der die das und nicht schön über straße", "de", "h.de") for i in range(40)]
    english = [(100 + i, "the and of with this that from there", "en", "h.uk") for i in range(40)]
    docs = spark.createDataFrame(
        [*german, *english, (900, "qx", None, "h.de"), (901, "qx", None, "h.uk")],
        "doc_id long, text string, lang string, source string",
    )
    got = {r["doc_id"]: r["lang"] for r in language.detect(docs, declared="lang", address="source").collect()}
    assert (got[900], got[901]) == ("de", "en")


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "h"), (1, "", None, None), (None, "the cat and the dog", "EN-us", "h"), (3, "123 !!", "en", "h")],
        "doc_id long, text string, lang string, source string",
    ).withColumn("host", F.lit("clash")).withColumn("suffix", F.lit("clash"))
    rows = language.detect(docs, declared="lang", address="source").collect()
    assert sorted((r["lang"], r["kept"]) for r in rows) == [("en", True), ("und", False), ("und", False), ("und", False)]
    assert language.detect(docs.limit(0), declared="lang", address="source").count() == 0
    bare = language.detect(docs.select("doc_id", "text")).collect()
    assert {r["lang"] for r in bare} == {"und"} and len(bare) == 4


def test_every_declared_language_is_a_candidate(spark):
    tags = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(70)]

    def text(i: int) -> str:
        return " ".join(chr(0x4E00 + 40 * i + k) * 2 + chr(0x4E00 + 40 * i + (7 * k) % 40) for k in range(40))

    rows = [(100 * i + k, text(i), tag, f"h{i}.example") for i, tag in enumerate(tags) for k in range(3 if i < 64 else 2)]
    rows += [(100_000 + i, text(i), None, f"h{i}.example") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    truth = {r[0]: tags[r[0] // 100 if r[0] < 100_000 else r[0] - 100_000] for r in rows}
    found = language.detect(docs, declared="lang", address="source").collect()
    assert len(found) == len(rows)
    assert all(r["lang"] == r["text_lang"] == truth[r["doc_id"]] and r["kept"] for r in found)
