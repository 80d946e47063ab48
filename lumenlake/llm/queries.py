"""Registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenlake.llm import bpe, exact, html, language, packing, phrases, pii, quality, search, sharding, simhash, toxicity, warc
from lumenlake.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).drop("keep_locator")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lang`` is what a document declares, ``source`` the host it came from."""
    return language.detect(table(spark, sf_dir, "documents"), declared="lang", address="source")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fertility_rules(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_simhash, op3_packing, op4_exact_dedup, op5_warc, op6_language, op7_html, op8_toxicity, op9_bpe,
        op10_quality, op11_search, op12_sharding, op13_phrases,
    )
}

ORACLE: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op5_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest,
                          min(page_id) OVER (PARTITION BY b) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM q
    """,
    "op11_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ),
        i AS (
            SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ),
        corpus AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d),
        q AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(w) AS term FROM i)),
        occ AS (SELECT d, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
        tf AS (SELECT d, doc_id, n, term, count(*)::BIGINT AS tf FROM occ GROUP BY ALL),
        df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
        s AS (
            SELECT q.i, q.item_id, tf.d, tf.doc_id,
                   sum(floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * df.df + 1)))::BIGINT
                       * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * tf.n * c.n) // c.l))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN corpus AS c GROUP BY ALL
        )
        SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM s WHERE score > 0
        QUALIFY rank <= 10
    """,
    "op13_phrases": r"""
        WITH d AS (
            SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]') AS pieces
            FROM documents
        ),
        p AS (SELECT lang, row_number() OVER () AS p, piece FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
        v AS (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        w AS (SELECT lang, p, unnest(w) AS x, unnest(range(len(w))) AS i FROM v),
        t AS (
            SELECT lang, x, lead(x) OVER own AS y, lead(x, 2) OVER own AS z FROM w
            WINDOW own AS (PARTITION BY p ORDER BY i)
        ),
        g AS (
            SELECT lang, 1 AS m, x AS phrase FROM t
            UNION ALL SELECT lang, 2, x || ' ' || y FROM t WHERE y IS NOT NULL
            UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM t WHERE z IS NOT NULL
        ),
        f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
        k AS (
            SELECT c.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
            FROM c CROSS JOIN (VALUES (1), (2)) AS cuts(k) WHERE k < m
        ),
        s AS (
            SELECT k.lang, k.m, k.phrase, k.a, k.k, x.f AS l, y.f AS r,
                   ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM k JOIN f AS x ON x.lang = k.lang AND x.phrase = k.x JOIN f AS y ON y.lang = k.lang AND y.phrase = k.y
        ),
        best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (
            SELECT lang, part, max(a) AS b FROM (
                SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
                FROM c WHERE m = 3
            ) GROUP BY ALL
        ),
        kept AS (
            SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.part = best.phrase
            WHERE longer.b IS NULL OR 100 * longer.b < 50 * a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang)
        QUALIFY rank <= 2000
    """,
}
