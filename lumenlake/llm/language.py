"""Language of a text by fusing evidence in Bayes' manner.

Evidence: likelihoods of byte trigrams, the language the markup declares, and a
prior of the host, smoothed towards its address suffix and that towards the
whole corpus.  Host, suffix and declaration counts come from grouped aggregates
of the text posteriors of all rows, in thousandths so that sums do not depend on
their order; a row's own share is taken out of its host's counts.

The trigram model is fitted on a bounded sample of rows with a declaration,
:data:`SAMPLE_ROWS` per language; every declared language has a model.  Only those
models and a table of languages by declarations are held by the driver; both list
what was seen only, so a rare tag takes little.  Likelihoods, posteriors and counts
of hosts are lists of languages too; a row leaves out languages whose likelihood is
below the best by a factor of e to the :data:`FAR`, which no prior makes up for.

Nulls in text, declaration or address are absent evidence.  A text without any
letter is ``und`` and is rejected; others are rejected when the best language has
a posterior below :data:`ACCEPT`.  Every input row gives one row, repeated ids
too.  Without any declared row there is no language to choose: all rows are
``und``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import per_text, text_or_empty
from lumenlake.scratch import store

BUCKETS = 1 << 16
SAMPLE_ROWS = 500
ACCEPT = 0.5
#: A text counts for at most so many independent trigrams: neighbours overlap.
MOST_EVIDENCE = 200.0
OVERLAP = 3.0
#: Weight of the parent distribution in smoothing, in rows.
PARENT_ROWS = 20.0
#: Logarithm of a likelihood ratio beyond any ratio of priors.
FAR = 100.0
#: Likelihoods are kept in steps of one in so many.
STEPS = 10_000
#: A task adds up trigrams of at most so many languages at once.
HELD = 32
#: Share of declarations taken to be wrong whatever the counts say.
DOUBT = 0.02


def buckets(data: bytes) -> np.ndarray:
    """Hashed trigrams of the lower-cased bytes with digits and ASCII signs left out."""
    raw = np.frombuffer(b" " + data.lower() + b" ", dtype=np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    kept = np.where(letter, raw, 32).astype(np.uint32)
    blank = kept == 32
    kept = kept[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(kept) < 3:
        return np.zeros(0, dtype=np.uint32)
    mixed = kept[:-2] * np.uint32(0x9E3779B1) + kept[1:-1] * np.uint32(0x85EBCA6B) + kept[2:] * np.uint32(0xC2B2AE35)
    return (mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)


def address_host(column: str | Column) -> Column:
    """The host of an address, or the value itself if it is none."""
    value = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.regexp_extract(value, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1)


def address_suffix(host: Column) -> Column:
    """The last label of a host; empty when it has one label only."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def markup_language(html: str | Column) -> Column:
    """The ``lang`` attribute of the html element, empty if none."""
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return F.lower(tag)


def declared_language(column: Column) -> Column:
    """The primary part of a language tag, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^\s*([A-Za-z]+)", 1))


class Model(NamedTuple):
    """Sparse by bucket: ``gain`` is what a trigram adds over an unseen one."""

    start: np.ndarray  # of each bucket's entries
    language: np.ndarray
    gain: np.ndarray
    unseen: np.ndarray  # log P of an unseen bucket by language


def _languages(docs: DataFrame) -> list[str]:
    return sorted(r["declared"] for r in docs.filter("declared != ''").select("declared").distinct().collect())


def _fit(docs: DataFrame, languages: list[str]) -> Model:
    """log P(bucket | language), in parts."""
    order = Window.partitionBy("declared").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = (
        docs.filter("declared != ''").select("doc_id", "declared")
        .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE_ROWS).drop("r").distinct()
    )
    texts = docs.join(F.broadcast(sample), ["doc_id", "declared"], "left_semi").select("declared", "text")

    def count(batches):
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}

        def out():
            for tag, table in totals.items():
                used = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tag] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(table[used], pa.int64())],
                    ["declared", "bucket", "n"],
                )
            totals.clear()

        for batch in batches:
            for tag, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tag not in totals and len(totals) == HELD:
                    yield from out()
                table = totals.setdefault(tag, np.zeros(BUCKETS, dtype=np.int64))
                table += np.bincount(buckets(data), minlength=BUCKETS)
        yield from out()

    counted = texts.mapInArrow(count, "declared string, bucket long, n long")
    summed = counted.groupBy("declared", "bucket").agg(F.sum("n").alias("n"))
    number = {tag: i for i, tag in enumerate(languages)}
    parts = [(np.zeros(0, np.int64),) * 3]
    for batch in summed.select("declared", F.col("bucket").cast("int"), "n").toArrow().to_batches():
        tags = batch.column(0).dictionary_encode()
        ids = np.array([number[t] for t in tags.dictionary.to_pylist()], dtype=np.int32)
        parts.append((ids[tags.indices.to_numpy()], batch.column(1).to_numpy(), batch.column(2).to_numpy()))
    language, bucket, n = (np.concatenate(x) for x in zip(*parts))
    rank = np.lexsort((language, bucket))
    language, bucket, n = language[rank], bucket[rank], n[rank]
    whole = np.bincount(language, weights=n, minlength=len(languages)) + 0.5 * BUCKETS
    return Model(
        np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=BUCKETS)))).astype(np.int64),
        language.astype(np.int32), np.log(2.0 * n + 1.0), np.log(0.5 / whole),
    )


def _likelihoods(model: Model, found: np.ndarray) -> np.ndarray:
    """Sum of log P over the trigrams, by language."""
    if len(found) > BUCKETS // 16:
        times = np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(times)
        times = times[used]
    else:
        used, times = np.unique(found, return_counts=True)
    start = model.start[used]
    length = model.start[used + 1] - start
    ends = np.cumsum(length)
    at = np.arange(ends[-1]) + np.repeat(start - ends + length, length)
    gains = model.gain[at] * np.repeat(times, length)
    return np.bincount(model.language[at], weights=gains, minlength=len(model.unseen)) + len(found) * model.unseen


def detect(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str | Column = "text",
    declared: str | Column | None = None,
    address: str | Column | None = None,
) -> DataFrame:
    """``doc_id, declared, host, lang, posterior, text_lang, kept``."""
    spark = docs.sparkSession

    def given(column):
        return F.lit("") if column is None else F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))

    source = docs.select(
        F.col(id_column).alias("doc_id"),
        declared_language(given(declared)).alias("declared"),
        address_host(given(address)).alias("host"),
        text_or_empty(text).cast("binary").alias("text"),
    )
    languages = _languages(source)
    if not languages:
        return source.select(
            "doc_id", "declared", "host", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"),
            F.lit("und").alias("text_lang"), F.lit(False).alias("kept"),
        )
    shared = spark.sparkContext.broadcast(_fit(source, languages))

    def make() -> Callable[[bytes], tuple]:
        model = shared.value

        def of(data: bytes) -> tuple:
            found = buckets(data)
            if not len(found):
                return 0, [], [], [], []
            weight = min(len(found) / OVERLAP, MOST_EVIDENCE) / len(found)
            total = _likelihoods(model, found)
            steps = np.rint((total - total.max()) * weight * STEPS)
            near = np.flatnonzero(steps >= -FAR * STEPS)
            steps = steps[near]
            # Posterior of the text alone, in thousandths.
            p = np.exp(steps / STEPS)
            share = np.floor(p / p.sum() * 1000 + 0.5).astype(np.int64)
            some = np.flatnonzero(share)
            return len(found), near, steps.astype(np.int64), near[some], share[some]

        return of

    fields = "n_grams long, near array<int>, loglik array<int>, likely array<int>, share array<long>"
    scored = store(per_text(source, "doc_id", F.col("text"), fields, make, keep="declared host"), "language")
    return _fuse(scored, languages)


class Evidence(NamedTuple):
    """What the whole corpus says, by language."""

    languages: list[str]
    base: np.ndarray
    said: dict[str, tuple[np.ndarray, np.ndarray]]  # by declaration: languages it was seen with, log P(declared | language)
    unsaid: np.ndarray  # the same for those it was not seen with


def _evidence(shares: DataFrame, languages: list[str]) -> Evidence:
    width = len(languages)
    table = shares.groupBy("declared", "i").agg(F.sum("s").alias("s")).toArrow()
    ids, sums = table.column("i").to_numpy(), table.column("s").to_numpy()
    total = np.bincount(ids, weights=sums, minlength=width)

    def p(i, seen):
        return np.log((1 - DOUBT) * (seen + 1000.0) / (total[i] + 1000.0 * width) + DOUBT / width)

    rows: dict[str, list[int]] = {}
    for k, d in enumerate(table.column("declared").to_pylist()):
        rows.setdefault(d, []).append(k)
    said = {d: (ids[k], p(ids[k], sums[k])) for d, k in rows.items() if d}
    base = (total + 1000.0) / (max(total.sum(), 1.0) + 1000.0 * width)
    return Evidence(languages, base, said, p(np.arange(width), 0.0))


def _fuse(scored: DataFrame, languages: list[str]) -> DataFrame:
    rows = scored.withColumn("suffix", address_suffix(F.col("host")))
    shares = rows.select("declared", "host", "suffix", F.explode(F.arrays_zip("likely", "share")).alias("e")).select(
        "declared", "host", "suffix", F.col("e.likely").alias("i"), F.col("e.share").alias("s")
    )
    shared = scored.sparkSession.sparkContext.broadcast(_evidence(shares, languages))

    def listed(sums: DataFrame, key: str, *others: str) -> DataFrame:
        """One row per key with its languages and their sums: at most one entry per language."""
        pairs = F.sort_array(F.collect_list(F.struct("i", "s")))
        return sums.groupBy(key, *others).agg(pairs.alias(f"{key}_sums"))

    by_host = store(shares.groupBy("host", "suffix", "i").agg(F.sum("s").alias("s")), "host-sums")
    by_suffix = by_host.groupBy("suffix", "i").agg(F.sum("s").alias("s"))
    priors = store(
        listed(by_host, "host", "suffix").join(listed(by_suffix, "suffix"), "suffix").select(
            "host", *[F.col(f"{k}_sums")[x].alias(f"{k}_{x}") for k in ("host", "suffix") for x in ("i", "s")]
        ),
        "host-priors",
    )
    joined = rows.join(priors, "host", "left").select(
        "doc_id", "declared", "host", "n_grams", "near", "loglik", "likely", "share",
        "host_i", "host_s", "suffix_i", "suffix_s",
    )
    id_type = scored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "declared", "host", "lang", "posterior", "text_lang", "kept"]

    def run(batches):
        import pyarrow as pa

        known = shared.value
        width, parent = len(known.languages), PARENT_ROWS * 1000.0

        def dense(ids, values) -> np.ndarray:
            out = np.zeros(width)
            out[ids.values.to_numpy()] = values.values.to_numpy()
            return out

        last, of_host, of_suffix = None, np.zeros(width), np.zeros(width)
        for batch in batches:
            (declared, hosts, grams) = (batch.column(i).to_pylist() for i in (1, 2, 3))
            found = []
            for r in range(batch.num_rows):
                if not grams[r]:
                    found.append(("und", 0.0, "und", False))
                    continue
                near, loglik, likely, share = (batch.column(i)[r].values.to_numpy() for i in (4, 5, 6, 7))
                if hosts[r] != last:
                    last = hosts[r]
                    host_i, host_s, suffix_i, suffix_s = (batch.column(i)[r] for i in (8, 9, 10, 11))
                    of_host = dense(host_i, host_s) if host_i.is_valid else np.zeros(width)
                    of_suffix = dense(suffix_i, suffix_s) if suffix_i.is_valid else np.zeros(width)
                    host_n, suffix_n = of_host.sum(), of_suffix.sum()
                own = np.zeros(width)
                own[likely] = share
                own_n, own = own.sum(), own[near]
                suffix_p = (of_suffix[near] - own + parent * known.base[near]) / (suffix_n - own_n + parent)
                host_p = (of_host[near] - own + parent * suffix_p) / (host_n - own_n + parent)
                score = loglik / STEPS + np.log(host_p)
                if declared[r]:
                    said = known.unsaid.copy()
                    if declared[r] in known.said:
                        ids, values = known.said[declared[r]]
                        said[ids] = values
                    score = score + said[near]
                best = int(score.argmax())
                posterior = round(float(1 / np.exp(score - score[best]).sum()), 6)
                text = known.languages[near[loglik.argmax()]]
                found.append((known.languages[near[best]], posterior, text, posterior >= ACCEPT))
            lang, posterior, text, kept = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(lang, pa.string()),
                 pa.array(posterior, pa.float64()), pa.array(text, pa.string()), pa.array(kept, pa.bool_())],
                names,
            )

    return joined.mapInArrow(
        run, f"doc_id {id_type}, declared string, host string, lang string, posterior double, text_lang string, kept boolean"
    )
