"""Quality rules from tokeniser fertility.

A public vocabulary measures each text: characters per token, the share of tokens
that fall back to bytes, and the evenness of the token distribution (entropy over
its maximum for that many tokens).  Bands come from all texts of a language, or
of the script of most words where no language is given, and of a size class (texts of
as many binary digits of tokens), as short texts scatter more and evenness falls with
length: quartiles of a histogram in fixed steps, widened by :data:`WIDE` times their
distance (and by a least width), so that only texts far from their like are rejected.  Histograms are grouped counts; their
quartiles do not depend on the order of rows.

Besides that, the base rule rejects texts with fewer than 20 words or with over
30 % of their words in repeated windows of eight words.

Nulls count as texts without words.  Ids may be null or repeat; every input row
gives one row.  Where a language has fewer than :data:`LEAST_TEXTS` texts of a size
class, the bands of all its texts hold, else those of all texts of that class, else
those of all texts.  A quartile is the lowest step up to which a quarter of the texts
lie; a value on a bound fits.  An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import digest_of, held, per_text, text_or_empty
from lumenlake.scratch import store

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Outer fences as Tukey has them.
WIDE = 3.0
LEAST_TEXTS = 50
CACHE = 300_000
CACHED_LENGTH = 64
#: Step of the histogram and least distance of a bound from its quartile.
STEPS = {"chars_per_token": (0.01, 0.1), "byte_share": (0.001, 0.05), "evenness": (0.002, 0.05)}
FENCES = [f"{side}_{m}" for m in STEPS for side in ("low", "high")]


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that occur at least twice."""
    n = len(words)
    if n <= WINDOW:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=n)
    width = 1
    while width < WINDOW:  # numbers for windows of twice the width, exact at each step
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        width *= 2
        if width < WINDOW:
            ids = np.unique(pairs, return_inverse=True)[1]
        else:
            _, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    start = np.flatnonzero(counts[which] > 1)
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[start] += 1
    np.add.at(cover, start + WINDOW, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _script(word: str) -> str:
    for c in word:
        if c.isalpha():
            return "LATIN" if c < "ɐ" else unicodedata.name(c, "OTHER").split()[0]
    return ""


class Meter:
    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(size)])
        self.seen: dict[bytes, bytes] = {}
        self.scripts: dict[bytes, str] = {}

    def tokens(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        missing = set(words).difference(seen)
        if len(seen) + len(missing) > CACHE:
            seen.clear()
            missing = set(words)
        long: dict[bytes, bytes] = {}
        for w in missing:
            ids = np.array(self.pieces.encode(w.decode()), dtype="<u4").tobytes()
            (seen if len(w) <= CACHED_LENGTH else long)[w] = ids
        found = (long[w] if w in long else seen[w] for w in words) if long else map(seen.__getitem__, words)
        return np.frombuffer(b"".join(found), dtype="<u4")

    def script(self, words: list[bytes]) -> str:
        """The script of most words."""
        known = self.scripts
        if len(known) > CACHE:
            known.clear()
        scripts: Counter[str] = Counter()
        for w, n in Counter(words).items():
            found = known.get(w)
            if found is None:
                found = _script(w.decode())
                if len(w) <= CACHED_LENGTH:
                    known[w] = found
            scripts[found] += n
        scripts.pop("", None)
        return min(scripts, key=lambda s: (-scripts[s], s)) if scripts else ""

    def measure(self, text: str) -> tuple:
        words = text.encode().split()
        ids = self.tokens(words)
        n = len(ids)
        chars = len(text) - sum(map(text.count, BLANKS))
        fell_back = int(self.is_byte[ids].sum()) if n else 0
        evenness = 1.0
        if n > 1:
            share = np.unique(ids, return_counts=True)[1] / n
            evenness = float(-(share * np.log(share)).sum() / np.log(n))
        return (
            len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words),
            n, chars / n if n else 0.0, fell_back / n if n else 0.0, round(evenness, 6), self.script(words),
        )


def measures(docs: DataFrame, model: str, id_column: str, text_column: str, language_column: str | None) -> DataFrame:
    """Counts and token measures per row."""
    with open(model, "rb") as f:
        pieces = f.read()  # fixed size
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    content = digest_of("meter", pieces)

    def make() -> Callable[[str], tuple]:
        return held(content, lambda: Meter(shared.value)).measure

    spoken = F.lit(None).cast("string") if language_column is None else F.lower(F.trim(F.col(language_column)))
    fields = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "n_tokens long, chars_per_token double, byte_share double, evenness double, script string"
    )
    source = docs.select(F.col(id_column).alias("doc_id"), spoken.alias("spoken"), text_or_empty(text_column).alias("text"))
    return per_text(source, "doc_id", F.col("text"), fields, make, keep="spoken")


def _bands(measured: DataFrame) -> DataFrame:
    """``band, size, n, low_*, high_*`` from all texts with a token: one row per language
    or script and size class, one per language or script (size 0), one per size class
    (band ''), and one for all."""
    steps = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / step).cast("long").alias("step"))
        for m, (step, _) in STEPS.items()
    ])
    judged = measured.filter("n_tokens > 0")
    bins = judged.select("band", "size", F.explode(steps).alias("s")).groupBy("band", "size", "s.measure", "s.step").count()
    wider = F.array_distinct(F.array(*[
        F.struct(band.alias("band"), size.alias("size"))
        for band in (F.col("band"), F.lit("")) for size in (F.col("size"), F.lit(0))
    ]))
    both = (
        bins.withColumn("k", F.explode(wider)).groupBy("k.band", "k.size", "measure", "step")
        .agg(F.sum("count").alias("count"))
    )
    # Rows of a band are its steps.
    whole = Window.partitionBy("band", "size", "measure")
    placed = both.withColumn("upto", F.sum("count").over(whole.orderBy("step"))).withColumn("n", F.sum("count").over(whole))

    def quartile(q: float):
        return F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("step")))

    quarters = placed.groupBy("band", "size", "measure").agg(
        F.max("n").alias("n"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3")
    )
    sides = []
    for m, (step, least) in STEPS.items():
        spread = F.greatest((F.col("q3") - F.col("q1") + 1) * step * WIDE, F.lit(least))
        own = F.col("measure") == m
        sides.append(F.max(F.when(own, F.col("q1") * step - spread)).alias(f"low_{m}"))
        sides.append(F.max(F.when(own, (F.col("q3") + 1) * step + spread)).alias(f"high_{m}"))
    return quarters.groupBy("band", "size").agg(F.max("n").alias("n"), *sides)


def fertility_rules(
    docs: DataFrame,
    model: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str | None = "lang",
) -> DataFrame:
    """Counts, token measures, ``base_failed`` and ``kept`` per row."""
    measured = store(measures(docs, model, id_column, text_column, language_column), "measures").withColumn(
        "band", F.coalesce(F.nullif(F.col("spoken"), F.lit("")), "script", F.lit(""))
    ).withColumn("size", F.length(F.bin("n_tokens")))
    bands = store(_bands(measured), "bands")
    fence = F.struct(*FENCES)
    known = bands.filter((F.col("n") >= LEAST_TEXTS) | ((F.col("band") == "") & (F.col("size") == 0)))
    named, unnamed = known.filter("band != ''"), known.filter("band = ''")
    joined = (
        measured.join(named.filter("size > 0").select("band", "size", fence.alias("f1")), ["band", "size"], "left")
        .join(named.filter("size = 0").select("band", fence.alias("f2")), "band", "left")
        .join(unnamed.filter("size > 0").select("size", fence.alias("f3")), "size", "left")
    )
    every = unnamed.filter("size = 0").first()  # one row, none for texts without tokens
    last = [] if every is None else [F.struct(*[F.lit(every[c]).alias(c) for c in FENCES])]
    joined = joined.withColumn("f", F.coalesce("f1", "f2", "f3", *last))
    within = F.lit(True)
    for m in STEPS:
        if m != "evenness":
            within = within & (F.col(m) <= F.col(f"f.high_{m}"))
        if m != "byte_share":
            within = within & (F.col(m) >= F.col(f"f.low_{m}"))
    fits = (F.col("n_tokens") == 0) | F.coalesce(within, F.lit(True))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & fits).alias("kept"), "band", "n_tokens",
        F.round("chars_per_token", 6).alias("chars_per_token"), F.round("byte_share", 6).alias("byte_share"),
        "evenness",
    )
