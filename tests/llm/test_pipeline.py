from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from lumenlake.llm import language, packing, pii
from lumenlake.llm.common import table
from tests.conftest import SF
from tests.llm.brute import near_groups
import re


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "pii", "packing"]


def test_run_against_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in language.detect(docs, declared="lang", address="source").collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    first: dict[str, int] = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    unique = [(i, texts[i]) for i in first.values()]
    groups = near_groups(unique)
    left = {i: pii.mask(t) for i, t in unique if groups[i][1] == i}
    total = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        total[r["doc_id"]] += r["n_tokens"]
    assert total == {i: len(t.encode()) + 1 for i, t in left.items()}


def test_stages_keep_columns_and_bear_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _kept string"
    docs = spark.createDataFrame(
        [(1, "the cat sat with the dog and a@b.cd", "en", "s", 35, "x", "y"), (1, "the cat sat with the dog and a@b.cd", "en", "s", 35, "x", "y"),
         (2, None, "en", "s", None, None, None), (None, "another text of the same kind", None, None, 9, None, None),
         (4, "", "en", "s", 0, "x", "y")],
        schema,
    )
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, data, SF)
            assert out.columns == docs.columns
            out.collect()
        assert set(packing.best_fit_pack(data).columns) >= {"doc_id", "bin"}
    clean = corpus_pipeline.exact_dedup(spark, docs, SF).collect()
    assert len(clean) == 3
