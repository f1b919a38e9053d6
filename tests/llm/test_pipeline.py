"""Stages of the corpus pipeline against plain versions on the smallest tables."""

import corpus_pipeline
import test_decontamination as leaks
import test_ngram_join as near
from conftest import SF
from courtflow.llm.tables import keep
from helpers import clashing, odd


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
        after[name] = docs.collect()
        if name != "shards":
            assert docs.columns == columns
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {r.doc_id for r in after["language"]} == {r.doc_id for r in start if any(c.isalpha() for c in r.text)}
    rows = [(r.doc_id, r.text) for r in after["language"]]
    assert sorted(r.doc_id for r in after["near copies"]) == sorted(d for d, _, c in near.brute(rows) if d == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in after["near copies"]]
    assert sorted(r.doc_id for r in after["leaks"]) == sorted(d for d, _, n, _ in leaks.brute(rows, items) if not n)
    words = lambda part: sum(len(r.text.split()) for r in part)
    assert abs(words(after["mixture"]) / words(after["leaks"]) - 1.5) < 0.1
    assert max(sum(r.doc_id == d for r in after["mixture"]) for d in {r.doc_id for r in after["mixture"]}) <= 2
    assert sorted(map(str, (r[:5] for r in after["shards"]))) == sorted(map(str, (tuple(r) for r in after["mixture"])))
    assert len({(r.shard, r.slot) for r in after["shards"]}) == len(after["shards"])


def test_odd_rows_pass(spark):
    docs = clashing(odd(spark))
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
    assert docs.count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, odd(spark).limit(0), SF).count() == 0
