"""The pipeline's stages against brute force on a small fixture."""

import math

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import common, quality, quality_rules, toxicity
from tests.llm.test_llm import ODD, brute_components, brute_leaks, brute_rules, tiktoken_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_quality_stage_against_the_model_by_hand(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    weights = model.weights.astype(np.float32).astype(float)
    want = set()
    for r in docs.collect():
        score = sum(weights[b] * v for b, v in zip(*quality.features(r.text or "")))
        if 1 - 1 / (1 + math.exp(score - model.thresholds[0])) >= corpus_pipeline.LEAST_QUALITY:
            want.add(r.doc_id)
    got = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, FOLDER).collect()}
    assert got == want and 0 < len(got) < docs.count()


def best_path(emit, steps):
    """The best labels of one chain, step by step; a tie is content."""
    score, back = list(emit[0]), []
    for e in emit[1:]:
        ways = [[score[a] + steps[a][b] for a in (0, 1)] for b in (0, 1)]
        back.append([int(w[1] >= w[0]) for w in ways])
        score = [max(w) + e[b] for b, w in enumerate(ways)]
    path = [int(score[1] >= score[0])]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_rules_stage_against_brute_force(spark, tables):
    docs, labels = tables
    field = quality_rules.train(docs, labels)
    want = set()
    for r in docs.collect():
        n_words, *_, repeated = brute_rules(r.text)
        rows, sizes, _ = quality_rules.line_features(r.text or "", field.recurring)
        if n_words < 50 or 100 * repeated > 50 * n_words:
            continue
        path = best_path((np.array(rows) @ field.weights).tolist(), field.steps.tolist())
        if sum(n for n, k in zip(sizes, path) if k) >= 0.5 * sum(sizes):
            want.add(r.doc_id)
    got = {r.doc_id for r in corpus_pipeline.quality_rules_stage(spark, docs, FOLDER).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_bpe_stage_against_the_library(spark, tables):
    library = tiktoken_of(P.path("byte_bpe_multi_50k.tiktoken"))
    for r in corpus_pipeline.byte_bpe(spark, tables[0], FOLDER).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) and r.round_trip


def test_stages_keep_the_columns_and_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.dtypes, docs.count()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        previous, docs = docs, spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.dtypes == columns and 0 < docs.count() <= before
        assert docs.select("doc_id").exceptAll(previous.select("doc_id")).count() == 0
        if name == "near duplicates":
            texts = {r.doc_id: r.text for r in previous.collect()}
            component, _ = brute_components(texts, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY)
            assert {r.doc_id for r in docs.collect()} == {k for k, c in component.items() if k == c}
        if name == "benchmark decontamination":
            assert all(brute_leaks(r.text, items)[1] == 0 for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() > 50


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(i, t, None, None, None, 1) for i, t in enumerate(ODD)] + [(None, "null key", "en", "s", 0, 2), (4, "a", "en", "s", 0, 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long")
    out = stage(spark, odd, sf_dir)
    assert set(odd.columns) <= set(out.columns) and out.count() <= odd.count()
    if name == "byte-level BPE":
        assert out.count() == odd.count() and out.where("not round_trip").count() == 0
    assert stage(spark, odd.where("false"), sf_dir).count() == 0


def test_training_without_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.rate(docs, quality.train(docs, labels)).count() == 5
    assert quality_rules.label_lines(docs, quality_rules.train(docs, labels)).count() == 5
    scored = toxicity.score(docs, toxicity.train(docs, labels)).select("toxicity.score").collect()
    assert len(scored) == 5 and all(0 <= r.score < 0.5 for r in scored)
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.rate(docs, quality.train(docs, nulls)).count() == 5 and toxicity.score(docs, toxicity.train(docs, nulls)).count() == 5


def test_one_large_row_group_is_dealt_to_many_tasks(spark, tables, tmp_path, monkeypatch):
    """Also rows that share a doc_id or have none stay, each once."""
    docs = tables[0].unionAll(tables[0].limit(5)).unionAll(tables[0].limit(3).selectExpr("cast(null as bigint) as doc_id", *tables[0].columns[1:]))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(common, "LARGEST_PART", 0.05)
    monkeypatch.setattr(common, "DEALT_PART", 1 / 64)
    one = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spread = common.dealt(one, "doc_id", "text")
    sizes = [r[0] for r in spread.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 4 and max(sizes) < one.count() / 2
    assert spread.exceptAll(one).isEmpty() and one.exceptAll(spread).isEmpty()
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.quality_rules_stage):
        parts = stage(spark, one, FOLDER).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 4
