"""The pipeline on documents whose fate is known beforehand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arcwatch.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert {r["shard"] for r in out.select("shard").distinct().collect()} <= set(range(8))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """600 documents: 0-99 toxic, 100-119 copies and near copies of 200-219,
    120-139 with a benchmark passage, the rest clean."""
    folder = tmp_path_factory.mktemp("planted")
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list("abcdefghiklmnorstu"), 6)) for _ in range(3000)]
    words = lambda n: [str(w) for w in rng.choice(vocab, n)]
    items = [(i, " ".join(words(30))) for i in range(20)]
    texts = {i: words(80) for i in range(600)}
    for i in range(100):
        for at in (10, 40, 70):
            texts[i][at] = ["vile", "scum", "grobble"][i % 3]
    for i in range(20):
        texts[100 + i] = list(texts[200 + i])
        if i % 2:
            texts[100 + i][50] = "changed"
        texts[120 + i][20:20] = items[i][1].split()[3:27]
    rows = [(i, " ".join(t), "en", ["a", "a", "a", "b"][i % 4], 0) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i < 100)) for i in range(600) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_each_stage_does_its_work_and_no_more(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before = ids(docs)
    after = ids(stages["toxicity"](spark, docs, planted))
    assert before - after == set(range(100))
    after_near = ids(stages["near_duplicates"](spark, docs, planted))
    assert before - after_near == set(range(200, 220))
    after_clean = ids(stages["decontamination"](spark, docs, planted))
    assert before - after_clean == set(range(120, 140))
    mixed = stages["mixing"](spark, docs, planted)
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs).collect()}
    assert rates["a"] < 1 < rates["b"] and mixed.columns == docs.columns
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(450 * rates["a"], rel=0.15) and n["b"] == pytest.approx(150 * rates["b"], rel=0.2)
    dealt = stages["sharding"](spark, docs, planted)
    counts = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert sum(counts) == 600 and len(counts) == 8 and max(counts) - min(counts) <= 12


def test_run_applies_the_stages_one_after_the_other(spark, planted):
    out = corpus_pipeline.run(spark, planted)
    kept = {r["doc_id"] for r in out.collect()}
    assert not kept & (set(range(100)) | set(range(200, 220)) | set(range(120, 140)))
    # the clean rest is only resampled by source
    clean = set(range(600)) - set(range(140)) - set(range(200, 220))
    expected = mixing.mix_sources(spark.read.parquet(f"{planted}/documents.parquet").filter(F.col("doc_id").isin([*clean, *range(100, 120)])).select("doc_id", "text", "source"))
    assert kept == {r["doc_id"] for r in expected.collect()}
