"""The corpus pipeline, stage by stage, on what each stage receives."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from parallaxis.llm import storage
from tests.llm.test_operators import near_groups


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = storage.materialize(stage(spark, before, sf_dir), f"stage{k}")
        if k < 4:
            assert after.columns == columns and dict(after.dtypes) == dict(before.dtypes)
        if name == "line dedup":
            assert after.count() == before.count() and after.filter("n_chars <> length(text)").count() == 0
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in after.collect()} == {d for d, _, c in near_groups(rows, 5, 80, 100) if d == c}
        if name == "toxicity":
            toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1")
            assert after.join(toxic, "doc_id", "left_semi").count() < 0.4 * toxic.count()
            assert before.count() - after.count() < 1.5 * toxic.count() * before.count() / spark.read.parquet(f"{sf_dir}/labels.parquet").count()
        if name == "packing":
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
        before = after


def test_run_equals_the_stages(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.count() > 0 and pieces.filter(F.col("length") <= 0).count() == 0
