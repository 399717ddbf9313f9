"""The pipeline's stages, each on what its predecessor kept."""

import collections

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "mix_sources", "pack_sequences"]
    columns = docs.columns
    junk = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "123 ---", "en", "s", 7), (None, "the and of to this that", None, "s", 23)], docs.schema)
    known = stages["language_id"](spark, docs.unionByName(junk), SF).cache()
    assert known.columns == columns and known.where("doc_id in (9001, 9002)").count() == 0
    assert known.where("lang is null").count() == 0 and known.where("doc_id is null").count() == 1
    assert known.where("doc_id < 9000").count() == docs.count()

    kept = stages["near_dedup"](spark, known, SF).cache()
    assert kept.columns == columns
    texts = collections.Counter(r.text for r in kept.collect())
    assert max(texts.values()) == 1 and kept.count() < known.count()

    mixed = stages["mix_sources"](spark, kept, SF)
    assert mixed.columns == columns and 0.6 < mixed.count() / kept.count() < 1.4
    assert mixed.select("doc_id").distinct().join(kept, "doc_id", "left_anti").where("doc_id is not null").count() == 0

    pieces = stages["pack_sequences"](spark, mixed, SF)
    assert pieces.where("start = 0").count() == mixed.count()
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.where("n <> 2048").count() <= 1


def test_run_of_no_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
