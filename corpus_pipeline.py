"""From raw documents to packed training sequences, stage by stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
documents. SQL can't express the stages (trained centroids, shingle signatures, a
tokenizer), so there is no ``ORACLE_SQL``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lettermill.llm import mixing
from lettermill.llm.langid import fit, predict
from lettermill.llm.minhash import near_duplicates
from lettermill.llm.packing import PackingConfig, pack
from lettermill.session import materialize, prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language model rejects: null texts, texts without letters, texts of no learned
    language. A null label is filled in with the language found; given labels stay."""
    prepare(spark)
    known = predict(docs, fit(docs)).where(~F.col("rejected"))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document of smallest id, and of rows of
    one id the one of smallest text hash. Documents without words or id all stay."""
    kept = near_duplicates(docs).where("kept").select("doc_id").dropna().distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    found = docs.join(kept, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return found.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources take the shares their tempered weights ask for."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, neighbours along the curve together; a repeated
    document is packed once for each of its rows."""
    import public_tokenizers

    return pack(docs, PackingConfig(str(public_tokenizers.path("word_bpe_49k.json")), end_id=1))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
