"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lettermill.llm.alignment import AlignConfig, align, count_links
from lettermill.llm.annforest import nearest
from lettermill.llm.chat import format_chats
from lettermill.llm.embdedup import embedding_near_duplicates
from lettermill.llm.langid import fit, held_out, predict
from lettermill.llm.licenses import scan_licenses
from lettermill.llm.minhash import MinHashConfig, near_duplicates
from lettermill.llm import mixing, urlfilter
from lettermill.llm.packing import PackingConfig, pack
from lettermill.llm.pieces import PieceEncoder
from lettermill.llm.sharding import shard
from lettermill.llm.tokenfile import TokenFileConfig, read_tokens, write_tokens
from lettermill.llm.urlfilter import judge_urls
from lettermill.llm.variants import group_variants
from lettermill.session import prepare, scratch_path


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, MinHashConfig(words=4))


def op2_bitplane_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "token-file")
    write_tokens(docs, path, TokenFileConfig(_vocabulary("byte_bpe_50k.json"), end_id=2))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_role_repair_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_conditional_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_centroid_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs, model, keep=["doc_id"]).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_sorted_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, PackingConfig(_vocabulary("word_bpe_49k.json"), end_id=1))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_prefix_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op10_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"),
    )
    placed = shard(sized, spare_key="text_crc32")
    return placed.select(*sized.columns, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = AlignConfig(_vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), cfg)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return count_links(aligned.withColumn("groups_sha256", digest).drop("groups"), PieceEncoder(cfg.piece_path).width)


def op12_trie_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_bitplane_token_files": op2_bitplane_token_files,
    "op3_role_repair_chat": op3_role_repair_chat,
    "op4_conditional_license_scan": op4_conditional_license_scan,
    "op5_centroid_language_id": op5_centroid_language_id,
    "op6_sorted_projection_dedup": op6_sorted_projection_dedup,
    "op7_curve_packing": op7_curve_packing,
    "op8_poisson_mixing": op8_poisson_mixing,
    "op9_prefix_forest_search": op9_prefix_forest_search,
    "op10_bounded_ring_sharding": op10_bounded_ring_sharding,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_trie_spelling_variants": op12_trie_spelling_variants,
    "op13_bloom_cascade_urls": op13_bloom_cascade_urls,
}


def _prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(prepare(spark), sf_dir)


QUERIES = {name: _prepared(f) for name, f in _OPERATORS.items()}

ORACLE_SQL: dict[str, str] = {
    "op8_poisson_mixing": mixing.oracle_sql(),
    "op13_bloom_cascade_urls": urlfilter.oracle_sql(),
}
