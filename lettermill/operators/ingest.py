"""First-wins deduplication of arriving messages, attachments and URLs (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lettermill.operators.components import join_hot
from lettermill.operators.joins import merge_groups


def dedup_messages(incoming: DataFrame, archive: DataFrame, sources: DataFrame) -> DataFrame:
    """``incoming (id, ingestion_source_id, message_key, input_path, ordinal)`` with ``status`` and ``survivor_id``.

    Inside a merge group the first message of a key by input and ordinal is archived, unless the
    archive ``(id, ingestion_source_id, provider_message_id)`` has the key already; others are
    duplicates of the survivor. A row of null key failed to parse.
    """
    groups = merge_groups(sources).withColumnRenamed("source_id", "ingestion_source_id")
    rooted = lambda df: df.join(groups, "ingestion_source_id", "left").withColumn("root_id", F.coalesce("root_id", "ingestion_source_id"))
    known = rooted(archive).groupBy("root_id", F.col("provider_message_id").alias("message_key")).agg(F.min("id").alias("known_id"))
    good = incoming.where("message_key is not null")
    first = rooted(good).groupBy("root_id", "message_key").agg(F.min_by("id", F.struct("input_path", "ordinal", "id")).alias("first_id"))
    # both are one row a key; only the last join meets a key as often as mail repeats it
    survivors = first.join(known, ["root_id", "message_key"], "left").select("root_id", "message_key", F.coalesce("known_id", "first_id").alias("survivor_id"))
    rows = join_hot(rooted(good), survivors, ["root_id", "message_key"])
    status = F.when(F.col("id") == F.col("survivor_id"), "archived").otherwise("duplicate").alias("status")
    done = rows.select(*incoming.columns, "survivor_id", status)
    failed = incoming.where("message_key is null").select(*incoming.columns, F.lit(None).cast("string").alias("survivor_id"), F.lit("failed").alias("status"))
    return done.unionByName(failed)


def dedup_attachments(parts: DataFrame) -> DataFrame:
    """``parts (email_id, root_id, content_hash_sha256, filename, mime_type, size_bytes, ordinal)`` with the
    ``attachment_id`` of their content in the group, and the first part's name and type."""
    key = ["root_id", "content_hash_sha256"]
    first = parts.groupBy(*key).agg(F.min_by(F.struct("filename", "mime_type", "size_bytes"), F.struct("ordinal", "email_id")).alias("w"))
    made = F.sha2(F.concat_ws("|", *key), 256).alias("attachment_id")
    return join_hot(parts.select("email_id", *key, "ordinal"), first, key).select("email_id", *key, made, "ordinal", "w.filename", "w.mime_type", "w.size_bytes")


def cap_urls(df: DataFrame, n: int = 50, key: str = "email_id") -> DataFrame:
    """The first ``n`` URLs of each message in document order: the feature's own bound."""
    by = Window.partitionBy(key).orderBy("ord", "url")
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")
