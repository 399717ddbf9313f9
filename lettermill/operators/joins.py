"""Joins of the archive tables (J). Sides are not hinted: Spark picks by their true sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lettermill.functions.html import is_safe_image
from lettermill.functions.text import trim_all


def merge_groups(sources: DataFrame) -> DataFrame:
    """``(source_id, root_id)``: a source's root is what it was merged into, or itself; groups have two levels."""
    return sources.select(F.col("id").alias("source_id"), F.coalesce("merged_into_id", "id").alias("root_id"))


def with_source_name(emails: DataFrame, sources: DataFrame, out: str = "source_name") -> DataFrame:
    named = sources.select(F.col("id").alias("ingestion_source_id"), F.col("name").alias("__name"))
    return emails.join(named, "ingestion_source_id", "left").withColumn(out, F.coalesce("__name", "import_source")).drop("__name")


def hits_to_emails(hits: DataFrame, emails: DataFrame) -> DataFrame:
    return emails.join(hits.withColumnRenamed("email_id", "id"), "id")


def email_attachments(emails: DataFrame, links: DataFrame, attachments: DataFrame) -> DataFrame:
    """``(email_id, attachment columns)`` of the emails given, each pair once."""
    held = links.distinct().join(emails.select(F.col("id").alias("email_id")).distinct(), "email_id", "left_semi")
    return held.join(attachments.withColumnRenamed("id", "attachment_id"), "attachment_id")


def with_source(emails: DataFrame, sources: DataFrame) -> DataFrame:
    detail = sources.select(F.col("id").alias("ingestion_source_id"), F.struct("name", "provider", "status", "created_at").alias("source"))
    return emails.join(detail, "ingestion_source_id", "left")


def with_thread(emails: DataFrame, sources: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``wanted`` (all by default) with ``thread``: live members of the thread in the merge group, by time."""
    groups = merge_groups(sources).withColumnRenamed("source_id", "ingestion_source_id")
    rooted = lambda df: df.join(groups, "ingestion_source_id", "left").withColumn("root_id", F.coalesce("root_id", "ingestion_source_id"))
    live = rooted(emails.where("deleted_at is null and thread_id is not null"))
    threads = live.groupBy("thread_id", "root_id").agg(
        F.array_sort(F.collect_list(F.struct("sent_at", "id", "subject", "sender_email"))).alias("thread")
    )
    return rooted(emails if wanted is None else wanted).join(threads, ["thread_id", "root_id"], "left").drop("root_id")


def sources_with_emails(sources: DataFrame, emails: DataFrame) -> DataFrame:
    """Every source with its live emails; one without keeps a row of nulls."""
    live = emails.where("deleted_at is null").select(F.col("ingestion_source_id").alias("__s"), F.col("id").alias("email_id"), "size_bytes")
    return sources.join(live, F.col("id") == F.col("__s"), "left").drop("__s")


def with_issue_assets(emails: DataFrame, assets: DataFrame) -> DataFrame:
    bad = assets.where(F.col("status").isin("failed", "blocked"))
    listed = bad.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("id", "original_url", "status", "failure_reason"))).alias("issues"))
    return emails.join(listed.withColumnRenamed("email_id", "id"), "id", "left")


def _keys(other: DataFrame, on: str | list[str]) -> DataFrame:
    """A filter asks whether a key is there, so each goes once into the join, however often it occurs."""
    return other.select(*([on] if isinstance(on, str) else on)).distinct()


def semi_filter(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(_keys(other, on), on, "left_semi")


def anti_filter(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(_keys(other, on), on, "left_anti")


def explode_json(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """One row per element of a JSON array text, or of an array column."""
    value = F.col(column) if df.schema[column].dataType.typeName() == "array" else F.from_json(column, "array<string>")
    return df.withColumn(out, F.explode(value))


def with_contact(df: DataFrame, contacts: DataFrame, email: str = "sender_email") -> DataFrame:
    known = contacts.select(F.col("email").alias("__email"), F.col("display_name").alias("contact_name"))
    return df.join(known, F.lower(trim_all(email)) == F.col("__email"), "left").drop("__email")


def resolve_assets(urls: DataFrame, assets: DataFrame, key: str = "email_id") -> DataFrame:
    """``urls`` with the asset stored under the original or the final URL, and whether it can be shown."""
    ranked = assets.select(key, F.explode(F.array_distinct(F.array_compact(F.array("original_url", "final_url")))).alias("url"), F.struct(F.when(F.col("status") == "archived", 0).otherwise(1).alias("rank"), "id", "status", "content_type", "storage_path").alias("a"))
    best = ranked.groupBy(key, "url").agg(F.min("a").alias("a"))
    usable = (F.col("a.status") == "archived") & F.col("a.storage_path").isNotNull() & is_safe_image("a.content_type")
    return urls.join(best, [key, "url"], "left").select(*urls.columns, F.col("a.id").alias("asset_id"), F.col("a.status").alias("status"), F.coalesce(usable, F.lit(False)).alias("usable"))
