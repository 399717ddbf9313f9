"""Dashboard aggregates, roll-ups and the windows they need (A, W5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lettermill.functions.text import trim_all, utc_day
from lettermill.operators.filters import JOB_STATUSES, job_condition
from lettermill.operators.joins import merge_groups, sources_with_emails

DAY_MS = 86_400_000


def archive_totals(emails: DataFrame) -> DataFrame:
    return emails.where("deleted_at is null").agg(F.count("*").alias("total_emails"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("storage_used"))


def failed_sources(sources: DataFrame, now_ms: int) -> DataFrame:
    return sources.agg(F.count_if((F.col("status") == "error") & (F.col("updated_at") >= now_ms - 7 * DAY_MS)).alias("failed_last_7_days"))


def remote_failures(emails: DataFrame) -> DataFrame:
    return emails.where("deleted_at is null").agg(
        F.count_if(F.col("remote_content_status") == "failed").alias("failed"), F.count_if(F.col("remote_content_status") == "partial").alias("partial")
    )


def ingestion_history(emails: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    recent = emails.where(F.col("deleted_at").isNull() & (F.col("archived_at") >= now_ms - days * DAY_MS))
    return recent.groupBy(utc_day("archived_at").alias("day")).agg(F.count("*").alias("count")).orderBy("day")


def top_senders(emails: DataFrame, k: int = 10) -> DataFrame:
    counted = emails.where("deleted_at is null").groupBy(F.col("sender_email").alias("sender")).agg(F.count("*").alias("count"))
    return counted.orderBy(F.col("count").desc(), "sender").limit(k)


def source_stats(sources: DataFrame, emails: DataFrame) -> DataFrame:
    """Emails and bytes of every source; the sum of none is null."""
    return sources_with_emails(sources, emails).groupBy("id", "name", "status").agg(F.count("email_id").alias("email_count"), F.sum("size_bytes").alias("storage_used"))


def tag_facets(emails: DataFrame) -> DataFrame:
    tags = emails.where("deleted_at is null").select(F.explode("tags").alias("tag")).where(trim_all("tag") != "").distinct()
    return tags.orderBy(F.lower("tag"), "tag")


def queue_counts(jobs: DataFrame, now_ms: int, queues: tuple[str, ...] = ("ingestion", "indexing", "remote-content")) -> DataFrame:
    """Jobs of each queue by status; a queue without jobs has zeros."""
    counted = jobs.groupBy("queue").agg(*[F.count_if(job_condition(s, now_ms)).alias(s) for s in JOB_STATUSES])
    names = jobs.sparkSession.createDataFrame([(q,) for q in queues], "queue string")
    return names.join(counted, "queue", "left").na.fill(0)


def remote_status(assets: DataFrame) -> DataFrame:
    """``(email_id, status, archived)`` from the assets of each email."""
    by = assets.groupBy("email_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("archived", "failed", "blocked")])
    bad = F.col("failed") + F.col("blocked")
    status = F.when(bad + F.col("archived") == 0, "skipped").when(bad == 0, "archived").when(F.col("archived") > 0, "partial").otherwise("failed")
    return by.select("email_id", status.alias("status"), "archived")


def duplicate_counts(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("all"), *[F.count_if(F.col("class") == c).alias(c) for c in ("exact", "likely")])


def with_group_total(df: DataFrame, column: str, out: str = "total", by: list[str] | None = None) -> DataFrame:
    """A column's total over ``by``, or over a table of one row a source, day or sender, which is small."""
    return df.withColumn(out, F.sum(column).over(Window.partitionBy(*(by or []))))


def storage_share(stats: DataFrame) -> DataFrame:
    shown = with_group_total(stats.where("storage_used > 0"), "storage_used")
    return shown.withColumn("share", F.col("storage_used") / F.col("total")).drop("total")


def ratio_to_max(df: DataFrame, column: str, out: str = "ratio") -> DataFrame:
    return df.withColumn(out, F.col(column) / F.greatest(F.lit(1), F.max(column).over(Window.partitionBy())))


def archive_revision(emails: DataFrame, ignores: DataFrame) -> DataFrame:
    """One row that changes whenever clusters may: what cached clusters are keyed by."""
    mails = emails.agg(F.count("*").alias("n"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.max("archived_at").alias("last_archived"), F.max("deleted_at").alias("last_deleted"))
    ledger = ignores.agg(F.count("*").alias("ignored"), F.max("created_at").alias("last_ignored"))
    return mails.join(ledger, F.lit(True))


def group_status(sources: DataFrame) -> DataFrame:
    """``(root_id, status)`` of each merge group."""
    rooted = sources.join(merge_groups(sources).withColumnRenamed("source_id", "id"), "id")
    s, child = F.col("status"), F.col("id") != F.col("root_id")
    by = rooted.groupBy("root_id").agg(
        F.bool_or(s == "error").alias("e"), F.bool_or(s == "importing").alias("i"), F.bool_and(s == "paused").alias("p"),
        F.bool_or(~child & (s == "paused")).alias("rp"), F.bool_or(child & s.isin("active", "imported", "importing")).alias("ca"),
        F.bool_and(s.isin("imported", "active")).alias("a"), F.max(F.when(~child, s)).alias("own"),
    )
    status = (
        F.when(F.col("e"), "error").when(F.col("i"), "importing").when(F.col("p"), "paused")
        .when(F.col("rp") & F.col("ca"), "partially_active").when(F.col("a"), "active").otherwise(F.col("own"))
    )
    return by.select("root_id", status.alias("status"))


def preview_counters(urls: DataFrame, assets: DataFrame) -> DataFrame:
    """``(email_id, remote, archived, blocked, failed)`` for a preview's header."""
    seen = urls.groupBy("email_id").agg(F.count("*").alias("remote"))
    by = assets.groupBy("email_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("archived", "blocked", "failed")])
    return seen.join(by, "email_id", "full").na.fill(0)


def session_progress(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Sessions after a log of mailbox results ``(session_id, ok, error)``; ``last`` marks the finished ones."""
    done = results.groupBy(F.col("session_id").alias("id")).agg(F.count_if("ok").alias("__ok"), F.count_if(~F.col("ok")).alias("__bad"), F.array_sort(F.collect_list("error")).alias("__errors"))
    joined = sessions.join(done, "id", "left")
    moved = joined.withColumns({
        "completed_mailboxes": F.col("completed_mailboxes") + F.coalesce("__ok", F.lit(0)),
        "failed_mailboxes": F.col("failed_mailboxes") + F.coalesce("__bad", F.lit(0)),
        "error_messages": F.concat("error_messages", F.coalesce("__errors", F.expr("cast(array() as array<string>)"))),
    })
    last = F.col("completed_mailboxes") + F.col("failed_mailboxes") >= F.col("total_mailboxes")
    return moved.select(*sessions.columns, last.alias("last"))


def import_stats(outcome: DataFrame) -> DataFrame:
    """Messages of a dedup outcome (``status`` archived, duplicate or failed) by what became of them."""
    return outcome.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("archived", "archived"), ("duplicate", "duplicates"), ("failed", "failed"))])


def input_bytes(inputs: DataFrame) -> DataFrame:
    return inputs.groupBy("source_path").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
