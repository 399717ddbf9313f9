"""The archive's front-to-back views (V): each is one composition of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lettermill.functions.dates import iso_ms
from lettermill.functions.html import css_urls, extract_remote_urls, is_safe_image, is_tracking_pixel, is_tracking_url, scan_tags, srcset_urls, to_remote_url, url_block_reason
from lettermill.functions.text import flatten_recipients, progress_percent, sender_label, subject_label
from lettermill.operators import aggregates as agg
from lettermill.operators.duplicates import cluster_members, duplicate_groups
from lettermill.operators.filters import displayable_assets, filter_emails, job_status, newest_first, page_groups, page_issues, page_jobs, rank_assets, remote_issue, sort_emails
from lettermill.operators.joins import email_attachments, merge_groups, with_issue_assets, with_source, with_source_name, with_thread
from lettermill.operators.search import bm25, match_clauses, match_with_fallback, order_hits, to_documents
from lettermill.schemas import Archive


def list_emails(tables: Archive, postings: DataFrame | None = None, lengths: DataFrame | None = None, query: str | None = None, clauses: dict[str, str] | None = None, field_match: str = "all", strategy: str = "last", fields=None, sort=None, direction="desc", page=1, limit=10, **filters) -> tuple[DataFrame, int]:
    """One page of the listing or search, and the number of all hits."""
    rows = with_source_name(filter_emails(tables.emails, tables.sources, tables.links, tables.attachments, **filters), tables.sources)
    hits = None
    if postings is not None and (query or clauses):
        hits = match_clauses(postings, clauses, field_match, query, fields) if clauses else match_with_fallback(postings, query, fields, strategy)
    if hits is None:
        return to_documents(sort_emails(rows, sort, direction), page, limit), rows.count()
    found = rows.join(hits.withColumnRenamed("email_id", "id"), "id", "left_semi")
    if query and lengths is not None:
        scored = bm25(hits, postings, lengths, query, fields).withColumnRenamed("email_id", "id")
        ordered = order_hits(found.join(scored, "id", "left"), sort, direction)
    else:
        ordered = sort_emails(found, sort, direction)
    return to_documents(ordered, page, limit), found.count()


def email_detail(tables: Archive, ids: list[str]) -> DataFrame:
    wanted = tables.emails.where(F.col("id").isin(*ids))
    files = email_attachments(wanted, tables.links, tables.attachments)
    listed = files.groupBy(F.col("email_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("filename", "mime_type", "size_bytes", "attachment_id"))).alias("attachments"))
    rows = with_source(with_thread(tables.emails, tables.sources, wanted), tables.sources).join(listed, "id", "left")
    return rows.select("id", "subject", "sender_email", flatten_recipients("recipients").alias("recipients"), iso_ms("sent_at").alias("sent_at"), "sent_at_kind", "tags", "source", "thread", "attachments")


def facets(tables: Archive) -> DataFrame:
    return agg.tag_facets(tables.emails)


def dashboard(tables: Archive, now_ms: int) -> dict[str, DataFrame]:
    return {
        "totals": agg.archive_totals(tables.emails), "failed_sources": agg.failed_sources(tables.sources, now_ms), "remote_failures": agg.remote_failures(tables.emails),
        "history": agg.ingestion_history(tables.emails, now_ms), "senders": agg.top_senders(tables.emails), "sources": agg.source_stats(tables.sources, tables.emails),
    }


def remote_content_issues(tables: Archive, status: str = "all", sort="archived_at", direction="desc", page=1, limit=25) -> tuple[DataFrame, int]:
    """Emails whose remote content failed, trashed ones too, with what failed."""
    rows = remote_issue(tables.emails, status)
    shown = with_issue_assets(page_issues(rows, sort, direction, page, limit), tables.assets)
    labels = [subject_label("subject").alias("subject"), sender_label(F.col("sender_name"), F.col("sender_email")).alias("sender")]
    return shown.select("id", *labels, "archived_at", "remote_content_status", "issues"), rows.count()


def remote_assets(tables: Archive, email_ids: list[str]) -> DataFrame:
    rows = displayable_assets(tables.assets.where(F.col("email_id").isin(*email_ids)))
    shown = (F.col("status") == "archived") & is_safe_image("content_type")
    return rank_assets(rows.withColumn("viewable", shown))


def list_sources(tables: Archive) -> DataFrame:
    """Sources, newest first, with progress of a running import and the status of their group."""
    running = tables.sessions.groupBy(F.col("ingestion_source_id").alias("id")).agg(F.sum("processed_bytes").alias("done"), F.sum("total_bytes").alias("all"))
    groups = merge_groups(tables.sources).withColumnRenamed("source_id", "id")
    status = agg.group_status(tables.sources).withColumnRenamed("status", "group_status")
    rows = tables.sources.join(running, "id", "left").join(groups, "id").join(status, "root_id")
    return newest_first(rows.select("id", "name", "status", "root_id", "group_status", progress_percent("done", "all").alias("progress"), "created_at"))


def queue_overview(jobs: DataFrame, now_ms: int, queues: tuple[str, ...]) -> DataFrame:
    return agg.queue_counts(jobs, now_ms, queues)


def queue_jobs(jobs: DataFrame, queue: str, status: str, now_ms: int, page=1, limit=10) -> DataFrame:
    rows = job_status(jobs.where(F.col("queue") == queue), status, now_ms)
    return page_jobs(rows, page, limit).select("id", "name", "state", "attempts", "created_at", F.split_part("error", F.lit("\n"), F.lit(1)).alias("failed_reason"))


def contact_map(contacts: DataFrame) -> DataFrame:
    """``(email, display_name)``, the form in which a map of any size can be joined."""
    return contacts.select("email", "display_name")


def review_duplicates(tables: Archive, classification: str | None = None, page=1, limit=25) -> DataFrame:
    members = cluster_members(tables.emails, tables.links, tables.attachments, tables.ignores)
    return page_groups(duplicate_groups(members, classification), page, limit)


def audit_urls(df: DataFrame, html: str, key: str) -> DataFrame:
    """``(key, pos, tag, url, pixel, tracker, blocked)`` of every remote URL of a tag: ``src``, ``href``,
    ``poster``, ``background``, source sets and style attributes, and of style sheets (tag ``style``)."""
    a, none = F.col("attrs"), F.expr("cast(array() as array<string>)")
    named = F.array_compact(F.array(*[to_remote_url(a[k]) for k in ("src", "href", "poster", "background")]))
    urls = F.array_distinct(F.concat(named, F.coalesce(srcset_urls(a["srcset"]), none), F.coalesce(css_urls(a["style"]), none)))
    tags = scan_tags(df, html, key).select(key, F.col("pos").cast("long").alias("pos"), "tag", is_tracking_pixel(a).alias("pixel"), F.explode(urls).alias("url"))
    sheets = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<style[^>]*>(.*?)</style>"), 1)
    styled = df.select(key, F.posexplode(sheets).alias("pos", "__css")).select(key, F.col("pos").cast("long").alias("pos"), F.lit("style").alias("tag"), F.lit(False).alias("pixel"), F.explode(F.array_distinct(css_urls(F.col("__css")))).alias("url"))
    return tags.unionByName(styled).withColumn("tracker", is_tracking_url("url")).withColumn("blocked", url_block_reason("url"))


def archived_urls(df: DataFrame, html: str, key: str) -> DataFrame:
    return extract_remote_urls(df, html, key)


