"""Filters, ordering, paging and set operations over archive tables (F, O, X)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lettermill.functions.dates import parse_filter_timestamp
from lettermill.functions.text import clamp_positive
from lettermill.operators.joins import merge_groups


def trash_gate(df: DataFrame, trashed: bool | str | None = False) -> DataFrame:
    gone = trashed is True or trashed == "true"
    return df.where(F.col("deleted_at").isNotNull() if gone else F.col("deleted_at").isNull())


def in_source_group(df: DataFrame, sources: DataFrame, source_id: str | None) -> DataFrame:
    """Rows of a source's merge group; none for an unknown source."""
    if not source_id:
        return df
    groups = merge_groups(sources)
    root = groups.where(F.col("source_id") == source_id).select("root_id")
    members = groups.join(root, "root_id", "left_semi").select(F.col("source_id").alias("ingestion_source_id"))
    return df.join(members, "ingestion_source_id", "left_semi")


def eq_filter(df: DataFrame, import_source: str | None = None, sender: str | None = None, source_path: str | None = None) -> DataFrame:
    for column, value in (("import_source", import_source), ("sender_email", sender), ("source_path", source_path)):
        if value:
            df = df.where(F.col(column) == value)
    return df


def has_recipient(df: DataFrame, kind: str, address: str | None) -> DataFrame:
    return df.where(F.exists(F.col("recipients")[kind], lambda p: p["address"] == address)) if address else df


def has_attachments(df: DataFrame, flag: str | bool | None) -> DataFrame:
    wanted = {"true": True, "false": False, True: True, False: False}.get(flag)
    return df if wanted is None else df.where(F.col("has_attachments") == wanted)


def has_tag(df: DataFrame, tag: str | None) -> DataFrame:
    return df.where(F.array_contains("tags", tag)) if tag else df


def has_attachment_ext(df: DataFrame, links: DataFrame, attachments: DataFrame, exts: list[str] | None) -> DataFrame:
    """Emails with an attachment of any of the extensions; one with other than letters and digits is ignored."""
    good = [e.lower() for e in exts or [] if re.fullmatch(r"[A-Za-z0-9]+", e)]
    if not good:
        return df
    named = attachments.where(reduce(lambda a, b: a | b, [F.lower("filename").endswith("." + e) for e in good]))
    hits = links.join(named.select(F.col("id").alias("attachment_id")), "attachment_id", "left_semi")
    return df.join(hits.select(F.col("email_id").alias("id")), "id", "left_semi")


def in_range(df: DataFrame, sent_after: str | None = None, sent_before: str | None = None, archived_after: str | None = None, archived_before: str | None = None) -> DataFrame:
    """Closed ranges; a bound that can't be read filters nothing."""
    bound = lambda v: parse_filter_timestamp(F.lit(str(v)))
    for column, low, high in (("sent_at", sent_after, sent_before), ("archived_at", archived_after, archived_before)):
        if low:
            df = df.where(bound(low).isNull() | (F.col(column) >= bound(low)))
        if high:
            df = df.where(bound(high).isNull() | (F.col(column) <= bound(high)))
    return df


def filter_emails(emails: DataFrame, sources: DataFrame, links: DataFrame | None = None, attachments: DataFrame | None = None, **p) -> DataFrame:
    """All filters of the listing, and-ed; an empty value filters nothing."""
    df = trash_gate(emails, p.get("trashed", False))
    df = in_source_group(df, sources, p.get("source_id"))
    df = eq_filter(df, p.get("import_source"), p.get("sender"), p.get("source_path"))
    for kind in ("to", "cc", "bcc"):
        df = has_recipient(df, kind, p.get(kind))
    df = has_tag(has_attachments(df, p.get("has_attachments")), p.get("tag"))
    if links is not None and p.get("exts"):
        df = has_attachment_ext(df, links, attachments, p["exts"])
    return in_range(df, p.get("sent_after"), p.get("sent_before"), p.get("archived_after"), p.get("archived_before"))


def remote_issue(df: DataFrame, status: str = "all") -> DataFrame:
    wanted = [status] if status in ("failed", "partial") else ["failed", "partial"]
    return df.where(F.col("remote_content_status").isin(*wanted))


JOB_STATUSES = ("active", "completed", "failed", "delayed", "waiting", "paused")


def job_condition(status: str, now_ms: int) -> Column:
    waiting = F.col("state") == "waiting"
    known = {
        "active": F.col("state") == "active", "completed": F.col("state") == "completed", "failed": F.col("state") == "failed",
        "delayed": waiting & (F.col("run_at") > now_ms), "waiting": waiting & (F.col("run_at") <= now_ms), "paused": F.lit(False),
    }
    if status not in known:
        raise ValueError(f"unknown job status {status!r}")
    return known[status]


def job_status(df: DataFrame, status: str, now_ms: int) -> DataFrame:
    return df.where(job_condition(status, now_ms))


def displayable_assets(df: DataFrame) -> DataFrame:
    sheet = (F.col("status") == "archived") & F.coalesce(F.col("content_type").startswith("text/css"), F.lit(False))
    return df.where((F.col("status") != "pending") & ~sheet)


def nonzero_storage(df: DataFrame, column: str = "storage_used") -> DataFrame:
    return df.where(F.col(column) > 0)


SORTS = {"archivedAt": "archived_at", "sender": "sender_email", "subject": "subject", "sizeBytes": "size_bytes"}


def _ordered(column: str, direction: str | None) -> Column:
    return F.col(column).asc_nulls_first() if direction == "asc" else F.col(column).desc_nulls_last()


def sort_emails(df: DataFrame, sort: str | None = None, direction: str | None = "desc", *ties: str) -> DataFrame:
    """By a listing column, then by ``ties``, then by id, which makes pages stable."""
    return df.orderBy(_ordered(SORTS.get(sort, "sent_at"), direction), *ties, "id")


def paginate(df: DataFrame, page=1, limit=10, fallback: int = 10, most: int = 100) -> DataFrame:
    """One page of a sorted table; its size is the feature, and Spark takes it as top rows of each partition."""
    n = clamp_positive(limit, fallback, most)
    return df.offset((clamp_positive(page, 1, 2**31 - 1) - 1) * n).limit(n)


def page_groups(df: DataFrame, page=1, limit=25) -> DataFrame:
    return paginate(df.orderBy(F.col("count").desc(), "min_id"), page, limit, 25)


def page_issues(df: DataFrame, sort: str = "archived_at", direction: str = "desc", page=1, limit=25) -> DataFrame:
    column = sort if sort in ("archived_at", "subject", "remote_content_status") else "archived_at"
    return paginate(df.orderBy(_ordered(column, direction), "id"), page, limit, 25)


def page_jobs(df: DataFrame, page=1, limit=10) -> DataFrame:
    return paginate(df.orderBy("created_at", "id"), page, limit)


def rank_assets(df: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "archived", 0).when(F.col("status") == "failed", 1).when(F.col("status") == "blocked", 2).otherwise(3)
    return df.orderBy("email_id", rank, "id")


def sort_nocase(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.lower(column), column)


def newest_first(df: DataFrame, column: str = "created_at") -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), "id")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def combine_ids(a: DataFrame, b: DataFrame, how: str = "all") -> DataFrame:
    return a.intersect(b) if how == "all" else a.union(b).distinct()


def unique_ids(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def minus(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")
