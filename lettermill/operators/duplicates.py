"""Duplicate detection over the archive (D): exact and likely clusters, and decisions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lettermill.functions.text import duplicate_hash, length_prefixed
from lettermill.operators.components import connected_components, join_hot
from lettermill.session import materialize

SEMANTIC = ["subject_hash", "sender", "recipient_fp", "sent_at", "body_hash", "attachment_fp"]


def attachment_content_fp(links: DataFrame, attachments: DataFrame) -> DataFrame:
    """``(email_id, fp)`` of the distinct sorted content hashes; emails without attachments have no row."""
    held = links.join(attachments.select(F.col("id").alias("attachment_id"), "content_hash_sha256"), "attachment_id")
    return held.groupBy("email_id").agg(duplicate_hash(F.array_join(F.array_sort(F.collect_set("content_hash_sha256")), "|")).alias("fp"))


def attachment_metadata_fp(links: DataFrame, attachments: DataFrame) -> DataFrame:
    """``(email_id, fp)`` of hash, name, type and size of all links, sorted, each field after its length."""
    held = links.join(attachments.withColumnRenamed("id", "attachment_id"), "attachment_id")
    row = F.struct(F.col("content_hash_sha256").alias("h"), F.col("filename").alias("f"), F.coalesce("mime_type", F.lit("")).alias("m"), F.col("size_bytes").alias("s"))
    listed = F.array_sort(F.collect_list(row))
    fields = lambda r: F.concat(*[length_prefixed(r[k].cast("string")) for k in "hfms"])
    return held.groupBy("email_id").agg(F.array_join(F.transform(listed, fields), "").alias("fp"))


def duplicate_signals(emails: DataFrame, links: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row per live email with what duplicates have in common.

    Letter case of senders and message ids is folded as Unicode. A blank message id is null.
    """
    live = emails.where("deleted_at is null")
    content = attachment_content_fp(links, attachments).select(F.col("email_id").alias("id"), F.col("fp").alias("attachment_fp"))
    metadata = attachment_metadata_fp(links, attachments).select(F.col("email_id").alias("id"), F.col("fp").alias("metadata_fp"))
    mid = F.trim("message_id_header")
    rows = live.join(content, "id", "left").join(metadata, "id", "left")
    return rows.select(
        "id", "sent_at", "archived_at", F.col("storage_hash_sha256").alias("storage_hash"), F.when(mid != "", mid).alias("message_id"),
        F.col("duplicate_subject_hash").alias("subject_hash"), F.lower("sender_email").alias("sender"),
        F.col("duplicate_recipient_fingerprint").alias("recipient_fp"), F.col("duplicate_body_hash").alias("body_hash"), "attachment_fp",
        F.coalesce("metadata_fp", F.lit("")).alias("metadata_fp"),
    )


def _stars(signals: DataFrame, keys: list) -> DataFrame:
    """An edge from the least id of each key to every other: never pairs."""
    keyed = signals.select("id", F.struct(*keys).alias("k"))
    least = keyed.groupBy("k").agg(F.min("id").alias("u"), F.count("*").alias("n")).where("n > 1").select("k", "u")
    return join_hot(keyed, least, "k").where("id <> u").select("u", F.col("id").alias("v"))


def exact_edges(signals: DataFrame) -> DataFrame:
    """Equal stored bytes; or equal meaning, message id and attachment details. Null equals null in the meaning."""
    stored = _stars(signals.where("storage_hash <> ''"), ["storage_hash"])
    same = _stars(signals.where("message_id is not null"), [*SEMANTIC, F.lower("message_id").alias("mid"), "metadata_fp"])
    return stored.unionByName(same).distinct()


def with_roots(signals: DataFrame) -> DataFrame:
    """Signals with ``root``: the least id of the exact component."""
    found = connected_components(exact_edges(signals))
    return signals.join(found.withColumnsRenamed({"node": "id", "component": "root"}), "id", "left").withColumn("root", F.coalesce("root", "id"))


def likely_groups(rooted: DataFrame, strict_nonempty: bool = False) -> DataFrame:
    """``(id, root, bucket)`` of emails whose meaning several exact components share.

    ``strict_nonempty`` leaves out emails whose subject and body have no comparable text.
    """
    rows = rooted.where("subject_hash is not null or body_hash is not null") if strict_nonempty else rooted
    keyed = rows.select("id", "root", F.struct(*SEMANTIC).alias("k"))
    shared = keyed.groupBy("k").agg(F.min("id").alias("bucket"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    return join_hot(keyed, shared.select("k", "bucket"), "k").select("id", "root", "bucket")


def exact_groups(rooted: DataFrame, likely: DataFrame) -> DataFrame:
    """``(id, root)`` of components of several emails that no likely group touches."""
    several = rooted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    clear = several.join(likely.select("root").distinct(), "root", "left_anti")
    return join_hot(rooted.select("id", "root"), clear, "root", "left_semi")


def drop_ignored(clusters: DataFrame, ledger: DataFrame) -> DataFrame:
    return clusters.join(ledger.select(F.col("fingerprint").alias("min_id")), "min_id", "left_anti")


def choose_keeper(members: DataFrame, by: str = "min_id") -> DataFrame:
    """The email of each cluster to keep: the earliest sent, then archived, then of least id."""
    return members.groupBy(by).agg(F.min_by("id", F.struct("sent_at", "archived_at", "id")).alias("keeper"))


def cluster_members(emails: DataFrame, links: DataFrame, attachments: DataFrame, ledger: DataFrame, strict_nonempty: bool = False) -> DataFrame:
    """``(class, min_id, id, sent_at, archived_at)`` of every cluster that isn't ignored."""
    # texts are hashed once; edges, components and buckets read the signals several times
    signals = materialize(duplicate_signals(emails, links, attachments), "signals")
    rooted = materialize(with_roots(signals), "duplicates")
    likely = likely_groups(rooted, strict_nonempty)
    exact = exact_groups(rooted, likely).select(F.lit("exact").alias("class"), F.col("root").alias("min_id"), "id")
    rows = exact.unionByName(likely.select(F.lit("likely").alias("class"), F.col("bucket").alias("min_id"), "id"))
    return drop_ignored(rows, ledger).join(rooted.select("id", "sent_at", "archived_at"), "id")


def duplicate_groups(members: DataFrame, classification: str | None = None) -> DataFrame:
    """``(fingerprint, class, count, keeper, members, min_id)`` of clusters of two or more."""
    if classification in ("exact", "likely"):
        members = members.where(F.col("class") == classification)
    groups = members.groupBy("class", "min_id").agg(
        F.count("*").alias("count"), F.min_by("id", F.struct("sent_at", "archived_at", "id")).alias("keeper"),
        F.transform(F.array_sort(F.collect_list(F.struct("sent_at", "archived_at", "id"))), lambda m: m["id"]).alias("members"),
    )
    return groups.where("count > 1").select(F.concat(F.lit("cluster:"), "min_id").alias("fingerprint"), "class", "count", "keeper", "members", "min_id")


def approved_deletions(emails: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ids to delete from decisions ``(keeper, delete array)``; a decision whose keeper is gone counts for nothing."""
    there = emails.where("deleted_at is null").select(F.col("id").alias("keeper"))
    valid = decisions.join(there, "keeper", "left_semi")
    return valid.select("keeper", F.explode(F.array_distinct("delete")).alias("id")).where("id <> keeper").select("id").distinct()


def approve_groups(emails: DataFrame, decisions: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    from lettermill.operators.mutations import soft_delete

    return soft_delete(emails, approved_deletions(emails, decisions), now_ms)


def approve_all_exact(emails: DataFrame, members: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Trashes all but the keeper of every exact cluster; likely ones stay."""
    from lettermill.operators.mutations import soft_delete

    exact = members.where("class = 'exact'")
    rest = join_hot(exact, choose_keeper(exact), "min_id").where("id <> keeper").select("id").distinct()
    return soft_delete(emails, rest, now_ms)


def ignore_groups(ledger: DataFrame, keys: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The ledger with new keys (``fingerprint``, with or without ``cluster:``), and the new ones."""
    clean = keys.select(F.regexp_replace("fingerprint", "^cluster:", "").alias("fingerprint")).where("fingerprint <> ''").distinct()
    new = clean.join(ledger, "fingerprint", "left_anti").withColumn("created_at", F.lit(now_ms).cast("long"))
    return ledger.unionByName(new.select(*ledger.columns)), new
