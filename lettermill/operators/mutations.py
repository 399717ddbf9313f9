"""Table mutations (M): each takes tables and returns new ones, with an outcome frame where one is due."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lettermill.functions.html import is_tracking_url
from lettermill.functions.tags import apply_tag_changes, normalize_tags
from lettermill.operators.aggregates import remote_status, source_stats
from lettermill.operators.joins import merge_groups
from lettermill.schemas import Archive
from lettermill.session import dealt

NOT_FOUND = "Archived email not found"


def _outcome(emails: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, ok, error)`` of each requested id, once."""
    there = emails.select("id", F.lit(True).alias("ok"))
    asked = ids.select("id").distinct().join(there, "id", "left")
    return asked.select("id", F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("ok").isNull(), NOT_FOUND).alias("error"))


def _marked(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(key), F.lit(True).alias("__hit")).distinct(), key, "left")


def soft_delete(emails: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    stamp = F.when(F.col("__hit") & F.col("deleted_at").isNull(), F.lit(now_ms).cast("long")).otherwise(F.col("deleted_at"))
    return _marked(emails, ids).withColumn("deleted_at", stamp).select(*emails.columns), _outcome(emails, ids)


def restore(emails: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    cleared = F.when(F.col("__hit").isNull(), F.col("deleted_at"))
    return _marked(emails, ids).withColumn("deleted_at", cleared).select(*emails.columns), _outcome(emails, ids)


def permanent_delete(tables: Archive, ids: DataFrame) -> tuple[Archive, DataFrame, DataFrame]:
    """Removes emails, links, assets and index rows; an attachment goes with its last link.

    Also returns the storage paths left over and the outcome.
    """
    gone = ids.select(F.col("id").alias("email_id")).distinct()
    dead = tables.emails.join(gone.withColumnRenamed("email_id", "id"), "id", "left_semi")
    links = tables.links.join(gone, "email_id", "left_anti")
    # links are read once: an attachment is lost where every link of it goes
    held = tables.links.join(gone.withColumn("__gone", F.lit(True)), "email_id", "left").select("attachment_id", F.col("__gone").isNotNull().alias("__gone"))
    lost = dealt(held, "attachment_id").groupBy("attachment_id").agg(F.bool_and("__gone").alias("__lost")).where("__lost").select("attachment_id")
    attachments = tables.attachments.join(lost.withColumnRenamed("attachment_id", "id"), "id", "left_anti")
    orphans = tables.attachments.join(lost.withColumnRenamed("attachment_id", "id"), "id", "left_semi").select("storage_path")
    orphans = orphans.unionByName(dead.select("storage_path")).where("storage_path is not null").distinct()
    left = tables.with_tables(
        emails=tables.emails.join(gone.withColumnRenamed("email_id", "id"), "id", "left_anti").select(*tables.emails.columns),
        links=links.select(*tables.links.columns), attachments=attachments.select(*tables.attachments.columns),
        assets=tables.assets.join(gone, "email_id", "left_anti").select(*tables.assets.columns), docs=tables.docs.join(gone, "email_id", "left_anti").select(*tables.docs.columns),
    )
    return left, orphans, _outcome(tables.emails, ids)


def empty_trash(tables: Archive) -> tuple[Archive, DataFrame, DataFrame]:
    return permanent_delete(tables, tables.emails.where("deleted_at is not null").select("id"))


def _delete_sources(tables: Archive, doomed: DataFrame) -> tuple[Archive, DataFrame]:
    ids = tables.emails.join(doomed.select(F.col("id").alias("ingestion_source_id")), "ingestion_source_id", "left_semi").select("id")
    left, orphans, _ = permanent_delete(tables, ids)
    key = doomed.select(F.col("id").alias("ingestion_source_id"))
    return left.with_tables(
        sources=tables.sources.join(doomed, "id", "left_anti").select(*tables.sources.columns),
        sessions=tables.sessions.join(key, "ingestion_source_id", "left_anti").select(*tables.sessions.columns),
    ), orphans


def drop_emptied_sources(tables: Archive, providers: tuple[str, ...] = ("mbox_import", "eml_import")) -> Archive:
    """Removes file sources that ended (imported or error) and hold no email any more, trashed ones included."""
    used = tables.emails.select(F.col("ingestion_source_id").alias("id")).distinct()
    parents = tables.sources.where("merged_into_id is not null").select(F.col("merged_into_id").alias("id")).distinct()
    ended = tables.sources.where(F.col("provider").isin(*providers) & F.col("status").isin("imported", "error")).select("id")
    return _delete_sources(tables, ended.join(used, "id", "left_anti").join(parents, "id", "left_anti"))[0]


def delete_source(tables: Archive, source_id: str) -> tuple[Archive, DataFrame]:
    """Removes a source, those merged into it and all they hold; returns the storage paths left over."""
    doomed = tables.sources.where((F.col("id") == source_id) | (F.col("merged_into_id") == source_id)).select("id")
    return _delete_sources(tables, doomed)


MAX_TAG_EDIT = 1000


def update_tags(emails: DataFrame, ids: list[str], add: list[str], remove: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edits tags of at most 1000 emails; the outcome has ``(id, tags)`` of those that changed."""
    wanted = list(dict.fromkeys(i for i in ids if i))
    if not wanted or len(wanted) > MAX_TAG_EDIT:
        raise ValueError(f"between 1 and {MAX_TAG_EDIT} ids are needed")
    if not add and not remove:
        raise ValueError("at least one change is needed")
    given = lambda xs: normalize_tags(F.lit(xs) if xs else F.expr("cast(array() as array<string>)"))
    hit = F.col("id").isin(*wanted)
    new = F.when(hit, apply_tag_changes("tags", given(add), given(remove))).otherwise(F.col("tags"))
    edited = emails.withColumn("__new", new)
    changed = edited.where(hit & ~F.col("__new").eqNullSafe(F.col("tags"))).select("id", F.col("__new").alias("tags"))
    return edited.withColumn("tags", F.col("__new")).select(*emails.columns), changed


def merge_folder_tags(survivors: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Survivors ``(id, tags, ...)`` with the folders ``(id, path, ordinal)`` of their later copies as tags, in order."""
    paths = duplicates.where("path <> ''").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "path"))), lambda p: p["path"]).alias("__p"))
    empty = F.expr("cast(array() as array<string>)")
    merged = F.array_union(F.coalesce("tags", empty), F.coalesce("__p", empty))
    return survivors.join(paths, "id", "left").withColumn("tags", merged).select(*survivors.columns)


def dedup_contacts(parsed: DataFrame) -> DataFrame:
    """The last name given for each address."""
    return parsed.groupBy("email").agg(F.max_by("display_name", "ordinal").alias("display_name"))


def upsert_contacts(contacts: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new contacts table, and one row of counts parsed, imported, updated and skipped."""
    new = dedup_contacts(parsed).select("email", F.col("display_name").alias("__name"))
    both = contacts.join(new, "email", "full")
    merged = both.select(F.coalesce("id", F.sha2("email", 256)).alias("id"), "email", F.coalesce("__name", "display_name").alias("display_name"))
    fresh, given = F.col("id").isNull(), F.col("__name").isNotNull()
    counts = both.agg(
        F.count_if(fresh).alias("imported"), F.count_if(~fresh & given & ~F.col("__name").eqNullSafe(F.col("display_name"))).alias("updated"),
        F.count_if(~fresh & given & F.col("__name").eqNullSafe(F.col("display_name"))).alias("skipped"),
    )
    return merged, counts.join(parsed.agg(F.count("*").alias("parsed")), F.lit(True)).select("parsed", "imported", "updated", "skipped")


def upsert_assets(assets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Assets after fetch outcomes ``(email_id, url_hash, original_url, ...)``; archived ones are never redone."""
    key = ["email_id", "url_hash"]
    rest = [c for c in assets.columns if c not in key]
    given = outcomes.dropDuplicates(key).select(*key, *[F.col(c).alias(f"__{c}") for c in rest if c in outcomes.columns], F.lit(True).alias("__given"))
    both = assets.withColumn("__old", F.lit(True)).join(given, key, "full")
    keep = F.col("__old") & ((F.col("status") == "archived") | F.col("__given").isNull())

    def value(c: str):
        made = F.sha2(F.concat_ws("|", *key), 256) if c == "id" else F.col(f"__{c}") if c in outcomes.columns else F.lit(None)
        if c in ("id", "original_url"):
            made = F.coalesce(F.when(F.col("__old"), F.col(c)), made)
        return F.when(F.coalesce(keep, F.lit(False)), F.col(c)).otherwise(made).alias(c)

    return both.select(*key, *[value(c) for c in rest]).select(*assets.columns)


def sweep_tracking_assets(assets: DataFrame, emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops failed and blocked assets that are trackers, and recomputes the status of their emails."""
    dead = F.col("status").isin("failed", "blocked") & is_tracking_url("original_url")
    left = assets.where(~F.coalesce(dead, F.lit(False)))
    touched = assets.where(dead).select(F.col("email_id").alias("id")).distinct()
    status = remote_status(left).select(F.col("email_id").alias("id"), F.col("status").alias("__s"), F.col("archived").alias("__n"))
    joined = emails.join(touched.withColumn("__t", F.lit(True)), "id", "left").join(status, "id", "left")
    moved = joined.withColumn("remote_content_status", F.when(F.col("__t"), F.coalesce("__s", F.lit("skipped"))).otherwise(F.col("remote_content_status")))
    moved = moved.withColumn("remote_content_asset_count", F.when(F.col("__t"), F.coalesce("__n", F.lit(0))).otherwise(F.col("remote_content_asset_count")))
    return left, moved.select(*emails.columns)


def update_sources(sources: DataFrame, patch: DataFrame, clear: tuple[str, ...] = ()) -> DataFrame:
    """Sources with the patch's non-null columns; those in ``clear`` become null for patched rows."""
    fields = [c for c in patch.columns if c != "id" and c in sources.columns]
    joined = sources.join(patch.select("id", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__hit")), "id", "left")

    def value(c: str):
        if c in clear:
            return F.when(F.col("__hit").isNull(), F.col(c)).alias(c)
        return (F.coalesce(f"__{c}", c) if c in fields else F.col(c)).alias(c)

    return joined.select(*[value(c) for c in sources.columns])


def unmerge(sources: DataFrame, source_id: str) -> DataFrame:
    return sources.withColumn("merged_into_id", F.when(F.col("id") != source_id, F.col("merged_into_id")))


def merge_into(sources: DataFrame, source_id: str, target: str) -> DataFrame:
    """Merges a source, and what was merged into it, into the target's root."""
    root = merge_groups(sources).where(F.col("source_id") == target).select("root_id")
    moved = sources.join(root, F.lit(True), "left")
    hit = ((F.col("id") == source_id) | (F.col("merged_into_id") == source_id)) & F.col("root_id").isNotNull() & (F.col("id") != F.col("root_id"))
    return moved.withColumn("merged_into_id", F.when(hit, F.col("root_id")).otherwise(F.col("merged_into_id"))).select(*sources.columns)


def dedup_links(links: DataFrame) -> DataFrame:
    return links.dropDuplicates(["email_id", "attachment_id"])


def purge_jobs(jobs: DataFrame, now_ms: int) -> DataFrame:
    day, done = 86_400_000, F.coalesce("finished_at", "created_at")
    old = ((F.col("state") == "completed") & (done < now_ms - 2 * day)) | ((F.col("state") == "failed") & (done < now_ms - 14 * day))
    return jobs.where(~old)


def clean_stale_sessions(sessions: DataFrame, sources: DataFrame, now_ms: int, silent_ms: int = 1_800_000) -> tuple[DataFrame, DataFrame]:
    """Drops sessions silent too long; the source of one that wasn't finished turns to error."""
    stale = F.col("last_activity_at") < now_ms - silent_ms
    broken = sessions.where(stale & (F.col("completed_mailboxes") + F.col("failed_mailboxes") < F.col("total_mailboxes")))
    ids = broken.select(F.col("ingestion_source_id").alias("id")).distinct()
    moved = _marked(sources, ids)
    moved = moved.withColumn("status", F.when(F.col("__hit"), "error").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("__hit"), F.lit(now_ms).cast("long")).otherwise(F.col("updated_at")))
    return sessions.where(~stale), moved.select(*sources.columns)


def finalize_import(sources: DataFrame, sessions: DataFrame, now_ms: int) -> DataFrame:
    """Sources after their finished sessions: status, message and time. A paused source stays paused."""
    ended = sessions.where("completed_mailboxes + failed_mailboxes >= total_mailboxes")
    done = ended.groupBy(F.col("ingestion_source_id").alias("id")).agg(F.max_by(F.struct("completed_mailboxes", "failed_mailboxes", "error_messages", "is_initial_import"), F.struct("last_activity_at", F.col("id"))).alias("s"))
    failed = F.concat(F.lit("Import finished with "), F.col("s.failed_mailboxes").cast("string"), F.lit(" error(s):\n"), F.array_join("s.error_messages", "\n"))
    first = F.concat(F.lit("Import finished. Archived "), F.col("s.completed_mailboxes").cast("string"), F.lit(" mailbox(es)."))
    message = F.when(F.col("s.failed_mailboxes") > 0, failed).when(F.col("s.is_initial_import"), first).otherwise("Import completed successfully.")
    status = F.when(F.col("status") == "paused", "paused").when(F.col("s.failed_mailboxes") > 0, "error").when(F.col("provider").isin("mbox_import", "eml_import"), "imported").otherwise("active")
    hit = F.col("s").isNotNull()
    moved = sources.join(done, "id", "left").withColumns({
        "last_import_status_message": F.when(hit, message).otherwise(F.col("last_import_status_message")),
        "last_import_finished_at": F.when(hit, F.lit(now_ms).cast("long")).otherwise(F.col("last_import_finished_at")),
        "status": F.when(hit, status).otherwise(F.col("status")),
    })
    return moved.select(*sources.columns)


def emptied(tables: Archive) -> DataFrame:
    """Sources without live emails."""
    return source_stats(tables.sources, tables.emails).where("email_count = 0")
