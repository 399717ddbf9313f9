"""Structured Streaming forms of the archive's continuous work (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lettermill.functions.dates import derive_sent_at
from lettermill.functions.text import folder_and_labels, normalize_source_path, thread_id
from lettermill.operators.aggregates import archive_revision, import_stats
from lettermill.operators.components import join_hot
from lettermill.operators.duplicates import cluster_members, duplicate_groups
from lettermill.operators.ingest import dedup_attachments, dedup_messages
from lettermill.operators.joins import merge_groups
from lettermill.operators.mutations import merge_folder_tags
from lettermill.operators.search import build_postings
from lettermill.session import materialize
from lettermill.sources.mailbox import parse_messages
from lettermill.sources.ranged import read_mbox_ranges

_ARRIVED = "id string, ingestion_source_id string, provider_message_id string, thread_id string, subject string, sent_at long, sent_at_kind string, path string, tags array<string>, storage_hash string, size_bytes long, input_path string, ordinal long"
_ATTACHED = "id string, filename string, mime_type string, size_bytes long, content_hash_sha256 string, ingestion_source_id string, content binary"


def import_attachments(messages: DataFrame, sources: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and new attachments of archived messages ``(id, ingestion_source_id, attachments)``.

    A content is one attachment in a merge group, with the name and type that it had first; those whose
    ``id`` is ``known`` already are linked, not added.
    """
    groups = merge_groups(sources).withColumnRenamed("source_id", "ingestion_source_id")
    rooted = messages.join(groups, "ingestion_source_id", "left").withColumn("root_id", F.coalesce("root_id", "ingestion_source_id"))
    parts = rooted.select(F.col("id").alias("email_id"), "root_id", F.posexplode("attachments").alias("ordinal", "a"))
    parts = parts.select("email_id", "root_id", F.col("a.content_hash").alias("content_hash_sha256"), "a.filename", "a.mime_type", "a.size_bytes", "ordinal", "a.content")
    found = dedup_attachments(parts)
    one = ["root_id", "content_hash_sha256"]
    contents = parts.groupBy(*one).agg(F.first("content").alias("content"))
    rows = found.dropDuplicates(["attachment_id"]).join(contents, one)
    rows = rows.select(F.col("attachment_id").alias("id"), "filename", "mime_type", "size_bytes", "content_hash_sha256", F.col("root_id").alias("ingestion_source_id"), "content")
    return found.select("email_id", "attachment_id").distinct(), rows.join(known.select("id"), "id", "left_anti")


def import_batch(raw: DataFrame, archive: DataFrame, sources: DataFrame, source_id: str, attached: DataFrame | None = None) -> dict[str, DataFrame]:
    """New archive rows of raw messages ``(file_path, ordinal, raw)``: parsed, dated, filed, first of each key.

    A message without an id of its own is known by its bytes and its source. Folders of later
    copies become tags of the copy that stays. Returns ``messages``; ``folders``, those of copies that the
    archive holds already, ``(id, path, ordinal)``; ``counts``, a row of archived, duplicates and failed;
    ``links`` and ``attachments`` of the new messages, of attachments those not yet ``attached (id)``.
    """
    m = parse_messages(raw)
    at = derive_sent_at(F.col("date"), F.lit(None).cast("long"), F.col("received"))
    filed = folder_and_labels(F.col("gmail_labels"), F.col("folder"), F.lit(""))
    thread = thread_id(F.col("references"), F.col("in_reply_to"), F.col("conversation_id"), F.col("message_id"))
    path = normalize_source_path(filed["path"])
    own = F.when(F.col("message_id").isNull(), F.concat("message_key", F.lit("-"), F.lit(source_id))).otherwise(F.col("message_key"))
    # a name by place and bytes: equal rows of one file share it, whatever partition they come from
    rows = m.select(
        F.sha2(F.concat_ws("|", F.lit(source_id), "file_path", F.coalesce("message_key", F.lit("")), "storage_hash", "date"), 256).alias("id"),
        F.lit(source_id).alias("ingestion_source_id"), own.alias("message_key"), F.col("file_path").alias("input_path"), "ordinal",
        thread.alias("thread_id"), "subject", at.alias("at"), path.alias("path"),
        F.array_union(F.when(path != "", F.array(path)).otherwise(F.expr("cast(array() as array<string>)")), filed["labels"]).alias("tags"), "storage_hash", "size_bytes", "attachments",
    )
    # three branches of the deduplication read it, and none of them parses
    found = materialize(dedup_messages(materialize(rows, "import-parsed"), archive, sources), "import")
    place = found.groupBy("id").agg(F.min("ordinal").alias("__first"))
    again = (F.col("status") == "archived") & (F.col("ordinal") > F.col("__first"))
    told = join_hot(found, place, "id").withColumn("status", F.when(again, "duplicate").otherwise(F.col("status"))).drop("__first")
    first = told.where("status = 'archived'")
    later = told.where("status = 'duplicate'").select(F.col("survivor_id").alias("id"), "path", "ordinal").where("path <> ''")
    tagged = merge_folder_tags(first, later)
    new = tagged.select(
        "id", "ingestion_source_id", F.col("message_key").alias("provider_message_id"), "thread_id", "subject", F.col("at.ms").alias("sent_at"), F.col("at.kind").alias("sent_at_kind"),
        "path", "tags", "storage_hash", "size_bytes", "input_path", "ordinal",
    )
    known = raw.sparkSession.createDataFrame([], "id string") if attached is None else attached
    links, attachments = import_attachments(first.select("id", "ingestion_source_id", "attachments"), sources, known)
    folders = later.join(first.select("id"), "id", "left_anti")
    return {"messages": new, "folders": folders, "counts": import_stats(told), "links": links, "attachments": attachments}


def stream_import(spark: SparkSession, in_dir: str, archive_dir: str, sources: DataFrame, source_id: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Imports arriving mbox files, at most ``files_a_batch`` at once, by byte ranges: text before a
    file's first record is none. A batch writes folders of its own, so a repeated batch replaces itself:
    messages, folders that archived messages gained (``_folders``), ``_counts``, ``_links`` and ``_attachments``."""
    listed = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = listed.option("maxFilesPerTrigger", files_a_batch).load(in_dir).select("path", "length")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the batch's own earlier try must not count as archived already
        before = spark.read.schema(f"{_ARRIVED}, batch long").parquet(archive_dir).where(F.col("batch") != batch_id)
        attached = spark.read.schema(f"{_ATTACHED}, batch long").parquet(f"{archive_dir}_attachments").where(F.col("batch") != batch_id)
        results = import_batch(read_mbox_ranges(batch), before, sources, source_id, attached.select("id"))
        for name, df in results.items():
            df.write.mode("overwrite").parquet(f"{archive_dir}{'' if name == 'messages' else '_' + name}/batch={batch_id}")

    for schema, place in ((_ARRIVED, archive_dir), (_ATTACHED, f"{archive_dir}_attachments")):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{place}/batch=-1")
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(sdf: DataFrame, delay: str = "1 day", key: tuple[str, ...] = ("root_id", "message_id"), time: str = "ts") -> DataFrame:
    """First message of each key within the delay; state is bounded by it, and the exact form is ``dedup_messages``."""
    return sdf.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def stream_history(sdf: DataFrame, delay: str = "1 day", time: str = "ts") -> DataFrame:
    """Arrivals a day; a day is closed, and late rows dropped, once the watermark passes it."""
    by = sdf.withWatermark(time, delay).groupBy(F.window(time, "1 day"))
    return by.agg(F.count("*").alias("count")).select(F.to_date("window.start").alias("day"), "count")


def stream_stale_sessions(sdf: DataFrame, gap: str = "30 minutes", key: str = "session_id", time: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """``(session, started, last_activity, events)`` of sessions that have been silent for the gap."""
    by = sdf.withWatermark(time, delay).groupBy(key, F.session_window(time, gap))
    return by.agg(F.max(time).alias("last_activity"), F.count("*").alias("events")).select(key, F.col("session_window.start").alias("started"), "last_activity", "events")


def stream_progress(sdf: DataFrame, key: str = "session_id", delta: str = "delta") -> DataFrame:
    """Bytes processed so far by session, from a log of deltas; complete or update mode."""
    return sdf.groupBy(key).agg(F.sum(delta).alias("processed_bytes"))


def stream_index(sdf: DataFrame, index_dir: str, checkpoint: str) -> StreamingQuery:
    """Writes the postings of arriving search documents, and which emails each batch indexed anew."""

    def write(batch: DataFrame, batch_id: int) -> None:
        build_postings(batch).write.mode("overwrite").parquet(f"{index_dir}/postings/batch={batch_id}")
        batch.select("email_id").distinct().write.mode("overwrite").parquet(f"{index_dir}/emails/batch={batch_id}")

    return sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, index_dir: str) -> DataFrame:
    """The postings of a streamed index: of each email those of its last batch."""
    last = spark.read.parquet(f"{index_dir}/emails").groupBy("email_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{index_dir}/postings").join(last, ["email_id", "batch"], "left_semi").select("term", "email_id", "field", "tf", "positions")


def refresh_duplicates(emails: DataFrame, links: DataFrame, attachments: DataFrame, ignores: DataFrame, snapshot_dir: str) -> DataFrame:
    """The duplicate groups, computed anew only if the archive's revision differs from the stored one."""
    spark = emails.sparkSession
    revision = archive_revision(emails, ignores).select(F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)).first()[0]
    path = f"{snapshot_dir}/revision={revision}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        duplicate_groups(cluster_members(emails, links, attachments, ignores)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
