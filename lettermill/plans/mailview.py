"""Archive tables as pure projections of the driver's tables, in Spark and in DuckDB SQL alike.

Content columns derive from text, language and length, so that copies agree; identity
columns from the row's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lettermill.functions.text import duplicate_hash, normalize_duplicate_text, recipient_fingerprint
from lettermill.session import dealt

EPOCH = 1704067200000
NOW = EPOCH + 2592 * 1000000
_PERSONS = "array<struct<name:string,address:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n, i = F.col("n_chars"), F.col("doc_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    person = lambda address: F.array(F.struct(F.lit(None).cast("string").alias("name"), address.alias("address")))
    none = F.expr(f"cast(array() as {_PERSONS})")
    to = person(text("r", (n % 13).cast("string"), "@", F.col("lang"), ".example"))
    cc = F.when(n % 5 == 0, person(text("c", (n % 7).cast("string"), "@example.org"))).otherwise(none)
    recipients = F.struct(to.alias("to"), cc.alias("cc"), none.alias("bcc"))
    mid = F.when(i % 7 != 0, F.concat(F.md5("text"), F.when(i % 3 == 0, text("-", i.cast("string"))).otherwise("")))
    subject = F.substring_index("text", "\n", 1)
    status = F.when(i % 10 == 0, "failed").when(i % 10 == 1, "partial").when(i % 10 == 2, "archived").otherwise("skipped")
    hashed = lambda c: duplicate_hash(normalize_duplicate_text(c))
    null = lambda kind: F.lit(None).cast(kind)
    return d.select(
        F.lpad(i.cast("string"), 10, "0").alias("id"), text("t", (n % 500).cast("string")).alias("thread_id"), F.col("source").alias("ingestion_source_id"),
        F.col("source").alias("import_source"), mid.alias("message_id_header"), F.coalesce(mid, text("generated-", i.cast("string"))).alias("provider_message_id"),
        (F.lit(EPOCH) + (n % 400) * 3600000).alias("sent_at"), F.lit("sent").alias("sent_at_kind"), subject.alias("subject"),
        text("User ", (n % 97).cast("string")).alias("sender_name"), text("u", (n % 97).cast("string"), "@", F.col("lang"), ".example").alias("sender_email"),
        recipients.alias("recipients"), text("eml/", i.cast("string")).alias("storage_path"), F.sha2(text(F.col("text"), "|", (i % 2).cast("string")), 256).alias("storage_hash_sha256"),
        F.octet_length("text").cast("long").alias("size_bytes"), (i % 4 == 0).alias("has_attachments"), (F.lit(EPOCH) + (i % 2592) * 1000000).alias("archived_at"),
        F.concat(F.lit("Folder/"), F.col("lang")).alias("source_path"), hashed(subject).alias("duplicate_subject_hash"), hashed(F.col("text")).alias("duplicate_body_hash"),
        recipient_fingerprint(recipients).alias("duplicate_recipient_fingerprint"), null("string").alias("duplicate_attachment_fingerprint"), status.alias("remote_content_status"),
        F.lit(0).cast("long").alias("remote_content_asset_count"), null("long").alias("remote_content_archived_at"), F.array("lang", "source").alias("tags"),
        F.when(i % 11 == 0, F.lit(EPOCH) + i).alias("deleted_at"),
    )


#: Emails as a common table expression over ``documents``.
EMAILS_SQL = f"""emails AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id, 't' || (n_chars % 500) AS thread_id, source AS ingestion_source_id, source AS import_source, text,
    CASE WHEN doc_id % 7 <> 0 THEN md5(text) || CASE WHEN doc_id % 3 = 0 THEN '-' || doc_id ELSE '' END END AS message_id,
    {EPOCH} + (n_chars % 400) * 3600000 AS sent_at, split_part(text, chr(10), 1) AS subject, 'User ' || (n_chars % 97) AS sender_name,
    'u' || (n_chars % 97) || '@' || lang || '.example' AS sender_email, 'r' || (n_chars % 13) || '@' || lang || '.example' AS to_address,
    CASE WHEN n_chars % 5 = 0 THEN 'c' || (n_chars % 7) || '@example.org' END AS cc_address, sha256(text || '|' || (doc_id % 2)) AS storage_hash,
    CAST(strlen(text) AS BIGINT) AS size_bytes, doc_id % 4 = 0 AS has_attachments, {EPOCH} + (doc_id % 2592) * 1000000 AS archived_at,
    'Folder/' || lang AS source_path, lang, source, doc_id,
    CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'archived' ELSE 'skipped' END AS remote_content_status,
    CASE WHEN doc_id % 11 = 0 THEN {EPOCH} + doc_id END AS deleted_at
  FROM documents)"""


def hashed_sql(column: str) -> str:
    plain = f"trim(regexp_replace(lower(regexp_replace({column}, '<[^>]*>', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
    return f"CASE WHEN {plain} <> '' THEN sha256({plain}) END"


SIGNALS_SQL = f"""signals AS (
  SELECT id, sent_at, archived_at, storage_hash, message_id, lower(message_id) AS mid, {hashed_sql("subject")} AS subject_hash, lower(sender_email) AS sender,
    {hashed_sql("text")} AS body_hash,
    sha256(array_to_string(list_sort(list_filter([lower(to_address), lower(cc_address)], lambda x: x IS NOT NULL)), '|')) AS recipient_fp, attachment_fp, coalesce(metadata_fp, '') AS metadata_fp
  FROM emails LEFT JOIN (SELECT email_id, sha256(string_agg(DISTINCT content_hash, '|' ORDER BY content_hash)) AS attachment_fp,
      string_agg(content_hash || '|' || filename || '|' || size_bytes, ';' ORDER BY content_hash, filename, size_bytes) AS metadata_fp
    FROM links JOIN attachments a ON a.id = attachment_id GROUP BY 1) f ON f.email_id = id WHERE deleted_at IS NULL)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("source").distinct()
    k = F.substring("source", 4, 9).cast("int")
    status = F.get(F.array(*[F.lit(s) for s in ("error", "imported", "active", "paused", "imported")]), k % 5)
    null = lambda kind: F.lit(None).cast(kind)
    return names.select(
        F.col("source").alias("id"), F.concat(F.lit("Archive "), k.cast("string")).alias("name"), F.lit("mbox_import").alias("provider"), F.lit("{}").alias("provider_config"),
        status.alias("status"), null("long").alias("last_import_started_at"), null("long").alias("last_import_finished_at"), null("string").alias("last_import_status_message"),
        F.when(k % 4 != 0, F.concat(F.lit("src"), (k - k % 4).cast("string"))).alias("merged_into_id"), (F.lit(EPOCH) + k * 1000).alias("created_at"),
        (F.lit(EPOCH) + k * 86400000 * F.lit(1).cast("long")).alias("updated_at"),
    )


SOURCES_SQL = f"""sources AS (
  SELECT source AS id, 'Archive ' || k AS name, ['error', 'imported', 'active', 'paused', 'imported'][k % 5 + 1] AS status,
    CASE WHEN k % 4 <> 0 THEN 'src' || (k - k % 4) END AS merged_into_id, {EPOCH} + k * 1000 AS created_at, {EPOCH} + CAST(k AS BIGINT) * 86400000 AS updated_at
  FROM (SELECT source, CAST(substr(source, 4) AS INTEGER) AS k FROM (SELECT DISTINCT source FROM documents)))"""


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as they come, some of them twice."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("email_id"), F.col("l_partkey").cast("string").alias("attachment_id"))


def links(spark: SparkSession, sf_dir: str, by: str = "email_id") -> DataFrame:
    """Links once each, dealt by the end that is joined next, so that they move once."""
    return dealt(link_rows(spark, sf_dir), by).distinct()


LINKS_SQL = "links AS (SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS email_id, CAST(l_partkey AS VARCHAR) AS attachment_id FROM lineitem)"


def mail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of a quarter of the emails, chosen by length, so that some copies agree in them and some don't."""
    d = table(spark, sf_dir, "documents").where("doc_id % 4 = 0")
    picked = F.array(F.col("n_chars") % 200 + 1, F.when(F.col("doc_id") % 8 == 0, F.col("n_chars") % 7 + 1))
    rows = d.select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("email_id"), F.explode(F.array_compact(picked)).alias("attachment_id"))
    return rows.select("email_id", F.col("attachment_id").cast("string").alias("attachment_id")).distinct()


MAIL_LINKS_SQL = """links AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS email_id, CAST(n_chars % 200 + 1 AS VARCHAR) AS attachment_id FROM documents WHERE doc_id % 4 = 0
  UNION SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0'), CAST(n_chars % 7 + 1 AS VARCHAR) FROM documents WHERE doc_id % 8 = 0)"""
_EXTS = ["pdf", "jpg", "zip", "docx", "stl", "txt", "mp3"]


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ext = F.get(F.array(*[F.lit(e) for e in _EXTS]), F.col("p_size") % len(_EXTS))
    null = F.lit(None).cast("string")
    return part.select(
        F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit("."), ext).alias("filename"), F.lit("application/octet-stream").alias("mime_type"),
        F.col("p_size").cast("long").alias("size_bytes"), F.sha2(F.concat("p_brand", "p_type"), 256).alias("content_hash_sha256"), F.concat(F.lit("att/"), F.col("p_partkey").cast("string")).alias("storage_path"),
        null.alias("ingestion_source_id"), null.alias("content_description"), null.alias("original_created_at"), null.alias("original_modified_at"), F.lit("").alias("extracted_text"),
    )


ATTACHMENTS_SQL = f"""attachments AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || '.' || {_EXTS!r}[p_size % {len(_EXTS)} + 1] AS filename, 'application/octet-stream' AS mime_type,
    CAST(p_size AS BIGINT) AS size_bytes, sha256(p_brand || p_type) AS content_hash, 'att/' || p_partkey AS storage_path FROM part)"""



def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as remote assets of the first hundred emails."""
    k = F.col("p_partkey").cast("string")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.lpad((F.col("p_partkey") % 100).cast("string"), 10, "0").alias("email_id"),
        F.concat(F.when(F.col("p_size") % 5 == 0, "https://open.emltrk.com/").otherwise("https://cdn.example/"), k).alias("original_url"), null.alias("final_url"), F.md5(k).alias("url_hash"),
        pick(("archived", "failed", "blocked", "pending"), F.col("p_partkey") % 4).alias("status"), pick(("image/png", "text/css", "image/svg+xml"), F.col("p_size") % 3).alias("content_type"),
        F.col("p_size").cast("long").alias("size_bytes"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("a/"), k)).alias("storage_path"), null.alias("failure_reason"),
    )


ASSETS_SQL = """assets AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, lpad(CAST(p_partkey % 100 AS VARCHAR), 10, '0') AS email_id, CASE WHEN p_size % 5 = 0 THEN 'https://open.emltrk.com/' ELSE 'https://cdn.example/' END || p_partkey AS original_url,
    md5(CAST(p_partkey AS VARCHAR)) AS url_hash, ['archived', 'failed', 'blocked', 'pending'][p_partkey % 4 + 1] AS status, ['image/png', 'text/css', 'image/svg+xml'][p_size % 3 + 1] AS content_type,
    CASE WHEN p_partkey % 3 <> 0 THEN 'a/' || p_partkey END AS storage_path FROM part)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as import sessions of three mailboxes."""
    k, bad = F.col("s_suppkey"), (F.col("s_nationkey") % 3 == 0).cast("long")
    long = lambda c: c.cast("long")
    return table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("id"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("ingestion_source_id"), (k % 2 == 0).alias("is_initial_import"), long(F.lit(3)).alias("total_mailboxes"),
        long(k % 4).alias("completed_mailboxes"), bad.alias("failed_mailboxes"), F.when(bad == 1, F.array(F.lit("bad"))).otherwise(F.expr("cast(array() as array<string>)")).alias("error_messages"),
        long(F.lit(EPOCH)).alias("created_at"), long(F.lit(EPOCH) + k * 60000).alias("last_activity_at"), long(F.lit(1000)).alias("total_bytes"), long(k * 10).alias("processed_bytes"),
    )


SESSIONS_SQL = f"""sessions AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, 'src' || (s_suppkey % 20) AS source_id, s_suppkey % 2 = 0 AS initial, CAST(3 AS BIGINT) AS total, CAST(s_suppkey % 4 AS BIGINT) AS completed,
    CAST(CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS failed, {EPOCH} + s_suppkey * 60000 AS active_at, CAST(1000 AS BIGINT) AS total_bytes, CAST(s_suppkey * 10 AS BIGINT) AS processed FROM supplier)"""

QUEUES = ("click", "error", "purchase", "signup", "view")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    state = F.get(F.array(*[F.lit(s) for s in ("active", "completed", "failed", "waiting", "waiting")]), (F.col("user_id") % 5).cast("int"))
    null = lambda kind: F.lit(None).cast(kind)
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("queue"), F.lit("job").alias("name"), F.col("props").alias("payload"), state.alias("state"),
        F.lit(0).cast("long").alias("attempts"), F.lit(3).cast("long").alias("max_attempts"), ms.alias("run_at"), null("string").alias("singleton_key"),
        F.when(state == "failed", F.concat(F.lit("failed at "), F.col("user_id").cast("string"), F.lit("\ntrace"))).alias("error"), ms.alias("created_at"), null("long").alias("started_at"),
        F.when(state.isin("completed", "failed"), ms + 1000).alias("finished_at"),
    )


JOBS_SQL = """jobs AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_type AS queue, ['active', 'completed', 'failed', 'waiting', 'waiting'][user_id % 5 + 1] AS state, epoch_us(ts) // 1000 AS run_at,
    epoch_us(ts) // 1000 AS created_at, user_id, props FROM events)"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lower("c_name"), F.lit("@x.example")).alias("email"), F.col("c_name").alias("display_name"))


def thread_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as mails of a thread."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit(">")).alias("thread_id"),
        (F.lit(EPOCH) + F.col("turn") * 60000).alias("sent_at"), F.substring_index("text", "\n", 1).alias("subject"), F.col("role").alias("sender_email"),
        F.concat(F.lit("src"), (F.col("conv_id") % 3).cast("string")).alias("ingestion_source_id"), F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, F.lit(EPOCH)).alias("deleted_at"),
    )


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents of the emails view: sender, recipients and meta as the index builds them."""
    from lettermill.operators.search import build_search_docs

    mails = emails(spark, sf_dir)
    body = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("id"), "text", F.lit("").alias("html"))
    return build_search_docs(mails, mail_links(spark, sf_dir), attachments(spark, sf_dir), body)
