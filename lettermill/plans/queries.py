"""Registered queries of the archive operators, each with its equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lettermill.functions import html as H, text as P
from lettermill.functions.dates import derive_sent_at, describe_date, iso_ms, parse_filter_timestamp
from lettermill.functions.tags import apply_tag_changes, normalize_tags
from lettermill.operators import aggregates as agg, duplicates as dup, filters as flt, joins as jn, mutations as mut, ranked, search as srch
from lettermill.operators.ingest import cap_urls, dedup_attachments, dedup_messages
from lettermill.plans import mailview as V, views
from lettermill.schemas import Archive
from lettermill.session import materialize, prepare, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``tables`` are common table expressions that its SQL starts with."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = ("WITH RECURSIVE " + ",\n".join(tables) + "\n" if tables else "") + sql
        return f

    return register


LIVE = "deleted_at IS NULL"
LISTED = "id, subject, sender_email, sent_at, archived_at, size_bytes"


@query("mail_listing", V.EMAILS_SQL, sql=f"SELECT {LISTED} FROM emails WHERE {LIVE} ORDER BY sent_at DESC, id LIMIT 10")
def mail_listing(spark, sf):
    rows = flt.sort_emails(flt.trash_gate(V.emails(spark, sf)))
    return flt.paginate(rows, 1, 10).select("id", "subject", "sender_email", "sent_at", "archived_at", "size_bytes")


@query("mail_listing_page3_by_size", V.EMAILS_SQL, sql=f"SELECT {LISTED} FROM (SELECT *, row_number() OVER (ORDER BY size_bytes, id) AS k FROM emails WHERE {LIVE}) WHERE k BETWEEN 51 AND 75")
def mail_listing_page3(spark, sf):
    rows = flt.sort_emails(flt.trash_gate(V.emails(spark, sf)), "sizeBytes", "asc")
    return flt.paginate(rows, 3, 25).select("id", "subject", "sender_email", "sent_at", "archived_at", "size_bytes")


@query(
    "mail_filters", V.EMAILS_SQL, V.SOURCES_SQL,
    sql=f"""SELECT e.id, subject, sender_email, sent_at FROM emails e JOIN sources s ON e.ingestion_source_id = s.id
    WHERE {LIVE} AND coalesce(s.merged_into_id, s.id) = 'src4' AND lang = 'en' AND NOT has_attachments
      AND sent_at BETWEEN 1704110400000 AND 1705190400000""",
)
def mail_filters(spark, sf):
    rows = flt.filter_emails(V.emails(spark, sf), V.sources(spark, sf), source_id="src5", tag="en", has_attachments="false", sent_after="2024-01-01T12:00:00+02:00", sent_before="2024-01-14")
    return rows.select("id", "subject", "sender_email", "sent_at")


@query("mail_recipient_filter", V.EMAILS_SQL, sql=f"SELECT id FROM emails WHERE {LIVE} AND cc_address = 'c3@example.org'")
def mail_recipient_filter(spark, sf):
    rows = flt.trash_gate(V.emails(spark, sf))
    return flt.has_recipient(flt.has_recipient(rows, "cc", "c3@example.org"), "to", None).select("id")


@query("mail_trash", V.EMAILS_SQL, sql="SELECT id, deleted_at FROM emails WHERE deleted_at IS NOT NULL")
def mail_trash(spark, sf):
    return flt.trash_gate(V.emails(spark, sf), "true").select("id", "deleted_at")


@query(
    "mail_attachment_ext", V.LINKS_SQL, V.ATTACHMENTS_SQL,
    sql="""SELECT id FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id FROM orders)
    WHERE id IN (SELECT email_id FROM links JOIN attachments a ON a.id = attachment_id WHERE filename LIKE '%.pdf' OR filename LIKE '%.stl')""",
)
def mail_attachment_ext(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("id"))
    return flt.has_attachment_ext(orders, V.links(spark, sf), V.attachments(spark, sf), ["PDF", "stl", "x*"])


@query("archive_totals", V.EMAILS_SQL, sql=f"SELECT count(*) AS total_emails, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS storage_used FROM emails WHERE {LIVE}")
def archive_totals(spark, sf):
    return agg.archive_totals(V.emails(spark, sf))


@query("failed_sources", V.SOURCES_SQL, sql=f"SELECT count(*) FILTER (WHERE status = 'error' AND updated_at >= {V.EPOCH - 4 * 86400000}) AS failed_last_7_days FROM sources")
def failed_sources(spark, sf):
    return agg.failed_sources(V.sources(spark, sf), V.EPOCH + 3 * 86400000)


@query("remote_failures", V.EMAILS_SQL, sql=f"SELECT count(*) FILTER (WHERE remote_content_status = 'failed') AS failed, count(*) FILTER (WHERE remote_content_status = 'partial') AS partial FROM emails WHERE {LIVE}")
def remote_failures(spark, sf):
    return agg.remote_failures(V.emails(spark, sf))


@query("ingestion_history", V.EMAILS_SQL, sql=f"SELECT CAST(make_timestamp(archived_at * 1000) AS DATE) AS day, count(*) AS count FROM emails WHERE {LIVE} AND archived_at >= {V.NOW - 30 * 86400000} GROUP BY 1")
def ingestion_history(spark, sf):
    return agg.ingestion_history(V.emails(spark, sf), V.NOW)


@query("top_senders", V.EMAILS_SQL, sql=f"SELECT sender_email AS sender, count(*) AS count FROM emails WHERE {LIVE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_senders(spark, sf):
    return agg.top_senders(V.emails(spark, sf))


@query("top_senders_ratio", V.EMAILS_SQL, sql=f"SELECT sender, count, round(count / max(count) OVER (), 6) AS ratio FROM (SELECT sender_email AS sender, count(*) AS count FROM emails WHERE {LIVE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)")
def top_senders_ratio(spark, sf):
    return agg.ratio_to_max(agg.top_senders(V.emails(spark, sf)), "count").withColumn("ratio", F.round("ratio", 6))


@query("source_stats", V.EMAILS_SQL, V.SOURCES_SQL, sql=f"SELECT s.id, name, status, count(e.id) AS email_count, CAST(sum(size_bytes) AS BIGINT) AS storage_used FROM sources s LEFT JOIN emails e ON e.ingestion_source_id = s.id AND {LIVE} GROUP BY ALL")
def source_stats(spark, sf):
    return agg.source_stats(V.sources(spark, sf), V.emails(spark, sf))


@query("storage_share", V.EMAILS_SQL, sql=f"SELECT source AS id, CAST(sum(size_bytes) AS BIGINT) AS storage_used, round(sum(size_bytes) / sum(sum(size_bytes)) OVER (), 6) AS share FROM emails WHERE {LIVE} GROUP BY 1")
def storage_share(spark, sf):
    shares = agg.storage_share(agg.source_stats(V.sources(spark, sf), V.emails(spark, sf)))
    return shares.select("id", "storage_used", F.round("share", 6).alias("share"))


@query("tag_facets", V.EMAILS_SQL, sql=f"SELECT DISTINCT tag FROM (SELECT unnest([lang, source]) AS tag FROM emails WHERE {LIVE})")
def tag_facets(spark, sf):
    return agg.tag_facets(V.emails(spark, sf))


_NOW_JOBS = V.EPOCH + 15 * 86400000


@query(
    "queue_counts", V.JOBS_SQL,
    sql=f"""SELECT queue, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'completed') AS completed,
    count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'waiting' AND run_at > {_NOW_JOBS}) AS delayed,
    count(*) FILTER (WHERE state = 'waiting' AND run_at <= {_NOW_JOBS}) AS waiting, CAST(0 AS BIGINT) AS paused FROM jobs GROUP BY queue""",
)
def queue_counts(spark, sf):
    return views.queue_overview(V.jobs(spark, sf), _NOW_JOBS, V.QUEUES)


@query(
    "queue_jobs_failed", V.JOBS_SQL,
    sql="SELECT id, created_at, 'failed at ' || user_id AS failed_reason FROM jobs WHERE queue = 'click' AND state = 'failed' ORDER BY created_at, id LIMIT 10 OFFSET 10",
)
def queue_jobs_failed(spark, sf):
    return views.queue_jobs(V.jobs(spark, sf), "click", "failed", _NOW_JOBS, 2, 10).select("id", "created_at", "failed_reason")


@query("job_payload", sql="SELECT CAST(event_id AS VARCHAR) AS id, json_extract_string(props, '$.k') AS field FROM events")
def job_payload(spark, sf):
    return V.jobs(spark, sf).select("id", P.payload_field("payload", "$.k").alias("field"))


@query(
    "purge_jobs", V.JOBS_SQL,
    sql=f"""SELECT id FROM jobs WHERE NOT (state = 'completed' AND created_at + 1000 < {_NOW_JOBS - 2 * 86400000})
    AND NOT (state = 'failed' AND created_at + 1000 < {_NOW_JOBS - 14 * 86400000})""",
)
def purge_jobs(spark, sf):
    return mut.purge_jobs(V.jobs(spark, sf), _NOW_JOBS).select("id")


@query(
    "group_status", V.SOURCES_SQL,
    sql="""SELECT root_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'importing') THEN 'importing' WHEN bool_and(status = 'paused') THEN 'paused'
      WHEN bool_or(id = root_id AND status = 'paused') AND bool_or(id <> root_id AND status IN ('active', 'imported', 'importing')) THEN 'partially_active'
      WHEN bool_and(status IN ('imported', 'active')) THEN 'active' ELSE max(CASE WHEN id = root_id THEN status END) END AS status
    FROM (SELECT *, coalesce(merged_into_id, id) AS root_id FROM sources) GROUP BY root_id""",
)
def group_status(spark, sf):
    return agg.group_status(V.sources(spark, sf))


@query("archive_revision", V.EMAILS_SQL, sql=f"SELECT count(*) AS n, count(*) FILTER (WHERE {LIVE}) AS live, max(archived_at) AS last_archived, max(deleted_at) AS last_deleted FROM emails")
def archive_revision(spark, sf):
    ledger = spark.createDataFrame([], "fingerprint string, created_at long")
    return agg.archive_revision(V.emails(spark, sf), ledger).select("n", "live", "last_archived", "last_deleted")


@query(
    "thread_members", V.SOURCES_SQL,
    sql=f"""SELECT '<' || conv_id || '>' AS thread_id, string_agg(conv_id || '-' || turn, ',' ORDER BY turn, conv_id || '-' || turn) AS members
    FROM conversations WHERE (conv_id + turn) % 9 <> 0 GROUP BY conv_id""",
)
def thread_members(spark, sf):
    mails = V.thread_mails(spark, sf)
    threads = jn.with_thread(mails, V.sources(spark, sf)).where("thread is not null")
    return threads.select("thread_id", F.array_join(F.transform("thread", lambda m: m["id"]), ",").alias("members")).distinct()


@query("source_names", V.EMAILS_SQL, V.SOURCES_SQL, sql="SELECT e.id, coalesce(s.name, import_source) AS source_name FROM emails e LEFT JOIN sources s ON s.id = e.ingestion_source_id")
def source_names(spark, sf):
    return jn.with_source_name(V.emails(spark, sf), V.sources(spark, sf)).select("id", "source_name")


@query("email_attachments", V.LINKS_SQL, V.ATTACHMENTS_SQL, sql="SELECT email_id, filename, content_hash FROM links JOIN attachments a ON a.id = attachment_id")
def email_attachments(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("id"))
    rows = jn.email_attachments(orders, V.links(spark, sf), V.attachments(spark, sf))
    return rows.select("email_id", "filename", F.col("content_hash_sha256").alias("content_hash"))


@query(
    "attachment_content_fp", V.LINKS_SQL, V.ATTACHMENTS_SQL,
    sql="SELECT email_id, sha256(string_agg(DISTINCT content_hash, '|' ORDER BY content_hash)) AS fp FROM links JOIN attachments a ON a.id = attachment_id GROUP BY 1",
)
def attachment_content_fp(spark, sf):
    return dup.attachment_content_fp(V.links(spark, sf), V.attachments(spark, sf))


@query(
    "attachment_metadata_fp", V.LINKS_SQL, V.ATTACHMENTS_SQL,
    sql="""SELECT email_id, string_agg('64:' || content_hash || strlen(filename) || ':' || filename || strlen(mime_type) || ':' || mime_type || strlen(CAST(size_bytes AS VARCHAR)) || ':' || size_bytes, ''
      ORDER BY content_hash, filename, mime_type, size_bytes) AS fp FROM links JOIN attachments a ON a.id = attachment_id GROUP BY 1""",
)
def attachment_metadata_fp(spark, sf):
    return dup.attachment_metadata_fp(V.links(spark, sf), V.attachments(spark, sf))


@query("attachment_categories", V.ATTACHMENTS_SQL, sql="SELECT id, CASE split_part(filename, '.', 2) WHEN 'pdf' THEN 'Documents' WHEN 'jpg' THEN 'Pictures' WHEN 'zip' THEN 'Archives' WHEN 'docx' THEN 'Documents' WHEN 'stl' THEN '3D Printing' WHEN 'txt' THEN 'Documents' WHEN 'mp3' THEN 'Audio' END AS category FROM attachments")
def attachment_categories(spark, sf):
    return P.attachment_category(V.attachments(spark, sf), "filename").select("id", "category")


@query("contact_names", sql="SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS contact FROM customer WHERE lower(c_name) || '@x.example' IS NOT NULL")
def contact_names(spark, sf):
    people = V.contacts(spark, sf)
    mails = people.select("id", F.concat(F.lit("  "), F.upper("email")).alias("sender"), F.lit("").alias("header_name"))
    return P.resolve_contact(mails, people, "sender", "header_name").select("id", "contact")


@query("duplicate_text", V.EMAILS_SQL, sql=f"SELECT id, {V.hashed_sql('subject')} AS subject_hash, {V.hashed_sql('text')} AS body_hash FROM emails")
def duplicate_text(spark, sf):
    return V.emails(spark, sf).select("id", F.col("duplicate_subject_hash").alias("subject_hash"), F.col("duplicate_body_hash").alias("body_hash"))


@query(
    "mail_scalars", V.EMAILS_SQL,
    sql="""SELECT id, CASE WHEN subject = '' THEN '(no subject)' ELSE trim(subject) END AS subject_label, strftime(make_timestamp(sent_at * 1000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS sent_iso,
      CASE WHEN size_bytes / 1048576.0 >= 0.1 THEN 'large' ELSE size_bytes || ' bytes' END AS size_text, CAST(ceil(size_bytes / 100.0) AS BIGINT) AS pages,
      'Sent' AS label, strftime(make_timestamp(sent_at * 1000), '%Y-%m-%d') AS sent_day FROM emails""",
)
def mail_scalars(spark, sf):
    e = V.emails(spark, sf)
    size = P.human_size("size_bytes")
    said = describe_date("sent_at", F.col("sent_at_kind"))
    return e.select(
        "id", P.subject_label("subject").alias("subject_label"), iso_ms("sent_at").alias("sent_iso"), F.when(size.endswith(" MB"), "large").otherwise(size).alias("size_text"),
        P.total_pages("size_bytes", 100).alias("pages"), said["label"].alias("label"), F.substring(said["text"], 1, 10).alias("sent_day"),
    )


@query("mail_dates", sql="SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000 AS sent_ms, 'sent' AS kind, epoch_us(date_trunc('second', ts)) // 1000 AS bare_ms, 'sent_zone_unknown' AS bare_kind, epoch_us(date_trunc('second', ts)) // 1000 AS filter_ms FROM events")
def mail_dates(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    zoned = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    bare = F.date_format("ts", "dd MMM yyyy HH:mm:ss")
    none, nothing = F.lit(None).cast("long"), F.expr("cast(array() as array<string>)")
    a, b = derive_sent_at(zoned, none, nothing), derive_sent_at(bare, none, nothing)
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+05:00"))
    return e.select("event_id", a["ms"].alias("sent_ms"), a["kind"].alias("kind"), b["ms"].alias("bare_ms"), b["kind"].alias("bare_kind"), parse_filter_timestamp(iso).alias("filter_ms"))


@query(
    "tag_changes", V.EMAILS_SQL,
    sql="SELECT id, CASE WHEN lang = 'en' THEN source || '|New' ELSE lang || '|' || source || '|New' END AS tags FROM emails",
)
def tag_changes(spark, sf):
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    add, remove = normalize_tags(lit(" #New ", "new", "EN", "")), normalize_tags(lit("EN"))
    changed = apply_tag_changes("tags", add, remove)
    return V.emails(spark, sf).select("id", F.array_join(changed, "|").alias("tags"))


@query("recipient_list", V.EMAILS_SQL, sql="SELECT id, to_address || ':to' || CASE WHEN cc_address IS NULL THEN '' ELSE ',' || cc_address || ':cc' END AS people FROM emails")
def recipient_list(spark, sf):
    people = F.transform(P.flatten_recipients("recipients"), lambda p: F.concat(p["email"], F.lit(":"), p["kind"]))
    return V.emails(spark, sf).select("id", F.array_join(people, ",").alias("people"))


# Duplicates: the components are reached by walking the exact edges to the least id.
_CLUSTERS_SQL = """edges AS (
  SELECT a.id AS x, b.id AS y FROM signals a JOIN signals b ON a.storage_hash = b.storage_hash
  UNION SELECT a.id, b.id FROM signals a JOIN signals b ON a.mid = b.mid AND a.sender = b.sender AND a.recipient_fp = b.recipient_fp AND a.sent_at = b.sent_at
    AND a.subject_hash IS NOT DISTINCT FROM b.subject_hash AND a.body_hash IS NOT DISTINCT FROM b.body_hash
    AND a.attachment_fp IS NOT DISTINCT FROM b.attachment_fp AND a.metadata_fp = b.metadata_fp),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
roots AS (SELECT x AS id, min(y) AS root FROM reach GROUP BY x),
rooted AS (SELECT * FROM signals JOIN roots USING (id)),
buckets AS (SELECT *, min(id) OVER w AS bucket, min(root) OVER w AS a, max(root) OVER w AS b FROM rooted
  WINDOW w AS (PARTITION BY subject_hash, sender, recipient_fp, sent_at, body_hash, attachment_fp)),
likely AS (SELECT 'likely' AS class, bucket AS min_id, id, root, sent_at, archived_at FROM buckets WHERE a <> b),
exact AS (SELECT 'exact' AS class, root AS min_id, id, root, sent_at, archived_at FROM rooted
  WHERE root IN (SELECT root FROM rooted GROUP BY root HAVING count(*) > 1) AND root NOT IN (SELECT root FROM likely)),
members AS (SELECT * FROM exact UNION ALL SELECT * FROM likely)"""
_GROUPED_SQL = "SELECT 'cluster:' || min_id AS fingerprint, class, count(*) AS count, arg_min(id, (sent_at, archived_at, id)) AS keeper, string_agg(id, ',' ORDER BY sent_at, archived_at, id) AS members FROM members GROUP BY class, min_id"


def _members(spark, sf) -> DataFrame:
    return dup.cluster_members(V.emails(spark, sf), V.mail_links(spark, sf), V.attachments(spark, sf), spark.createDataFrame([], "fingerprint string, created_at long"))


@query("duplicate_groups", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.SIGNALS_SQL, _CLUSTERS_SQL, sql=_GROUPED_SQL)
def duplicate_groups(spark, sf):
    groups = dup.duplicate_groups(_members(spark, sf))
    return groups.select("fingerprint", "class", "count", "keeper", F.array_join("members", ",").alias("members"))


@query("duplicate_counts", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.SIGNALS_SQL, _CLUSTERS_SQL, sql=f'SELECT count(*) AS "all", count(*) FILTER (WHERE class = \'exact\') AS exact, count(*) FILTER (WHERE class = \'likely\') AS likely FROM ({_GROUPED_SQL})')
def duplicate_counts(spark, sf):
    return agg.duplicate_counts(dup.duplicate_groups(_members(spark, sf)))


@query(
    "duplicate_approve_all", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.SIGNALS_SQL, _CLUSTERS_SQL,
    sql=f"""SELECT id, CASE WHEN id IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY min_id ORDER BY sent_at, archived_at, id) AS k FROM exact) WHERE k > 1)
      THEN {V.NOW} ELSE deleted_at END AS deleted_at FROM emails""",
)
def duplicate_approve_all(spark, sf):
    emails, _ = dup.approve_all_exact(V.emails(spark, sf), _members(spark, sf), V.NOW)
    return emails.select("id", "deleted_at")


@query("soft_delete", V.EMAILS_SQL, sql=f"SELECT id, CASE WHEN doc_id % 5 = 0 AND deleted_at IS NULL THEN {V.NOW} ELSE deleted_at END AS deleted_at FROM emails")
def soft_delete(spark, sf):
    e = V.emails(spark, sf)
    return mut.soft_delete(e, e.where("cast(id as int) % 5 = 0").select("id"), V.NOW)[0].select("id", "deleted_at")


@query("restore", V.EMAILS_SQL, sql="SELECT id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE deleted_at END AS deleted_at FROM emails")
def restore(spark, sf):
    e = V.emails(spark, sf)
    return mut.restore(e, e.where("cast(id as int) % 2 = 0").select("id"))[0].select("id", "deleted_at")


def _orders_archive(spark, sf) -> Archive:
    """Orders as emails, with their attachments."""
    base = V.table(spark, sf, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    from lettermill.schemas import EMAILS

    schema = spark.createDataFrame([], EMAILS).schema
    known = {"id": key, "deleted_at": F.when(F.col("o_orderkey") % 3 == 0, F.lit(V.EPOCH).cast("long")), "storage_path": F.concat(F.lit("eml/"), key), "sender_email": F.lit("a@b.example")}
    emails = base.select(*[(known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    return Archive.empty(spark, emails=emails, attachments=V.attachments(spark, sf), links=V.links(spark, sf))


_DELETED_SQL = "gone AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS email_id FROM orders WHERE o_orderkey % 3 = 0), rest AS (SELECT * FROM links WHERE email_id NOT IN (SELECT email_id FROM gone))"


@query(
    "empty_trash_orphans", V.LINKS_SQL, V.ATTACHMENTS_SQL, _DELETED_SQL,
    sql="""SELECT storage_path FROM attachments WHERE id IN (SELECT attachment_id FROM links WHERE email_id IN (SELECT email_id FROM gone)) AND id NOT IN (SELECT attachment_id FROM rest)
    UNION SELECT 'eml/' || email_id FROM gone""",
)
def empty_trash_orphans(spark, sf):
    return mut.empty_trash(_orders_archive(spark, sf))[1]


@query("empty_trash_links", V.LINKS_SQL, _DELETED_SQL, sql="SELECT email_id, attachment_id FROM rest")
def empty_trash_links(spark, sf):
    return mut.empty_trash(_orders_archive(spark, sf))[0].links


@query("contact_upsert", sql="SELECT CAST(count(*) AS BIGINT) AS parsed, count(*) FILTER (WHERE c_custkey % 2 = 1) AS imported, count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0) AS updated, count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0) AS skipped FROM customer")
def contact_upsert(spark, sf):
    people = V.contacts(spark, sf)
    old = people.where("cast(id as int) % 2 = 0")
    renamed = F.when(F.col("id").cast("int") % 3 == 0, F.concat("display_name", F.lit("!"))).otherwise(F.col("display_name"))
    parsed = people.select("email", renamed.alias("display_name"), F.col("id").cast("long").alias("ordinal"))
    return mut.upsert_contacts(old, parsed)[1]


# every tenth email is in the archive already, every fiftieth could not be read
_TOLD_SQL = """keyed AS (SELECT e.id, coalesce(merged_into_id, s.id) AS root, coalesce(message_id, 'generated-' || doc_id) AS key, doc_id FROM emails e JOIN sources s ON s.id = ingestion_source_id),
known AS (SELECT root, key, min('k' || id) AS k FROM keyed WHERE doc_id % 10 = 0 GROUP BY root, key),
told AS (SELECT id, coalesce(k, min(id) OVER w) AS survivor_id, CASE WHEN k IS NULL AND id = min(id) OVER w THEN 'archived' ELSE 'duplicate' END AS status
    FROM keyed LEFT JOIN known USING (root, key) WHERE doc_id % 50 <> 7 WINDOW w AS (PARTITION BY root, key)
  UNION ALL SELECT id, NULL, 'failed' FROM keyed WHERE doc_id % 50 = 7)"""


@query("message_dedup", V.EMAILS_SQL, V.SOURCES_SQL, _TOLD_SQL, sql="SELECT id, survivor_id, status FROM told")
def message_dedup(spark, sf):
    e = V.emails(spark, sf)
    key = F.when(F.col("id").cast("long") % 50 != 7, F.col("provider_message_id"))
    rows = e.select("id", "ingestion_source_id", key.alias("message_key"), F.lit("a.mbox").alias("input_path"), F.col("id").cast("long").alias("ordinal"))
    archive = e.where("cast(id as long) % 10 = 0").select(F.concat(F.lit("k"), "id").alias("id"), "ingestion_source_id", "provider_message_id")
    return dedup_messages(rows, archive, V.sources(spark, sf)).select("id", "survivor_id", "status")


@query("import_stats", V.EMAILS_SQL, V.SOURCES_SQL, _TOLD_SQL, sql="SELECT count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'failed') AS failed FROM told")
def import_stats(spark, sf):
    return agg.import_stats(message_dedup(spark, sf))


@query(
    "attachment_dedup", V.LINKS_SQL, V.ATTACHMENTS_SQL,
    sql="""SELECT email_id, content_hash, arg_min(filename, (o, e2)) OVER (PARTITION BY content_hash) AS filename
    FROM (SELECT email_id, email_id AS e2, content_hash, filename, CAST(a.id AS BIGINT) AS o FROM links JOIN attachments a ON a.id = attachment_id)""",
)
def attachment_dedup(spark, sf):
    # the table of attachments is small as a file only: broadcast, it would stand in every task and grow with the archive
    named = V.attachments(spark, sf).withColumnRenamed("id", "attachment_id").hint("merge")
    held = V.links(spark, sf, "attachment_id").join(named, "attachment_id")
    parts = held.withColumns({"root_id": F.lit("r"), "ordinal": F.col("attachment_id").cast("long")})
    return dedup_attachments(parts).select("email_id", F.col("content_hash_sha256").alias("content_hash"), "filename")


@query("keepers", V.EMAILS_SQL, sql="SELECT text AS body, arg_min(id, (sent_at, archived_at, id)) AS keeper FROM emails GROUP BY text")
def keepers(spark, sf):
    body = V.table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("id"), F.col("text").alias("body"))
    return dup.choose_keeper(V.emails(spark, sf).join(body, "id"), "body")


# Search
def _tokens_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')"


_DOCS_SQL = """docs AS (SELECT id AS email_id, subject, text AS body, sender_email || ' ' || sender_name AS sender,
  to_address || CASE WHEN cc_address IS NULL THEN '' ELSE ' ' || cc_address END AS recipients, import_source || ' ' || source_path || ' ' || lang || ' ' || source AS meta,
  coalesce((SELECT string_agg(filename || chr(10), chr(10) ORDER BY filename) FROM links JOIN attachments a ON a.id = attachment_id WHERE email_id = emails.id), '') AS attachments FROM emails)"""
_POSTINGS_SQL = "postings AS (" + " UNION ALL ".join(
    f"SELECT email_id, '{f}' AS field, unnest({_tokens_sql(f)}) AS term, generate_subscripts({_tokens_sql(f)}, 1) - 1 AS pos FROM docs" for f in ("subject", "body", "sender", "recipients", "attachments", "meta")
) + ")"


def _postings(spark, sf) -> DataFrame:
    return srch.save_index(srch.build_postings(V.search_docs(spark, sf)), scratch_path(spark, "postings"))


@query("search_postings", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, _DOCS_SQL, _POSTINGS_SQL, sql="SELECT term, field, count(DISTINCT email_id) AS emails, count(*) AS tf, CAST(sum(pos) AS BIGINT) AS places FROM postings GROUP BY ALL")
def search_postings(spark, sf):
    places = F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p)
    return srch.build_postings(V.search_docs(spark, sf)).groupBy("term", "field").agg(F.count("*").alias("emails"), F.sum("tf").alias("tf"), F.sum(places).alias("places"))


@query("search_and_prefix", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, _DOCS_SQL, _POSTINGS_SQL, sql="SELECT email_id FROM postings WHERE term = 'the' INTERSECT SELECT email_id FROM postings WHERE term = 'with' INTERSECT SELECT email_id FROM postings WHERE term LIKE 'ating%'")
def search_and_prefix(spark, sf):
    return srch.match(_postings(spark, sf), 'The "with ating')


@query("search_any", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, _DOCS_SQL, _POSTINGS_SQL, sql="SELECT DISTINCT email_id FROM postings WHERE field IN ('subject', 'meta') AND (term = 'fr' OR term LIKE 'src7%')")
def search_any(spark, sf):
    return srch.match(_postings(spark, sf), "fr src7", ["subject", "tags", "nonsense"], or_mode=True)


@query("search_phrase", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, _DOCS_SQL, _POSTINGS_SQL, sql="SELECT DISTINCT a.email_id FROM postings a JOIN postings b USING (email_id, field) WHERE b.pos = a.pos + 1 AND a.term = 'of' AND b.term LIKE 'the%'")
def search_phrase(spark, sf):
    return srch.match(_postings(spark, sf), "of-the")


@query("search_clauses", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, _DOCS_SQL, _POSTINGS_SQL, sql="SELECT email_id FROM postings WHERE field = 'sender' AND term LIKE 'u1%' UNION SELECT email_id FROM postings WHERE field = 'recipients' AND term LIKE 'c3%'")
def search_clauses(spark, sf):
    return srch.match_clauses(_postings(spark, sf), {"sender": "u1", "recipients": "c3"}, "any")


_BM25_SQL = """SELECT email_id, -sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score FROM (
      SELECT email_id, k, f, count(*) OVER (PARTITION BY k) AS n FROM (
        SELECT email_id, k, sum(CASE field WHEN 'subject' THEN 10.0 WHEN 'body' THEN 2.0 WHEN 'sender' THEN 6.0 WHEN 'recipients' THEN 3.0 WHEN 'attachments' THEN 1.0 ELSE 2.0 END) AS f
        FROM postings, (VALUES (0), (1)) AS q(k) WHERE (k = 0 AND term = 'onre') OR (k = 1 AND term LIKE 'er%') GROUP BY ALL)) h
    JOIN (SELECT email_id, count(*) AS length FROM postings GROUP BY 1) l USING (email_id),
    (SELECT count(*) AS n_all, avg(length) AS avg_length FROM (SELECT d.email_id, count(p.term) AS length FROM docs d LEFT JOIN postings p USING (email_id) GROUP BY 1))
    WHERE email_id IN (SELECT email_id FROM postings WHERE term = 'onre') AND email_id IN (SELECT email_id FROM postings WHERE term LIKE 'er%') GROUP BY 1"""


@query(
    "search_bm25", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, _DOCS_SQL, _POSTINGS_SQL,
    sql=f"SELECT email_id, round(score, 6) AS score FROM ({_BM25_SQL})",
)
def search_bm25(spark, sf):
    docs = V.search_docs(spark, sf)
    postings = srch.save_index(srch.build_postings(docs), scratch_path(spark, "postings"))
    lengths = materialize(srch.doc_lengths(docs), "lengths")  # read for the mean and for the hits
    scored = srch.bm25(srch.match(postings, "onre er"), postings, lengths, "onre er")
    return scored.select("email_id", F.round("score", 6).alias("score"))


@query(
    "search_top_hits", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, _DOCS_SQL, _POSTINGS_SQL,
    sql=f"SELECT email_id, round(score, 6) AS score FROM (SELECT * FROM ({_BM25_SQL}) ORDER BY score, email_id LIMIT 10)",
)
def search_top_hits(spark, sf):
    """The page of ten best hits, out of an index of blocks."""
    index = ranked.write_index(V.search_docs(spark, sf), scratch_path(spark, "index"))
    return ranked.top_hits(index, "onre er", 10).select("email_id", F.round("score", 6).alias("score"))


@query("index_terms", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, _DOCS_SQL, _POSTINGS_SQL, sql="SELECT term, count(DISTINCT email_id) AS df FROM postings GROUP BY 1")
def index_terms(spark, sf):
    """The index's dictionary: every term and in how many documents it occurs."""
    return ranked.write_index(V.search_docs(spark, sf), scratch_path(spark, "index")).terms.select("term", "df")


@query("body_snippets")
def body_snippets(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", P.body_snippet(srch.tokenize("text"), ["the", "with"]).alias("snippet"))


@query("remote_issues", V.EMAILS_SQL, sql="SELECT id, trim(subject) AS subject, sender_name AS sender, archived_at, remote_content_status FROM emails WHERE remote_content_status IN ('failed', 'partial') ORDER BY archived_at DESC, id LIMIT 25")
def remote_issues(spark, sf):
    tables = Archive.empty(spark, emails=V.emails(spark, sf), sources=V.sources(spark, sf))
    return views.remote_content_issues(tables)[0].drop("issues")


# Pages
@query("page_text")
def page_text(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", H.html_to_text("html").alias("text"))


@query("page_tags", sql=r"SELECT page_id, lower(regexp_extract(t, '^<([a-zA-Z][\w:-]*)', 1)) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][\w:-]*[^>]*>')) AS t FROM pages) GROUP BY ALL")
def page_tags(spark, sf):
    return H.scan_tags(V.table(spark, sf, "pages"), "html", "page_id").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("page_links", sql=r"""SELECT page_id, url, count(*) AS n FROM (SELECT page_id, replace(regexp_extract(t, 'href="([^"]*)"', 1), '&amp;', '&') AS url FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>')) AS t FROM pages)) GROUP BY ALL""")
def page_links(spark, sf):
    tags = H.scan_tags(V.table(spark, sf, "pages"), "html", "page_id").where("tag = 'a'")
    return tags.select("page_id", F.col("attrs")["href"].alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("n"))


@query(
    "page_entities",
    # the ampersands that come of entities are set aside, so that none is decoded twice
    sql="""SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&amp;', chr(1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), chr(1), '&') AS html FROM pages""",
)
def page_entities(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", H.decode_entities("html").alias("html"))


@query("page_styles", sql=r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<style>([^<]*)</style>', 1), lambda x: trim(x)), '|') AS css FROM pages")
def page_styles(spark, sf):
    sheets = F.regexp_extract_all("html", F.lit("<style>([^<]*)</style>"), 1)
    return V.table(spark, sf, "pages").select("page_id", F.array_join(F.transform(sheets, H.sanitize_css), "|").alias("css"))


@query("page_first_links", sql=r"""SELECT page_id, ord, url FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos, url) AS ord, url FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="[^"]*"')) AS url, generate_subscripts(regexp_extract_all(html, 'href="[^"]*"'), 1) AS pos FROM pages)) WHERE ord <= 50""")
def page_first_links(spark, sf):
    found = F.regexp_extract_all("html", F.lit('(href="[^"]*")'), 1)
    rows = V.table(spark, sf, "pages").select("page_id", F.posexplode(found).alias("pos", "url"))
    ordered = rows.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("pos", "url")))
    return cap_urls(ordered, 50, "page_id").select("page_id", "ord", "url")


# Windows that streams share with batches
@query("event_history", sql="SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS count FROM events GROUP BY 1")
def event_history(spark, sf):
    from lettermill.streaming.jobs import stream_history

    return stream_history(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query(
    "event_sessions",
    sql="""SELECT user_id, count(*) AS events, epoch_us(min(ts)) // 1000 AS started, epoch_us(max(ts)) // 1000 AS last_activity FROM (
      SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def event_sessions(spark, sf):
    from lettermill.streaming.jobs import stream_stale_sessions

    found = stream_stale_sessions(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), key="user_id")
    return found.select("user_id", "events", F.unix_millis("started").alias("started"), F.unix_millis("last_activity").alias("last_activity"))


@query("session_progress", sql="SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(sum(event_id) AS BIGINT) AS processed_bytes FROM events GROUP BY 1")
def session_progress(spark, sf):
    from lettermill.streaming.jobs import stream_progress

    return stream_progress(V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("delta")))
