"""More registered queries: scalars, views, mutations and decisions over the archive as the test tables give it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lettermill.functions import html as H, text as P
from lettermill.functions.dates import backfill_sent_at
from lettermill.operators import aggregates as agg, duplicates as dup, filters as flt, joins as jn, mutations as mut, search as srch
from lettermill.operators.incremental import ComponentLog, exact_key_edges, exact_roots
from lettermill.plans import mailview as V, views
from lettermill.plans.queries import _CLUSTERS_SQL, _GROUPED_SQL, _members, LIVE, query
from lettermill.schemas import Archive, SEARCH_DOCS
from lettermill.session import dealt, materialize, scratch_path
from lettermill.sources import mailbox as mb
from lettermill.sources.ranged import list_files, read_eml_archives, write_eml_archives
from lettermill.streaming import jobs

NONE = "cast(array() as array<string>)"


def _part(spark, sf):
    return V.table(spark, sf, "part")


def _ids(df):
    return df.select("id")


@query(
    "file_names",
    sql=r"""SELECT p_partkey AS k, p_brand || '/' || p_type || '/' || p_partkey AS path, p_name AS clean, regexp_replace(p_name, '[ ]+', '_', 'g') AS file,
      ['attachment.jpg', 'attachment.txt', 'attachment'][p_size % 3 + 1] AS honest FROM part""",
)
def file_names(spark, sf):
    mime = F.get(F.array(F.lit("image/jpeg; q=1"), F.lit(" TEXT/Plain"), F.lit("x/y")), F.col("p_size") % 3)
    raw = F.concat(F.lit(" /"), "p_brand", F.lit("/./ "), "p_type", F.lit(" \\..\\"), F.col("p_partkey").cast("string"))
    dirty = F.concat(F.lit("\u0007 "), "p_name", F.lit("� "))
    return _part(spark, sf).select(
        F.col("p_partkey").alias("k"), P.normalize_source_path(raw).alias("path"), P.sanitize_text(dirty).alias("clean"),
        P.sanitize_filename(F.concat(F.lit("dir/"), "p_name")).alias("file"), P.honest_attachment_name(mime).alias("honest"),
    )


@query(
    "unique_file_names",
    sql="""SELECT g, k, CASE WHEN n = 1 THEN size || '.pdf' ELSE size || '-' || n || '.pdf' END AS unique_name FROM (
      SELECT p_brand || p_type AS g, p_partkey AS k, p_size % 3 AS size, row_number() OVER (PARTITION BY p_brand || p_type, p_size % 3 ORDER BY p_partkey) AS n FROM part)""",
)
def unique_file_names(spark, sf):
    rows = _part(spark, sf).select(F.concat("p_brand", "p_type").alias("g"), F.col("p_partkey").alias("k"), F.concat((F.col("p_size") % 3).cast("string"), F.lit(".pdf")).alias("name"))
    return P.unique_names(rows, "g", "name", "k").select("g", "k", "unique_name")


@query(
    "contact_scalars",
    sql="""SELECT c_custkey AS k, lower(c_name) || '@x.example' AS email, FALSE AS bare, TRUE AS good, c_name AS name, lower(c_name) || '@x.example' AS address FROM customer""",
)
def contact_scalars(spark, sf):
    mail = P.normalize_email(F.concat(F.lit(" MAILTO:"), "c_name", F.lit("@X.example ")))
    who = P.parse_display_address(F.concat(F.lit('"'), "c_name", F.lit('" <'), mail, F.lit(">")))
    return V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), mail.alias("email"), P.is_email("c_name").alias("bare"), P.is_email(mail).alias("good"), who["name"].alias("name"), who["address"].alias("address")
    )


@query(
    "mail_threading",
    sql="""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<r' || n_chars || '>' WHEN 1 THEN '<i' || doc_id || '>' WHEN 2 THEN 'c' || lang ELSE '<m' || doc_id || '>' END AS thread,
      CASE WHEN doc_id % 4 = 3 THEN '<m' || doc_id || '>' ELSE 'generated-' || sha256(text) || '-' || source END AS key,
      CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'F' END AS path, CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source ELSE '' END AS labels FROM documents""",
)
def mail_threading(spark, sf):
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    mid = F.when(i % 4 == 3, F.concat(F.lit("<m"), s(i), F.lit(">")))
    refs = F.when(i % 4 == 0, F.concat(F.lit(" <r"), s(F.col("n_chars")), F.lit(">  <later>")))
    reply, conv = F.when(i % 4 == 1, F.concat(F.lit("<i"), s(i), F.lit(">"))), F.when(i % 4 == 2, F.concat(F.lit("c"), "lang"))
    filed = P.folder_and_labels(F.when(i % 2 == 0, F.concat("lang", F.lit(", ,"), "source")), F.lit("F"), F.lit("p"))
    return V.table(spark, sf, "documents").select(
        "doc_id", P.thread_id(refs, reply, conv, mid).alias("thread"), P.message_key(mid, F.col("text").cast("binary"), F.col("source")).alias("key"),
        filed["path"].alias("path"), F.array_join(filed["labels"], "|").alias("labels"),
    )


@query(
    "source_naming",
    sql="""SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'Box' || s_suppkey WHEN 2 THEN 'top' || s_nationkey ELSE 'mbox import' END AS name,
      CASE s_suppkey % 3 WHEN 0 THEN 'B' || s_suppkey WHEN 1 THEN 'f' ELSE 'z' || s_nationkey END AS shown FROM supplier""",
)
def source_naming(spark, sf):
    k, s = F.col("s_suppkey"), lambda c: F.col(c).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit(" "), "s_name"))
    paths = F.when(k % 4 == 1, F.array(F.concat(F.lit("x/Box"), s("s_suppkey"), F.lit(".mbox/mbox")))).when(k % 4 == 2, F.array(F.concat(F.lit("top"), s("s_nationkey"), F.lit("/a.eml")))).otherwise(F.expr(NONE))
    path = F.when(k % 3 == 0, F.concat(F.lit("in/B"), s("s_suppkey"), F.lit(".mbox/mbox"))).when(k % 3 == 1, F.lit("in/f.mbox")).otherwise(F.concat(F.lit("in/z"), s("s_nationkey"), F.lit(".zip")))
    return V.table(spark, sf, "supplier").select(k.alias("k"), P.derive_source_name(name, paths, F.lit(None).cast("string"), F.lit("mbox_import")).alias("name"), P.import_display_name(path).alias("shown"))


@query(
    "row_scalars", V.EMAILS_SQL,
    sql="""SELECT id, to_address AS tos, coalesce(cc_address, '') AS ccs, lang || '|e' || doc_id AS errors,
      CASE WHEN doc_id % 3 = 0 THEN CAST(least(doc_id + 1, 100) AS BIGINT) ELSE CAST(25 AS BIGINT) END AS page, round(least(100.0, doc_id * 100.0 / 700), 6) AS percent FROM emails""",
)
def row_scalars(spark, sf):
    number = F.col("id").cast("long")
    asked = F.when(number % 3 == 0, (number + 1).cast("string")).when(number % 3 == 1, "x").otherwise("-4")
    errors = P.append_error(F.array(F.col("tags")[0]), F.concat(F.lit("e"), number.cast("string")))
    return V.emails(spark, sf).select(
        "id", F.array_join(P.addresses("recipients", "to"), ",").alias("tos"), F.array_join(P.addresses("recipients", "cc"), ",").alias("ccs"), F.array_join(errors, "|").alias("errors"),
        P.clamp_positive_column(asked, 25, 100).alias("page"), F.round(P.progress_percent(number, F.lit(700)), 6).alias("percent"),
    )


# URLs made of keys, so that every rule is met by some row
_URL_SQL = """urls AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'https://cdn.example/i' || p_partkey || '.png' WHEN 1 THEN 'http://10.' || p_size || '.0.1/a' WHEN 2 THEN 'ftp://x.example/' || p_partkey
  WHEN 3 THEN 'https://t' || p_size || '.emltrk.com/' || p_partkey WHEN 4 THEN 'http://u:p@x.example/' || p_partkey WHEN 5 THEN 'http://x.example:8' || p_size || '/' ELSE 'http://' || (2130706432 + p_size) || '/' END AS url, p_size, p_partkey % 7 AS r FROM part)"""


def _urls(spark, sf):
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    made = [("https://cdn.example/i", k, ".png"), ("http://10.", z, ".0.1/a"), ("ftp://x.example/", k, ""), ("https://t", z, F.concat(F.lit(".emltrk.com/"), k)), ("http://u:p@x.example/", k, ""), ("http://x.example:8", z, "/"), ("http://", (F.lit(2130706432) + F.col("p_size")).cast("string"), "/")]
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    url = F.get(F.array(*[F.concat(*map(lit, m)) for m in made]), (F.col("p_partkey") % 7).cast("int"))
    # a file of keys is small and read by few tasks, the pages made of them are long to scan: they are dealt first
    return dealt(_part(spark, sf).select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("k"), url.alias("url"), "p_size")


@query(
    "url_policy", _URL_SQL,
    sql="""SELECT k, r = 3 AS tracker, CASE r WHEN 1 THEN 'Address 10.' || p_size || '.0.1 is a private or local network address' WHEN 2 THEN 'Unsupported remote content protocol'
      WHEN 4 THEN 'Credentialed remote content URLs are blocked' WHEN 5 THEN 'Non-standard remote content ports are blocked'
      WHEN 6 THEN 'Address 127.0.0.' || p_size || ' is a private or local network address' END AS blocked, r <> 2 AS safe FROM urls""",
)
def url_policy(spark, sf):
    return _urls(spark, sf).select("k", H.is_tracking_url("url").alias("tracker"), H.url_block_reason("url").alias("blocked"), H.is_safe_link("url").alias("safe"))


def _pages(spark, sf):
    """One page a part: an image of some size, a source set, a style and a link."""
    u = F.col("url")
    page = F.concat(
        F.lit('<p><img src="'), u, F.lit('" width="'), F.col("p_size").cast("string"), F.lit('" height=1><img srcset="https://s.example/'), F.col("k").cast("string"),
        F.lit('.png 2x, /local.png 1x"><div style="background: url(\'https://b.example/'), F.col("p_size").cast("string"), F.lit("')\"></div><a href=\"https://a.example/\">x</a>"),
    )
    return _urls(spark, sf).select("k", "url", "p_size", page.alias("html"))


@query(
    "remote_urls", _URL_SQL,
    sql="""SELECT k, row_number() OVER (PARTITION BY k ORDER BY o) AS ord, url FROM (
      SELECT k, 0 AS o, url FROM urls WHERE p_size > 2 AND r NOT IN (2, 3) UNION ALL SELECT k, 1, 'https://s.example/' || k || '.png' FROM urls UNION ALL SELECT k, 2, 'https://b.example/' || p_size FROM urls)""",
)
def remote_urls(spark, sf):
    return H.extract_remote_urls(_pages(spark, sf), "html", "k").select("k", F.col("ord").cast("long").alias("ord"), "url")


@query(
    "asset_types",
    sql="""SELECT p_partkey AS k, ['image/png', 'text/css', NULL][p_size % 3 + 1] AS kind, p_size % 3 = 0 AS viewable, ['image/gif', 'text/css', NULL][p_size % 3 + 1] AS stored,
      CASE WHEN p_size % 3 = 2 THEN 'Remote content has no content type and is not a recognized image' END AS refused, 'a' || p_partkey AS cids,
      CASE WHEN p_size % 2 = 0 THEN 'Remote server returned HTTP 404 Not Found' ELSE 'Remote server returned HTTP 799' END AS said FROM part""",
)
def asset_types(spark, sf):
    kind = F.get(F.array(F.lit(" Image/PNG; q=1"), F.lit("text/css"), F.lit(" ")), F.col("p_size") % 3)
    body = F.when(F.col("p_size") % 3 == 0, F.lit(b"GIF89a......")).otherwise(F.lit(b"body { }"))
    stored = H.archivable(body, kind)
    cids = H.cid_references(F.concat(F.lit('<img src="cid:A'), F.col("p_partkey").cast("string"), F.lit('"><img src="CID:a'), F.col("p_partkey").cast("string"), F.lit('">')))
    return _part(spark, sf).select(
        F.col("p_partkey").alias("k"), H.normalize_content_type(kind).alias("kind"), H.is_safe_image(kind).alias("viewable"), stored["content_type"].alias("stored"), stored["reason"].alias("refused"),
        F.array_join(cids, ",").alias("cids"), H.http_reason(F.when(F.col("p_size") % 2 == 0, 404).otherwise(799)).alias("said"),
    )


@query(
    "sheet_resources", V.ASSETS_SQL,
    sql="""SELECT email_id, row_number() OVER (PARTITION BY email_id ORDER BY sheet) AS ord, url FROM (
      SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS email_id, 'https://h.example/d/' || s_suppkey || '.css' AS sheet, 'https://h.example/i' || s_nationkey || '.png' AS url FROM supplier)""",
)
def sheet_resources(spark, sf):
    k = F.col("s_suppkey").cast("string")
    css = V.table(spark, sf, "supplier").select(
        F.lpad(k, 10, "0").alias("email_id"), F.concat(F.lit("https://h.example/d/"), k, F.lit(".css")).alias("sheet_url"),
        F.concat(F.lit("a { b: url(../i"), F.col("s_nationkey").cast("string"), F.lit(".png) } c { d: url('https://x.emltrk.com/p') }")).alias("css"),
    )
    return H.css_subresources(V.assets(spark, sf), css).select("email_id", F.col("ord").cast("long").alias("ord"), "url")


@query("mail_eq_filter", V.EMAILS_SQL, sql="SELECT id FROM emails WHERE import_source = 'src3' AND source_path = 'Folder/en'")
def mail_eq_filter(spark, sf):
    return _ids(flt.eq_filter(V.emails(spark, sf), import_source="src3", source_path="Folder/en"))


_ASSET_STATUS = "max(CASE WHEN status = 'archived' THEN 1 ELSE 0 END) AS a, count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status IN ('failed', 'blocked')) AS bad"


@query(
    "remote_asset_list", V.ASSETS_SQL,
    sql="""SELECT id, email_id, status, status = 'archived' AND content_type = 'image/png' AS viewable FROM assets
      WHERE email_id IN ('0000000001', '0000000002', '0000000007') AND status <> 'pending' AND NOT (status = 'archived' AND content_type = 'text/css')""",
)
def remote_asset_list(spark, sf):
    tables = Archive.empty(spark, assets=V.assets(spark, sf))
    return views.remote_assets(tables, ["0000000001", "0000000002", "0000000007"]).select("id", "email_id", "status", "viewable")


@query("remote_status", V.ASSETS_SQL, sql=f"SELECT email_id, CASE WHEN bad + archived = 0 THEN 'skipped' WHEN bad = 0 THEN 'archived' WHEN archived > 0 THEN 'partial' ELSE 'failed' END AS status, archived FROM (SELECT email_id, {_ASSET_STATUS} FROM assets GROUP BY 1)")
def remote_status(spark, sf):
    return agg.remote_status(V.assets(spark, sf))


@query(
    "issue_assets", V.EMAILS_SQL, V.ASSETS_SQL,
    sql="SELECT e.id, coalesce(n, 0) AS issues FROM emails e LEFT JOIN (SELECT email_id, count(*) AS n FROM assets WHERE status IN ('failed', 'blocked') GROUP BY 1) a ON a.email_id = e.id",
)
def issue_assets(spark, sf):
    rows = jn.with_issue_assets(V.emails(spark, sf), V.assets(spark, sf))
    return rows.select("id", F.coalesce(F.size("issues"), F.lit(0)).cast("long").alias("issues"))


@query(
    "asset_lookup", V.ASSETS_SQL,
    sql="SELECT email_id, original_url AS url, id AS asset_id, status, status = 'archived' AND storage_path IS NOT NULL AND content_type = 'image/png' AS usable FROM assets UNION ALL SELECT email_id, 'https://no.example/', NULL, NULL, FALSE FROM assets WHERE CAST(id AS BIGINT) % 10 = 0",
)
def asset_lookup(spark, sf):
    a = V.assets(spark, sf)
    asked = a.select("email_id", F.col("original_url").alias("url")).unionByName(a.where("cast(id as long) % 10 = 0").select("email_id", F.lit("https://no.example/").alias("url")))
    return jn.resolve_assets(asked, a)


@query(
    "preview_counters", V.ASSETS_SQL,
    sql="""SELECT email_id, count(*) AS remote, count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'failed') AS failed FROM assets GROUP BY 1""",
)
def preview_counters(spark, sf):
    a = V.assets(spark, sf)
    return agg.preview_counters(a.select("email_id", F.col("original_url").alias("url")), a)


@query("asset_sweep", V.EMAILS_SQL, V.ASSETS_SQL, sql=f"""SELECT e.id, CASE WHEN t.email_id IS NULL THEN remote_content_status WHEN coalesce(bad + archived, 0) = 0 THEN 'skipped' WHEN bad = 0 THEN 'archived' WHEN archived > 0 THEN 'partial' ELSE 'failed' END AS status
  FROM emails e LEFT JOIN (SELECT DISTINCT email_id FROM assets WHERE status IN ('failed', 'blocked') AND original_url LIKE '%emltrk%') t ON t.email_id = e.id
  LEFT JOIN (SELECT email_id, {_ASSET_STATUS} FROM assets WHERE NOT (status IN ('failed', 'blocked') AND original_url LIKE '%emltrk%') GROUP BY 1) r ON r.email_id = e.id""")  # fmt: skip
def asset_sweep(spark, sf):
    return mut.sweep_tracking_assets(V.assets(spark, sf), V.emails(spark, sf))[1].select("id", F.col("remote_content_status").alias("status"))


@query(
    "asset_upsert", V.ASSETS_SQL,
    sql="SELECT email_id, url_hash, CASE WHEN status <> 'archived' AND CAST(id AS BIGINT) % 2 = 0 THEN 'archived' ELSE status END AS status FROM assets UNION ALL SELECT 'new', 'h' || id, 'failed' FROM assets WHERE CAST(id AS BIGINT) % 5 = 0",
)
def asset_upsert(spark, sf):
    a = V.assets(spark, sf)
    redone = a.where("cast(id as long) % 2 = 0").select("email_id", "url_hash", "original_url", F.lit("archived").alias("status"))
    new = a.where("cast(id as long) % 5 = 0").select(F.lit("new").alias("email_id"), F.concat(F.lit("h"), "id").alias("url_hash"), "original_url", F.lit("failed").alias("status"))
    return mut.upsert_assets(a, redone.unionByName(new)).select("email_id", "url_hash", "status")


@query("nocase_tags", V.EMAILS_SQL, sql="SELECT DISTINCT source AS tag, lower(source) AS folded FROM emails")
def nocase_tags(spark, sf):
    return flt.sort_nocase(flt.distinct_rows(V.emails(spark, sf).select(F.col("import_source").alias("tag"), F.lower("import_source").alias("folded")), ["tag", "folded"]), "tag")


@query("set_operations", V.EMAILS_SQL, sql=f"SELECT id, FALSE AS added FROM emails WHERE {LIVE} AND NOT has_attachments UNION ALL SELECT 'x' || id, TRUE FROM emails WHERE deleted_at IS NOT NULL AND NOT has_attachments")
def set_operations(spark, sf):
    e = V.emails(spark, sf)
    live = flt.trash_gate(e).select("id", F.lit(False).alias("added"))
    more = e.where("deleted_at is not null").select(F.concat(F.lit("x"), "id").alias("id"), F.lit(True).alias("added")).unionByName(live)
    bare = e.where("has_attachments").select("id")
    table = flt.insert_or_ignore(live, more.unionByName(more), ["id"])
    return flt.minus(flt.minus(table, bare, "id"), bare.select(F.concat(F.lit("x"), "id").alias("id")), "id")


@query("unique_ids", V.EMAILS_SQL, sql="SELECT id, lang || ',' || source AS ids FROM emails")
def unique_ids(spark, sf):
    t = F.col("tags")
    return V.emails(spark, sf).select("id", F.array_join(flt.unique_ids(F.array(t[0], F.lit(""), t[1], t[0], F.lit(None).cast("string"))), ",").alias("ids"))


@query("hit_emails", V.EMAILS_SQL, sql="SELECT id, sent_at FROM emails WHERE size_bytes % 3 = 0")
def hit_emails(spark, sf):
    e = V.emails(spark, sf)
    return jn.hits_to_emails(e.where("size_bytes % 3 = 0").select(F.col("id").alias("email_id")), e).select("id", "sent_at")


@query("source_details", V.EMAILS_SQL, V.SOURCES_SQL, sql="SELECT e.id, s.name, s.status, s.created_at FROM emails e LEFT JOIN sources s ON s.id = ingestion_source_id")
def source_details(spark, sf):
    return jn.with_source(V.emails(spark, sf), V.sources(spark, sf)).select("id", "source.name", "source.status", "source.created_at")


@query("semi_and_anti", V.LINKS_SQL, V.ATTACHMENTS_SQL, sql="SELECT id, TRUE AS linked FROM attachments WHERE id IN (SELECT attachment_id FROM links) UNION ALL SELECT id, FALSE FROM attachments WHERE id NOT IN (SELECT attachment_id FROM links)")
def semi_and_anti(spark, sf):
    a, used = V.attachments(spark, sf).select("id"), V.link_rows(spark, sf).select(F.col("attachment_id").alias("id"))
    return jn.semi_filter(a, used, "id").withColumn("linked", F.lit(True)).unionByName(jn.anti_filter(a, used, "id").withColumn("linked", F.lit(False)))


@query("json_tags", V.EMAILS_SQL, sql="SELECT id, unnest([lang, source]) AS tag FROM emails")
def json_tags(spark, sf):
    rows = V.emails(spark, sf).select("id", F.to_json("tags").alias("tags"))
    return jn.explode_json(rows, "tags", "tag").select("id", "tag")


@query("sender_contacts", sql="SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS contact FROM customer")
def sender_contacts(spark, sf):
    people = V.contacts(spark, sf)
    book = views.contact_map(people.where("cast(id as int) % 2 = 0"))
    return jn.with_contact(people.select("id", F.upper("email").alias("sender_email")), book).select("id", F.col("contact_name").alias("contact"))


@query(
    "session_results", V.SESSIONS_SQL,
    sql="""SELECT id, completed + 1 AS completed, failed + 1 AS failed, completed + failed + 2 >= total AS last, CASE WHEN failed > 0 THEN 'bad|' ELSE '' END || 'e' || id AS errors FROM sessions""",
)
def session_results(spark, sf):
    s = V.sessions(spark, sf)
    told = s.select(F.col("id").alias("session_id"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")).unionByName(s.select(F.col("id").alias("session_id"), F.lit(False).alias("ok"), F.concat(F.lit("e"), "id").alias("error")))
    return agg.session_progress(s, told).select("id", F.col("completed_mailboxes").alias("completed"), F.col("failed_mailboxes").alias("failed"), "last", F.array_join("error_messages", "|").alias("errors"))


_STALE = V.EPOCH + 1_800_000 + 5 * 60_000


@query(
    "stale_sessions", V.SOURCES_SQL, V.SESSIONS_SQL,
    sql=f"""SELECT id, CASE WHEN id IN (SELECT source_id FROM sessions WHERE active_at < {_STALE - 1_800_000} AND completed + failed < total) THEN 'error' ELSE status END AS status FROM sources
    UNION ALL SELECT id, 'kept' FROM sessions WHERE active_at >= {_STALE - 1_800_000}""",
)
def stale_sessions(spark, sf):
    kept, sources = mut.clean_stale_sessions(V.sessions(spark, sf), V.sources(spark, sf), _STALE)
    return sources.select("id", "status").unionByName(kept.select("id", F.lit("kept").alias("status")))


@query(
    "finished_imports", V.SOURCES_SQL, V.SESSIONS_SQL,
    sql="""SELECT s.id, CASE WHEN d.id IS NULL THEN NULL WHEN failed > 0 THEN 'Import finished with ' || failed || ' error(s):' || chr(10) || 'bad' WHEN initial THEN 'Import finished. Archived ' || completed || ' mailbox(es).' ELSE 'Import completed successfully.' END AS message,
      CASE WHEN d.id IS NULL OR status = 'paused' THEN status WHEN failed > 0 THEN 'error' ELSE 'imported' END AS status
    FROM sources s LEFT JOIN (SELECT * FROM sessions WHERE completed + failed >= total QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY active_at DESC, id DESC) = 1) d ON d.source_id = s.id""",
)
def finished_imports(spark, sf):
    done = mut.finalize_import(V.sources(spark, sf), V.sessions(spark, sf), V.NOW)
    return done.select("id", F.col("last_import_status_message").alias("message"), "status")


@query(
    "source_list", V.SOURCES_SQL, V.SESSIONS_SQL,
    sql="SELECT s.id, name, coalesce(merged_into_id, s.id) AS root_id, round(greatest(0, least(100.0, done * 100.0 / all_bytes)), 6) AS progress FROM sources s LEFT JOIN (SELECT source_id, sum(processed) AS done, sum(total_bytes) AS all_bytes FROM sessions GROUP BY 1) p ON p.source_id = s.id",
)
def source_list(spark, sf):
    tables = Archive.empty(spark, sources=V.sources(spark, sf), sessions=V.sessions(spark, sf))
    return views.list_sources(tables).select("id", "name", "root_id", F.round("progress", 6).alias("progress"))


@query("source_edits", V.SOURCES_SQL, sql="SELECT id, CASE WHEN id = 'src1' THEN 'Renamed' ELSE name END AS name, CASE WHEN id IN ('src4', 'src5', 'src6', 'src7') THEN 'src8' ELSE merged_into_id END AS merged_into_id FROM sources")
def source_edits(spark, sf):
    s = V.sources(spark, sf)
    patch = s.where("id = 'src1'").select("id", F.lit("Renamed").alias("name"))
    return mut.merge_into(mut.update_sources(s, patch), "src4", "src9").select("id", "name", "merged_into_id")


def _archive(spark, sf) -> Archive:
    return Archive.empty(spark, emails=V.emails(spark, sf), sources=V.sources(spark, sf), attachments=V.attachments(spark, sf), links=V.mail_links(spark, sf), assets=V.assets(spark, sf), sessions=V.sessions(spark, sf))


@query(
    "source_removal", V.EMAILS_SQL, V.SOURCES_SQL, V.MAIL_LINKS_SQL,
    sql="""SELECT 'email' AS kind, id FROM emails WHERE source NOT IN ('src4', 'src5', 'src6', 'src7') UNION ALL SELECT 'source', id FROM sources WHERE id NOT IN ('src4', 'src5', 'src6', 'src7')
    UNION ALL SELECT 'link', email_id || '-' || attachment_id FROM links WHERE email_id NOT IN (SELECT id FROM emails WHERE source IN ('src4', 'src5', 'src6', 'src7'))""",
)
def source_removal(spark, sf):
    left = mut.delete_source(_archive(spark, sf), "src4")[0]
    rows = [("email", left.emails.select("id")), ("source", left.sources.select("id")), ("link", left.links.select(F.concat_ws("-", "email_id", "attachment_id").alias("id")))]
    parts = [df.select(F.lit(k).alias("kind"), "id") for k, df in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("emptied_sources", V.EMAILS_SQL, V.SOURCES_SQL, sql="SELECT id FROM sources WHERE NOT (status IN ('imported', 'error') AND id IN ('src2', 'src5', 'src9', 'src10', 'src11') AND id NOT IN (SELECT merged_into_id FROM sources WHERE merged_into_id IS NOT NULL))")
def emptied_sources(spark, sf):
    t = _archive(spark, sf)
    left = t.with_tables(emails=t.emails.where("ingestion_source_id not in ('src2', 'src5', 'src9', 'src10', 'src11')"))
    return mut.drop_emptied_sources(left).sources.select("id")


@query("tag_edit", V.EMAILS_SQL, sql="SELECT id, CASE WHEN id IN ('0000000003', '0000000005') THEN source || ',new' ELSE lang || ',' || source END AS tags FROM emails")
def tag_edit(spark, sf):
    e = V.emails(spark, sf)
    got = mut.update_tags(e, ["0000000003", "0000000005", "none"], ["#new"], ["en", "fr", "de", "es", "it"])[0]
    return got.select("id", F.array_join("tags", ",").alias("tags"))


@query("folder_tags", V.EMAILS_SQL, sql="SELECT id, lang || ',' || source || CASE WHEN doc_id % 3 = 0 THEN ',Old/' || lang ELSE '' END AS tags FROM emails")
def folder_tags(spark, sf):
    e = V.emails(spark, sf)
    copies = e.where("cast(id as int) % 3 = 0").select("id", F.concat(F.lit("Old/"), F.col("tags")[0]).alias("path"), F.lit(1).cast("long").alias("ordinal"))
    again = copies.withColumn("ordinal", F.lit(2).cast("long"))
    return mut.merge_folder_tags(e, copies.unionByName(again)).select("id", F.array_join("tags", ",").alias("tags"))


# Decisions on duplicates, with a ledger that holds every third cluster
_LEDGER_SQL = "ledger AS (SELECT min_id FROM members GROUP BY min_id HAVING CAST(min_id AS BIGINT) % 3 = 0)"


@query("duplicates_not_ignored", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.SIGNALS_SQL, _CLUSTERS_SQL, _LEDGER_SQL, sql="SELECT class, min_id, id FROM members WHERE min_id NOT IN (SELECT min_id FROM ledger) AND class = 'exact'")
def duplicates_not_ignored(spark, sf):
    members = _members(spark, sf)
    keys = members.where("cast(min_id as long) % 3 = 0").select(F.concat(F.lit("cluster:"), "min_id").alias("fingerprint"))
    ledger, _ = dup.ignore_groups(spark.createDataFrame([], "fingerprint string, created_at long"), keys, V.NOW)
    return dup.drop_ignored(members, ledger).where("class = 'exact'").select("class", "min_id", "id")


@query("duplicate_class", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.SIGNALS_SQL, _CLUSTERS_SQL, sql=f"SELECT fingerprint, count FROM ({_GROUPED_SQL}) WHERE class = 'likely' ORDER BY count DESC, fingerprint LIMIT 25")
def duplicate_class(spark, sf):
    return flt.page_groups(dup.duplicate_groups(_members(spark, sf), "likely")).select("fingerprint", "count")


@query(
    "duplicate_decisions", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.SIGNALS_SQL, _CLUSTERS_SQL,
    sql=f"""SELECT id, CASE WHEN deleted_at IS NULL AND id IN (SELECT id FROM members m WHERE class = 'likely' AND id <> (SELECT arg_min(id, (sent_at, archived_at, id)) FROM members x WHERE x.class = 'likely' AND x.min_id = m.min_id)) THEN {V.NOW} ELSE deleted_at END AS deleted_at FROM emails""",
)
def duplicate_decisions(spark, sf):
    groups = dup.duplicate_groups(_members(spark, sf), "likely")
    return dup.approve_groups(V.emails(spark, sf), groups.select("keeper", F.col("members").alias("delete")), V.NOW)[0].select("id", "deleted_at")


# Whole views
@query(
    "view_listing", V.EMAILS_SQL, V.SOURCES_SQL,
    sql=f"""SELECT e.id, 'from' AS kind, sender_email AS "from", strftime(make_timestamp(sent_at * 1000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS sent_at, deleted_at IS NOT NULL AS trashed FROM emails e
    WHERE {LIVE} AND lang = 'en' ORDER BY size_bytes DESC, e.id LIMIT 20 OFFSET 20""",
)
def view_listing(spark, sf):
    page, _ = views.list_emails(_archive(spark, sf), sort="sizeBytes", page=2, limit=20, tag="en")
    return page.select("id", F.lit("from").alias("kind"), "from", "sent_at", "trashed")


@query(
    "view_detail", V.EMAILS_SQL, V.SOURCES_SQL, V.MAIL_LINKS_SQL,
    sql="""SELECT e.id, subject, to_address || CASE WHEN cc_address IS NULL THEN '' ELSE ',' || cc_address END AS people, s.name AS source, (SELECT count(*) FROM links WHERE email_id = e.id) AS files
    FROM emails e JOIN sources s ON s.id = ingestion_source_id WHERE e.id IN ('0000000001', '0000000002', '0000000010', '0000000150')""",
)
def view_detail(spark, sf):
    rows = views.email_detail(_archive(spark, sf), ["0000000001", "0000000002", "0000000010", "0000000150", "no"])
    people = F.array_join(F.transform("recipients", lambda p: p["email"]), ",")
    return rows.select("id", "subject", people.alias("people"), "source.name", F.coalesce(F.size("attachments"), F.lit(0)).cast("long").alias("files")).withColumnRenamed("name", "source")


@query("view_facets", V.EMAILS_SQL, sql=f"SELECT DISTINCT tag FROM (SELECT unnest([lang, source]) AS tag FROM emails WHERE {LIVE})")
def view_facets(spark, sf):
    return views.facets(_archive(spark, sf))


@query("view_dashboard", V.EMAILS_SQL, sql=f"SELECT count(*) AS total_emails, CAST(sum(size_bytes) AS BIGINT) AS storage_used, count(*) FILTER (WHERE remote_content_status = 'failed') AS failed, count(*) FILTER (WHERE remote_content_status = 'partial') AS partial FROM emails WHERE {LIVE}")
def view_dashboard(spark, sf):
    board = views.dashboard(_archive(spark, sf), V.NOW)
    return board["totals"].join(board["remote_failures"], F.lit(True))


@query("view_review", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.SIGNALS_SQL, _CLUSTERS_SQL, sql=f"SELECT fingerprint, class, count, keeper FROM ({_GROUPED_SQL}) ORDER BY count DESC, fingerprint LIMIT 10")
def view_review(spark, sf):
    return views.review_duplicates(_archive(spark, sf), limit=10).select("fingerprint", "class", "count", "keeper")


# Search results and upkeep of the index
@query(
    "search_results", V.EMAILS_SQL,
    sql="SELECT id, subject, size_bytes FROM emails WHERE contains(lower(sender_email), 'u11@') ORDER BY size_bytes DESC, id LIMIT 10",
)
def search_results(spark, sf):
    e = V.emails(spark, sf)
    postings = srch.build_postings(V.search_docs(spark, sf).select("email_id", *[(F.col(f) if f == "sender" else F.lit("")).alias(f) for f in srch.FIELDS]))
    hits = srch.match_with_fallback(postings, "u11 nowhere")
    found = jn.hits_to_emails(hits, e).withColumn("score", F.lit(0.0))
    return srch.to_documents(srch.order_hits(found.where("sender_email like 'u11@%'"), "sizeBytes"), 1, 10).select("id", "subject", "size_bytes")


@query("index_upkeep", V.EMAILS_SQL, sql="SELECT email_id, field, count(*) AS terms FROM (SELECT DISTINCT id AS email_id, 'meta' AS field, unnest(CASE WHEN doc_id % 2 = 0 THEN ['changed', lang] ELSE [source, 'folder', lang] END) AS term FROM emails WHERE doc_id % 5 <> 0) GROUP BY ALL")
def index_upkeep(spark, sf):
    e = V.emails(spark, sf)
    docs = V.search_docs(spark, sf).select("email_id", *[(F.col(f) if f == "meta" else F.lit("")).alias(f) for f in srch.FIELDS])
    kept = srch.sweep_orphans(docs, e.where("cast(id as int) % 5 <> 0"))
    postings = srch.reindex(srch.build_postings(docs), kept, docs.select(F.col("email_id").alias("id")))
    changed = e.where("cast(id as int) % 2 = 0 and cast(id as int) % 5 <> 0").select(F.col("id").alias("email_id"), F.concat(F.lit("changed "), F.col("tags")[0]).alias("meta"))
    return srch.reindex_meta(postings, changed).groupBy("email_id", "field").agg(F.count("*").alias("terms"))


@query("search_attachments", V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.EMAILS_SQL, sql="SELECT DISTINCT email_id FROM links JOIN attachments a ON a.id = attachment_id JOIN emails e ON e.id = email_id WHERE filename LIKE '%.stl'")
def search_attachments(spark, sf):
    e = V.emails(spark, sf)
    body = e.select("id", F.lit("").alias("text"), F.lit("").alias("html"))
    docs = srch.build_search_docs(e, V.mail_links(spark, sf), V.attachments(spark, sf), body)
    return srch.match(srch.build_postings(docs), "stl", ["attachments.filename"])


@query("search_blind_copies", V.EMAILS_SQL, sql="SELECT id AS email_id FROM emails WHERE doc_id % 6 = 0")
def search_blind_copies(spark, sf):
    e = V.emails(spark, sf)
    person = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("hidden@example.org").alias("address")))
    hidden = e.withColumn("recipients", F.when(F.col("id").cast("int") % 6 == 0, F.col("recipients").withField("bcc", person)).otherwise(F.col("recipients")))
    body = e.select("id", F.lit("").alias("text"), F.lit("").alias("html"))
    docs = srch.build_search_docs(hidden, V.links(spark, sf).where("false"), V.attachments(spark, sf), body)
    return srch.match(srch.build_postings(docs), "hidden", ["bcc"])


# Files: mail written from the documents and read back
def _mail_files(spark, sf) -> str:
    """The documents as mbox files on scratch storage; every fifth one has the id of another."""
    d = V.table(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    head = F.concat(
        F.lit("Message-ID: <m"), F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise(i), F.lit(">\nFrom: Writer <"), "lang", F.lit("@x.example>\nTo: A <a@x.example>, b@x.example\nBcc: c@x.example\nSubject: About "), i,
        F.lit("\nDate: Mon, 01 Jan 2024 00:00:00 +0000\nX-Gmail-Labels: Box/"), "source", F.lit(",Seen\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"),
    )
    folder = scratch_path(spark, "mbox")
    mb.export_mbox(d.select(F.concat(head, "text", F.lit("\n")).cast("binary").alias("raw")), folder)
    return folder


@query(
    "mail_files",
    sql=r"""SELECT 'About ' || doc_id AS subject, '<m' || CASE WHEN doc_id % 5 = 0 THEN lang ELSE CAST(doc_id AS VARCHAR) END || '>' AS message_id, lang || '@x.example' AS sender, 'a@x.example,b@x.example|c@x.example' AS people,
      md5(regexp_replace(text, '\s+', '', 'g')) AS body FROM documents""",
)
def mail_files(spark, sf):
    m = mb.parse_messages(mb.read_mbox(spark, _mail_files(spark, sf)))
    of = lambda k: F.array_join(F.transform(F.col("recipients")[k], lambda p: p["address"]), ",")
    return m.select("subject", "message_id", F.col("senders")[0]["address"].alias("sender"), F.concat(of("to"), F.lit("|"), of("bcc")).alias("people"), F.md5(F.regexp_replace("text", r"\s+", "")).alias("body"))


@query(
    "stream_import",
    # every copy's folder is a tag of the one that stays, and so is the label
    sql="""SELECT '<m' || CASE WHEN doc_id % 5 = 0 THEN lang ELSE CAST(doc_id AS VARCHAR) END || '>' AS message_id, 1704067200000 AS sent_at, 'sent' AS kind, count(DISTINCT source) + 1 AS tags FROM documents GROUP BY 1""",
)
def stream_import(spark, sf):
    place = scratch_path(spark, "stream-import")
    sources = spark.createDataFrame([("s1", None)], "id string, merged_into_id string")
    jobs.stream_import(spark, _mail_files(spark, sf), f"{place}/archive", sources, "s1", f"{place}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{place}/archive")
    return got.select(F.col("provider_message_id").alias("message_id"), "sent_at", F.col("sent_at_kind").alias("kind"), F.size("tags").cast("long").alias("tags"))


def _attached_mail_files(spark, sf) -> str:
    """The documents as mbox files of mails with one or two attachments: the text's first line, and the language."""
    d = V.table(spark, sf, "documents")
    i, line = F.col("doc_id").cast("string"), F.substring_index("text", "\n", 1)
    part = lambda kind, name, body: F.concat(F.lit(f"--B\nContent-Type: {kind}; name="), name, F.lit("\nContent-Disposition: attachment; filename="), name, F.lit("\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(body, "UTF-8")), F.lit("\n"))
    mail = F.concat(
        F.lit("Message-ID: <m"), i, F.lit(">\nFrom: a@x.example\nSubject: s\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nhello\n"),
        part("text/csv", F.concat("lang", F.lit(".csv")), line), F.when(F.col("doc_id") % 3 == 0, part("text/plain", F.lit("lang.txt"), F.col("lang"))).otherwise(""), F.lit("--B--\n"),
    )
    folder = scratch_path(spark, "mbox")
    mb.export_mbox(d.select(mail.cast("binary").alias("raw")), folder)
    return folder


@query(
    "stream_attachments",
    sql="""WITH part AS (SELECT doc_id, split_part(text, chr(10), 1) AS body, lang || '.csv' AS filename, 'text/csv' AS kind FROM documents
      UNION ALL SELECT doc_id, lang, 'lang.txt', 'text/plain' FROM documents WHERE doc_id % 3 = 0)
    SELECT sha256(body) AS content, CAST(min(strlen(body)) AS BIGINT) AS size_bytes, count(DISTINCT doc_id) AS emails, count(DISTINCT kind) AS kinds FROM part GROUP BY body""",
)
def stream_attachments(spark, sf):
    place = scratch_path(spark, "stream-attachments")
    sources = spark.createDataFrame([("s1", None)], "id string, merged_into_id string")
    jobs.stream_import(spark, _attached_mail_files(spark, sf), f"{place}/archive", sources, "s1", f"{place}/checkpoint", 3).awaitTermination()
    links, held = spark.read.parquet(f"{place}/archive_links"), spark.read.parquet(f"{place}/archive_attachments")
    by = links.join(held.withColumnRenamed("id", "attachment_id"), "attachment_id").groupBy("attachment_id")
    rows = by.agg(F.first("content").alias("content"), F.first("size_bytes").alias("size_bytes"), F.count_distinct("email_id").alias("emails"), F.count_distinct("mime_type").alias("kinds"))
    return rows.select(F.sha2("content", 256).alias("content"), "size_bytes", "emails", "kinds")


@query(
    "mail_archives",
    sql=r"""SELECT 'in/' || source AS source_path, 'Doc ' || doc_id AS subject, md5(regexp_replace(text, '\s+', '', 'g')) AS body FROM documents""",
)
def mail_archives(spark, sf):
    d = V.table(spark, sf, "documents")
    raw = F.concat(F.lit("Subject: Doc "), F.col("doc_id").cast("string"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text")
    mails = d.select(F.concat(F.lit("in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".eml")).alias("name"), raw.cast("binary").alias("raw"))
    folder = scratch_path(spark, "eml-zip")
    write_eml_archives(mails, folder)
    m = mb.parse_messages(read_eml_archives(list_files(spark, folder, "*.zip")), ("source_path",))
    return m.select("source_path", "subject", F.md5(F.regexp_replace("text", r"\s+", "")).alias("body"))


@query("stream_dedup", sql="SELECT DISTINCT event_type AS root_id, CAST(user_id AS VARCHAR) AS message_id FROM events")
def stream_dedup(spark, sf):
    place = scratch_path(spark, "stream-dedup")
    events = V.table(spark, sf, "events")
    events.write.parquet(f"{place}/in")  # a stream reads folders, and the table may be one file
    arriving = spark.readStream.schema(events.schema).parquet(f"{place}/in")
    rows = arriving.select(F.col("event_type").alias("root_id"), F.col("user_id").cast("string").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    kept = jobs.stream_dedup(rows, "3650 days").select("root_id", "message_id")
    kept.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("root_id string, message_id string").parquet(f"{place}/out")


@query("stream_index", V.EMAILS_SQL, sql="SELECT 'meta' AS field, lang AS term, count(*) AS emails FROM emails GROUP BY lang UNION ALL SELECT 'meta', source, count(*) FROM emails GROUP BY source UNION ALL SELECT 'meta', 'folder', count(*) FROM emails")
def stream_index(spark, sf):
    place = scratch_path(spark, "stream-index")
    docs = V.search_docs(spark, sf).select("email_id", *[(F.col(f) if f == "meta" else F.lit("")).alias(f) for f in srch.FIELDS])
    docs.write.parquet(f"{place}/docs")
    jobs.stream_index(spark.readStream.schema(SEARCH_DOCS).parquet(f"{place}/docs"), f"{place}/index", f"{place}/checkpoint").awaitTermination()
    return jobs.read_index(spark, f"{place}/index").groupBy("field", "term").agg(F.count("*").alias("emails"))


@query("incremental_roots", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.SIGNALS_SQL, _CLUSTERS_SQL, sql="SELECT id, root FROM rooted")
def incremental_roots(spark, sf):
    """The archive arrives in two parts, trashed mail and all; then what is trashed goes."""
    mails = V.emails(spark, sf)
    signals = materialize(dup.duplicate_signals(mails.withColumn("deleted_at", F.lit(None).cast("long")), V.mail_links(spark, sf), V.attachments(spark, sf)), "signals")
    late = F.col("id").cast("long") % 100 == 0
    log = ComponentLog(spark, scratch_path(spark, "components"))
    for part in (signals.where(~late), signals.where(late)):
        log.add(exact_key_edges(part))
    gone = mails.where("deleted_at is not null").select("id")
    log.remove(gone.withColumnRenamed("id", "node"))
    return exact_roots(log, signals.join(gone, "id", "left_anti")).select("id", "root")


@query("duplicate_snapshot", V.EMAILS_SQL, V.MAIL_LINKS_SQL, V.ATTACHMENTS_SQL, V.SIGNALS_SQL, _CLUSTERS_SQL, sql=f"SELECT fingerprint, class, count, keeper FROM ({_GROUPED_SQL})")
def duplicate_snapshot(spark, sf):
    ledger = spark.createDataFrame([], "fingerprint string, created_at long")
    groups = jobs.refresh_duplicates(V.emails(spark, sf), V.mail_links(spark, sf), V.attachments(spark, sf), ledger, scratch_path(spark, "snapshot"))
    return groups.select("fingerprint", "class", "count", "keeper")


@query("contact_csv", sql="SELECT lower(c_name) || '@x.example' AS email, c_name || ' ' || c_mktsegment AS name FROM customer")
def contact_csv(spark, sf):
    place = scratch_path(spark, "contacts")
    V.table(spark, sf, "customer").select(F.lit("x").alias("Title"), F.col("c_name").alias("First Name"), F.col("c_mktsegment").alias("Last Name"), F.concat(F.lit("MAILTO:"), "c_name", F.lit("@X.example")).alias("E-mail Address")).write.option("header", True).csv(place)
    return mb.read_contacts_csv(spark, place).select("email", F.col("display_name").alias("name"))


@query("contact_vcf", sql="SELECT lower(c_name) || '@x.example' AS email, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment || ' ' || c_custkey END AS name FROM customer")
def contact_vcf(spark, sf):
    place = scratch_path(spark, "cards")
    full = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("FN:"), "c_name", F.lit("\n"))).otherwise("")
    card = F.concat(F.lit("BEGIN:VCARD\nN:"), F.col("c_custkey").cast("string"), F.lit(";"), "c_mktsegment", F.lit("\n"), full, F.lit("EMAIL;TYPE=home:"), "c_name", F.lit("@x.example\nEND:VCARD"))
    V.table(spark, sf, "customer").select(card.alias("value")).write.text(place)
    return mb.read_contacts_vcf(spark, place).select("email", F.col("display_name").alias("name"))


@query("archive_round_trip", V.EMAILS_SQL, sql="SELECT id, source AS source, sent_at, lang || ',' || source AS tags FROM emails")
def archive_round_trip(spark, sf):
    place = scratch_path(spark, "archive")
    mb.write_archive(_archive(spark, sf), place)
    return mb.read_archive(spark, place).emails.select("id", F.col("ingestion_source_id").alias("source"), "sent_at", F.array_join("tags", ",").alias("tags"))


@query("attachment_texts", sql="SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE md5(text) END AS extracted FROM documents")
def attachment_texts(spark, sf):
    kind = F.get(F.array(F.lit("text/plain; charset=utf-8"), F.lit("application/json"), F.lit("image/png")), (F.col("doc_id") % 3).cast("int"))
    files = V.table(spark, sf, "documents").select("doc_id", kind.alias("mime_type"), F.lit("f").alias("filename"), F.col("text").cast("binary").alias("content"))
    text = mb.extract_attachment_text(files)
    return text.select("doc_id", F.when(F.col("extracted_text") == "", "").otherwise(F.md5("extracted_text")).alias("extracted"))


@query("mailbox_folders", sql="SELECT p_partkey AS k, 'In/' || p_brand || '/x' AS folder, 'In/' || p_brand AS bundle, 'In.mbox/' || p_brand || '.MBOX' AS eml FROM part")
def mailbox_folders(spark, sf):
    path = F.concat(F.lit("In.mbox/"), "p_brand", F.lit(".MBOX/x"))
    return _part(spark, sf).select(F.col("p_partkey").alias("k"), mb.mbox_folder(path).alias("folder"), mb.bundle_folder(path).alias("bundle"), mb.eml_folder(path).alias("eml"))


@query("mailbox_bytes", sql="SELECT source AS source_path, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM documents GROUP BY 1")
def mailbox_bytes(spark, sf):
    return agg.input_bytes(V.table(spark, sf, "documents").select(F.col("source").alias("source_path"), F.col("n_chars").alias("length")))


@query(
    "sent_backfill", V.EMAILS_SQL,
    sql="SELECT id, CASE WHEN doc_id % 4 = 0 THEN 1704067200000 ELSE sent_at END AS sent_at, CASE WHEN doc_id % 4 = 2 THEN 'unknown' ELSE 'sent' END AS kind FROM emails",
)
def sent_backfill(spark, sf):
    i = F.col("id").cast("long")
    old = V.emails(spark, sf).withColumn("sent_at_kind", F.when(i % 2 == 1, "sent"))
    date = F.when(i % 4 == 0, "Mon, 01 Jan 2024 00:00:00 +0000").otherwise("no date")
    heads = old.select("id", date.alias("date"), F.lit(None).cast("long").alias("emlx_ms"), F.expr(NONE).alias("received"))
    return backfill_sent_at(old, heads).select("id", "sent_at", F.col("sent_at_kind").alias("kind"))


@query(
    "url_audit", _URL_SQL,
    sql="""SELECT k, tag, url, pixel FROM (SELECT k, 'img' AS tag, url, p_size <= 2 AS pixel FROM urls WHERE r <> 2 UNION ALL SELECT k, 'img', 'https://s.example/' || k || '.png', FALSE FROM urls
      UNION ALL SELECT k, 'div', 'https://b.example/' || p_size, FALSE FROM urls UNION ALL SELECT k, 'a', 'https://a.example/', FALSE FROM urls)""",
)
def url_audit(spark, sf):
    return views.audit_urls(_pages(spark, sf), "html", "k").select("k", "tag", "url", "pixel")


@query("revision_with_ledger", V.EMAILS_SQL, sql=f"SELECT count(*) AS n, count(*) FILTER (WHERE {LIVE}) AS live, count(*) FILTER (WHERE doc_id % 3 = 0) AS ignored, max(archived_at) FILTER (WHERE doc_id % 3 = 0) AS last_ignored FROM emails")
def revision_with_ledger(spark, sf):
    e = V.emails(spark, sf)
    ledger = e.where("cast(id as int) % 3 = 0").select(F.col("id").alias("fingerprint"), F.col("archived_at").alias("created_at"))
    return agg.archive_revision(e, ledger).select("n", "live", "ignored", "last_ignored")
