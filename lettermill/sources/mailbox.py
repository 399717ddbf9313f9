"""Mailbox, archive and contact files as tables, and the way back (S)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lettermill.functions.text import is_email, normalize_email, text_column, trim_all
from lettermill.sources.ranged import list_files, read_eml_archives, read_mbox_ranges

_LATIN = "ISO-8859-1"


def mbox_folder(c: Column | str) -> Column:
    """A path without ``.mbox`` on any of its segments."""
    parts = F.transform(F.split(text_column(c), r"[/\\]"), lambda s: F.regexp_replace(s, r"(?i)\.mbox$", ""))
    return F.array_join(F.filter(parts, lambda s: s != ""), "/")


def bundle_folder(c: Column | str) -> Column:
    """The ``.mbox`` segments of a path alone, without the suffix."""
    parts = F.filter(F.split(text_column(c), r"[/\\]"), lambda s: s.rlike(r"(?i)\.mbox$"))
    return F.array_join(F.transform(parts, lambda s: F.regexp_replace(s, r"(?i)\.mbox$", "")), "/")


def eml_folder(c: Column | str) -> Column:
    parts = F.filter(F.split(text_column(c), r"[/\\]"), lambda s: s != "")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), "/")


def _relative(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, "^[a-z]+:/+", "/")
    start = "/" + root.split(":", 1)[-1].strip("/")
    return F.regexp_replace(plain, "^" + _quoted(start) + "/*", "")


def _quoted(text: str) -> str:
    return "".join("\\" + x if not x.isalnum() and x != "/" else x for x in text)


def list_inputs(spark: SparkSession, root: str) -> DataFrame:
    """``(path, kind, source_path, length)`` of the mail files below a folder, by path.

    ``*.mbox`` files, a bare ``mbox`` and ``*.emlx`` inside an ``.mbox`` package only, and loose
    ``*.eml``; sidecars ``._*`` are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    rel = _relative(F.col("path"), root)
    name, packed = F.element_at(F.split(rel, "/"), -1), rel.rlike(r"(?i)\.mbox/")
    kind = (
        F.when(name.startswith("._"), None).when(name.rlike(r"(?i)\.mbox$"), "mbox").when((F.lower(name) == "mbox") & packed, "mbox")
        .when(name.rlike(r"(?i)\.emlx$") & packed, "emlx").when(name.rlike(r"(?i)\.eml$"), "eml").when(name.rlike(r"(?i)\.zip$"), "zip")
    )
    folder = F.when((F.lower(name) == "mbox") | (kind == "emlx"), bundle_folder(rel)).when(kind == "mbox", mbox_folder(rel)).otherwise(eml_folder(rel))
    return files.select("path", kind.alias("kind"), folder.alias("source_path"), "length").where("kind is not null").orderBy("path")


def strip_envelope(c: Column | str) -> Column:
    """Bytes without a first line that starts ``From ``. Latin-1 there and back keeps every byte."""
    return F.encode(F.regexp_replace(F.decode(text_column(c), _LATIN), r"^From [^\n]*\n", ""), _LATIN)


def unescape_mbox(c: Column | str) -> Column:
    """Bytes whose quoted ``>From `` lines lose one ``>``."""
    return F.encode(F.regexp_replace(F.decode(text_column(c), _LATIN), r"(?m)^>(>*From )", "$1"), _LATIN)


def read_mbox(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file_path, ordinal, raw)``: one row per record, a record starting at a line ``From ``.

    One pass over byte ranges, dealt to tasks; ``ordinal`` is the byte at which a record starts. Text
    before the first such line is no record.
    """
    return read_mbox_ranges(list_files(spark, path, "*"))


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.eml").load(path)
    return rows.select(F.col("path").alias("file_path"), F.lit(0).cast("long").alias("ordinal"), F.col("content").alias("raw"))


def read_emlx(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, ordinal, raw, date_sent_ms, sender, subject)``; a file of bad length is dropped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.emlx").load(path)
    text = F.decode("content", _LATIN)
    head = F.regexp_extract(text, r"^\s*(\d{1,15})[^\n]*\n", 0)
    size = F.regexp_extract(head, r"(\d+)", 1).try_cast("long")
    trailer = F.expr("substring(__t, cast(length(__h) + __n + 1 as int))")
    cut = rows.select("path", text.alias("__t"), head.alias("__h"), size.alias("__n")).where("__n is not null and length(__h) + __n <= length(__t)")
    plist = lambda key, kind: F.regexp_extract("__p", rf"<key>{key}</key>\s*<{kind}>([^<]*)</{kind}>", 1)
    got = cut.withColumn("__p", trailer)
    sent = F.coalesce(plist("date-sent", "integer").try_cast("double"), plist("date-sent", "real").try_cast("double"))
    text_of = lambda key: F.when(plist(key, "string") != "", F.decode(F.encode(plist(key, "string"), _LATIN), "UTF-8"))
    body = F.encode(F.expr("substring(__t, cast(length(__h) + 1 as int), cast(__n as int))"), _LATIN)
    return got.select(F.col("path").alias("file_path"), F.lit(0).cast("long").alias("ordinal"), body.alias("raw"), (sent * 1000).cast("long").alias("date_sent_ms"), text_of("sender").alias("sender"), text_of("subject").alias("subject"))


def read_eml_zip(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, source_path, ordinal, raw)`` of the ``.eml`` entries of archives of any size, dealt by their ranges."""
    return read_eml_archives(list_files(spark, path, "*.zip"))


MESSAGE_SCHEMA = (
    "file_path string, ordinal long, message_id string, message_key string, storage_hash string, size_bytes long, subject string, date string, "
    "received array<string>, references string, in_reply_to string, conversation_id string, gmail_labels string, folder string, "
    "senders array<struct<name:string,address:string>>, recipients struct<to:array<struct<name:string,address:string>>,"
    "cc:array<struct<name:string,address:string>>,bcc:array<struct<name:string,address:string>>>, text string, html string, "
    "attachments array<struct<filename:string,mime_type:string,content_hash:string,size_bytes:bigint,content:binary>>"
)


def _parsed(file: str, ordinal: int, raw: bytes) -> dict | None:
    """One message as a row; None where it has neither headers nor body."""
    import email
    import email.policy
    import email.utils
    import hashlib

    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    if not m.keys() and not (m.get_payload() or "").strip():
        return None

    def head(name: str) -> str | None:
        value = m.get(name)
        if value is None:
            return None
        from email.header import decode_header, make_header

        try:
            return str(make_header(decode_header(str(value)))).strip()
        except (UnicodeError, LookupError, ValueError):
            return str(value).strip()

    def people(name: str) -> list[dict]:
        values = [str(v) for v in m.get_all(name, [])]
        return [{"name": n or None, "address": a} for n, a in email.utils.getaddresses(values) if a]

    texts, htmls, parts, light = [], [], [], raw
    for part in m.walk():
        if part.is_multipart():
            continue
        body = part.get_payload(decode=True) or b""
        kind, name = part.get_content_type(), part.get_filename()
        inline = kind in ("text/plain", "text/html") and not name and part.get_content_disposition() != "attachment"
        if inline:
            try:
                value = body.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                value = body.decode("utf-8", "replace")
            (texts if kind == "text/plain" else htmls).append(value)
            continue
        digest = hashlib.sha256(body).hexdigest()
        parts.append({"filename": name, "mime_type": kind, "content_hash": digest, "size_bytes": len(body), "content": body})
        stored = part.get_payload()
        if isinstance(stored, str) and stored:
            light = light.replace(stored.encode("utf-8", "surrogateescape"), f"sha256:{digest}".encode(), 1)
    mid = head("message-id")
    return {
        "file_path": file, "ordinal": ordinal, "message_id": mid or None, "message_key": mid or "generated-" + hashlib.sha256(raw).hexdigest(),
        "storage_hash": hashlib.sha256(light).hexdigest(), "size_bytes": len(light), "subject": head("subject") or "", "date": head("date"),
        "received": [v.rpartition(";")[2].strip() for v in map(str, m.get_all("received", []))], "references": head("references"),
        "in_reply_to": head("in-reply-to"), "conversation_id": head("conversation-id"), "gmail_labels": head("x-gmail-labels"), "folder": head("x-folder"),
        "senders": people("from"), "recipients": {k: people(k) for k in ("to", "cc", "bcc")}, "text": "\n".join(texts), "html": "\n".join(htmls), "attachments": parts,
    }


def _pieces(sizes: list[int], rows: int = 100, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """``(start, number)`` of runs of at most ``rows`` messages and ``most`` bytes; one larger message goes alone."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and (k - start == rows or held + size > most):
            yield start, k - start
            start, held = k, 0
        held += size
    if sizes:
        yield start, len(sizes) - start


def parse_messages(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages of ``(file_path, ordinal, raw)`` as typed rows, with further columns to ``keep`` beside them.

    ``storage_hash`` and ``size_bytes`` describe the message with attachment bodies replaced by
    their digests, so that copies which only wrap an attachment otherwise agree. A message
    that can't be read at all never fails its batch: its row has a place and nothing else,
    no ``message_key`` above all, by which imports count it as failed.
    """
    spark = raw.sparkSession
    schema = spark.createDataFrame([], MESSAGE_SCHEMA).schema
    made = StructType([*schema.fields, *(raw.schema[k] for k in keep)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at, n in _pieces(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()):
                part = batch.slice(at, n)
                rows = []
                for file, ordinal, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    try:
                        row = _parsed(file, ordinal, body.as_py() or b"")
                    except (ValueError, LookupError, TypeError, AttributeError, IndexError):
                        row = None
                    rows.append(row or {"file_path": file, "ordinal": ordinal})
                found = pa.RecordBatch.from_pylist(rows, schema=arrow)
                yield pa.RecordBatch.from_arrays([*found.columns, *part.columns[3:]], names=made.names)

    return raw.select("file_path", "ordinal", "raw", *keep).mapInArrow(kernel, made)


def read_contacts_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(email, display_name, ordinal)`` of a contact export; columns are found by their names."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    lower = [c.lower() for c in rows.columns]

    def find(needles: list[str], skip: tuple = ()) -> int | None:
        return next((k for k, h in enumerate(lower) if k not in skip and any(n in h for n in needles)), None)

    mail, first, last = find(["e-mail address", "email address", "email", "e-mail"]), find(["first name", "given name", "first"]), find(["last name", "family name", "surname", "last"])
    named = find(["display name", "full name", "name"], (first, last))
    cells = F.array(*[F.coalesce(trim_all(F.col(f"`{c}`")), F.lit("")) for c in rows.columns])
    good = F.filter(F.transform(cells, normalize_email), is_email)
    own = F.get(F.transform(cells, normalize_email), F.lit(mail if mail is not None else -1)) if mail is not None else F.lit(None).cast("string")
    address = F.coalesce(F.when(is_email(own), own), F.get(good, F.lit(0)))
    cell = lambda k: F.coalesce(F.get(cells, F.lit(k)), F.lit("")) if k is not None else F.lit("")
    parts = F.array_join(F.filter(F.array(cell(first), cell(last)), lambda p: p != ""), " ")
    name = F.when(cell(named) != "", cell(named)).when(parts != "", parts).otherwise(address)
    found = rows.select(address.alias("email"), name.alias("display_name"), F.monotonically_increasing_id().alias("ordinal"))
    return found.where("email is not null")


def read_contacts_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``(email, display_name, ordinal)``, one row per EMAIL line of each card; FN goes before N."""
    cards = spark.read.option("lineSep", "BEGIN:VCARD").text(path).select(F.regexp_replace("value", "\r", "").alias("v"), F.monotonically_increasing_id().alias("card"))
    line = lambda key: trim_all(F.regexp_extract("v", rf"(?im)^\s*{key}(?:;[^:\n]*)?:([^\n]*)$", 1))
    n = F.split(line("N"), ";")
    made = F.array_join(F.filter(F.array(*[trim_all(F.coalesce(F.get(n, F.lit(k)), F.lit(""))) for k in (1, 0)]), lambda p: p != ""), " ")
    mails = F.regexp_extract_all("v", F.lit(r"(?im)^\s*EMAIL(?:;[^:\n]*)?:([^\n]*)$"), 1)
    rows = cards.select("card", F.when(line("FN") != "", line("FN")).otherwise(made).alias("name"), F.posexplode(F.transform(mails, normalize_email)).alias("at", "email"))
    return rows.where(is_email("email")).select("email", F.when(F.col("name") != "", F.col("name")).otherwise(F.col("email")).alias("display_name"), (F.col("card") * 1024 + F.col("at")).alias("ordinal"))


def _published(spark: SparkSession, folder: str):
    """The folder's file system, and the numbers of its published versions."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path(folder))] if files.exists(path(folder)) else []
    numbers = [int(n[len("version=") :]) for n in names if n.startswith("version=")]
    return files, path, sorted(n for n in numbers if files.exists(path(f"{folder}/version={n}/_PUBLISHED"))), max(numbers, default=0)


def read_archive(spark: SparkSession, folder: str):
    """The tables of the newest version that ``write_archive`` published; all empty where there is none."""
    from lettermill.schemas import SCHEMAS, Archive

    versions = _published(spark, folder)[2]
    if not versions:
        return Archive.empty(spark)
    return Archive(**{name: spark.read.schema(schema).parquet(f"{folder}/version={versions[-1]}/{name}") for name, schema in SCHEMAS.items()})


def emails_view(emails: DataFrame, sources: DataFrame) -> DataFrame:
    from lettermill.operators.joins import with_source_name

    return with_source_name(emails, sources)


def write_archive(tables, folder: str) -> int:
    """Writes all tables of the bundle as a new version, and publishes it last; returns its number.

    Readers see the old version or the new one, never a mixture, and tables read from the
    folder itself may be written back. Emails lie by source, which is what listings prune by.
    """
    from dataclasses import fields

    spark = tables.emails.sparkSession
    files, path, _, last = _published(spark, folder)
    version = last + 1
    for f in fields(tables):
        writer = getattr(tables, f.name).write
        (writer.partitionBy("ingestion_source_id") if f.name == "emails" else writer).parquet(f"{folder}/version={version}/{f.name}")
    files.create(path(f"{folder}/version={version}/_PUBLISHED"), False).close()
    return version


MAX_TEXT_BYTES = 50 * 1024 * 1024


def extract_attachment_text(attachments: DataFrame) -> DataFrame:
    """``attachments (…, mime_type, filename, content)`` with ``extracted_text``.

    Text types, JSON and XML are decoded natively; word and sheet files are unzipped in Arrow
    batches. Other types, broken files and ones over 50 MiB give an empty text.
    """
    kind, name = F.lower(F.coalesce("mime_type", F.lit(""))), F.lower(F.coalesce("filename", F.lit("")))
    plain = kind.startswith("text/") | kind.rlike(r"^application/([^;]*\+)?(json|xml)")
    office = F.when(name.endswith(".docx") | kind.contains("wordprocessingml"), "docx").when(name.endswith(".xlsx") | kind.contains("spreadsheetml"), "xlsx")
    small = F.coalesce(F.octet_length("content"), F.lit(0)) <= MAX_TEXT_BYTES
    marked = attachments.withColumn("__kind", F.when(small & plain, "text").when(small, office))
    native = F.when(F.col("__kind") == "text", F.decode(F.encode(F.decode("content", "UTF-8"), "UTF-8"), "UTF-8")).otherwise("")
    rest = marked.where("__kind is null or __kind = 'text'").withColumn("extracted_text", native)
    schema = marked.drop("extracted_text").schema.add("extracted_text", "string")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("__kind").to_pylist(), batch.column("content"))
            texts = [_office_text(k, c.as_py()) for k, c in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "extracted_text"])

    zipped = marked.drop("extracted_text").where("__kind in ('docx', 'xlsx')").mapInArrow(kernel, schema)
    return rest.unionByName(zipped).drop("__kind")


def _office_text(kind: str, content: bytes) -> str:
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        if kind == "docx":
            root = ElementTree.fromstring(archive.read("word/document.xml"))
            w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            return "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
        s = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in x.iter(f"{s}t")) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{s}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for sheet in sheets:
            lines = []
            for row in ElementTree.fromstring(archive.read(sheet)).iter(f"{s}row"):
                cells = []
                for c in row.iter(f"{s}c"):
                    v = c.find(f"{s}v")
                    value = "".join(t.text or "" for t in c.iter(f"{s}t")) if v is None else v.text or ""
                    cells.append(shared[int(value)] if c.get("t") == "s" and v is not None else value)
                lines.append("\t".join(cells))
            out.append("\n".join(lines))
        return "\n\n".join(out)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, RuntimeError):
        return ""


def export_mbox(df: DataFrame, folder: str) -> None:
    """Writes raw messages as mbox files, one a partition, with ``From `` lines quoted again.

    The text writer puts out a string's bytes as they are, so ``read_mbox`` gives back what was written.
    """
    quoted = F.encode(F.regexp_replace(F.decode("raw", _LATIN), r"(?m)^(>*From )", ">$1"), _LATIN)
    record = F.concat(F.lit(b"From MAILER-DAEMON Thu Jan  1 00:00:00 1970\n"), quoted).cast("string")
    df.select(record.alias("value")).write.option("lineSep", "\n").mode("overwrite").text(folder)
