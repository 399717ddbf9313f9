"""String, path, name and hash expressions (P1-P23). Each takes and returns Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# ``(?U)`` gives ``\s`` its Unicode meaning, as texts are free-form.
_EDGES = r"(?U)^\s+|\s+$"


def text_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once a row, however often ``f`` uses it.

    Spark inlines an expression wherever it is named, inside a lambda once an element.
    """
    return F.transform(F.array(value), f)[0]


def trim_all(c: Column | str) -> Column:
    """Trim Unicode white space on both ends (Spark's trim takes blanks alone)."""
    return F.regexp_replace(text_column(c), _EDGES, "")


def missing_if_blank(c: Column | str) -> Column:
    c = trim_all(c)
    return F.when(c != "", c)


def normalize_source_path(c: Column | str) -> Column:
    parts = F.transform(F.split(text_column(c), r"[/\\]"), trim_all)
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def normalize_duplicate_text(c: Column | str) -> Column:
    """Tags to blanks, lower case, runs of anything but a-z and 0-9 to one blank, trimmed."""
    plain = F.lower(F.regexp_replace(text_column(c), "<[^>]*>", " "))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def duplicate_hash(c: Column | str) -> Column:
    """Null for an empty or null value, else its sha256; ``c`` is computed once."""
    hashed = F.transform(F.array(text_column(c)), lambda x: F.when(x != "", F.sha2(x, 256)))
    return F.get(hashed, F.lit(0))


def recipient_fingerprint(recipients: Column | str) -> Column:
    """Sorted addresses of to, cc and bcc, repeats kept, hashed."""
    r = text_column(recipients)
    empty = F.expr("cast(array() as array<struct<name:string,address:string>>)")
    people = F.concat(*[F.coalesce(r[k], empty) for k in ("to", "cc", "bcc")])
    addresses = F.transform(people, lambda p: F.lower(trim_all(F.coalesce(p["address"], F.lit("")))))
    return duplicate_hash(F.array_join(F.array_sort(F.filter(addresses, lambda a: a != "")), "|"))


def length_prefixed(c: Column) -> Column:
    """``byte length:value``, so that neighbouring fields can't run into each other."""
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)


def sanitize_text(c: Column | str) -> Column:
    """Without U+FFFD and control characters but tab, line feed and carriage return; trimmed."""
    return trim_all(F.regexp_replace(text_column(c), "[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))


def sanitize_filename(c: Column | str) -> Column:
    base = F.element_at(F.split(trim_all(c), "/"), -1)
    clean = trim_all(F.regexp_replace(base, r"[\\/ ]+", "_"))
    return F.when(clean.isin("", ".", ".."), "file").otherwise(clean)


def sanitize_path_component(c: Column | str) -> Column:
    clean = trim_all(F.regexp_replace(text_column(c), r"[/\\\p{Cc}]", "_"))
    return F.when(clean.isin("", ".", ".."), "_").otherwise(clean)


def base_name(c: Column | str) -> Column:
    base = trim_all(F.element_at(F.split(text_column(c), r"[/\\]"), -1))
    return F.when(base.isin("", ".", ".."), "attachment").otherwise(base)


def _split_name(base: str) -> tuple[str, str]:
    """A name's stem, and its extension with the dot before it."""
    stem, dot, ext = base.rpartition(".")
    return (stem, dot + ext) if dot else (base, "")


def _free_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of rows ``(group, order, name, family)`` that arrive by group, family and order.

    Numbers of a name only grow, since a number that is taken stays so. One is taken by an earlier row of
    the same name, or by a row whose own name it makes; that row has had it, or lost it to another, once it has come.
    """
    at, numbers = None, {}
    for batch in batches:
        names = batch.column(2).to_pylist()
        made = []
        for group, name, family in zip(batch.column(0).to_pylist(), names, batch.column(3).to_pylist()):
            if (group, family) != at:
                at, numbers = (group, family), {}
            if name is None:
                made.append(None)
                continue
            stem, ext = _split_name(name)
            if name not in numbers:
                whole, dash, digits = stem.rpartition("-")
                canonical = dash and len(digits) < 19 and digits.isascii() and digits.isdigit() and digits[0] != "0" and digits != "1"
                # the next number that the shorter name tries tells whether this one went to it
                n = 2 if canonical and int(digits) < numbers.get(whole + ext, 1) else 1
            else:
                n = numbers[name]
            while n > 1 and f"{stem}-{n}{ext}" in numbers:
                n += 1
            numbers[name] = n + 1
            made.append(name if n == 1 else f"{stem}-{n}{ext}")
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=[*batch.schema.names[:3], "__made"])


def unique_names(df: DataFrame, group: str, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Names made unique inside a group, in order: ``a.pdf``, ``a-2.pdf``, ...

    A made-up name never meets a real one that came before it. Rows are dealt by family, the names of a group
    that are one but for numbers at the end of stem or extension; only those can meet. A task keeps a number
    for each different name of one family, and no rows.
    """
    family = F.regexp_replace(F.col(name), r"(?:-[0-9]+)+(?=(?:\.[^.]*)?\z)", "")
    rows = df.select(F.col(group).alias("__g"), F.col(order).alias("__o"), F.col(name).alias("__n"), family.alias("__f"))
    dealt = rows.repartition("__g", "__f").sortWithinPartitions("__g", "__f", "__o", "__n")
    kinds = T.StructType([rows.schema[k] for k in ("__g", "__o", "__n")]).add("__made", "string")
    return dealt.mapInArrow(_free_names, kinds).toDF(group, order, name, out)


#: Extensions of the content types that turn up nameless in mail.
MIME_EXTENSIONS = {
    "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/heic": "heic",
    "image/heif": "heic", "image/tiff": "tiff", "image/bmp": "bmp", "image/svg+xml": "svg", "application/pdf": "pdf",
    "text/plain": "txt", "text/html": "html", "text/calendar": "ics", "text/csv": "csv", "application/zip": "zip",
    "application/json": "json", "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "message/rfc822": "eml",
}

#: The attachment categories and their extensions.
CATEGORIES = {
    "Pictures": ["jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif", "svg"],
    "Documents": ["pdf", "doc", "docx", "rtf", "txt", "md", "odt", "pages", "wpd"],
    "Spreadsheets": ["xls", "xlsx", "csv", "ods", "numbers"],
    "Presentations": ["ppt", "pptx", "odp", "key"],
    "Archives": ["zip", "rar", "7z", "tar", "gz", "tgz"],
    "3D Printing": ["stl", "3mf", "obj", "gcode", "step", "stp", "scad", "f3d"],
    "Audio": ["mp3", "wav", "m4a", "aac", "ogg", "flac"],
    "Video": ["mp4", "mov", "avi", "mkv", "wmv", "webm"],
    "Email & Contacts": ["eml", "ics", "vcf"],
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def honest_attachment_name(mime: Column | str) -> Column:
    kind = F.lower(F.trim(F.split(text_column(mime), ";")[0]))
    ext = literal_map(MIME_EXTENSIONS)[kind]
    return F.coalesce(F.concat(F.lit("attachment."), ext), F.lit("attachment"))


def attachment_category(df: DataFrame, filename: str = "filename", out: str = "category") -> DataFrame:
    """Adds the category of a file name's extension; null for others."""
    ext = F.lower(F.regexp_extract(F.col(filename), r"\.([^./\\]+)$", 1))
    return df.withColumn(out, literal_map({e: k for k, es in CATEGORIES.items() for e in es})[ext])


def normalize_email(c: Column | str) -> Column:
    return trim_all(F.regexp_replace(F.lower(trim_all(c)), "^mailto:", ""))


def is_email(c: Column | str) -> Column:
    return text_column(c).rlike(r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+$")


def parse_display_address(c: Column | str) -> Column:
    """``struct(name, address)`` of ``Name <addr>`` or a bare address; null for anything else."""
    raw = trim_all(c)
    inner = trim_all(F.regexp_extract(raw, r"(?s)^.*<([^<>]*)>[^>]*$", 1))
    name = trim_all(F.regexp_replace(trim_all(F.regexp_extract(raw, r"(?s)^(.*)<[^<>]*>[^>]*$", 1)), '^"+|"+$', ""))
    shaped = F.struct(F.when(name != "", name).otherwise(inner).alias("name"), inner.alias("address"))
    return F.when(inner != "", shaped).when(raw.contains("@"), F.struct(raw.alias("name"), raw.alias("address")))


def thread_id(references: Column, in_reply_to: Column, conversation_id: Column, message_id: Column) -> Column:
    first = F.split(trim_all(references), r"(?U)\s+")[0]
    return F.coalesce(F.when(first != "", first), *[missing_if_blank(c) for c in (in_reply_to, conversation_id, message_id)])


def message_key(message_id: Column, raw: Column, source_id: Column | None = None) -> Column:
    """The header's id, or one generated from the bytes, which the archive ties to its source."""
    made = F.concat(F.lit("generated-"), F.sha2(raw, 256))
    if source_id is not None:
        made = F.concat(made, F.lit("-"), source_id)
    return F.coalesce(message_id, made)


def folder_and_labels(labels: Column, folder: Column, path: Column) -> Column:
    """``struct(path, labels)``: all labels are tags, the first one is the folder."""
    listed = F.filter(F.transform(F.split(labels, ","), trim_all), lambda x: x != "")
    empty = F.expr("cast(array() as array<string>)")
    place = F.when(labels.isNotNull(), F.coalesce(F.get(listed, F.lit(0)), path)).otherwise(F.coalesce(folder, path))
    return F.struct(place.alias("path"), F.coalesce(listed, empty).alias("labels"))


def derive_source_name(name: Column, paths: Column, file_name: Column, provider: Column) -> Column:
    """The name given, an ``.mbox`` segment, a dotless top folder, a file's stem, or ``<provider> import``."""
    boxes = F.filter(F.transform(paths, lambda p: F.regexp_extract(p, r"(?i)([^/]+)\.mbox(?:/|$)", 1)), lambda x: x != "")
    tops = F.filter(F.transform(paths, lambda p: F.split(p, "/")[0]), lambda x: (x != "") & ~x.contains("."))
    first = F.element_at(F.split(F.get(paths, F.lit(0)), "/"), -1)
    stem = F.regexp_replace(F.coalesce(file_name, F.when(first != "", first)), r"(?i)\.(mbox|eml|emlx)$", "")
    kind = F.regexp_replace(F.coalesce(provider, F.lit("import")), "(_import)+$", "")
    return F.coalesce(missing_if_blank(name), F.get(boxes, F.lit(0)), F.get(tops, F.lit(0)), stem, F.concat(kind, F.lit(" import")))


def import_display_name(path: Column | str) -> Column:
    """A mailbox's package or file name without ``.mbox`` and ``.eml``, or an archive's without ``.zip``."""
    p = text_column(path)
    file = F.element_at(F.split(p, "/"), -1)
    parent = F.regexp_extract(p, r"([^/]+)/[^/]*$", 1)
    base = F.when((F.lower(file) == "mbox") & (parent != ""), parent).otherwise(file)
    boxed = F.regexp_replace(F.regexp_replace(base, r"(?i)\.mbox$", ""), r"\.eml$", "")
    return F.when(file.rlike(r"\.zip$"), F.regexp_replace(file, r"\.zip$", "")).otherwise(boxed)


def resolve_contact(df: DataFrame, contacts: DataFrame, email: str, fallback: str, out: str = "contact") -> DataFrame:
    """Adds the contact's name for an address, else the header's; null where it repeats the address."""
    known = contacts.select(F.col("email").alias("__email"), F.col("display_name").alias("__name"))
    shown = F.coalesce("__name", missing_if_blank(fallback))
    joined = df.join(known, F.lower(trim_all(email)) == F.col("__email"), "left")
    return joined.withColumn(out, F.when(F.lower(shown) != F.lower(trim_all(email)), shown)).drop("__email", "__name")


def subject_label(c: Column | str) -> Column:
    return F.coalesce(missing_if_blank(c), F.lit("(no subject)"))


def sender_label(name: Column, address: Column) -> Column:
    return F.coalesce(missing_if_blank(name), missing_if_blank(address), F.lit("Unknown sender"))


def format_bytes(c: Column | str, decimals: int = 2) -> Column:
    b = text_column(c).cast("double")
    step = F.least(F.floor(F.ln(b) / F.ln(F.lit(1024.0))), F.lit(8)).cast("int")
    units = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")])
    shown = F.format_number(b / F.pow(F.lit(1024.0), step), decimals)
    plain = F.regexp_replace(F.regexp_replace(shown, ",", ""), r"\.?0+$" if decimals else "^$", "")
    return F.when(b == 0, "0 Bytes").when(b > 0, F.concat(plain, F.lit(" "), F.get(units, step)))


def human_size(c: Column | str) -> Column:
    b = text_column(c)
    mb = b / F.lit(1024.0 * 1024.0)
    return F.when(mb >= 0.1, F.concat(F.regexp_replace(F.format_number(mb, 1), ",", ""), F.lit(" MB"))).otherwise(F.concat(b.cast("string"), F.lit(" bytes")))


def utc_day(ms: Column | str) -> Column:
    return F.to_date(F.timestamp_millis(text_column(ms)))


def clamp_positive(value, fallback: int, most: int) -> int:
    """A paging parameter: floor of a number of at least 1, else the fallback, capped."""
    try:
        n = float(value)
    except (TypeError, ValueError):
        return fallback
    return min(int(n), most) if 1 <= n < float("inf") else fallback


def clamp_positive_column(c: Column, fallback: int, most: int) -> Column:
    n = c.try_cast("double")
    return F.when((n >= 1) & (n < float("inf")), F.least(F.floor(n), F.lit(most))).otherwise(F.lit(fallback).cast("long"))


def progress_percent(done: Column | str, total: Column | str) -> Column:
    done, total = text_column(done), text_column(total)
    return F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), done * 100.0 / total)))


def total_pages(total: Column | str, limit: Column | int) -> Column:
    return F.ceil(text_column(total) / limit).cast("long")


def payload_field(c: Column | str, path: str = "$.ingestionSourceId") -> Column:
    return F.try_variant_get(F.try_parse_json(text_column(c)), path, "string")


def append_error(errors: Column | str, message: Column) -> Column:
    empty = F.expr("cast(array() as array<string>)")
    return F.array_append(F.coalesce(text_column(errors), empty), message)


PERSON = T.StructType([T.StructField("name", T.StringType()), T.StructField("address", T.StringType())])
RECIPIENTS = T.StructType([T.StructField(k, T.ArrayType(PERSON)) for k in ("to", "cc", "bcc")])


def flatten_recipients(recipients: Column | str) -> Column:
    """``[struct(name, email, kind)]`` in the order to, cc, bcc."""
    r = text_column(recipients)
    empty = F.expr("cast(array() as array<struct<name:string,email:string,kind:string>>)")

    def listed(kind: str) -> Column:
        return F.transform(r[kind], lambda p: F.struct(p["name"].alias("name"), p["address"].alias("email"), F.lit(kind).alias("kind")))

    return F.concat(*[F.coalesce(listed(k), empty) for k in ("to", "cc", "bcc")])


def addresses(recipients: Column | str, kind: str) -> Column:
    found = F.filter(F.transform(text_column(recipients)[kind], lambda p: p["address"]), lambda a: a.isNotNull() & (a != ""))
    return F.coalesce(found, F.expr("cast(array() as array<string>)"))


def body_snippet(tokens: Column | str, terms: list[str], n: int = 24) -> Column:
    """The window of ``n`` tokens that holds the most different terms, the first such one."""
    wanted = F.array(*[F.lit(x) for x in terms]) if terms else F.expr("cast(array() as array<string>)")

    def shown(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(t) - n))
        scored = F.transform(starts, lambda s: F.struct(F.size(F.array_intersect(wanted, F.slice(t, s + 1, n))).alias("hits"), (-s).alias("at")))

        def window(start: Column) -> Column:
            text = F.array_join(F.slice(t, start + 1, n), " ")
            return F.concat(F.when(start > 0, "…").otherwise(""), text, F.when(start + n < F.size(t), "…").otherwise(""))

        return bound(-F.array_max(scored)["at"], window)

    return bound(text_column(tokens), shown)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
