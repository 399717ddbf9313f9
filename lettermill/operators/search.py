"""Ranked full-text search over six fields (T): postings, boolean match, phrases, prefixes, bm25."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lettermill.functions.text import sanitize_text, text_column, trim_all
from lettermill.operators import postings as kernels
from lettermill.operators.filters import combine_ids, paginate, sort_emails
from lettermill.session import materialize

FIELDS = ["subject", "body", "sender", "recipients", "attachments", "meta"]
#: bm25 weight of each field.
WEIGHTS = {"subject": 10.0, "body": 2.0, "sender": 6.0, "recipients": 3.0, "attachments": 1.0, "meta": 2.0}
#: The public field names and the index field each one searches.
PUBLIC_FIELDS = {
    "subject": "subject", "body": "body", "from": "sender", "senderName": "sender", "to": "recipients", "cc": "recipients",
    "bcc": "recipients", "attachments.filename": "attachments", "attachments.content": "attachments", "importSource": "meta",
    "sourcePath": "meta", "tags": "meta",
}
MAX_TERMS = 12


def _folds() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters, and the letters they fold to, by decomposition."""
    import unicodedata

    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x400, 0x530), *range(0x1E00, 0x2000)]:
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(code).lower()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(code).lower():
            pairs.append((chr(code).lower() if len(chr(code).lower()) == 1 else chr(code), plain))
    pairs = list(dict(pairs).items())
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def fold(c: Column | str) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(text_column(c)), r"\p{Mn}", ""), _FROM, _TO)


def tokenize(c: Column | str) -> Column:
    """Runs of letters, numbers and private-use characters, folded."""
    return F.filter(F.split(fold(F.coalesce(text_column(c), F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def token_text(c: Column | str) -> Column:
    """The tokens of ``tokenize`` with a blank between them."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text_column(c), F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+", " "))


def build_postings(docs: DataFrame) -> DataFrame:
    """``(term, email_id, field, tf, positions)``; positions are from 0 in the field.

    Documents are dealt by id, so that those of equal id are one, and their tokens counted where they are.
    """
    dealt = docs.select("email_id", *FIELDS).repartition("email_id").sortWithinPartitions("email_id")
    words = dealt.select("email_id", *[token_text(f).alias(f) for f in FIELDS])
    return words.mapInArrow(lambda batches: kernels.postings(batches, FIELDS), "term string, email_id string, field string, tf long, positions array<int>")


def save_index(postings: DataFrame, path: str) -> DataFrame:
    """The postings as a table in order of term, so that a query reads the row groups of its terms alone."""
    made = materialize(postings, "postings-made")  # ranges are found by a pass of their own
    made.repartitionByRange("term", "email_id").sortWithinPartitions("term", "email_id", "field").write.parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)


def token_number(c: Column | str) -> Column:
    """How many tokens a ``token_text`` holds."""
    c = text_column(c)
    return F.length(c) - F.length(F.translate(c, " ", "")) + (c != "").cast("int")


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("email_id", reduce(lambda a, b: a + b, [token_number(token_text(f)) for f in FIELDS]).alias("length"))


def parse_query(query: str) -> list[tuple[list[str], bool]]:
    """Phrases of a query as ``(tokens, last one a prefix)``; phrases without tokens drop out."""
    import re
    import unicodedata

    def folded(term: str) -> list[str]:
        # single letters fold as the index does; others by decomposition
        plain = "".join(x for x in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(x))
        return [t for t in re.split(r"[\W_]+", plain) if t]

    terms = [t for t in (x.replace('"', "") for x in (query or "").split()) if t.strip()][:MAX_TERMS]
    phrases = [(folded(t), k == len(terms) - 1) for k, t in enumerate(terms)]
    return [p for p in phrases if p[0]]


def resolve_fields(fields: str | list[str] | None) -> list[str]:
    """Index fields of public names; unknown ones are ignored, and none means all."""
    names = [x.strip() for x in fields.split(",")] if isinstance(fields, str) else list(fields or [])
    found = list(dict.fromkeys(PUBLIC_FIELDS[n] for n in names if n in PUBLIC_FIELDS))
    return found or list(FIELDS)


def prefix_terms(postings: DataFrame, prefix: str) -> DataFrame:
    return postings.where(F.col("term").startswith(prefix))


def phrase_hits(postings: DataFrame, tokens: list[str], prefix: bool, fields: list[str]) -> DataFrame:
    """``(email_id, field, tf)`` of a phrase: its tokens side by side in one field."""
    scoped = postings.where(F.col("field").isin(*fields)) if len(fields) < len(FIELDS) else postings

    def of(k: int) -> DataFrame:
        last = prefix and k == len(tokens) - 1
        rows = prefix_terms(scoped, tokens[k]) if last else scoped.where(F.col("term") == tokens[k])
        starts = F.transform("positions", lambda p: p - k)
        rows = rows.select("email_id", "field", starts.alias(f"p{k}"))
        if last:  # several terms may share the prefix
            rows = rows.groupBy("email_id", "field").agg(F.flatten(F.collect_list(f"p{k}")).alias(f"p{k}"))
        return rows

    joined = reduce(lambda a, b: a.join(b, ["email_id", "field"]), [of(k) for k in range(len(tokens))])
    starts = reduce(F.array_intersect, [F.col(f"p{k}") for k in range(len(tokens))])
    tf = F.size(starts) if len(tokens) > 1 else F.size("p0")
    return joined.select("email_id", "field", tf.alias("tf")).where("tf > 0")


def match(postings: DataFrame, query: str, fields: str | list[str] | None = None, or_mode: bool = False) -> DataFrame | None:
    """``(email_id)`` of the emails where every phrase (or any) occurs in some field; None for an empty query."""
    if not (query or "").replace('"', "").strip():
        return None
    phrases, scope = parse_query(query), resolve_fields(fields)
    if not phrases:
        return postings.select("email_id").limit(0)
    if all(len(tokens) == 1 for tokens, _ in phrases):  # one pass for all terms
        rows = postings.where(F.col("field").isin(*scope)) if len(scope) < len(FIELDS) else postings
        is_term = [F.col("term").startswith(t[0]) if prefix else F.col("term") == t[0] for t, prefix in phrases]
        seen = rows.where(reduce(lambda a, b: a | b, is_term)).groupBy("email_id").agg(*[F.bool_or(c).alias(f"t{k}") for k, c in enumerate(is_term)])
        return seen.where(F.lit(or_mode) | F.array_min(F.array(*[F.col(f"t{k}") for k in range(len(is_term))]))).select("email_id")
    hits = [phrase_hits(postings, t, p, scope).select("email_id").distinct() for t, p in phrases]
    return reduce(lambda a, b: combine_ids(a, b, "any" if or_mode else "all"), hits)


def match_clauses(postings: DataFrame, clauses: dict[str, str], how: str = "all", query: str | None = None, fields=None) -> DataFrame | None:
    """The query and scoped clauses (``sender``, ``recipients``, ``subject``, ``body`` and their texts) together."""
    sets = [match(postings, query or "", fields)]
    for field, text in clauses.items():
        public = next(k for k, v in PUBLIC_FIELDS.items() if v == field)
        sets.append(match(postings, text, [public]))
    sets = [s for s in sets if s is not None]
    return reduce(lambda a, b: combine_ids(a, b, how), sets) if sets else None


def match_with_fallback(postings: DataFrame, query: str, fields=None, strategy: str = "last") -> DataFrame | None:
    """All phrases, or any of them where nothing has all and the strategy allows it."""
    hits = match(postings, query, fields)
    if hits is None or strategy == "all" or len(parse_query(query)) < 2 or not hits.isEmpty():
        return hits
    return match(postings, query, fields, or_mode=True)


def bm25(hits: DataFrame, postings: DataFrame, lengths: DataFrame, query: str, fields=None, weights: dict[str, float] | None = None) -> DataFrame:
    """``(email_id, score)``, lower is better: k1 1.2, b 0.75, counts weighted by field, idf floored at 1e-6."""
    weights, scope = weights or WEIGHTS, resolve_fields(fields)
    weight = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("field")]
    rows = []
    for k, (tokens, prefix) in enumerate(parse_query(query)):
        found = phrase_hits(postings, tokens, prefix, scope)
        rows.append(found.groupBy("email_id").agg(F.sum(F.col("tf") * weight).alias("f")).withColumn("k", F.lit(k)))
    if not rows:
        return hits.select("email_id", F.lit(0.0).alias("score"))
    freq = reduce(DataFrame.unionByName, rows)
    stats = freq.groupBy("k").agg(F.count("*").alias("n")).join(lengths.agg(F.count("*").alias("total"), F.avg("length").alias("avg")), F.lit(True))
    idf = F.greatest(F.ln((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    norm = F.col("f") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("avg"))
    part = idf * F.col("f") * 2.2 / norm
    scored = freq.join(hits, "email_id", "left_semi").join(stats, "k").join(lengths, "email_id")
    return scored.groupBy("email_id").agg((-F.sum(part)).alias("score"))


def order_hits(df: DataFrame, sort: str | None = None, direction: str = "desc") -> DataFrame:
    """The sort column first; the score breaks its ties."""
    return sort_emails(df, sort, direction, "score")


def count_hits(df: DataFrame) -> int:
    return df.count()


def to_documents(df: DataFrame, page=1, limit=10) -> DataFrame:
    """The result documents of one page of a sorted listing."""
    from lettermill.functions.dates import iso_ms
    from lettermill.functions.text import addresses

    shown = paginate(df, page, limit)
    return shown.select(
        "id", "thread_id", "ingestion_source_id", "import_source", "source_path", "subject", F.col("sender_email").alias("from"), "sender_name",
        *[addresses("recipients", k).alias(k) for k in ("to", "cc", "bcc")], iso_ms("sent_at").alias("sent_at"), "sent_at_kind",
        iso_ms("archived_at").alias("archived_at"), "size_bytes", "has_attachments", "remote_content_status", "tags",
        F.col("deleted_at").isNotNull().alias("trashed"), "message_id_header",
    )


def build_search_docs(emails: DataFrame, links: DataFrame, attachments: DataFrame, bodies: DataFrame) -> DataFrame:
    """Index documents from emails, their attachments' names and texts, and ``bodies (id, text, html)``."""
    clean = lambda c: sanitize_text(F.coalesce(c, F.lit("")))
    held = links.join(attachments.withColumnRenamed("id", "attachment_id"), "attachment_id")
    piece = F.concat(clean(F.col("filename")), F.lit("\n"), clean(F.col("extracted_text")))
    files = held.groupBy(F.col("email_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(piece)), "\n").alias("attachments"))
    none = F.expr("cast(array() as array<struct<name:string,address:string>>)")
    people = F.flatten(F.array(*[F.coalesce(F.col("recipients")[k], none) for k in ("to", "cc", "bcc")]))
    rows = emails.join(bodies, "id", "left").join(files, "id", "left")
    return rows.select(
        F.col("id").alias("email_id"), clean(F.col("subject")).alias("subject"),
        clean(F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("html"))).alias("body"),
        trim_all(F.concat_ws(" ", clean(F.col("sender_email")), clean(F.col("sender_name")))).alias("sender"),
        F.array_join(F.transform(people, lambda p: clean(p["address"])), " ").alias("recipients"), F.coalesce("attachments", F.lit("")).alias("attachments"),
        F.concat_ws(" ", clean(F.col("import_source")), clean(F.col("source_path")), F.array_join(F.transform("tags", clean), " ")).alias("meta"),
    )


def reindex(postings: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings with those of the ids rebuilt from ``docs``; ids without a document leave the index."""
    wanted = ids.select(F.col("id").alias("email_id")).distinct()
    return postings.join(wanted, "email_id", "left_anti").unionByName(build_postings(docs.join(wanted, "email_id", "left_semi")).select(*postings.columns))


def reindex_meta(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with the ``meta`` field of changed emails ``(email_id, meta)`` rebuilt."""
    old = (F.col("field") == "meta") & F.col("__new").isNotNull()
    marked = postings.join(changed.select("email_id", F.lit(True).alias("__new")), "email_id", "left")
    kept = marked.where(~F.coalesce(old, F.lit(False))).select(*postings.columns)
    rows = changed.select("email_id", F.lit("meta").alias("field"), F.posexplode(tokenize("meta")).alias("pos", "term"))
    new = rows.groupBy("term", "email_id", "field").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return kept.unionByName(new.select(*postings.columns))


def sweep_orphans(docs: DataFrame, emails: DataFrame) -> DataFrame:
    return docs.join(emails.select(F.col("id").alias("email_id")), "email_id", "left_semi")

