"""Dates as mail gives them (P30-P36); times are epoch milliseconds, the session is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lettermill.functions.text import bound, text_column, trim_all

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Offsets in minutes of the zone names that mail standards list.
_ZONES = {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def date_has_timezone(c: Column | str) -> Column:
    """Whether the last word is a numeric offset or an alphabetic zone."""
    last = F.element_at(F.split(trim_all(c), r"(?U)\s+"), -1)
    return F.coalesce(last.rlike(r"^[+-]\d{4}$|^[A-Za-z]+$"), F.lit(False))


def _instant(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.unix_millis(F.try_make_timestamp(year, month, day, hour, minute, second, F.lit("UTC")))


def parse_mail_date(c: Column | str) -> Column:
    """Epoch ms of a zoned RFC 5322 date; null if it is malformed, out of range or has no zone."""
    return bound(F.regexp_replace(trim_all(c), r"\s*\([^()]*\)\s*$", ""), _parsed_date)


def _parsed_date(c: Column) -> Column:
    shape = r"(?i)^(?:[a-z]{3,9}\s*,\s*)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s+([+-]\d{4}|[a-z]+)$"
    part = lambda k: F.regexp_extract(c, shape, k)
    number = lambda k: part(k).try_cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(part(2))).cast("int")
    zone = part(7)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 4, 2).try_cast("int")
    numeric = F.when((hours < 24) & (minutes < 60), sign * (hours * 60 + minutes))
    named = F.coalesce(F.create_map(*[F.lit(x) for p in _ZONES.items() for x in p])[F.upper(zone)], F.lit(0))
    offset = F.when(zone.rlike(r"^[+-]"), numeric).otherwise(named)
    second = F.coalesce(number(6), F.lit(0)).cast("decimal(8,6)")
    at = _instant(number(3), F.when(month > 0, month), number(1), number(4), number(5), second)
    return F.when(c.rlike(shape), at - offset * 60000)


def derive_sent_at(date: Column, emlx_ms: Column, received: Column) -> Column:
    """``struct(ms, kind)``: a zoned date, the mail client's own, a zone-less date read as UTC,
    the earliest Received time, or nothing. ``received`` is an array of date texts."""
    zoned = parse_mail_date(date)
    bare = F.when(~date_has_timezone(date) & (trim_all(date) != ""), parse_mail_date(F.concat(trim_all(date), F.lit(" +0000"))))
    first = F.array_min(F.filter(F.transform(received, parse_mail_date), lambda x: x.isNotNull()))
    made = lambda ms, kind: bound(ms, lambda x: F.when(x.isNotNull(), F.struct(x.alias("ms"), F.lit(kind).alias("kind"))))
    nothing = F.struct(F.lit(0).cast("long").alias("ms"), F.lit("unknown").alias("kind"))
    return F.coalesce(made(zoned, "sent"), made(emlx_ms, "sent"), made(bare, "sent_zone_unknown"), made(first, "received"), nothing)


def parse_filter_timestamp(c: Column | str) -> Column:
    """Epoch ms of an ISO date and time or a number of ms; offsets and fractions are dropped, and an
    impossible date is null, which filters nothing."""
    c = trim_all(c)
    shape = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?.*)?$"
    number = lambda k: F.coalesce(F.regexp_extract(c, shape, k).try_cast("int"), F.lit(0))
    at = _instant(number(1), number(2), number(3), number(4), number(5), number(6).cast("decimal(8,6)"))
    iso = F.when(c.rlike(shape) & number(1).between(1, 9999), at)
    return F.coalesce(F.when(c.rlike(r"^-?\d{5,}$"), c.try_cast("long")), iso)


def iso_ms(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(text_column(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def describe_date(ms: Column | str, kind: Column, zone: str = "UTC", order: str = "ymd", hour12: bool = False) -> Column:
    """``struct(label, text, qualifier)``: what a time really is. One without a zone is shown as written."""
    ms = text_column(ms)
    dates = {"mdy": "MM/dd/yyyy", "dmy": "dd/MM/yyyy", "ymd": "yyyy-MM-dd", "long": "MMMM d, yyyy"}
    clock = "h:mm a" if hour12 else "H:mm"
    utc = F.timestamp_millis(ms)
    text = F.date_format(F.from_utc_timestamp(utc, zone), f"{dates[order]}, {clock}")
    bare = F.date_format(utc, f"MMM d, yyyy, {clock}")
    none = F.lit(None).cast("string")
    made = lambda label, text, qualifier: F.struct(F.lit(label).alias("label"), text.alias("text"), qualifier.alias("qualifier"))
    return (
        F.when(kind == "unknown", made("", F.lit("Date unknown"), none))
        .when(kind == "sent_zone_unknown", made("Sent", bare, F.lit("timezone unknown")))
        .when(kind == "received", made("Received", text, none))
        .otherwise(made("Sent", text, none))
    )


def backfill_sent_at(emails: DataFrame, headers: DataFrame) -> DataFrame:
    """Fills ``sent_at`` and its kind where the kind is null, from ``(id, date, emlx_ms, received)``.

    An unknown time leaves the old ``sent_at``; rows of known kind stay; running it again
    changes nothing.
    """
    found = headers.select("id", derive_sent_at(F.col("date"), F.col("emlx_ms"), F.col("received")).alias("__at"))
    todo = emails.where("sent_at_kind is null").join(found, "id", "left")
    moved = F.when(F.col("__at.kind") != "unknown", F.col("__at.ms")).otherwise(F.col("sent_at"))
    done = todo.withColumn("sent_at", F.coalesce(moved, "sent_at")).withColumn("sent_at_kind", F.col("__at.kind"))
    return emails.where("sent_at_kind is not null").unionByName(done.select(*emails.columns))
