"""Tag expressions (P42-P44)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lettermill.functions.text import text_column, trim_all

MAX_TAG_LENGTH = 64
MAX_TAGS = 64


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def normalize_tag(c: Column | str) -> Column:
    v = F.regexp_replace(text_column(c), r"[\x00-\x1F\x7F]", "")
    v = trim_all(F.regexp_replace(v, r"(?U)\s+", " "))
    return F.substring(trim_all(F.regexp_replace(v, "^#+", "")), 1, MAX_TAG_LENGTH)


def _holds(tags: Column, tag: Column) -> Column:
    return F.exists(tags, lambda t: F.lower(t) == F.lower(tag))


def normalize_tags(c: Column | str) -> Column:
    """Normalised tags of an array, the first of those that differ in case alone, empty ones dropped."""
    clean = F.transform(text_column(c), normalize_tag)
    step = lambda acc, t: F.when((t == "") | t.isNull() | _holds(acc, t), acc).otherwise(F.concat(acc, F.array(t)))
    return F.coalesce(F.aggregate(clean, _none(), step), _none())


def apply_tag_changes(current: Column | str, add: Column, remove: Column) -> Column:
    """Removes, whatever the case; then appends what isn't there; a tag both added and removed stays
    out; stops at ``MAX_TAGS``."""
    kept = F.filter(F.coalesce(text_column(current), _none()), lambda t: ~_holds(remove, t))
    step = lambda acc, t: F.when((F.size(acc) >= MAX_TAGS) | _holds(remove, t) | _holds(acc, t), acc).otherwise(F.concat(acc, F.array(t)))
    return F.aggregate(add, kept, step)
