"""URL filtering by a cascade of Bloom filters.

A rule is a host and a path prefix. A URL's keys are the host suffixes and path prefixes that
have as many labels and characters as some rule has; all keys of all URLs are the universe. The
first filter of a cascade holds the listed keys, the second what else of the universe passes
the first, the third what of the listed keys passes the second, and so on until nothing
passes by mistake. So the level at which a key of the universe fails tells exactly whether
it is listed, and URLs are judged in one pass over the table, without a join.

Filters are built by grouping and held as literals of seven bits a byte. A cascade grows with
the list, not with the universe: the first filter's rate of false positives falls as the
universe grows, so that they are about as many as the listed keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The rules (verdict, host, path) of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@dataclass(frozen=True)
class UrlFilterConfig:
    """``rules``: ``(verdict, host, path)``, ``verdict`` allow or block. ``otherwise``: the verdict on URLs of no rule.

    ``literal_bytes`` bounds a cascade that is carried in expressions; where a list needs more, its
    keys are joined instead. ``seed`` starts the hashes; a cascade has ``max_levels`` at most.
    """

    rules: tuple[tuple[str, str, str], ...] = tuple(RULES)
    otherwise: str = "allow"
    literal_bytes: int = 1 << 20
    seed: int = 13
    max_levels: int = 64


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty where there is no ``://`` or no URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def shapes(rules: tuple[tuple[str, str, str], ...]) -> list[tuple[int, int]]:
    """The numbers of host labels and path characters that rules have, most labels first."""
    return sorted({(host.count(".") + 1, len(path)) for _, host, path in rules}, reverse=True)


def key(host: Column, path: Column, labels: int, size: int) -> Column:
    """A URL's key of one shape; null where it is too short for it."""
    fits = (F.length(host) - F.length(F.translate(host, ".", "")) >= labels - 1) & (F.length(path) >= size)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, size)))


@dataclass(frozen=True)
class Level:
    """A Bloom filter of ``bits`` bits in bytes of seven, and the seeds of its hashes."""

    bits: int
    seeds: tuple[int, ...]
    data: bytes

    def holds(self, k: Column) -> Column:
        return reduce(lambda a, b: a & b, [self._bit(F.pmod(F.xxhash64(F.lit(s), k), F.lit(self.bits))) for s in self.seeds])

    def _bit(self, at: Column) -> Column:
        byte = F.ascii(F.substring(F.lit(self.data), (at / 7).cast("int") + 1, F.lit(1)).cast("string"))
        return F.call_function("shiftright", byte, (at % 7).cast("int")).bitwiseAND(F.lit(1)) == 1


@dataclass(frozen=True)
class Cascade:
    """``holds`` is exact for the listed keys and every key of the universe it was built over."""

    levels: tuple[Level, ...]

    def holds(self, k: Column) -> Column:
        """The first filter that a key fails decides: listed keys fail even ones, others odd ones."""
        out = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[number].holds(k), out).otherwise(F.lit(number % 2 == 1))
        return F.coalesce(out, F.lit(False))

    @property
    def size(self) -> int:
        return sum(len(level.data) for level in self.levels)


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The filter of ``n`` keys at a rate of false positives, its bytes grouped from the keys' positions."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    seeds = tuple(seed * 64 + j for j in range(max(1, min(32, round(-math.log2(rate))))))
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(s), "key"), F.lit(bits)) for s in seeds]))
    placed = keys.select(at.alias("at")).select((F.col("at") / 7).cast("int").alias("byte"), F.expr("shiftleft(1, cast(at % 7 as int))").alias("bit"))
    data = bytearray(-(-bits // 7))
    for row in placed.groupBy("byte").agg(F.bit_or("bit").alias("value")).toLocalIterator():  # bounded by literal_bytes
        data[row["byte"]] = row["value"]
    return Level(bits, seeds, bytes(data))


def build_cascade(listed: DataFrame, universe: DataFrame, cfg: UrlFilterConfig = UrlFilterConfig()) -> Cascade | None:
    """The cascade of ``listed (key)`` over ``universe (key)``; None where it would pass ``literal_bytes``.

    Both may hold keys more than once and null keys, which are none. Only keys that pass a filter by
    mistake are ever dealt by key: they are about as many as the listed ones.
    """
    listed = listed.where("key is not null").distinct()
    n, all_keys = listed.count(), universe.agg(F.approx_count_distinct("key")).first()[0]
    if not n:
        return Cascade(())
    others, levels, inside, size = universe.where("key is not null"), [], n, 0
    rate = min(0.5, max(2.0**-30, math.sqrt(0.5) * n / max(1, all_keys)))
    for number in range(cfg.max_levels):
        size += max(64, math.ceil(inside * -math.log(rate) / math.log(2) ** 2)) // 7 + 1
        if size > cfg.literal_bytes:
            return None
        level = _level(listed, inside, rate, cfg.seed + number)
        levels.append(level)
        passing = others.where(level.holds(F.col("key"))).distinct()
        if number == 0:  # the universe holds listed keys too; from here on both sides are apart
            passing = passing.join(listed, "key", "left_anti")
        others, listed, rate = listed, passing, 0.5
        inside = listed.count()
        if not inside:
            return Cascade(tuple(levels))
    raise RuntimeError(f"keys still pass by mistake after {cfg.max_levels} levels")


def judge_urls(pages: DataFrame, cfg: UrlFilterConfig = UrlFilterConfig(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``(page_id, host, path, rule, verdict)``.

    A rule fits its host and all subdomains where the path starts with the rule's; of several the
    longest decides, of equally long ones that of the longer host. ``rule`` is the rule as ``host/path``.
    A URL of no rule has a null ``rule`` and the verdict ``otherwise``: a list of rules says nothing about it.

    A null URL, or one without ``://``, has an empty host and path, which no rule fits that has a host.
    Rows of equal or null id each have their row. An empty table gives an empty result; other
    columns are not read. Raises where a host and path have both verdicts.
    """
    spark, listed = pages.sparkSession, {}
    for verdict, host, path in cfg.rules:
        if listed.setdefault((host, path), verdict) != verdict or verdict not in ("allow", "block"):
            raise ValueError(f"rule {host}{path} needs one verdict, allow or block")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = [key(F.col("host"), F.col("path"), *shape) for shape in shapes(cfg.rules)]
    if not keys:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(cfg.otherwise).alias("verdict"))
    universe = rows.select(F.explode(F.array(*keys)).alias("key"))
    verdicts = {v: _keys(spark, [h + p for (h, p), kind in listed.items() if kind == v]) for v in ("allow", "block")}
    built = {v: build_cascade(df, universe, cfg) for v, df in verdicts.items()}
    if None in built.values():
        return _joined(rows, keys, verdicts, cfg)
    # the longest key that some cascade holds; keys stand in order of their hosts
    found = []
    for number, k in enumerate(keys):
        verdict = F.when(built["block"].holds(k), "block").when(built["allow"].holds(k), "allow")
        found.append(F.when(verdict.isNotNull(), F.struct(F.length(k).alias("size"), F.lit(-number).alias("order"), k.alias("rule"), verdict.alias("verdict"))))
    best = F.array_max(F.array(*found))
    return rows.select("*", best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(cfg.otherwise)).alias("verdict"))


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _joined(rows: DataFrame, keys: list[Column], verdicts: dict[str, DataFrame], cfg: UrlFilterConfig) -> DataFrame:
    """The same for lists that are too long for literals: every key is looked up by a join."""
    rules = reduce(DataFrame.unionByName, [df.distinct().withColumn("verdict", F.lit(v)) for v, df in verdicts.items()])
    named = rows.withColumn("row", F.monotonically_increasing_id())
    asked = named.select("row", F.posexplode(F.array(*keys)).alias("number", "key")).where("key is not null")
    best = asked.join(rules, "key").groupBy("row").agg(F.max(F.struct(F.length("key").alias("size"), (-F.col("number")).alias("order"), F.col("key").alias("rule"), "verdict")).alias("best"))
    return named.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(cfg.otherwise)).alias("verdict"))


def oracle_sql(cfg: UrlFilterConfig = UrlFilterConfig()) -> str:
    """DuckDB SQL of ``judge_urls`` over ``pages``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in cfg.rules)
    return f"""
WITH cut AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES {rules}),
fits AS (SELECT k, arg_max(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule, arg_max(verdict, (length(rule_host || rule_path), length(rule_host))) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, {quoted(cfg.otherwise)}) AS verdict FROM parts LEFT JOIN fits USING (k)
"""
