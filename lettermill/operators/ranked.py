"""A search index of blocks with bounds, and pages of best hits that skip the blocks which can't reach them.

Documents are dealt by id, laid in order of length in each task and cut into parts. A block holds
what one term has in one part, with the counts of which one has the greatest share in a score
there; a dictionary holds each term's document frequency. Shares grow with counts less than in proportion, so the shares of
several terms add up to a bound of their sum, and a phrase has no more than its rarest token.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from lettermill.operators import postings as kernels
from lettermill.operators.search import FIELDS, WEIGHTS, parse_query, phrase_hits, resolve_fields, token_number, token_text
from lettermill.session import materialize

_BLOCKS = "term string, part long, df long, best array<struct<f:double,length:int>>, email_id array<string>, length array<int>, field array<tinyint>, tf array<int>, at array<int>, places array<int>"


@dataclass(frozen=True)
class Index:
    """``terms (term, df, blocks)``, ``blocks`` of ``postings.blocks``, the number of documents and their mean length."""

    terms: DataFrame
    blocks: DataFrame
    total: int
    average: float


def _share(f: Column, length: Column, average: float) -> Column:
    """What a weighted count has in a score, without the term's rarity."""
    return f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / average))


def _weight() -> Column:
    return F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])[F.col("field")]


def write_index(docs: DataFrame, path: str, per_part: int = 1024) -> Index:
    """Write the index of search documents below ``path``; a part has ``per_part`` documents at most.

    Texts move once, to the task of their id, which lays them by length, makes the blocks of its parts and writes
    them where they are, in runs by term: a term in all documents is as many rows as there are parts, and blocks are
    neither shuffled nor spilled. The mean length is known when all is written, so blocks tell what their greatest share depends on, not the share.
    Documents of equal id are one.
    """
    spark = docs.sparkSession
    same = Window.partitionBy("email_id").orderBy("email_id")  # joined rows stand so
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = docs.select("email_id", *[token_text(f).alias(f) for f in FIELDS])
    held = held.withColumn("own", reduce(lambda a, b: a + b, [token_number(f) for f in FIELDS]))
    # any one row of an id counts it
    held = held.select("email_id", F.max("own").over(whole).alias("length"), F.row_number().over(same).alias("nth"), *FIELDS)
    seen, one = Observation(), F.col("nth") == 1
    held = held.observe(seen, F.count(F.when(one, 1)).alias("n"), F.sum(F.when(one, F.col("length")).cast("long")).alias("length")).where("email_id is not null")
    laid = held.sortWithinPartitions("length", "email_id").select("email_id", "length", *FIELDS)
    made = laid.mapInArrow(lambda batches: kernels.blocks(batches, FIELDS, WEIGHTS, per_part, TaskContext.get().partitionId()), _BLOCKS)
    # within a run of blocks terms are in order, so a query reads pages of its terms alone where pages are short
    made.write.option("compression", "zstd").option("parquet.page.row.count.limit", 2000).parquet(f"{path}/blocks")
    total, average = seen.get["n"], float((seen.get["length"] or 0) / (seen.get["n"] or 1)) or 1.0
    stored = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    stored.groupBy("term").agg(F.sum("df").alias("df"), F.count("*").alias("blocks")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    stats = spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(average).alias("average"))
    stats.write.parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    known = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/blocks"), known["total"], known["average"])


def _fits(token: str, prefix: bool) -> Column:
    return F.col("term").startswith(token) if prefix else F.col("term") == token


def _tokens(phrases) -> list[tuple[int, str, bool]]:
    return [(k, t, prefix and n == len(tokens) - 1) for k, (tokens, prefix) in enumerate(phrases) for n, t in enumerate(tokens)]


def _of_terms(index: Index, phrases) -> DataFrame:
    return index.blocks.where(reduce(lambda a, b: a | b, [_fits(t, p) for _, t, p in _tokens(phrases)]))


def _postings(blocks: DataFrame) -> DataFrame:
    """``(term, email_id, length, field, tf, positions)`` of blocks."""
    rows = blocks.select("term", "places", F.inline(F.arrays_zip("email_id", "length", "field", "tf", "at")))
    field = F.get(F.array(*[F.lit(f) for f in FIELDS]), F.col("field").cast("int"))
    return rows.select("term", "email_id", "length", field.alias("field"), F.col("tf").cast("long").alias("tf"), F.slice("places", F.col("at") + 1, F.col("tf")).alias("positions"))


def document_frequencies(index: Index, query: str, fields=None) -> list[int]:
    """In how many documents each phrase of a query occurs.

    A whole term in all fields is looked up in the dictionary. Prefixes and chosen fields count ids, without
    places; phrases of several tokens read the blocks of their terms, since nothing smaller tells their number.
    """
    phrases, scope = parse_query(query), resolve_fields(fields)
    asked = []
    for k, (tokens, prefix) in enumerate(phrases):
        if len(tokens) > 1:
            found = phrase_hits(_postings(_of_terms(index, [(tokens, prefix)])), tokens, prefix, scope)
            asked.append(found.select(F.lit(k).alias("k"), "email_id").distinct().groupBy("k").count())
        elif prefix or len(scope) < len(FIELDS):
            ids = index.blocks.where(_fits(tokens[0], prefix)).select(F.inline(F.arrays_zip("email_id", "field")))
            seen = ids.where(F.col("field").isin(*[FIELDS.index(f) for f in scope])).select(F.lit(k).alias("k"), "email_id")
            asked.append(seen.distinct().groupBy("k").count())
        else:
            asked.append(index.terms.where(F.col("term") == tokens[0]).select(F.lit(k).alias("k"), F.col("df").alias("count")))
    found = dict(reduce(DataFrame.unionByName, asked).collect()) if asked else {}
    return [found.get(k, 0) for k in range(len(phrases))]


def _rarity(index: Index, n: int) -> float:
    return max(math.log((index.total - n + 0.5) / (n + 0.5)), 1e-6)


def part_bounds(index: Index, query: str, counts: list[int], or_mode: bool = False) -> DataFrame:
    """``(part, bound, blocks)``: no document of a part scores more, over the parts that can hold a hit."""
    phrases = parse_query(query)
    told = [F.sum(F.when(_fits(t, p), F.col("impact"))).alias(f"b{n}") for n, (_, t, p) in enumerate(_tokens(phrases))]
    impact = F.array_max(F.transform("best", lambda b: _share(b["f"], b["length"], index.average)))
    seen = _of_terms(index, phrases).select("term", "part", impact.alias("impact")).groupBy("part").agg(*told, F.count("*").alias("blocks"))
    owner = [k for k, _, _ in _tokens(phrases)]
    parts, needed = [], []
    for k in range(len(phrases)):
        mine = [F.col(f"b{n}") for n, o in enumerate(owner) if o == k]
        whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in mine])
        parts.append(F.when(whole, F.least(*mine) if len(mine) > 1 else mine[0]).otherwise(0.0) * _rarity(index, counts[k]))
        needed.append(whole)
    can = reduce((lambda a, b: a | b) if or_mode else (lambda a, b: a & b), needed)
    return seen.where(can).select("part", reduce(lambda a, b: a + b, parts).alias("bound"), "blocks")


def _scored(blocks: DataFrame, index: Index, query: str, counts: list[int], fields, or_mode: bool) -> DataFrame:
    phrases, scope = parse_query(query), resolve_fields(fields)
    postings = _postings(blocks)
    lengths = blocks.select(F.inline(F.arrays_zip("email_id", "length"))).distinct()
    rows = []
    for k, (tokens, prefix) in enumerate(phrases):
        found = phrase_hits(postings, tokens, prefix, scope).groupBy("email_id").agg(F.sum(F.col("tf") * _weight()).alias("f"))
        rows.append(found.select("email_id", "f", F.lit(_rarity(index, counts[k])).alias("rarity")))
    joined = reduce(DataFrame.unionByName, rows).join(lengths, "email_id")
    shares = joined.groupBy("email_id").agg(F.sum(F.col("rarity") * _share(F.col("f"), F.col("length"), index.average)).alias("s"), F.count("*").alias("n"))
    return shares.where(F.lit(or_mode) | (F.col("n") == len(phrases))).select("email_id", (-F.col("s")).alias("score"))


def needed_parts(index: Index, query: str, k: int, fields=None, or_mode: bool = False, first_parts: int = 4) -> tuple[DataFrame, list[int]]:
    """The parts that can hold one of the ``k`` best hits, as rows of ``part_bounds``, and the phrases' frequencies.

    The ``first_parts`` of greatest bound are scored; parts whose bound is less than the k-th score met are left out.
    """
    counts = document_frequencies(index, query, fields)
    bounds = materialize(part_bounds(index, query, counts, or_mode), "index-bound")
    first = [r.part for r in bounds.orderBy(F.desc("bound"), "part").limit(first_parts).collect()]
    blocks = _of_terms(index, parse_query(query)).where(F.col("part").isin(*first)) if first else index.blocks.limit(0)
    met = [-r.score for r in _scored(blocks, index, query, counts, fields, or_mode).orderBy("score").limit(k).collect()]
    least = met[-1] if len(met) == k else 0.0
    # sums of the same numbers in another order may differ in their last digits
    return bounds.where(F.col("bound") >= least * (1 - 1e-9)), counts


def top_hits(index: Index, query: str, k: int = 10, fields=None, or_mode: bool = False, first_parts: int = 4) -> DataFrame:
    """``(email_id, score)`` of the ``k`` best hits by bm25, best (lowest) first, ties by id.

    They are those of ``bm25`` over all hits. Hits hold every phrase in a field of ``fields``, or any phrase with
    ``or_mode``. A query without tokens gives no rows; ``k`` is the page asked for and bounds what the driver is sent.
    """
    if not parse_query(query):
        return index.blocks.select(F.lit("").alias("email_id"), F.lit(0.0).alias("score")).limit(0)
    parts, counts = needed_parts(index, query, k, fields, or_mode, first_parts)
    blocks = _of_terms(index, parse_query(query)).join(parts.select("part"), "part", "left_semi")
    return _scored(blocks, index, query, counts, fields, or_mode).orderBy("score", "email_id").limit(k)
