"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's repetition rate is its target share of the output over its share of the
rows. Each document draws its number of replicas by inverting the Poisson distribution
of that mean at a uniform number hashed from seed and id, is exploded by the count, and
the replicas are put in the order of another hash over all partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from lettermill.session import materialize


@dataclass(frozen=True)
class MixConfig:
    """``weights``: target weight by source; sources that it doesn't name get none and
    their documents rate 0. Where it is empty the weight is the source's rows to the
    power ``alpha``. ``epochs``: rows of the output, on average, over rows of the input.
    """

    weights: dict[str, float] = field(default_factory=dict)
    alpha: float = 0.7
    epochs: float = 1.0
    seed: int = 42


def _hashed(digits: int, *parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, cfg: MixConfig, source_col: str = "source") -> DataFrame:
    """``(source, n, rate)``: rows and mean replicas a document of each source."""
    counted = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if cfg.weights:
        given = F.create_map(*[F.lit(x) for pair in cfg.weights.items() for x in pair])
        weight = F.coalesce(F.get(F.array(given[F.col("source")]), F.lit(0)).cast("double"), F.lit(0.0))
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(cfg.alpha))
    everything = Window.partitionBy()  # one row a source
    counted = counted.withColumn("weight", weight)
    share = F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(everything)), F.lit(0.0))
    rate = share * F.sum("n").over(everything) * F.lit(cfg.epochs) / F.col("n")
    return counted.select("source", "n", rate.alias("rate"))


def _distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... until they are 1 in double precision."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    zero = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.ln(rate / k)
        total = s["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(s["cdf"], F.array(total)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda s: s["cdf"])
    return F.when(rate > 0, cdf).otherwise(F.array(F.lit(1.0)))


def mix(docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Replicas of ``docs`` in a global shuffle: its columns and ``replica`` (from 1),
    ``n_replicas`` and ``shuffle_key``, by which the output is sorted; these three replace input
    columns of the same name.

    Rows of equal id draw equal counts; a row of null id draws by its text, and all rows
    of null id and text draw alike. A null source is a source of its own, which weights can't
    name. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("replica", "n_replicas", "shuffle_key")]
    # one row a source, written so that its true size decides whether it is broadcast
    known = materialize(rates(docs, cfg, source_col), "mixing-rates")
    known = known.select(F.col("source").alias("__source"), _distribution(F.col("rate")).alias("__cdf"))
    identity = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.col(text_col)), F.lit(""))
    drawn = (
        docs.select(*own).withColumn("__id", F.md5(identity))
        .join(known, F.col(source_col).eqNullSafe(F.col("__source")))
        .withColumn("__u", _hashed(13, F.lit(f"{cfg.seed} count"), F.col("__id")) / F.lit(float(1 << 52)))
        .withColumn("n_replicas", F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))))
        .where("n_replicas > 0")
        .withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("n_replicas"))))
        .withColumn("shuffle_key", _hashed(15, F.lit(f"{cfg.seed} order"), F.col("__id"), F.col("replica").cast("string")))
    )
    return drawn.select(*own, "replica", "n_replicas", "shuffle_key").orderBy("shuffle_key", id_col, "replica")


def oracle_sql(cfg: MixConfig = MixConfig()) -> str:
    """The query over ``documents`` in DuckDB SQL, with weights left to ``alpha``."""
    return f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, {cfg.alpha}) / sum(pow(n, {cfg.alpha})) OVER () * sum(n) OVER () * {cfg.epochs} / n AS rate FROM s),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
      FROM r, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 26) AS BIGINT))) AS t(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
l AS (SELECT source, list(cdf ORDER BY k) AS cdfs FROM c GROUP BY source),
d AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || text, '')) AS h FROM documents),
u AS (SELECT d.*, CAST('0x' || substr(md5('{cfg.seed} count|' || h), 1, 13) AS BIGINT) / 4503599627370496.0 AS u, cdfs
      FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
n AS (SELECT *, CAST(len(list_filter(cdfs, lambda x: x <= u)) AS INTEGER) AS n_replicas FROM u)
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INTEGER) AS replica, n_replicas,
       CAST('0x' || substr(md5('{cfg.seed} order|' || h || '|' || k), 1, 15) AS BIGINT) AS shuffle_key
FROM n, unnest(range(1, n_replicas + 1)) AS t(k)
"""
