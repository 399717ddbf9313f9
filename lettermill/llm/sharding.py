"""Sharding by a consistent-hash ring with bounded loads, with DataFrame functions only.

Every shard has ``points`` virtual nodes on a ring of hashes; a key belongs to the next
node clockwise. A shard holds at most its equal part of the rows: rows of an arc
beyond what its shard still has room for go on clockwise to the next shard with room.
Arcs are filled in ring order, rows of an arc in hash order, so the layout is a fold
over counts of arcs (a table that parameters bound), and each row finds its shard and slot
from its rank in its arc.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lettermill.llm.lookup import count_below

_BITS = 60


@dataclass(frozen=True)
class RingConfig:
    """``cells`` cuts the ring into the ranges inside which rows are ranked."""

    shards: int = 16
    points: int = 64
    cell_bits: int = 16
    seed: int = 5


def _place(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[: _BITS // 4], 16)


def ring(cfg: RingConfig) -> tuple[list[int], list[list[int]]]:
    """Ascending places of the nodes, and for each arc the shards in clockwise order from it.

    Arc k ends at node k; the arc after the last node belongs to the first one.
    """
    nodes = sorted((_place(f"{cfg.seed} node {s} {p}"), s) for s in range(cfg.shards) for p in range(cfg.points))
    owners = [s for _, s in nodes]
    return [p for p, _ in nodes], [list(dict.fromkeys(owners[k:] + owners[:k])) for k in range(len(owners))]


def _layout(arcs: Column, shards: int) -> Column:
    """``[(arc, shard, low, high, slot)]``: ranks low to high of the arc go to the shard from that slot on."""
    total = F.aggregate(arcs, F.lit(0).cast("long"), lambda n, a: n + a["n"])
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(total / shards).cast("long") + (s < total % shards).cast("long"))
    start = F.struct(
        room.alias("room"),
        F.array_repeat(F.lit(0).cast("long"), shards).alias("used"),
        F.expr("cast(array() as array<struct<arc:int,shard:int,low:bigint,high:bigint,slot:bigint>>)").alias("segments"),
    )

    def fill(arc: Column):
        def step(t: Column, s: Column) -> Column:
            take = F.least(t["left"], t["room"][s] - t["used"][s])
            segment = F.struct(
                arc["arc"].alias("arc"), s.alias("shard"), t["low"].alias("low"), (t["low"] + take).alias("high"), t["used"][s].alias("slot")
            )
            moved = F.struct(
                t["room"].alias("room"),
                F.transform(t["used"], lambda x, i: F.when(i == s, x + take).otherwise(x)).alias("used"),
                F.concat(t["segments"], F.array(segment)).alias("segments"),
                (t["left"] - take).alias("left"),
                (t["low"] + take).alias("low"),
            )
            return F.when((t["left"] > 0) & (t["room"][s] > t["used"][s]), moved).otherwise(t)

        return step

    def outer(t: Column, arc: Column) -> Column:
        zero = F.struct(
            t["room"].alias("room"), t["used"].alias("used"), t["segments"].alias("segments"),
            arc["n"].alias("left"), F.lit(0).cast("long").alias("low"),
        )
        return F.aggregate(arc["order"], zero, fill(arc), lambda r: F.struct(r["room"].alias("room"), r["used"].alias("used"), r["segments"].alias("segments")))

    return F.aggregate(arcs, start, outer, lambda t: t["segments"])


def shard(rows: DataFrame, cfg: RingConfig = RingConfig(), key_col: str = "doc_id", spare_key: str | None = None) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard); counts of shards are at most one apart.

    Input columns named so are replaced. A null key is placed by ``spare_key`` if given,
    else with all null keys at one place of the ring, which one task then ranks. Rows
    of equal key lie side by side and are ordered by a hash of the whole row; equal rows
    may swap slots. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    places, orders = ring(cfg)
    spare = [F.col(spare_key).cast("string")] if spare_key else []
    text = F.coalesce(F.concat(F.lit("key "), F.col(key_col).cast("string")), *spare, F.lit(""))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{cfg.seed} "), text)), 1, _BITS // 4), 16, 10).cast("long")
    keyed = rows.select(*own, F.xxhash64(*own).alias("__row"), place.alias("__place"))
    keyed = keyed.withColumn("__arc", (count_below(F.col("__place"), places) % len(places)).cast("int"))
    keyed = keyed.withColumn("__cell", F.shiftright("__place", _BITS - cfg.cell_bits))

    # at most cells + nodes rows, however many rows there are; the last arc wraps round, so
    # its cells are put in ring order by starting after the last node
    counts = keyed.groupBy("__arc", "__cell").agg(F.count("*").alias("n"))
    wrapped = F.when(F.col("__cell") >= places[-1] >> (_BITS - cfg.cell_bits), F.col("__cell") - (1 << cfg.cell_bits)).otherwise(F.col("__cell"))
    turn = F.when(F.col("__arc") == 0, wrapped).otherwise(F.col("__cell"))
    before = Window.partitionBy("__arc").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__arc", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))

    order = spark.createDataFrame(list(enumerate(orders)), "arc int, order array<int>")
    totals = counts.groupBy(F.col("__arc").alias("arc")).agg(F.sum("n").alias("n")).join(order, "arc")
    arcs = totals.agg(F.array_sort(F.collect_list(F.struct("arc", "n", "order"))).alias("arcs"))
    segments = arcs.select(F.explode(_layout(F.col("arcs"), cfg.shards)).alias("s")).select("s.*")
    plan = segments.groupBy(F.col("arc").alias("__arc")).agg(F.collect_list(F.struct("low", "high", "shard", "slot")).alias("__plan"))

    by = Window.partitionBy("__arc", "__cell").orderBy("__place", "__row")
    ranked = keyed.withColumn("__at", F.row_number().over(by)).join(bases, ["__arc", "__cell"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__at") - 1)
    # the plan has at most one row a node
    placed = ranked.join(F.broadcast(plan), "__arc")
    mine = F.filter("__plan", lambda s: (s["low"] <= F.col("__rank")) & (F.col("__rank") < s["high"]))[0]
    return placed.select(*own, mine["shard"].alias("shard"), (mine["slot"] + F.col("__rank") - mine["low"]).alias("slot"))
