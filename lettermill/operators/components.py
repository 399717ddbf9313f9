"""Connected components over an edge table, wholly as DataFrame jobs.

Alternating large-star and small-star steps (Kiveris et al., SoCC 2014). An edge holds its
greater node first. Every round is one job whose result goes to a shared table, so plans
stay short and a lost executor costs one round at most. A hub, as the least node of a large
component is, has its rows dealt by its key in a join and nowhere else; both sides of those
joins are dealt anew, so that adaptive execution can split the hub's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from lettermill.session import materialize


def join_hot(rows: DataFrame, one: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``rows``, in which some keys are hot, with a grouped table of one row a key.

    A grouped table is dealt by its key already, and a join that only deals the other side is
    one adaptive execution can't split. A further key, which depends on the others, has it dealt anew.
    """
    keys = [keys] if isinstance(keys, str) else keys
    left, right = (df.withColumn("__again", F.xxhash64(*keys)) for df in (rows, one))
    return left.join(right, [*keys, "__again"], how).drop("__again")


def _round(edges: DataFrame) -> DataFrame:
    """Each node's edges go to the least neighbour of its lower ends, then its lower ends to their least one."""
    low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    large = join_hot(edges, low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = join_hot(large, least, "u")
    moved = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.select(F.explode(moved).alias("e")).select("e.*").where("u <> v")


def _state(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and checksum, taken as they are written."""
    seen = Observation()
    kept = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash"))
    table = materialize(kept, "cc")
    return table, (seen.get["n"], seen.get["hash"])


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table.

    ``component`` is the smallest node reachable. Edges with a null end and self
    loops link nothing; nodes that occur only in those are not returned, so a
    caller joins left and falls back to the node itself. An empty edge table gives
    an empty result. Raises if ``max_rounds`` do not suffice, never a partial answer.
    """
    state, seen = _state(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds if seen[0] else 0):
        state, now = _state(_round(state))
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
