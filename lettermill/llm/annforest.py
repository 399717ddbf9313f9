"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest, Bawa et al., WWW 2005).

The rows are dealt over blocks; a block holds, for each tree, the sorted array of its
rows' hash strings. A string's bits are the sides of random directions, each split at the
block's median. A query descends every tree to its longest matching prefix and then
ascends all trees together, one bit a step, meeting more candidates each step.

It stops by a rule that is the same at every size: when a row as far as the k-th
found so far would have been met by now with probability ``recall``. That distance,
against the block's variance, gives the correlation of such a row's side with the
query's, and with the query's own margin the probability that each bit is shared. Clustered data stop deep in the
trees; where all rows are equally far, the ascent goes near the root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lettermill.llm.blocks import segments
from lettermill.llm.embdedup import common_length, usable
from lettermill.session import materialize


@dataclass(frozen=True)
class ForestConfig:
    """A task holds ``block_rows`` rows, or ``block_values`` components where vectors are long, and a batch
    of queries; it builds its trees for ``query_rows`` queries, so that building costs little beside asking.
    ``partitions`` is the most there are: further blocks come one after another."""

    k: int = 10
    trees: int = 24
    bits: int = 32
    recall: float = 0.93
    block_rows: int = 16_384
    block_values: int = 1 << 21
    query_rows: int = 200_000
    partitions: int = 10_000
    seed: int = 9


_GRID = np.linspace(0, 6, 2401)
_NORMAL = np.array([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in _GRID])


class Forest:
    """The trees of one block."""

    def __init__(self, x: np.ndarray, cfg: ForestConfig):
        rng = np.random.default_rng(cfg.seed)
        self.cfg, self.x, self.squares = cfg, x, np.einsum("ij,ij->i", x, x)
        self.axes = rng.standard_normal((cfg.trees, cfg.bits, x.shape[1]))
        self.variance = ((x - x.mean(0)) ** 2).sum(1).mean()
        self.cuts, self.spread = np.zeros((cfg.trees, cfg.bits)), np.zeros((cfg.trees, cfg.bits))
        self.order, self.sorted = np.zeros((cfg.trees, len(x)), np.int64), np.zeros((cfg.trees, len(x)), np.uint64)
        for t, axes in enumerate(self.axes):
            side = x @ axes.T
            self.cuts[t], self.spread[t] = np.median(side, axis=0), side.std(0)
            keys = self._keys(side > self.cuts[t])
            self.order[t] = np.argsort(keys, kind="stable")
            self.sorted[t] = keys[self.order[t]]

    def _keys(self, bits: np.ndarray) -> np.ndarray:
        return (bits * (np.uint64(1) << np.arange(self.cfg.bits - 1, -1, -1, dtype=np.uint64))).sum(1, dtype=np.uint64)

    def search(self, queries: np.ndarray, skip: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and distances of the nearest found for each query, ``skip`` rows left out; ties included."""
        cfg, n = self.cfg, len(self.x)
        margins = np.zeros((len(queries), cfg.trees, cfg.bits))
        low = np.zeros((cfg.bits + 1, len(queries), cfg.trees), np.int64)
        high = np.full_like(low, n)
        for t, axes in enumerate(self.axes):
            side = queries @ axes.T
            margins[:, t] = np.abs(side - self.cuts[t])
            keys = self._keys(side > self.cuts[t])
            for x in range(1, cfg.bits + 1):
                rest = np.uint64(cfg.bits - x)
                first = (keys >> rest) << rest
                low[x, :, t] = np.searchsorted(self.sorted[t], first)
                high[x, :, t] = np.searchsorted(self.sorted[t], first + (np.uint64(1) << rest))
        width = (high - low).sum(2)
        for q, query in enumerate(queries):
            seen = np.zeros(n, bool)
            seen[skip[q]] = True
            ids, dist = np.zeros(0, np.int64), np.zeros(0)
            every = None
            inner = cfg.bits
            a, b = low[inner, q], low[inner, q]  # what the trees have met so far: nothing
            for x in range(cfg.bits, -1, -1):
                # a level that adds little goes with the next one
                if x and width[x, q] < max(1, 1.2 * (b - a).sum()):
                    continue
                fresh = np.zeros(n, bool)
                for t in range(cfg.trees):
                    fresh[self.order[t, low[x, q, t] : a[t]]] = True
                    fresh[self.order[t, b[t] : high[x, q, t]]] = True
                a, b = low[x, q], high[x, q]
                new = np.flatnonzero(fresh & ~seen)
                seen[new] = True
                if len(new):
                    if every is None and 4 * len(new) < n:
                        square = self.squares[new] - 2 * (self.x[new] @ query)
                    else:  # many rows: cheaper without copying them first
                        every = self.squares - 2 * (self.x @ query) if every is None else every
                        square = every[new]
                    ids, dist = np.append(ids, new), np.append(dist, square)
                    if len(ids) > cfg.k:
                        # what rounding may have swapped stays; the exact distance decides at the end
                        slack = 1e-9 * (self.squares[ids].max() + query @ query)
                        keep = dist <= np.partition(dist, cfg.k - 1)[cfg.k - 1] + slack
                        ids, dist = ids[keep], dist[keep]
                if len(ids) >= cfg.k and x:
                    far = max(0.0, dist.max() + query @ query)
                    like = max(0.0, 1 - far / (2 * self.variance)) if self.variance else 1.0
                    scale = self.spread[:, :x] * math.sqrt(1 - like * like)
                    shared = np.interp(like * margins[q, :, :x] / np.maximum(scale, 1e-300), _GRID, _NORMAL).prod(1)
                    if 1 - np.prod(1 - shared) >= cfg.recall:
                        break
            yield ids, np.sqrt(((self.x[ids] - query) ** 2).sum(1))


def _searching(batches: Iterator[pa.RecordBatch], cfg: ForestConfig) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    forest = None
    for new, part in segments(batches, ["ib", "qb", "query"]):
        column = part.column("v")
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        if not part.column("query")[0].as_py():
            held = [] if new else held
            held.append(part.select(["ib", "qb", "id"]))
            rows = [x] if new else [*rows, x]
            forest = None
            continue
        if not held or any(held[0].column(k)[0] != part.column(k)[0] for k in ("ib", "qb")):
            continue
        if forest is None:
            row_ids = np.concatenate([b.column("id").to_numpy() for b in held])
            by_id = np.argsort(row_ids, kind="stable")
            forest, rows = Forest(np.concatenate(rows), cfg), []
        asked_ids = part.column("id").to_numpy()
        left, right = (np.searchsorted(row_ids[by_id], asked_ids, side=s) for s in ("left", "right"))
        out: list[tuple] = []
        for q, (at, dist) in enumerate(forest.search(x, [by_id[a:b] for a, b in zip(left, right)])):
            order = np.lexsort((row_ids[at], dist))[: cfg.k]
            out.append((np.full(len(order), asked_ids[q]), row_ids[at[order]], dist[order]))
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, cfg: ForestConfig = ForestConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``k`` nearest rows of ``vectors`` found.

    ``score`` is the Euclidean distance of the original vectors in double precision;
    ties go to the smaller id. Rows of the query's own id are no candidates of it. A
    vector that is null, zero, holds null or non-finite components or has another length
    than the commonest of ``vectors`` takes no part, nor does a row of null id; queries of
    equal id are searched one by one and ranked together. All candidates are returned where
    there are fewer than ``k``; an empty table gives an empty result. Other columns are not read.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"

    def named(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
        return rows.where(usable("v") & F.col("id").isNotNull())

    dims = common_length(F.col("v"), named(vectors))
    rows, asked = (materialize(named(df).where(F.size("v") == dims), "forest") for df in (vectors, queries))
    blocks = max(1, -(-rows.count() // max(1, min(cfg.block_rows, cfg.block_values // dims))))
    query_blocks = max(1, -(-asked.count() // cfg.query_rows))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int, query: bool) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        met = df.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return met.select("ib", "qb", F.lit(query).alias("query"), "id", "v")

    both = dealt(rows, "ib", blocks, "qb", query_blocks, False).unionByName(dealt(asked, "qb", query_blocks, "ib", blocks, True))
    both = both.repartition(min(cfg.partitions, blocks * query_blocks), "ib", "qb").sortWithinPartitions("ib", "qb", "query", "id")
    found = both.mapInArrow(lambda it: _searching(it, cfg), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")
