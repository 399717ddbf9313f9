"""Helpers for map-side kernels that see their rows group by group."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def give_back() -> None:
    """Hands freed memory back to the machine, at the end of a task: workers live on beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to hand back by hand
        pass


def segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Consecutive rows of equal keys, a slice of one batch at a time, and whether the keys are new; rows arrive sorted by keys."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            first = tuple(c[a] for c in columns)
            yield first != last, batch.slice(a, b - a)
            last = first


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, as one table per run; rows arrive sorted by keys."""
    held: list[pa.RecordBatch] = []
    for new, part in segments(batches, keys):
        if new and held:
            yield pa.Table.from_batches(held)
            held = []
        held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of many whole groups of one key each; rows arrive sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.asarray(batch.column(key))
        cut = int(np.searchsorted(values, values[-1]))  # the last group may go on in the next batch
        if cut or (held and held[-1].column(key)[-1].as_py() != values[-1]):
            done = [*held, batch.slice(0, cut)]
            held = []
            yield pa.Table.from_batches(done)
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(df: DataFrame, group: list[str], size: str, member: str, block: int) -> DataFrame:
    """Replicate the rows of each group so that every two rows meet in some group (ba, bb).

    A group of at most ``block`` rows is one block. A larger one is cut by a hash of
    ``member`` into blocks of about that many, and each row goes to the pairs of its
    block with every block, so no task sees more than about two blocks.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(block))).cast("int")
    own = F.pmod(F.xxhash64(member), F.col("_nb")).cast("int")
    return (
        df.withColumn("_nb", blocks)
        .withColumn("_b", own)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("ba", F.least("_b", "_o"))
        .withColumn("bb", F.greatest("_b", "_o"))
        .drop("_nb", "_b", "_o", size)
    )


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, member) of a star per component of a boolean adjacency matrix."""
    n = len(adjacent)
    left = adjacent.any(1)
    edges = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        frontier = np.array([root])
        while len(frontier):
            frontier = np.flatnonzero(adjacent[frontier].any(0) & left)
            left[frontier] = False
            edges += [(root, int(x)) for x in frontier]
    return edges
