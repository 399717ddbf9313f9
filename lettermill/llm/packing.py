"""Packing documents into fixed-length sequences along a space-filling curve.

A document's hashed token counts are projected to a few dimensions; the cell of
that point has a Hilbert key, and documents in key order are laid end to end and cut
at every ``length`` ids, so neighbours along the curve share sequences and only the
very last sequence is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lettermill.llm.blocks import give_back
from lettermill.llm.lookup import count_below
from lettermill.llm.tokens import encoder, settle_encoders
from lettermill.session import materialize


@dataclass(frozen=True)
class PackingConfig:
    """``dims`` and ``bits``: axes of the projection and bits an axis; their product is at most 32.

    ``bucket_docs``: documents of a key range, the unit that one task lays out.
    """

    tokenizer: str
    end_id: int
    length: int = 2048
    dims: int = 4
    bits: int = 8
    buckets: int = 4096
    bucket_docs: int = 4000
    seed: int = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of cell coordinates (Skilling, AIP 2004)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def _axes(cfg: PackingConfig, width: int) -> np.ndarray:
    return np.random.default_rng(cfg.seed).standard_normal((width, cfg.dims)).astype(np.float32)


_WIDTH = 4096


def _placing(batches: Iterator[pa.RecordBatch], cfg: PackingConfig) -> Iterator[pa.RecordBatch]:
    enc = encoder(cfg.tokenizer)
    axes = _axes(cfg, _WIDTH)
    end = np.array([cfg.end_id], enc.dtype).tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            ids = [enc.encode(t.as_py() or "") + end for t in part.column("text")]
            points = np.zeros((len(ids), cfg.dims), np.float32)
            for k, raw in enumerate(ids):
                own = np.frombuffer(raw, enc.dtype)
                # counts of hashed ids, damped so that a frequent id doesn't decide alone
                slots = (own.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
                vector = np.sqrt(np.bincount(slots, minlength=_WIDTH)).astype(np.float32)
                points[k] = vector @ axes / np.linalg.norm(vector)
            # the projections of unit vectors are near normal: their rank in (0, 1) fills the cells
            cells = (2**cfg.bits / (1 + np.exp(-1.702 * points))).astype(np.int64).clip(0, 2**cfg.bits - 1)
            spread = np.array([xxhash.xxh32_intdigest(f"{d}".encode()) >> 12 for d in part.column("doc_id").to_pylist()], np.uint64)
            key = (hilbert_keys(cells, cfg.bits) << np.uint64(20)) | spread
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(key.astype(np.int64)), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "key", "doc_tokens", "ids"],
            )
    settle_encoders()
    give_back()


def _cutting(batches: Iterator[pa.RecordBatch], cfg: PackingConfig) -> Iterator[pa.RecordBatch]:
    width = encoder(cfg.tokenizer).dtype
    bucket, at = None, 0
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in ("bucket", "base", "doc_id", "doc_tokens", "ids")))
        out: list[tuple] = []
        for b, base, doc, n, raw in rows:
            if b != bucket:
                bucket, at = b, base
            wide = np.frombuffer(raw, width).astype("<u4").tobytes()
            start = 0
            while start < n:
                offset = at % cfg.length
                size = min(n - start, cfg.length - offset)
                out.append((doc, start, size, n, at // cfg.length, offset, wide[4 * start : 4 * (start + size)]))
                start, at = start + size, at + size
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)
    give_back()


def pack(docs: DataFrame, cfg: PackingConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers. Sequences are
    numbered along the curve and full but for the last. A null text counts as empty and
    gives a piece of the end id alone. Rows of equal id are separate documents; a null
    id is kept as null. An empty table gives no pieces. Other columns are not read.

    Ids are made once and kept in a shared table. Key ranges come from quantiles of
    the keys, whose low bits spread copies, and each range's first position from the
    sums of the ranges before it, so that the layout needs one shuffle and no task holds
    more than a batch.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = materialize(rows.mapInArrow(lambda it: _placing(it, cfg), "doc_id long, key long, doc_tokens long, ids binary"), "packing")
    n = placed.count()
    parts = int(min(cfg.buckets, max(1, -(-n // cfg.bucket_docs))))
    cuts = sorted(set(placed.approxQuantile("key", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 and n else []))
    bucket = count_below(F.col("key"), [int(c) for c in cuts])
    placed = placed.withColumn("bucket", bucket)
    # one row a bucket, at most cfg.buckets
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket").agg(F.sum("doc_tokens").alias("ids_in"))
    base = sizes.select("bucket", F.coalesce(F.sum("ids_in").over(before), F.lit(0)).alias("base"))
    laid = placed.join(F.broadcast(base), "bucket").repartition("bucket").sortWithinPartitions("bucket", "key", "doc_id", "ids")
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return laid.select("bucket", "base", "doc_id", "doc_tokens", "ids").mapInArrow(lambda it: _cutting(it, cfg), schema)
