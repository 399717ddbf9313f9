"""Token-id files by bit-plane shuffling.

A dataset is a folder of two Parquet tables, so that Spark's commit protocol covers
them and any store Spark reads can hold them.

``segments``: one row for some whole documents of one shard, in ascending order.
``shard, seq`` place it; ``shard_start`` counts the shard's ids before it; ``doc_ids``
and ``lengths`` list its documents; ``data`` holds its ids: blocks of ``block`` ids
(the last one shorter) are transposed into planes, each plane is compressed with
zstandard, and ``chunks`` is the index: the byte offset of every plane, in order, and
the end. ``unit`` is ``bit`` or ``byte``; ``width`` the bytes of an id.

``shards``: ``shard, start, n_ids``; ``start`` counts all ids of the shards before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lettermill.llm.blocks import give_back
from lettermill.llm.tokens import encoder, settle_encoders


@dataclass(frozen=True)
class TokenFileConfig:
    """``segment_ids`` bounds a segment but for a longer single document, ``remembered`` the parts
    of texts in each of two generations whose ids a worker keeps."""

    tokenizer: str
    end_id: int
    unit: str = "byte"
    block: int = 65536
    segment_ids: int = 1 << 20
    segment_docs: int = 1 << 15
    level: int = 1
    remembered: int = 200_000


_SEGMENT = (
    "shard int, seq int, shard_start long, n_ids long, doc_ids array<long>, lengths array<long>, "
    "unit string, width int, block int, chunks array<long>, data binary"
)


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of one block: one per byte of an id, or one per bit, lowest first."""
    raw = np.frombuffer(ids.tobytes(), np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if unit == "byte":
        return [x.tobytes() for x in raw.T]
    return [np.packbits(x).tobytes() for x in np.unpackbits(raw, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int, width: int, unit: str) -> np.ndarray:
    stack = np.array([np.frombuffer(p, np.uint8) for p in planes])
    if unit == "bit":
        stack = np.packbits(np.unpackbits(stack, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(stack.T).view(f"<u{width}").ravel()


def compress(ids: np.ndarray, unit: str, block: int, level: int) -> tuple[bytes, list[int]]:
    zstd = zstandard.ZstdCompressor(level=level)
    planes = [zstd.compress(p) for at in range(0, len(ids), block) for p in to_planes(ids[at : at + block], unit)]
    return b"".join(planes), [0, *np.cumsum([len(p) for p in planes]).tolist()]


def decompress(data: bytes, chunks: list[int], n_ids: int, width: int, unit: str, block: int) -> np.ndarray:
    zstd, view = zstandard.ZstdDecompressor(), memoryview(data)
    per = width * (8 if unit == "bit" else 1)
    out = [np.zeros(0, f"<u{width}")]
    for k, at in enumerate(range(0, n_ids, block)):
        planes = [zstd.decompress(view[chunks[k * per + i] : chunks[k * per + i + 1]]) for i in range(per)]
        out.append(from_planes(planes, min(block, n_ids - at), width, unit))
    return np.concatenate(out)


def _segments(batches: Iterator[pa.RecordBatch], cfg: TokenFileConfig) -> Iterator[pa.RecordBatch]:
    enc = encoder(cfg.tokenizer, remembered=cfg.remembered)
    end = np.array([cfg.end_id], enc.dtype).tobytes()
    width = enc.dtype.itemsize
    shard, seq, start = TaskContext.get().partitionId(), 0, 0
    ids: list[bytes] = []
    docs: list[int | None] = []
    held = 0

    def close() -> pa.RecordBatch:
        nonlocal seq, start, held
        lengths = [len(x) // width for x in ids]
        whole = np.frombuffer(b"".join(ids), enc.dtype)
        data, chunks = compress(whole, cfg.unit, cfg.block, cfg.level)
        row = [shard, seq, start, len(whole), list(docs), lengths, cfg.unit, width, cfg.block, chunks, data]
        seq, start, held = seq + 1, start + len(whole), 0
        ids.clear()
        docs.clear()
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        names = [x.split()[0] for x in _SEGMENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = enc.encode(text.as_py() or "") + end
            if ids and held + len(own) // width > cfg.segment_ids:
                yield close()
            ids.append(own)
            docs.append(doc)
            held += len(own) // width
            if held >= cfg.segment_ids or len(docs) >= cfg.segment_docs:
                yield close()
    if ids:
        yield close()
    settle_encoders()
    give_back()


def write_tokens(docs: DataFrame, path: str, cfg: TokenFileConfig, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, end each with ``end_id``, and write them in ascending id order.

    A null text counts as empty: it holds the end id alone. Null ids come first; rows
    of equal id are separate documents, ordered by a hash of their text. An empty table
    writes an empty dataset. Columns other than the two are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(lambda it: _segments(it, cfg), _SEGMENT).write.parquet(f"{path}/segments")
    sizes = spark.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # one row a shard: as many as the range partitioning has, whatever the rows
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids").write.parquet(f"{path}/shards")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            get = {k: v.as_py() for k, v in row.items()}
            ids = decompress(get["data"], get["chunks"], get["n_ids"], get["width"], get["unit"], get["block"]).astype("<u4")
            ends = np.cumsum(get["lengths"])
            starts = ends - get["lengths"]
            step = 2048
            for at in range(0, len(ends), step):
                a, b = starts[at : at + step], ends[at : at + step]
                own = ids[a[0] : b[-1]]
                offsets = np.append(4 * (a - a[0]), 4 * (b[-1] - a[0])).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get["doc_ids"][at : at + step], pa.int64()), pa.array(a + get["base"] + get["shard_start"]), pa.array(b - a), binary],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of a dataset; ``ids`` are little-endian unsigned 32-bit integers."""
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("base"))
    rows = spark.read.parquet(f"{path}/segments").join(shards, "shard")
    return rows.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")
