"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Each document class posts under every pair of signature coordinate and value.
Lists of one posting are dropped, a class with fewer shared coordinates than the
match threshold is dropped, and of the rest only the prefix of rarest coordinates
is posted: two classes with ``matches`` equal coordinates must meet in a prefix, so
the long lists are skipped without losing a pair. Collisions are counted list by
list on whole signatures; what reaches the threshold is joined into clusters, and
inside a cluster links are confirmed on full shingle sets.

No pair of a group is ever a row: tasks return a spanning forest of the pairs they
find, at most one edge a posting. Hot lists and clusters are cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lettermill.llm.blocks import block_pairs, forest, give_back, runs
from lettermill.llm.words import forget_words, shingles
from lettermill.operators.components import connected_components, join_hot
from lettermill.session import materialize


@dataclass(frozen=True)
class MinHashConfig:
    """``words``: shingle width. ``percent``: least similarity in hundredths.

    ``coordinates`` and ``matches``: signature length, and equal coordinates that a
    pair must have; at a similarity of 0.8 a pair has 12 of 24 with probability
    0.9998. ``list_block`` and ``cluster_block``: rows of a list or cluster that meet
    in one task; larger ones are cut, not capped.
    """

    words: int = 5
    percent: int = 80
    coordinates: int = 24
    matches: int = 12
    list_block: int = 1024
    cluster_block: int = 512
    seed: int = 1


def _multipliers(cfg: MinHashConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    a = rng.integers(1, 2**63, cfg.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, cfg.coordinates, dtype=np.uint64)[:, None]


def _digest(s: np.ndarray) -> tuple[int, int]:
    """The class of a set: 128 bits of its shingles."""
    digest = xxhash.xxh3_128_intdigest(s.tobytes())
    return (digest & (2**64 - 1)) - 2**63, (digest >> 64) - 2**63


def signatures(docs: DataFrame, cfg: MinHashConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, coords)``; the set hashes are null for an empty set."""
    a, b = _multipliers(cfg)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, low, high, coords = batch.column(0), [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), cfg.words)
                n.append(len(s))
                if len(s):
                    a64, b64 = _digest(s)
                    low.append(a64)
                    high.append(b64)
                    if len(s) < 4096:
                        least = ((s ^ b) * a).min(1)
                    else:
                        least = np.array([((s ^ y) * x).min() for x, y in zip(a.ravel(), b.ravel())], np.uint64)
                    coords.append((least * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
                else:
                    low.append(None)
                    high.append(None)
                    coords.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(coords, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "coords"],
            )
        forget_words()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, n_shingles long, set_a long, set_b long, coords array<long>")


def prefix_postings(reps: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """``(j, v, n, rep)``: each class under the rarest of its shared coordinates."""
    posted = reps.select("rep", F.posexplode("coords").alias("j", "v"))
    shared = posted.groupBy("j", "v").agg(F.count("*").alias("n")).where("n > 1")
    ranked = (
        join_hot(posted, shared, ["j", "v"])
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("n", "j", "v"))).alias("e"))
        .where(F.size("e") >= cfg.matches)
    )
    prefix = F.slice("e", F.lit(1), F.size("e") - F.lit(cfg.matches - 1))
    return ranked.select("rep", F.explode(prefix).alias("e")).select("e.j", "e.v", "e.n", "rep")


def _matching(batches: Iterator[pa.RecordBatch], cfg: MinHashConfig) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for run in runs(batches, ["v", "j", "ba", "bb"]):
        m = run.num_rows
        if m < 2:
            continue
        rep = run.column("rep").to_numpy()
        sig = run.column("coords").combine_chunks()
        sig = sig.flatten().to_numpy().reshape(m, -1)
        if m == 2:
            edges = [(0, 1)] if np.count_nonzero(sig[0] == sig[1]) >= cfg.matches else []
        else:
            count = np.zeros((m, m), np.uint8)
            for k in range(sig.shape[1]):
                count += sig[:, k][:, None] == sig[:, k][None, :]
            adjacent = count >= cfg.matches
            np.fill_diagonal(adjacent, False)
            edges = forest(adjacent)
        u += [int(rep[x]) for x, _ in edges]
        v += [int(rep[y]) for _, y in edges]
        if len(u) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the sets whose similarity reaches ``percent`` hundredths, counted exactly."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = 100 * both >= percent * (int(sizes.sum()) - both)
        return np.array([[False, ok], [ok, False]])
    values, where, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = df > 1
    column = np.cumsum(common) - 1
    row = np.repeat(np.arange(m), sizes)
    keep = common[where]
    row, col = row[keep], column[where[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(256, 4_000_000 // m)
    inter = np.zeros((m, m), np.float32)
    for start in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(col, [start, start + width])
        dense = np.zeros((m, width), np.float32)
        dense[row[lo:hi], col[lo:hi] - start] = 1
        inter += dense @ dense.T
    inter = inter.astype(np.int64)
    adjacent = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(adjacent, False)
    return adjacent


def _confirming(batches: Iterator[pa.RecordBatch], cfg: MinHashConfig) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for run in runs(batches, ["cluster", "ba", "bb"]):
        if run.num_rows < 2:
            continue
        rep = run.column("rep").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in run.column("shingles")]
        for x, y in forest(similar(sets, cfg.percent)):
            u.append(int(rep[x]))
            v.append(int(rep[y]))
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _with_sets(texts: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """``(rep, set_a, set_b, shingles)`` of rows ``(rep, text)``: one a class, however many rows of an id are of it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 100
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sets = [shingles(t.as_py(), cfg.words) for t in part.column("text")]
                low, high = zip(*map(_digest, sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["rep", "set_a", "set_b", "shingles"],
                )
        forget_words()
        give_back()

    found = texts.select("rep", "text").mapInArrow(kernel, "rep long, set_a long, set_b long, shingles binary")
    return found.groupBy("rep", "set_a", "set_b").agg(F.first("shingles").alias("shingles"))


def near_duplicates(docs: DataFrame, cfg: MinHashConfig = MinHashConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_shingles, component_id, kept)``.

    Documents are linked where the similarity of their shingle sets reaches
    ``percent`` hundredths; ``component_id`` is the smallest id reachable, and
    ``kept`` marks the document of that id. Documents of equal sets form one class
    before anything is joined, so copies cost one row each.

    A null or blank text has an empty set and is linked with nothing. Rows of equal id are
    one document for linking, each keeps its row, and of them one is kept only by its
    id. A row of null id is linked with nothing, has no component and is kept. An empty
    table gives an empty result. Other columns are not read.
    """
    signed = materialize(signatures(docs, cfg, id_col, text_col), "minhash-sig")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    members = materialize(join_hot(full.drop("coords"), classes, ["set_a", "set_b"]).select("doc_id", "rep"), "minhash-member")
    reps = join_hot(full, classes, ["set_a", "set_b"]).where("doc_id = rep")
    # an id may stand for many classes, so classes have numbers of their own until links are confirmed
    reps = reps.select("rep", "set_a", "set_b", "coords").dropDuplicates(["rep", "set_a", "set_b"])
    reps = materialize(reps.withColumn("class", F.monotonically_increasing_id()), "minhash-rep")
    classes = reps.select(F.col("class").alias("rep"), "coords")
    postings = prefix_postings(classes, cfg).join(classes, "rep")
    met = block_pairs(postings, ["j", "v"], "n", "rep", cfg.list_block)
    met = met.repartition("v", "j", "ba", "bb").sortWithinPartitions("v", "j", "ba", "bb")
    found = met.select("v", "j", "ba", "bb", "rep", "coords").mapInArrow(lambda it: _matching(it, cfg), "u long, v long")
    clusters = connected_components(found).withColumnsRenamed({"node": "class", "component": "cluster"})
    clusters = reps.select("class", "rep", "set_a", "set_b").join(clusters, "class").drop("class")
    sized = join_hot(clusters, clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    wanted = materialize(sized, "minhash-cluster")

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    sets = _with_sets(texts.join(wanted.select("rep").distinct(), "rep", "left_semi"), cfg).join(wanted, ["rep", "set_a", "set_b"])
    sets = block_pairs(sets, ["cluster"], "n", "set_a", cfg.cluster_block)
    sets = sets.repartition("cluster", "ba", "bb").sortWithinPartitions("cluster", "ba", "bb")
    links = sets.select("cluster", "ba", "bb", "rep", "shingles").mapInArrow(lambda it: _confirming(it, cfg), "u long, v long")
    # an id that stands for rows of several texts ties their classes together
    owners = members.select("doc_id", "rep").distinct()
    least = owners.groupBy("doc_id").agg(F.min("rep").alias("u"))
    tied = join_hot(owners, least, "doc_id").where("rep <> u").select("u", F.col("rep").alias("v"))
    joined = connected_components(links.unionByName(tied)).withColumnsRenamed({"node": "rep"})
    placed = least.select("doc_id", F.col("u").alias("rep")).join(joined, "rep", "left")
    placed = placed.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
