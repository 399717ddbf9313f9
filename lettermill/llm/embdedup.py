"""Embedding near-duplicate detection by sorted projection passes.

Each pass gives a vector a key, the concatenated signs of its projections on random
directions, and sorts all vectors by it. Near vectors agree in most signs, so they often
stand close together; each is compared with the ``window`` vectors after it, over borders of
partitions too, and pairs that reach the cosine are united over all passes. Keys are long, so
that a dense run of vectors is sorted by further signs. Nothing is taken from a sample: after
its passes every vector has, from its own place in each order, the probability that a pair of
it at the cosine met in none of them, and goes on until that is below a stated one. Then all
vectors of a cluster are compared exactly, which gives every link inside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from lettermill.llm.blocks import block_pairs, runs
from lettermill.operators.components import connected_components, join_hot
from lettermill.session import materialize


@dataclass(frozen=True)
class ProjectionConfig:
    """``miss`` bounds, for each row, the probability that a pair of it at the cosine meets in no pass;
    a row goes on until what is reckoned for it is ``spare`` times that.
    Of ``windows`` the one of least work is taken; moving a row once costs as much as comparing
    ``row_cost`` pairs. None is larger than a block. Where none of them would reach ``miss`` in
    ``most_passes``, wider ones are tried, at last one of all rows. ``bits``: signs of a key.

    Blocks of ``block`` rows, or of ``block_values`` components where vectors are long, meet in a
    task. At most ``round_passes`` passes are sorted at once.
    """

    cosine: float = 0.95
    miss: float = 0.001
    spare: float = 0.1
    windows: tuple[int, ...] = (64, 256, 1024, 4096, 16384)
    most_passes: int = 256
    bits: int = 128
    row_cost: float = 4000
    block: int = 16384
    block_values: int = 1 << 20
    seed: int = 3
    round_passes: int = 16

    @property
    def goal(self) -> float:
        """Minus the logarithm of the miss probability at which a row leaves."""
        return -math.log(self.miss * self.spare)

    def rows(self, dims: int) -> int:
        """Rows of a block."""
        return max(1, min(self.block, self.block_values // max(1, dims)))

    def candidates(self, dims: int) -> list[int]:
        return [w for w in self.windows if w <= self.rows(dims)] or [self.rows(dims)]


@dataclass(frozen=True)
class Passes:
    """``number`` passes from ``first`` on over keys of the vectors seen from ``center``, each row against the ``window`` after it."""

    number: int
    window: int
    center: np.ndarray
    first: int = 0

    def all(self) -> range:
        return range(self.first, self.first + self.number)

    def projected(self, x: np.ndarray, number: int, cfg: ProjectionConfig, signs: int | None = None) -> np.ndarray:
        """The projections of one pass, the first ``signs`` of them."""
        directions = np.random.default_rng([cfg.seed, number]).standard_normal((x.shape[1], cfg.bits))
        return (x - self.center) @ directions[:, :signs]

    def keys(self, x: np.ndarray, number: int, cfg: ProjectionConfig) -> np.ndarray:
        """The signs of one pass as bytes, first sign first."""
        return np.packbits(self.projected(x, number, cfg) > 0, axis=1)


def usable(vector: str) -> Column:
    """A vector that takes part: not null, not zero, of finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit_rows(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _depths(keys: np.ndarray, width: int) -> np.ndarray:
    """For each row, so many first signs that at most ``width`` rows share them with it."""
    n = len(keys)
    order = np.lexsort(keys.T[::-1])
    if n <= width:
        return np.zeros(n)
    signs = np.unpackbits(keys[order], axis=1)
    differ = signs[:-width] != signs[width:]
    shared = np.where(differ.any(1), differ.argmax(1), signs.shape[1])
    # the most that any run of width + 1 rows around a row shares, by runs of doubled length
    most = np.full(n + width, -1)
    most[width : width + len(shared)] = shared
    reach, span = most, 1
    while span < width + 1:
        step = min(span, width + 1 - span)
        reach = np.maximum(reach[: len(reach) - step], reach[step:])
        span += step
    out = np.empty(n)
    out[order] = reach[:n] + 1
    return out


def plan(x: np.ndarray, n: int, cfg: ProjectionConfig) -> Passes:
    """What ``n`` rows ``x`` of length one would take if all stayed to the end: an estimate for rows at hand in memory.
    ``embedding_near_duplicates`` doesn't use it; there every row is followed by itself."""
    center = x.mean(0) if len(x) else np.zeros(x.shape[1])
    far = np.maximum(np.linalg.norm(x - center, axis=1), 1e-12)
    # seen from the center, a row within reach is at most this angle away
    same = 1 - np.arcsin(np.minimum(1, np.sqrt(2 - 2 * cfg.cosine) / far)) / np.pi
    best, least = Passes(1, max(1, n), center), np.inf
    for window in cfg.candidates(x.shape[1]):
        miss, number = np.ones(len(x)), 0
        while number < cfg.most_passes and (number + 1) * (cfg.row_cost + window) < least:
            miss *= 1 - same ** _depths(Passes(0, 0, center).keys(x, number, cfg), window)
            number += 1
            if not len(x) or miss.max() <= cfg.miss:
                best, least = Passes(number, window, center), number * (cfg.row_cost + window)
                break
    return best


def common_length(vector: Column, df: DataFrame) -> int:
    """The commonest number of components, of equally common ones the greatest; 1 where there is no vector."""
    top = df.select(F.size(vector).alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 1


def _center(classes: DataFrame, n: int, dims: int) -> np.ndarray:
    """The mean of all vectors of length one; its last digits, which hang on the order of adding, are cut off."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims)
        for batch in batches:
            if batch.num_rows:
                total += _unit_rows(batch.column("v")).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total)], names=["d", "s"])

    center = np.zeros(dims)
    for row in classes.select("v").mapInArrow(added, "d long, s double").groupBy("d").agg(F.sum("s").alias("s")).collect():
        center[row["d"]] = row["s"] / max(1, n)
    return center.round(6)


def _keyed(batches: Iterator[pa.RecordBatch], passes: Passes, cfg: ProjectionConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _unit_rows(batch.column("v"))
        for number in passes.all():
            keys = [k.tobytes() for k in passes.keys(x, number, cfg)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), number, np.int32)), pa.array(keys, pa.binary()), batch.column("node")], names=["pass", "key", "node"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(part, at, pass, node, key)``: the partition and the place in it of rows that arrive in order."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *(batch.column(c) for c in ("pass", "node", "key"))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "pass", "node", "key"])
        at += n


def placed(classes: DataFrame, passes: Passes, cfg: ProjectionConfig) -> DataFrame:
    """``(place, pass, node, key)``: every row's place in the order of every pass, one pass after the other."""
    keyed = classes.select("node", "v").mapInArrow(lambda it: _keyed(it, passes, cfg), "pass int, key binary, node long")
    ordered = keyed.repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node").select("pass", "node", "key")
    places = materialize(ordered.mapInArrow(_numbered, "part int, at long, pass int, node long, key binary"), "embdedup-place")
    held = places.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = held.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return places.join(before, "part").select((F.col("before") + F.col("at")).alias("place"), "pass", "node", "key")


def _stretch(window: int, rows: int) -> tuple[int, int]:
    """Places of a stretch, and into how many pieces its windows are cut, so that no task holds more than some three stretches."""
    size = max(256, min(4 * window, rows))
    return size, max(1, -(-window // size))


def windowed(classes: DataFrame, passes: Passes, rows: int, cfg: ProjectionConfig, places: DataFrame | None = None) -> DataFrame:
    """``(stretch, place, pass, node, v)``: every pass's order cut into stretches, each with the ``window`` rows after it;
    a stretch has ``rows`` rows at most, and a wider window comes in pieces that long, each with the stretch anew."""
    size, pieces = _stretch(passes.window, rows)
    place, own = F.col("place"), F.floor(F.col("place") / size)

    def block(at: Column) -> Column:
        return F.greatest(F.lit(0), F.floor(at / size))

    # rows at the start of a stretch also end the one before, where that begins within the window
    near = F.transform(F.sequence(block(place - min(size, passes.window)), own), lambda b: b * pieces)
    # a further piece is met by the rows of the stretches so far before
    k = F.sequence(F.lit(1), F.lit(pieces - 1)) if pieces > 1 else F.array().cast("array<int>")
    mine = F.transform(k, lambda o: own * pieces + o)
    met = F.transform(
        F.filter(k, lambda o: place > o * size),
        lambda o: F.transform(F.sequence(block(place - F.least((o + 1) * size, F.lit(passes.window))), block(place - o * size - 1)), lambda b: b * pieces + o),
    )
    stretches = F.array_distinct(F.concat(near, mine, F.flatten(met))) if pieces > 1 else near
    dealt = (placed(classes, passes, cfg) if places is None else places).select("place", "pass", "node", F.explode(stretches).alias("stretch"))
    return dealt.join(classes.select("node", "v"), "node").select("stretch", "place", "pass", "node", "v")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For both ends of a run, one sign more than they share."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("key", "other"))
        differ = np.unpackbits(a ^ b, axis=1)
        depth = np.where(differ.any(1), differ.argmax(1), differ.shape[1]).astype(np.int32) + 1
        for end in ("node", "last"):
            yield pa.RecordBatch.from_arrays([batch.column(end), batch.column("pass"), batch.column("window"), pa.array(depth)], names=["node", "pass", "window", "depth"])


def depths(places: DataFrame, windows: list[int]) -> DataFrame:
    """``(node, seen)``: for passes and windows, of how many first signs a row must be so that all of the same signs stand
    within the window before and after it. Where both reach over the ends of the order it is 0 and left out."""
    last = places.withColumn("window", F.explode(F.array(*map(F.lit, windows))))
    last = last.select((F.col("place") - F.col("window") - 1).alias("place"), "pass", "window", F.col("node").alias("last"), F.col("key").alias("other"))
    ends = places.join(last, ["place", "pass"]).select("pass", "window", "node", "last", "key", "other")
    signs = ends.mapInArrow(_shared, "node long, pass int, window int, depth int").repartition("node")
    deepest = signs.groupBy("node", "pass", "window").agg(F.max("depth").alias("depth"))
    return deepest.groupBy("node").agg(F.collect_list(F.struct("pass", "window", "depth")).alias("seen"))


#: Logarithms of the normal distribution, from -8 to 8.
_AT = np.linspace(-8, 8, 16385)
_LOG_NORMAL = np.log([math.erfc(-t / math.sqrt(2)) / 2 for t in _AT])


def gains(batches: Iterator[pa.RecordBatch], passes: Passes, windows: list[int], near: float, most: float, cfg: ProjectionConfig) -> Iterator[pa.RecordBatch]:
    """By how much ``passes`` lower the logarithm of each row's miss probability, a row a window, up to what is left of it.

    A row and one at the cosine stand ``near`` to ``most`` from the center, so the angle between them there is at most that
    of a triangle of these sides. How far the row itself stands from each plane is known, so the probability that the
    other stands on the same side is a normal one.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x, far, done = _unit_rows(batch.column("v")), batch.column("far").to_numpy(), batch.column("done").to_numpy()
        reach = 2 - 2 * cfg.cosine
        other = np.clip(np.sqrt(np.maximum(0, far**2 - reach)), near, most)
        cosine = np.clip((far**2 + other**2 - reach) / (2 * far * other), -1, 1)
        steep = cosine / np.sqrt(np.maximum(1e-12, 1 - cosine**2)) / far
        seen = batch.column("seen")
        row = np.repeat(np.arange(n), np.where(seen.is_valid(), seen.value_lengths().fill_null(0), 0).astype(int))
        flat = seen.flatten()
        depth = np.zeros((len(windows), passes.number, n), np.int64)
        which = np.searchsorted(windows, flat.field("window").to_numpy())
        depth[which, flat.field("pass").to_numpy() - passes.first, row] = flat.field("depth").to_numpy()
        gain = np.zeros((len(windows), n))
        for k, number in enumerate(passes.all()):
            top = min(cfg.bits, int(depth[:, k].max()))
            logs = np.interp(np.abs(passes.projected(x, number, cfg, top)) * steep[:, None], _AT, _LOG_NORMAL).cumsum(1)
            # of rows of all the same signs the window cuts some off
            logs = np.hstack([np.zeros((n, 1)), logs, np.full((n, 1), -np.inf)])
            for w in range(len(windows)):
                with np.errstate(divide="ignore"):
                    gain[w] -= np.log1p(-np.exp(logs[np.arange(n), np.where(depth[w, k] > cfg.bits, top + 1, depth[w, k])]))
        for w, window in enumerate(windows):
            columns = [batch.column("node"), batch.column("far"), batch.column("done"), pa.array(np.full(n, window)), pa.array(np.minimum(gain[w], cfg.goal - done))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "far", "done", "window", "gain"])


def sorted_passes(classes: DataFrame, dims: int, cfg: ProjectionConfig) -> DataFrame:
    """``(u, v)``: links between the rows of ``(node, v)`` that windows show, in rounds of passes over the rows not yet below ``miss``.

    A pair meets where both its rows still go on, and a row leaves only when any pair of it has met but for ``miss``, so those
    that go on need not see it. Window and number of passes of a round only weigh its work, by all rows that go on.
    """
    rows, goal = cfg.rows(dims), cfg.goal
    center = _center(classes, classes.count(), dims)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = np.maximum(np.linalg.norm(_unit_rows(batch.column("v")) - center, axis=1), 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(far), pa.array(np.zeros(len(far)))], names=["node", "far", "done"])

    def reckoned(places: DataFrame, passes: Passes, windows: list[int]) -> DataFrame:
        seen = live.select("node", "v", "far", "done").join(depths(places, windows), "node", "left")
        return seen.mapInArrow(lambda it: gains(it, passes, windows, near, most, cfg), "node long, far double, done double, window long, gain double")

    def gain_of(places: DataFrame, passes: Passes, windows: list[int]) -> DataFrame:
        seen = live.select("node", "v", "far", "done").join(depths(places, windows), "node", "left")
        return seen.mapInArrow(lambda it: gains(it, passes, windows, near, most, cfg), "node long, far double, done double, window long, gain double")

    state = materialize(classes.select("node", "v").mapInArrow(started, "node long, far double, done double").withColumn("gain", F.lit(goal)), "embdedup-state")
    first, window, weighed, links = 0, 0, math.inf, classes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    while True:
        seen = state.agg(F.count("*"), F.min("far"), F.max("far"), F.sum(goal - F.col("done")), F.sum("gain")).first()
        n, near, most, left, gained = seen
        if not n:
            return links
        live = classes.join(state, "node")
        number = max(1, math.ceil(min(cfg.round_passes, left / max(gained, 1e-300))))
        places = placed(live, Passes(number, 0, center, first), cfg)

        def need(windows: list[int]) -> dict[int, float]:
            """Passes of each window for what is left, by every row's place in the first of these orders."""
            found = gain_of(places.where(F.col("pass") == first), Passes(1, 0, center, first), windows)
            return {r["window"]: left / max(r["gain"], 1e-300) for r in found.groupBy("window").agg(F.sum("gain").alias("gain")).collect()}

        # the window is weighed anew where half of the rows have left, or where it gains too little for those that stay
        if n < weighed / 2 or n <= rows < weighed or left > cfg.most_passes * gained:
            # few rows that are left can meet all at once
            whole = [max(1, n - 1)] if n <= rows else []
            needed = need(sorted({*cfg.candidates(dims), *whole}))
            if min(needed.values()) > cfg.most_passes:
                wider = [max(needed) * 4]
                while wider[-1] < n - 1:
                    wider.append(wider[-1] * 4)
                needed |= need(wider)
            window = min(needed, key=lambda w: (needed[w] > cfg.most_passes, needed[w] * (cfg.row_cost + min(w, n))))
            number, weighed = min(number, math.ceil(needed[window])), n
        passes = Passes(number, window, center, first)
        places = places.where(F.col("pass") < first + number)
        stretches = windowed(classes, passes, rows, cfg, places).repartition("stretch").sortWithinPartitions("stretch", "place")
        linking = stretches.mapInArrow(lambda it, passes=passes: _linking(it, passes, rows, cfg), "u long, v long")
        links = links.unionByName(materialize(linking, "embdedup-link"))
        after = gain_of(places, passes, [window]).select("node", "far", (F.col("done") + F.col("gain")).alias("done"), (F.col("gain") / number).alias("gain"))
        state = materialize(after.where(F.col("done") < goal * (1 - 1e-12)), "embdedup-state")
        first += number


def _strips(x: np.ndarray, own: np.ndarray, ba: int, bb: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, other rows and which of them are near, strip by strip; every pair of the two blocks comes once."""
    a, b = np.flatnonzero(own == ba), np.flatnonzero(own == bb)
    right = np.ascontiguousarray(x[b].T)
    for k in range(0, len(a), 256):
        rows = a[k : k + 256]
        near = x[rows] @ right >= cosine
        if ba == bb:
            near &= b[None, :] > rows[:, None]
        yield rows, b, near


def _united(label: np.ndarray, rows: np.ndarray, others: np.ndarray, near: np.ndarray) -> None:
    """Gives rows and those near them the least label among them, wherever their labels stand."""
    for k in np.flatnonzero(near.any(1)):
        met = label[np.append(others[near[k]], rows[k])]
        if (met != met[0]).any():
            met = np.unique(met)
            label[np.isin(label, met[1:])] = met[0]


def _linking(batches: Iterator[pa.RecordBatch], passes: Passes, rows_: int, cfg: ProjectionConfig) -> Iterator[pa.RecordBatch]:
    """A star for each component that a stretch's windows show."""
    size, pieces = _stretch(passes.window, rows_)
    for run in runs(batches, ["stretch"]):
        node, number, place, x = run.column("node").to_numpy(), run.column("pass").to_numpy(), run.column("place").to_numpy(), _unit_rows(run.column("v"))
        stretch, piece = divmod(run.column("stretch")[0].as_py(), pieces)
        least, most = piece * size, min((piece + 1) * size, passes.window)
        label, own = np.arange(len(x)), np.searchsorted(place, (stretch + 1) * size)
        for k in range(0, own, 256):
            rows = np.arange(k, min(k + 256, own))
            others = np.arange(np.searchsorted(place, place[k] + least, "right"), np.searchsorted(place, place[rows[-1]] + most, "right"))
            near = x[rows] @ x[others].T >= cfg.cosine
            away = place[others][None, :] - place[rows][:, None]
            near &= (away > least) & (away <= most) & (number[others][None, :] == number[rows][:, None])
            _united(label, rows, others, near)
        moved = np.flatnonzero(label != np.arange(len(x)))
        yield pa.RecordBatch.from_arrays([pa.array(node[label[moved]]), pa.array(node[moved])], names=["u", "v"])


def _counting(batches: Iterator[pa.RecordBatch], cfg: ProjectionConfig) -> Iterator[pa.RecordBatch]:
    names = ["node", "links", "root"]
    for run in runs(batches, ["cluster", "ba", "bb"]):
        node, weight = run.column("node").to_numpy(), run.column("weight").to_numpy()
        x, label, links = _unit_rows(run.column("v")), np.arange(run.num_rows), np.zeros(run.num_rows, np.int64)
        for rows, others, near in _strips(x, run.column("own").to_numpy(), run.column("ba")[0].as_py(), run.column("bb")[0].as_py(), cfg.cosine):
            links[rows] += near @ weight[others]
            links[others] += weight[rows] @ near
            _united(label, rows, others, near)
        keep = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep]), pa.array(node[label][keep])], names=names)


def embedding_near_duplicates(vectors: DataFrame, cfg: ProjectionConfig = ProjectionConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``(vec_id, n_links, component_id, kept)``.

    Vectors are linked where their cosine, in double precision, reaches ``cosine``; pairs
    of one cluster are all found, others but for the ``miss`` of the configuration;
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    id reachable and ``kept`` marks its row. Equal vectors form one class first and count
    as linked with each other. A vector that is null, zero, holds null or non-finite
    components or has another length than the commonest (of equally common ones the
    greatest) links with nothing and is kept. A row of null id has no component, links
    with nothing and is kept. Rows of equal id count as rows of their own in ``n_links``
    and share a component. An empty table gives an empty result; other columns are not read.

    ``vectors`` is read three times and only its classes of equal vectors are written.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    dims = common_length(F.col("v"), rows.where(usable("v")))
    fits = F.col("vec_id").isNotNull() & usable("v") & (F.size("v") == dims)
    # two hashes of 64 bits stand for the vector, whose negative zeros count as zeros
    plain = F.transform("v", lambda x: x + F.lit(0).cast(kind[6:-1]))
    good = rows.where(fits).withColumn("v", plain).select("vec_id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(cfg.seed), "v").alias("b"), "v")
    grouped = good.groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "embdedup-class")
    block = cfg.rows(dims)

    def met(df: DataFrame, keys: list[str]) -> DataFrame:
        filled = join_hot(df, df.groupBy(*keys).agg(F.count("*").alias("n")), keys)
        own = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block)))).cast("int")
        pairs = block_pairs(filled.withColumn("own", own), keys, "n", "node", block)
        return pairs.repartition(*keys, "ba", "bb").sortWithinPartitions(*keys, "ba", "bb")

    clusters = connected_components(sorted_passes(classes, dims, cfg)).withColumnsRenamed({"component": "cluster"})
    blocks = met(clusters.join(classes.select("node", "weight", "v"), "node"), ["cluster"]).select("cluster", "ba", "bb", "own", "node", "weight", "v")
    counted = blocks.mapInArrow(lambda it: _counting(it, cfg), "node long, links long, root long")
    counted = materialize(counted, "embdedup-count")
    degree = counted.groupBy("node").agg(F.sum("links").alias("links"))
    member = join_hot(good.drop("v"), classes.select("a", "b", "node", "weight"), ["a", "b"])
    # an id that stands for rows of several vectors ties their classes together
    ids = member.groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).where("u <> w").select("vec_id", "u")
    tied = member.join(ids, "vec_id").where("node <> u").select("u", F.col("node").alias("v"))
    joined = connected_components(counted.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(tied))
    placed = classes.select("node", "rep", "weight").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    settled = join_hot(placed, least, "component").join(degree, "node", "left")
    settled = settled.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    found = member.select("vec_id", "node").join(settled, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fits).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
