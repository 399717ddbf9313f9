"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turns, and
ends with the assistant. Each turn of a conversation is kept, merged into the message
before it, or given another role, and empty messages may be put in; a shortest path over
the automaton of legal turns picks the cheapest way.

The path is found block by block: all turns are range-sorted and cut into blocks by their
place, a block of turns is a matrix of least costs from state to state, matrices of a
conversation are chained, and each block is then solved between its own two states. So no
task holds a whole conversation, however long, and equal or missing turn numbers change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lettermill.llm.blocks import runs, segments, whole
from lettermill.session import materialize

ROLES = ["system", "user", "assistant"]
START, SYSTEM, USER, ASSISTANT = range(4)
_FOREVER = 1 << 40


@dataclass(frozen=True)
class ChatConfig:
    """Costs of the repairs; ``unknown`` is that of naming a null or foreign role.

    ``block_turns``: turns of a block at most. ``before, after``: the marks of a rendered message.
    """

    merge: int = 1
    relabel: int = 3
    unknown: int = 1
    insert: int = 4
    block_turns: int = 4096
    joiner: str = "\n\n"
    before: str = "<|{role}|>\n"
    after: str = "\n<|end|>\n"


@dataclass(frozen=True)
class Step:
    """One way to take a turn: the states around it, its cost, its role, and the empty message before it."""

    source: int
    target: int
    cost: int
    role: int
    merged: bool
    inserted: int | None


def steps(cfg: ChatConfig) -> list[list[Step]]:
    """The ways to take a turn, for each given role (system, user, assistant, any other)."""
    out: list[list[Step]] = []
    for given in range(4):
        ways = []
        for role in (SYSTEM, USER, ASSISTANT):
            name = 0 if role == given + 1 else cfg.unknown if given == 3 else cfg.relabel
            for source in range(4):
                if source == role:
                    ways.append(Step(source, role, name + cfg.merge, role, True, None))
                follows = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
                if source in follows[role]:
                    ways.append(Step(source, role, name, role, False, None))
                elif role == USER and source == USER:
                    ways.append(Step(source, role, name + cfg.insert, role, False, ASSISTANT))
                elif role == ASSISTANT and source != USER:
                    ways.append(Step(source, role, name + cfg.insert, role, False, USER))
        out.append(ways)
    return out


def _forward(given: np.ndarray, entry: int, ways: list[list[Step]]) -> tuple[list[int], list[int], list[list[Step | None]]]:
    """Least cost and messages opened to reach each state from ``entry``, and the last step of each turn."""
    cost = [_FOREVER] * 4
    cost[entry] = 0
    opened, back = [0] * 4, []
    for g in given:
        new, n, last = [_FOREVER] * 4, [0] * 4, [None] * 4
        for w in ways[g]:
            c = cost[w.source] + w.cost
            if c < new[w.target]:
                new[w.target], last[w.target] = c, w
                n[w.target] = opened[w.source] + (not w.merged) + (w.inserted is not None)
        cost, opened = new, n
        back.append(last)
    return cost, opened, back


def _matrices(batches: Iterator[pa.RecordBatch], cfg: ChatConfig) -> Iterator[pa.RecordBatch]:
    ways = steps(cfg)
    for run in runs(batches, ["conv", "known", "block"]):
        given = run.column("given").to_numpy()
        got = [_forward(given, s, ways) for s in range(4)]
        columns = [run.column(k)[:1].combine_chunks() for k in ("conv", "known", "block")]
        columns += [pa.array([sum((g[k] for g in got), [])], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "known", "block", "costs", "opened"])


def _placed(batches: Iterator[pa.RecordBatch], cfg: ChatConfig) -> Iterator[pa.RecordBatch]:
    """Each turn's block, numbered in order within its conversation, and its place in the block."""
    first, at = TaskContext.get().partitionId() << 32, 0
    for new, part in segments(batches, ["conv", "known"]):
        at = 0 if new else at
        places = np.arange(at, at + part.num_rows)
        at += part.num_rows
        columns = [part.column("conv"), part.column("known"), pa.array(first + places // cfg.block_turns), pa.array(places % cfg.block_turns), part.column("given"), part.column("text")]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "known", "block", "place", "given", "text"])


def _chained(batches: Iterator[pa.RecordBatch], cfg: ChatConfig) -> Iterator[pa.RecordBatch]:
    """The states around each block on the cheapest way, for many conversations at once."""
    for table in whole(batches, "conv"):
        costs, opened = (table.column(k).combine_chunks().flatten().to_numpy().reshape(-1, 4, 4) for k in ("costs", "opened"))
        conv, known, n = table.column("conv").to_numpy(), table.column("known").to_numpy(), table.num_rows
        start = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])))
        blocks = np.diff(np.append(start, n))
        back = np.zeros((n, 4), np.int64)
        total = np.tile([0, _FOREVER, _FOREVER, _FOREVER], (len(start), 1))
        open_ = np.arange(len(start))
        for k in range(int(blocks.max())):
            open_ = open_[blocks[open_] > k]
            ways = total[open_][:, :, None] + costs[start[open_] + k]
            back[start[open_] + k] = ways.argmin(1)
            total[open_] = ways.min(1)
        state = (total + np.array([0, 2 * cfg.insert, cfg.insert, 0])).argmin(1)
        entry, leave = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(int(blocks.max()) - 1, -1, -1):
            on = np.flatnonzero(blocks > k) if k else np.arange(len(start))
            rows = start[on] + k
            leave[rows] = state[on]
            state[on] = entry[rows] = back[rows, state[on]]
        count = opened[np.arange(n), entry, leave]
        before = np.cumsum(count) - count
        first = before - np.repeat(before[start], blocks)
        last = np.zeros(n, bool)
        last[start + blocks - 1] = True
        columns = [table.column(k).combine_chunks() for k in ("conv", "known", "block")]
        columns += [pa.array(entry.astype(np.int32)), pa.array(leave.astype(np.int32)), pa.array(first), pa.array(last)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "known", "block", "entry", "leave", "first", "last"])


def _solved(batches: Iterator[pa.RecordBatch], cfg: ChatConfig) -> Iterator[pa.RecordBatch]:
    ways = steps(cfg)
    names = ["conv", "known", "message", "piece", "role", "text", "turns", "relabelled", "cost"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    for run in runs(batches, ["conv", "known", "block"]):
        given, texts = run.column("given").to_numpy(), run.column("text").to_pylist()
        conv, known, entry, state, first, last = (run.column(k)[0].as_py() for k in ("conv", "known", "entry", "leave", "first", "last"))
        block = run.column("block")[0].as_py()
        leave = state
        back = _forward(given, entry, ways)[2]
        path = []
        for at in range(len(given) - 1, -1, -1):
            path.append(back[at][state])
            state = path[-1].source
        message, out = first - 1, []
        for g, text, step in zip(given, texts, reversed(path)):
            changed = int(g + 1 != step.role)
            cost = step.cost
            if step.inserted is not None:
                message += 1
                out.append([conv, known, message, block, ROLES[step.inserted - 1], [], 0, 0, cfg.insert])
                cost -= cfg.insert
            if step.merged and out:
                out[-1][5].append(text)
                out[-1][6:] = [out[-1][6] + 1, out[-1][7] + changed, out[-1][8] + cost]
            else:
                message += not step.merged
                out.append([conv, known, message, block, ROLES[step.role - 1], [text], 1, changed, cost])
        if last:
            for role in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(leave, ()):
                message += 1
                out.append([conv, known, message, block, ROLES[role - 1], [], 0, 0, cfg.insert])
        for row in out:
            row[5] = cfg.joiner.join(t or "" for t in row[5])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def format_chats(turns: DataFrame, cfg: ChatConfig = ChatConfig(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message of each repaired conversation: ``(conv_id, message, role, text, n_turns,
    n_relabelled, cost, rendered)``, ``message`` from 0 in order; ``rendered`` pieces make the whole.

    No turn is dropped. Turns are taken in order of turn number, null ones first, and
    equal ones by role and a hash of the text. Roles are compared in lower case without blanks
    around; a null or other role is named at the cost of ``unknown``. A null text counts as
    empty and is kept. An inserted message has ``n_turns`` 0. Of several cheapest ways the one
    whose last steps come first in ``steps`` is taken. Rows of null conversation are one
    conversation, which is null in the result. An empty table gives an empty result.
    Other columns are not read.
    """
    role = F.lower(F.trim(F.col(role_col)))
    given = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), role), F.lit(0)).cast("int")
    conv = F.col(conv_col).cast("long")
    rows = turns.select(
        # a null conversation takes the least number, and a flag of its own beside it
        F.coalesce(conv, F.lit(-(2**63))).alias("conv"), conv.isNotNull().cast("int").alias("known"), F.col(turn_col).cast("long").alias("turn"),
        F.when(given == 0, 3).otherwise(given - 1).alias("given"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"), F.rand(7).alias("tie"),
    )
    order = ["conv", "known", "turn", "given", "mark", "tie"]  # the last one only parts rows that are equal
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "known", "given", "text")
    placed = materialize(ranged.mapInArrow(lambda it: _placed(it, cfg), "conv long, known int, block long, place long, given int, text string"), "chat")
    keys = ["conv", "known", "block"]
    schema = "conv long, known int, block long, costs array<bigint>, opened array<bigint>"
    # small rows that are dear to work on: dealt to a number of tasks that adaptive execution leaves alone
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = placed.select(*keys, "place", "given").repartition(tasks, *keys).sortWithinPartitions(*keys, "place")
    matrices = light.mapInArrow(lambda it: _matrices(it, cfg), schema).repartition(tasks, "conv").sortWithinPartitions(*keys)
    ends = matrices.mapInArrow(lambda it: _chained(it, cfg), "conv long, known int, block long, entry int, leave int, first long, last boolean")
    solved = placed.join(ends, keys).repartition(*keys).sortWithinPartitions(*keys, "place")
    schema = "conv long, known int, message long, piece long, role string, text string, turns int, relabelled int, cost long"
    pieces = solved.select("conv", "known", "block", "given", "text", "entry", "leave", "first", "last").mapInArrow(lambda it: _solved(it, cfg), schema)
    joined = pieces.groupBy("conv", "known", "message").agg(
        F.first("role").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), cfg.joiner).alias("text"),
        F.sum("turns").alias("n_turns"),
        F.sum("relabelled").alias("n_relabelled"),
        F.sum("cost").alias("cost"),
    )
    mark = lambda text: F.replace(F.lit(text), F.lit("{role}"), F.col("role"))
    return joined.select(
        F.when(F.col("known") == 1, F.col("conv")).alias("conv_id"), "message", "role", "text", "n_turns", "n_relabelled", "cost",
        F.concat(mark(cfg.before), "text", mark(cfg.after)).alias("rendered"),
    )
