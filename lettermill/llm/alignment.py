"""Alignment of two tokenizers' ids over the same bytes.

Each document is encoded twice, and the byte offsets where tokens end become dictionaries
from end to index. The ends that both have, a hash-set intersection, are sorted and slice
both id lists into groups; each group ends in one link, the tokens of either side that end
there together. Both tokenizers cut a text at some places whatever stands around them; what
lies between two such places is aligned by itself, and a worker remembers the groups of
parts that it has met. How often an id pair is linked is counted over the whole corpus: documents
lie in blocks of a bounded number of links, a block's links are summed before anything is
shuffled, and the counts of a block's pairs go back to the block's documents once.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lettermill.llm.blocks import give_back, segments
from lettermill.llm.pieces import PieceEncoder
from lettermill.llm.tokens import _BETWEEN, _BYTE_LETTERS, _LETTERS, _SAFE, Encoder, Remembered
from lettermill.operators.components import join_hot
from lettermill.session import materialize


@dataclass(frozen=True)
class AlignConfig:
    """``byte_path``: a byte-level vocabulary of the tokenizers library (A), which reads a space and
    the text. ``piece_path``: a sentencepiece model (B), which adds the space itself.

    ``remembered`` bounds the parts of a generation, of two at most, whose groups a worker keeps.
    ``window``: bytes whose ends are in dictionaries at once, so that a very long text needs no
    large ones. ``block_links``: links of a block, counted together; a longer document is a block.
    """

    byte_path: str
    piece_path: str
    remembered: int = 300_000
    window: int = 1 << 18
    block_links: int = 1 << 19


def _shared(index_a: dict[int, int], index_b: dict[int, int]) -> tuple[list[int], list[int]]:
    ends = sorted(index_a.keys() & index_b.keys())
    return [index_a[e] for e in ends], [index_b[e] for e in ends]


def common_ends(ends_a: list[int], ends_b: list[int], window: int) -> tuple[list[int], list[int]]:
    """How many tokens of each list lie before each common end, ascending; both lists of ends ascend.

    At most ``window`` bytes have their ends in the dictionaries at once."""
    if not ends_a or ends_a[-1] <= window:
        return _shared(dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1))))
    cuts_a: list[int] = []
    cuts_b: list[int] = []
    a = b = 0
    for stop in range(window, ends_a[-1] + window, window):
        a_stop, b_stop = bisect_right(ends_a, stop), bisect_right(ends_b, stop)
        more_a, more_b = _shared(dict(zip(ends_a[a:a_stop], range(a + 1, a_stop + 1))), dict(zip(ends_b[b:b_stop], range(b + 1, b_stop + 1))))
        cuts_a, cuts_b, a, b = cuts_a + more_a, cuts_b + more_b, a_stop, b_stop
    return cuts_a, cuts_b


#: letters with the space before them, other characters likewise; an apostrophe stays with the letters it leads
_PARTS = re.compile(f" ?[{_LETTERS}]+| ?[^{_LETTERS} ]*'[{_LETTERS}]+| ?[^{_LETTERS} ]+| ")
_BLANKS = re.compile(r"\s\s")
#: a part's groups written out, its links as codes, and its numbers of tokens; None where bytes differ
Part = tuple[str, bytes, int, int] | None


class Aligner:
    """Both tokenizers with the bytes and the decimal form of every id; made once a worker process."""

    def __init__(self, cfg: AlignConfig):
        self.cfg, self.a, self.b = cfg, Encoder(cfg.byte_path, specials_as_text=True, remembered=1), PieceEncoder(cfg.piece_path)
        byte_of = {letter: bytes([b]) for b, letter in _BYTE_LETTERS.items()}
        entries = self.a.tok.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes_a[k] = b"".join(byte_of.get(x, x.encode()) for x in entry)
        self.bytes_b = self.b.token_bytes
        self.names = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.sizes_a, self.sizes_b = ([len(x) for x in table] for table in (self.bytes_a, self.bytes_b))
        self.width, self.space = len(self.bytes_b), _BYTE_LETTERS[32]
        self.known = Remembered(self._part, cfg.remembered)
        parts = self.b.has_parts and self.a.parts is not None and self.a.lead == " "
        self.at_spaces = parts and self.b.never_joins("[^ ] ")
        self.at_letters = self.at_spaces and self.b.never_joins(f"[{_LETTERS}][^{_LETTERS} ]|[^{_LETTERS} '][{_LETTERS}]")

    def _part(self, part: str) -> Part:
        word = part.lstrip(" ")
        if part.isascii() and word.isalpha():  # one part for the byte-level tokenizer too
            ids_a = [t.id for t in self.a.tok.model.tokenize(self.space * (len(part) - len(word)) + word)]
        else:
            ids_a = np.frombuffer(self.a.encode(part), self.a.dtype).tolist()
        return self._aligned(part, ids_a, self.b.part(part))

    def _aligned(self, text: str, ids_a: list[int], ids_b: list[int]) -> Part:
        want = text.encode()
        if b"".join([self.bytes_a[x] for x in ids_a]) != want or b"".join([self.bytes_b[x] for x in ids_b]) != want:
            return None
        ends_a, ends_b = list(accumulate([self.sizes_a[x] for x in ids_a])), list(accumulate([self.sizes_b[x] for x in ids_b]))
        shown_a, shown_b = [self.names[x] for x in ids_a], [self.names[x] for x in ids_b]
        groups, links, i, j = [], array("q"), 0, 0
        for x, y in zip(*common_ends(ends_a, ends_b, self.cfg.window)):
            groups.append(f"{','.join(shown_a[i:x])}|{','.join(shown_b[j:y])}")
            links.append(ids_a[x - 1] * self.width + ids_b[y - 1])
            i, j = x, y
        return ";".join(groups), links.tobytes(), len(ids_a), len(ids_b)

    def align(self, text: str | None) -> tuple[int, int, str, np.ndarray] | None:
        """``(n_a, n_b, groups, links)`` of a text, links as codes ``a * width + b``; None where it has no tokens."""
        if not text:
            return None
        spaced = " " + text
        if self.at_letters and _SAFE.fullmatch(text) and not _BLANKS.search(spaced):
            parts = _PARTS.findall(spaced)
        elif self.at_spaces:
            first, *rest = _BETWEEN.split(spaced)
            parts = [first, *(" " + x for x in rest)]
        else:
            parts = []
        self.known.age()
        found = list(map(self.known.__getitem__, parts)) or [self._aligned(spaced, np.frombuffer(self.a.encode(spaced), self.a.dtype).tolist(), self.b.encode(text))]
        if None in found:
            return None
        groups, links, n_a, n_b = zip(*found)
        return sum(n_a), sum(n_b), ";".join(groups), np.frombuffer(b"".join(links), "<i8")


_aligners: dict[AlignConfig, Aligner] = {}


def _aligner(cfg: AlignConfig) -> Aligner:
    if cfg not in _aligners:
        _aligners[cfg] = Aligner(cfg)
    return _aligners[cfg]


_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, codes binary, times binary"


def align(docs: DataFrame, cfg: AlignConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_a, n_b, n_groups, n_links, groups, block, codes, times)``.

    ``groups`` writes the groups out, ``a1,a2|b1;a3|b2,b3``. ``codes`` holds the distinct linked id
    pairs, ascending, as little-endian 64-bit ``a * width + b`` with B's vocabulary as width, and
    ``times`` how many links of the document hold each; ``block`` deals documents for ``count_links``.

    A null or empty text, and one whose tokens of either side don't spell a space and the text, has
    no tokens: counts of 0 and empty strings. Strings of special tokens are ordinary text. Rows of equal
    or null id each have their row. An empty table gives an empty result; other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, links = _aligner(cfg), TaskContext.get().partitionId() << 33, 0
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part, rows = batch.slice(at, 100), []
                for text in part.column(1):
                    found = aligner.align(text.as_py())
                    if found is None:
                        rows.append((0, 0, 0, 0, "", block, b"", b""))
                        continue
                    n_a, n_b, groups, ends = found
                    if links and links + len(ends) > cfg.block_links:
                        block, links = block + 1, 0
                    links += len(ends)
                    codes, times = np.unique(ends, return_counts=True)
                    rows.append((n_a, n_b, len(ends), len(ends), groups, block, codes.astype("<i8").tobytes(), times.astype("<i8").tobytes()))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)
        aligner.known.settle()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, _SCHEMA)


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(block, code, n)``: the links of neighbouring rows of one block, each pair once."""

    def summed(block: int, codes: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        distinct, where = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(where, np.concatenate(times), len(distinct)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), pa.array(distinct), pa.array(n)], names=["block", "code", "n"])

    own, codes, times, held = 0, [], [], 0
    for new, part in segments(batches, ["block"]):
        if held and (new or held > 1 << 21):
            yield summed(own, codes, times)
            codes, times, held = [], [], 0
        own = part.column("block")[0].as_py()
        codes += [np.frombuffer(x.as_buffer(), "<i8") for x in part.column("codes")]
        times += [np.frombuffer(x.as_buffer(), "<i8") for x in part.column("times")]
        held = sum(map(len, codes))
    if held:
        yield summed(own, codes, times)


def count_links(aligned: DataFrame, width: int) -> DataFrame:
    """``aligned (…, block, codes, times)`` with ``n_best`` and ``count_sum``, and without ``block``, ``codes`` and ``times``.

    An id pair's count is the number of links of all rows that hold it; ``count_sum`` sums it over a
    row's links, ``n_best`` counts links of the highest count that their B id has, ties included.
    """
    table = materialize(aligned, "align")
    pairs = materialize(table.where("octet_length(codes) > 0").select("block", "codes", "times").mapInArrow(_summing, "block long, code long, n long"), "align-pair")
    total = pairs.groupBy("code").agg(F.sum("n").alias("total")).withColumn("b", F.col("code") % width)
    counted = total.join(total.groupBy("b").agg(F.max("total").alias("most")), "b").select("code", "total", (F.col("total") == F.col("most")).alias("best"))
    looked = join_hot(pairs.select("block", "code"), counted, "code")
    kept = [c for c in table.columns if c not in ("block", "codes", "times")]
    none = lambda c: F.lit(None).cast(table.schema[c].dataType).alias(c)
    known = looked.select("block", F.lit(0).alias("__kind"), "code", "total", "best", none("codes"), none("times"), *map(none, kept))
    asked = table.select("block", F.lit(1).alias("__kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("code", "long"), ("total", "long"), ("best", "boolean"))], "codes", "times", *kept)
    met = known.unionByName(asked).repartition("block").sortWithinPartitions("block", "__kind")
    schema = table.select(*kept, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        code = total = best = np.zeros(0, np.int64)
        for _, part in segments(batches, ["block", "__kind"]):
            if part.column("__kind")[0].as_py() == 0:
                parts.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("code", "total", "best")))
                continue
            if parts:  # what a block's documents look up comes before them
                code, total, best = map(np.concatenate, zip(*parts))
                order = np.argsort(code, kind="stable")
                code, total, best, parts = code[order], total[order], best[order].astype(np.int64), []
            n_best, count_sum = [], []
            for c, t in zip(part.column("codes"), part.column("times")):
                at, n = np.searchsorted(code, np.frombuffer(c.as_buffer(), "<i8")), np.frombuffer(t.as_buffer(), "<i8")
                n_best.append(int((best[at] * n).sum()))
                count_sum.append(int((total[at] * n).sum()))
            columns = [part.column(c) for c in kept] + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum"])

    return met.mapInArrow(kernel, schema)


def align_tokenizers(docs: DataFrame, cfg: AlignConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` with ``n_best`` and ``count_sum`` of ``count_links``; awkward rows as ``align`` says."""
    return count_links(align(docs, cfg, id_col, text_col), PieceEncoder(cfg.piece_path).width)
