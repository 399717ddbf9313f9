"""Spelling variants by a frontier that walks relational tries.

Two words one letter apart share their first half or their last, so each word is read twice, from
the front and from the back, and both walks start behind the half that carries no edit. Words of
one length and direction form tries, one under every half, that are two tables: a row a branching
node with its outgoing edges, and the words that end at nodes. Chains without branches are one
edge with a longer label, so the walk takes as many levels as some half has branching prefixes.
A state ``(word, position, node, edits)`` starts in the trie of its own length, to replace a
letter, and in that of the next shorter words, to lose one; each level joins states that may still
spend their edit with all edges of their nodes, and the others with the one edge that goes on with
their next letter; labels and the letters after them drop most of them at once. Two words part at
the first letter in which they differ, so a state spends its one edit where it leaves its own path.
Of two near words only one finds the other: the longer, or that of the smaller letter. States
that have read their word with one edit are where words end: neighbours.

Tables here grow with the words, and Spark sizes them from packed files or as if no row became many: joins are
hinted to sort both sides, but where the states of a level were counted and are few.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from lettermill.llm.blocks import give_back
from lettermill.operators.components import join_hot
from lettermill.session import materialize

#: bytes of states that are sent to every task rather than that the tries are sorted anew
_FEW = 8 << 20


@dataclass(frozen=True)
class VariantConfig:
    """``letters``: a character class whose maximal runs are words. A word has ``least_length`` code
    points and ``least_count`` occurrences at least. A near word is a word's form where it occurs
    ``ratio`` times as often at least. Of runs whose checksum ``drop_one_in`` divides one letter is lost.
    """

    letters: str = "A-Za-zÀ-ÿ"
    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    drop_one_in: int = 31
    held_words: int = 100_000


def count_words(docs: DataFrame, cfg: VariantConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the words of whole texts; tasks sum what they read before it is dealt by word."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run that is too short stays so
        lower = cfg.letters.replace("A-Z", "")
        run, seen = re.compile(f"[{lower}]{{{cfg.least_length},}}"), Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # bytes.lower() changes A-Z alone
                low = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(run.findall(low)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % cfg.drop_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < cfg.least_length:
                            continue
                    seen[word] += n
                if len(seen) > cfg.held_words:
                    yield told()
                    seen.clear()
        yield told()
        seen.clear()
        give_back()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text") != "")
    counted = rows.mapInArrow(kernel, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.least_count)


def _name(read: Column, size: Column, back: Column, at: Column) -> Column:
    """The node after ``at`` letters, in the trie of words of ``size`` letters read from the front or the back."""
    return F.xxhash64(back, size, F.substr(read, F.lit(1), at))


def _readings(words: DataFrame) -> DataFrame:
    """Each word ``(id, word)`` read from the front and, backwards, from the back."""
    both = F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("read")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("read")))
    read = words.select("id", F.length("word").alias("size"), F.inline(both))
    return read.select("id", "back", "read", "size", F.floor(F.col("size") / 2).cast("int").alias("half"))


def build_trie(readings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges, the same as one row a branching node, and ``(node, back, read)`` where words end.

    An edge is ``(node, first, label, size, child, next)``: its label and the label's first letter and
    length, and the first letters of the child's edges, none where words end. A node has one edge a
    letter, so no row of nodes is larger than the alphabet.
    """
    name = _name(F.col("read"), F.col("size"), F.col("back"), F.col("at"))
    places = readings.select("*", F.explode(F.sequence("half", F.col("size") - 1)).alias("at"))
    located = places.select("id", "back", "at", name.alias("node"), F.ascii(F.substr("read", F.col("at") + 1, F.lit(1))).alias("next"))
    branching = located.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b")).where("a <> b").select("node")
    cuts = join_hot(located.select("id", "back", "at", "node"), branching.hint("merge"), "node").groupBy("id", "back").agg(F.collect_set("at").alias("cuts"))
    stops = F.sort_array(F.array_union(F.array("half", "size"), F.coalesce("cuts", F.expr("cast(array() as array<int>)"))))
    cut = readings.join(cuts.hint("merge"), ["id", "back"], "left").select("back", "read", "size", stops.alias("stops"))
    step = cut.select("*", F.posexplode(F.slice("stops", 1, F.size("stops") - 1)).alias("k", "at")).withColumn("to", F.get("stops", F.col("k") + 1))
    child = _name(F.col("read"), F.col("size"), F.col("back"), F.col("to"))
    edges = step.select(name.alias("node"), F.substr("read", F.col("at") + 1, F.col("to") - F.col("at")).alias("label"), child.alias("child"))
    edges = materialize(edges.distinct(), "trie-edge")
    following = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("next"))
    seen = join_hot(edges, following.hint("merge"), "child", "left")
    table = materialize(seen.select("node", F.substring("label", 1, 1).alias("first"), "label", F.length("label").alias("size"), "child", F.coalesce("next", F.lit("")).alias("next")), "trie")
    nodes = table.groupBy("node").agg(F.collect_list(F.struct(*[c for c in table.columns if c != "node"])).alias("edges"))
    last = readings.select(_name(F.col("read"), F.col("size"), F.col("back"), F.col("size")).alias("node"), "back", F.col("read").alias("near"))
    return table, materialize(nodes, "trie-node"), last


def start(readings: DataFrame) -> DataFrame:
    """The first states ``(word, pos, node, edits, lack)``: each reading at the half it shares with what it
    seeks, once in the trie of its own length and once, lacking a letter, in that of the next shorter words."""
    ways = readings.select("back", F.col("read").alias("word"), "size", F.explode(F.array(F.lit(0), F.lit(1))).alias("lack"))
    size = F.col("size") - F.col("lack")
    half = F.floor(size / 2).cast("int")
    return ways.select("word", half.alias("pos"), _name(F.col("word"), size, F.col("back"), half).alias("node"), F.lit(0).alias("edits"), "lack")


def _reads(at: Column) -> Column:
    """Whether the word goes on with the edge's label from a place on."""
    return F.substr("word", at + 1, F.col("size")) == F.col("label")


def _live(to: Column) -> Column:
    """Something of the word is left that the edge's child goes on with, or nothing is and words end there."""
    left = (to < F.length("word")) & F.contains("next", F.substr("word", to + 1, F.lit(1)))
    return left | ((to == F.length("word")) & (F.col("next") == ""))


def _state(to: Column, edits: int) -> Column:
    return F.struct(to.cast("int").alias("pos"), F.col("child").alias("node"), F.lit(edits).alias("edits"), "lack")


def _moved(states: DataFrame, edges: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """The states after one more edge: of those without an edit over every edge, of the others over their own."""
    pos, own, after = F.col("pos"), F.substr("word", F.col("pos") + 1, F.lit(1)), F.substr("word", F.col("pos") + 2, F.lit(1))
    to, same = pos + F.col("size"), F.col("lack") == 0
    fresh = states.where("edits = 0").select("word", "pos", "lack", "node").hint("broadcast" if few else "merge").join(nodes, "node")
    fresh = fresh.select("word", "pos", "lack", F.inline("edges")).where((F.col("first") == own) | F.when(same, F.col("first") > own).otherwise(F.col("first") == after))
    # where nothing is lacking, the end of the own path is the word itself
    ahead = F.when(_reads(pos) & ((F.col("next") != "") | ~same), _state(to, 0))
    replaced = F.when((F.col("first") > own) & (F.substr("word", pos + 2, F.col("size") - 1) == F.substr("label", F.lit(2))) & _live(to), _state(to, 1))
    # the word is not in the trie of shorter ones, so they may part inside a label: one letter too many there
    longer = F.substr("word", pos + 1, F.col("size") + 1)
    deleted = F.when(~_reads(pos) & (F.length(longer) > F.col("size")) & (F.levenshtein(longer, F.col("label"), 1) == 1) & _live(to + 1), _state(to + 1, 1))
    fresh = fresh.select("word", F.coalesce(ahead, F.when(same, replaced).otherwise(deleted)).alias("s")).where("s is not null").select("word", "s.*")
    # one number names a node's edge, so a row is narrow; an edge is one row, so each task's share of edges is small and
    # is looked up in memory: the many states of a few upper nodes need no sort
    hop = F.xxhash64("node", "first").alias("hop")
    one = edges.select(hop, "label", "size", "child", "next")
    spent = states.where("edits = 1").select("word", "pos", "lack", "node", own.alias("first")).select("word", "pos", "lack", hop)
    spent = spent.hint("broadcast").join(one, "hop") if few else spent.join(one.hint("shuffle_hash"), "hop")
    spent = spent.where(_reads(pos) & _live(to)).select("word", _state(to, 1).alias("s")).select("word", "s.*")
    return fresh.unionByName(spent)


def near_words(words: DataFrame, max_levels: int = 100_000) -> DataFrame:
    """``(word, near)``, both ways round, of all words ``(id, word)`` one inserted, deleted or replaced letter apart."""
    readings = _readings(words)
    edges, nodes, last = build_trie(readings)
    states, done, few = start(readings), [], False
    for _ in range(max_levels):
        seen = Observation()
        moved = _moved(states, edges, nodes, few).observe(seen, F.count("*").alias("n"), F.sum(F.octet_length("word") + 64).alias("size"))
        level = materialize(moved, "variants-level")
        if not seen.get["n"]:
            break
        few = seen.get["size"] <= _FEW
        done.append(level)
        states = level.where("pos < length(word) - if(edits = 0, lack, 0)")
    else:
        raise RuntimeError(f"words not read after {max_levels} levels")
    if not done:
        return words.select("word", F.col("word").alias("near")).limit(0)
    ended = "pos = length(word) - if(edits = 0, lack, 0)"
    stopped = done[0].where(ended)
    for level in done[1:]:
        stopped = stopped.unionByName(level.where(ended))
    found = stopped.select("word", "node").distinct().join(last.hint("merge"), "node")
    # names of nodes are hashes: what they found is confirmed on the words
    found = found.where(F.levenshtein("word", "near") == 1)
    front = [F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "near")]
    found = materialize(found.select(*front).distinct(), "variants-near")
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near")))


def group_variants(docs: DataFrame, cfg: VariantConfig = VariantConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct word: ``(word, form, root, n, n_near, form_n)``.

    ``n`` counts occurrences in all texts, ``n_near`` the words one letter apart. ``form`` is the near
    word of largest ``n``, of equally frequent ones the smallest by code points, if it occurs ``ratio``
    times as often at least; else null. ``root`` follows forms from the word to the last one, and is
    the word itself where it has none.

    A null or empty text has no words; a null id counts as an empty one in checksums. Rows of equal id
    are texts of their own, and repeated rows count each. A run of any length is one word. An empty
    table gives an empty result; other columns are not read.
    """
    counted = materialize(count_words(docs, cfg, id_col, text_col), "variants-word")
    words = materialize(counted.withColumn("id", F.monotonically_increasing_id()), "variants-id")
    near = near_words(words.select("id", "word"))
    sized = join_hot(near, words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    best = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    formed = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.n")).alias("form_n"))
    wins = F.coalesce(F.col("form_n") >= cfg.ratio * F.col("n"), F.lit(False))
    formed = materialize(formed.select("word", "n", "n_near", F.when(wins, F.col("near")).alias("form"), F.when(wins, F.col("form_n")).alias("form_n")), "variants-form")
    # each form is ratio times as frequent, so chains are short and their length doubles a round
    root = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = root.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        seen = Observation()
        jumped = join_hot(root, step.hint("merge"), "root", "left").observe(seen, F.count("__next").alias("moved"))
        root = materialize(jumped.select("word", F.coalesce("__next", "root").alias("root")), "variants-root")
        if not seen.get["moved"]:
            break
    return formed.join(root.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
