"""Postings of documents whose fields are tokens with blanks between, reckoned in Arrow batches: no row a token, no shuffle of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text whose tokens are sorted at once; one document may have more
_BYTES = 8 << 20
#: bytes of blocks that are put in order of term at once; one part may have more
_RUN = 32 << 20


def _offsets(starts: np.ndarray, end: int) -> pa.Array:
    return pa.array(np.append(starts, end).astype(np.int32))


def _by_document(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.Table]:
    """Rows that arrive with equal ids side by side, in tables that hold all rows of their ids and little text."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        ids = batch.column(0)
        # no more tokens than every other letter
        lengths = sum(pc.fill_null(pc.binary_length(batch.column(f)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)
        new = np.ones(len(ids), bool)
        new[1:] = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
        new[0] = not held or held[-1].column(0)[-1].as_py() != ids[0].as_py()
        at = 0
        for k in range(len(ids)):
            if size >= _BYTES and new[k]:
                held.append(table.slice(at, k - at))
                yield pa.concat_tables(held).combine_chunks()
                held, size, at = [], 0, k
            size += int(lengths[k])
        held.append(table.slice(at))
    if held:
        yield pa.concat_tables(held).combine_chunks()


class Tokens:
    """The tokens of a table's rows ``(email_id, ..., fields)`` as sorted numbers: ``term``, ``doc`` (of the table's different
    ids), ``field`` and ``pos``; by document or by term first."""

    def __init__(self, table: pa.Table, fields: list[str], term_first: bool):
        ids = table.column("email_id").combine_chunks() if table.num_rows else pa.array([], pa.string())
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        new = np.ones(len(ids), bool)
        if len(ids) > 1:
            new[1:] = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
        number = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        docs, kinds, places, words = [], [], [], []
        for f, name in enumerate(fields):
            text = table.column(name)
            text = pa.concat_arrays(text.chunks) if text.num_chunks != 1 else text.chunk(0)
            # arrays of their own: none here is a slice of another, and a text without tokens is one empty piece
            lists = pc.split_pattern(pa.array(text.to_pylist(), pa.string()), " ")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            pieces = lists.flatten()
            blank = pc.equal(pieces, "").to_numpy(zero_copy_only=False)
            if blank.any():
                n = n - np.bincount(np.repeat(np.arange(len(n)), n)[blank], minlength=len(n))
                pieces = pieces.filter(pa.array(~blank))
            words.append(pieces)
            docs.append(np.repeat(number, n))
            kinds.append(np.full(n.sum(), f, np.int64))
            places.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        coded = pa.concat_arrays(words).dictionary_encode()
        self.words = coded.dictionary
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc, field, pos = (np.concatenate(x).astype(np.int64) for x in (docs, kinds, places))
        outer, inner = (term, doc) if term_first else (doc, term)
        # one number a group; places follow in order, but where an id has several rows they may not
        key = (outer * (inner.max(initial=0) + 1) + inner) * len(fields) + field
        order = np.argsort(key, kind="stable") if new.all() else np.lexsort((pos, key))
        self.key, self.term, self.doc, self.field, self.pos = key[order], term[order], doc[order], field[order], pos[order].astype(np.int32)

    def starts(self) -> np.ndarray:
        """Where the tokens of one term in one field of one document begin."""
        return np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1])) if len(self.key) else np.zeros(0, np.int64)


def postings(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """``(term, email_id, field, tf, positions)`` of rows ``(email_id, fields)`` that arrive by id."""
    names = pa.array(fields)
    for table in _by_document(batches, fields):
        t = Tokens(table, fields, term_first=False)
        at = t.starts()
        if not len(at):
            continue
        ids = table.column("email_id").take(pa.array(t.first[t.doc[at]])).combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        tf = np.diff(np.append(at, len(t.key)))
        places = pa.ListArray.from_arrays(_offsets(at, len(t.key)), pa.array(t.pos))
        found = pa.RecordBatch.from_arrays([t.words.take(pa.array(t.term[at])), ids, names.take(pa.array(t.field[at])), pa.array(tf), places], names=["term", "email_id", "field", "tf", "positions"])
        for k in range(0, found.num_rows, 20_000):
            yield found.slice(k, 20_000)


def blocks(batches: Iterator[pa.RecordBatch], fields: list[str], weights: dict[str, float], per_part: int, partition: int) -> Iterator[pa.RecordBatch]:
    """Blocks ``(term, part, df, best, email_id, length, field, tf, at, places)`` of rows ``(email_id, length, fields)`` that
    arrive by length and id.

    A block's arrays have an entry for each field of each document; its ``tf`` places stand from ``at`` on in ``places``.

    ``best`` has the weighted counts, with their documents' lengths, that are greater than all in shorter documents: a share in
    a score grows with the count and falls with the length, so one of them has the greatest, whatever the mean length.

    A part has ``per_part`` documents at most, and is closed earlier where its text is long. Parts of a task are
    numbered from ``partition << 33``. Blocks leave in runs of some parts each, in order of term and part.
    """

    def run() -> Iterator[pa.RecordBatch]:
        # one copy is enough: the parts' own are given up first
        whole = pa.concat_tables(held).combine_chunks()
        held.clear()
        order = pc.sort_indices(whole, sort_keys=[("term", "ascending"), ("part", "ascending")])
        for k in range(0, len(order), 5_000):
            yield from whole.take(order[k : k + 5_000]).combine_chunks().to_batches()

    held, size = [], 0
    weight, number = np.array([weights[f] for f in fields]), 0
    for table in _by_document(batches, fields):
        ids = table.column("email_id")
        new = np.append(True, pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy()) if len(ids) > 1 else np.ones(len(ids), bool)
        cuts = np.flatnonzero(new)[::per_part]
        for start, stop in zip(cuts, np.append(cuts[1:], table.num_rows)):
            made = _part(table.slice(start, stop - start), fields, weight, (partition << 33) + number)
            number += 1
            if made is not None:
                held.append(made)
                size += made.nbytes
            if size >= _RUN:
                yield from run()
                size = 0
    if held:
        yield from run()


def _part(table: pa.Table, fields: list[str], weight: np.ndarray, part: int) -> pa.Table | None:
    t = Tokens(table, fields, term_first=True)
    at = t.starts()
    if not len(at):
        return None
    tf = np.diff(np.append(at, len(t.key)))
    term, doc, field = t.term[at], t.doc[at], t.field[at]
    hit = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))
    block = np.flatnonzero(np.append(True, term[hit][1:] != term[hit][:-1]))
    one = lambda c, of: pa.concat_arrays(c.take(pa.array(t.first[of])).chunks)
    f, length = np.add.reduceat(tf * weight[field], hit), one(table.column("length"), doc[hit])
    # a block's hits stand by length; of counts numbered by block and size those above all before them
    counts, size = np.unique(f, return_inverse=True)
    place = np.repeat(np.arange(len(block)), np.diff(np.append(block, len(hit)))) * len(counts) + size
    above = np.append(True, place[1:] > np.maximum.accumulate(place)[:-1])
    best = pa.StructArray.from_arrays([pa.array(f[above]), length.filter(pa.array(above))], names=["f", "length"])
    entry = hit[block]
    listed = lambda c: pa.ListArray.from_arrays(_offsets(entry, len(at)), c)
    first = at - np.repeat(at[entry], np.diff(np.append(entry, len(at))))
    return pa.Table.from_arrays(
        [t.words.take(pa.array(term[entry])), pa.array(np.full(len(block), part)), pa.array(np.diff(np.append(block, len(hit)))),
         pa.ListArray.from_arrays(_offsets(np.cumsum(above)[block] - 1, above.sum()), best), listed(one(table.column("email_id"), doc)), listed(one(table.column("length"), doc)),
         listed(pa.array(field.astype(np.int8))), listed(pa.array(tf.astype(np.int32))), listed(pa.array(first.astype(np.int32))), pa.ListArray.from_arrays(_offsets(at[entry], len(t.key)), pa.array(t.pos))],
        names=["term", "part", "df", "best", "email_id", "length", "field", "tf", "at", "places"],
    )
