"""License scans by conditional compression.

A notice that differs from a template in few words has some run of the template's words
unchanged. Those runs, looked up among all words of a text and across lines, tell candidate
blocks. A block is compressed alone and with every template as a raw zstandard dictionary, and
the templates are ranked by the bytes that they save. The first of them whose whole wording,
but for few words that are missing or replaced, stands in the block is its license; the
reduction is that of the notice alone, whatever stands around it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

#: The customary wording of short license notices. ``*`` stands for any words.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "All-rights-reserved": "All rights reserved.",
}


@dataclass(frozen=True)
class LicenseConfig:
    """A template may lack ``changes`` of its words, and as many others may stand between
    them; it must shrink the notice found by ``reduction``."""

    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    reduction: float = 0.2
    changes: float = 0.1


_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*", re.UNICODE)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _extend(want: list[str], got: list[str], limit: int) -> list[tuple[list[str], list[str], int]]:
    """Ways to read all of ``want`` from the start of ``got``: words missing, others instead (``limit`` of each at most), words read."""
    ends, seen, open_ = [], set(), [(0, 0, (), ())]
    while open_:
        i, j, missing, extra = open_.pop()
        while i < len(want) and j < len(got) and want[i] == got[j]:
            i, j = i + 1, j + 1
        if i == len(want):
            ends.append((list(missing), list(extra), j))
        elif (i, j, len(missing)) not in seen:
            seen.add((i, j, len(missing)))
            if len(missing) < limit:
                open_.append((i + 1, j, (*missing, want[i]), extra))
            if len(extra) < limit and j < len(got):
                open_.append((i, j + 1, missing, (*extra, got[j])))
    return ends


class Scanner:
    """Templates with their dictionaries, and the runs of words one of which each notice has."""

    def __init__(self, cfg: LicenseConfig):
        self.cfg = cfg
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.words = {k: words(t) for k, t in cfg.templates.items()}
        self.given = {
            k: zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for k, w in self.words.items()
        }
        self.limit = {k: int(cfg.changes * len(w)) for k, w in self.words.items()}
        self.runs: dict[str, list[tuple[str, int, list[str]]]] = defaultdict(list)
        self.rare = set()
        for k, want in self.words.items():
            # so many missing words and so many others leave one of these runs whole
            n = min(len(want), 2 * self.limit[k] + 1)
            cuts = [len(want) * i // n for i in range(n + 1)]
            for a, b in zip(cuts, cuts[1:]):
                self.runs[want[a]].append((k, a, want[a:b]))
                self.rare.add(max(want[a:b], key=len))

    def place(self, own: list[str], at: int, template: str, a: int, run: list[str]) -> tuple | None:
        """``(changed, start, end, missing, extra)`` of the best reading around a run of the template at ``at``."""
        want, limit, b = self.words[template], self.limit[template], a + len(run)
        end, best = at + len(run), None
        after = _extend(want[b:], own[end : end + len(want) - b + limit], limit)
        for m, e, n in _extend(want[:a][::-1], own[max(0, at - a - limit) : at][::-1], limit) if after else ():
            for m2, e2, n2 in after:
                missing, extra = m[::-1] + m2, e[::-1] + e2
                key = (max(len(missing), len(extra)), len(missing) + len(extra), n + n2)
                if key[0] <= limit and (best is None or key < best[0]):
                    best = (key, (key[0], at - n, end + n2, missing, extra))
        return best and best[1]

    def saved(self, raw: bytes) -> dict[str, int]:
        """The bytes that each template as a dictionary saves."""
        size = len(self.plain.compress(raw))
        return {name: size - len(given.compress(raw)) for name, given in self.given.items()}

    def ranked(self, own: list[str], places: list[tuple]) -> Iterator[tuple]:
        """``(start, end, license, missing, extra)`` of the winners of every block of overlapping places.

        Of the templates ranked by what they save of the block the first with a place there wins; of
        equal ones that of fewest changes, then the longest. What doesn't overlap it is a block again.
        """
        blocks: list[list[tuple]] = []
        for place in sorted(places, key=lambda p: p[2:4]):
            if blocks and place[2] < max(p[3] for p in blocks[-1]):
                blocks[-1].append(place)
            else:
                blocks.append([place])
        while blocks:
            block = blocks.pop()
            a, b = min(p[2] for p in block), max(p[3] for p in block)
            saved = self.saved(" ".join(own[a:b]).encode("utf-8", "replace"))
            changed, length, start, end, name, missing, extra = min(block, key=lambda p: (-saved[p[4]], *p))
            raw = " ".join(own[start:end]).encode("utf-8", "replace")
            if self.saved(raw)[name] >= self.cfg.reduction * len(self.plain.compress(raw)):
                yield start, end, name, missing, extra
                rest = [p for p in block if p[3] <= start or p[2] >= end]
            else:
                rest = [p for p in block if p[2:5] != (start, end, name)]
            if rest:
                blocks.append(rest)

    def scan(self, text: str) -> list[tuple]:
        """``(line, block, license, plain, conditional, reduction, missing, extra)`` of every notice of a text."""
        low = text.lower()
        if not any(w in low for w in self.rare):
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        own = [text[a:b].lower() for a, b in spans]
        found = {}
        for at, word in enumerate(own):
            for name, a, run in self.runs.get(word, ()):
                if own[at : at + len(run)] == run:
                    got = self.place(own, at, name, a, run)
                    if got:
                        changed, start, end, missing, extra = got
                        found[name, start, end] = (changed, -len(self.words[name]), start, end, name, missing, extra)
        out = []
        for start, end, name, missing, extra in self.ranked(own, list(found.values())):
            raw = " ".join(own[start:end]).encode("utf-8", "replace")
            size, with_it = len(self.plain.compress(raw)), len(self.given[name].compress(raw))
            first, last = spans[start][0], spans[end - 1][1]
            while first and not text[first - 1].isspace() and (start == 0 or first > spans[start - 1][1]):
                first -= 1
            while last < len(text) and not text[last].isspace() and (end == len(spans) or last < spans[end][0]):
                last += 1
            out.append((text.count("\n", 0, first), text[first:last], name, size, with_it, 1 - with_it / size, missing, extra, start))
        return [x[:-1] for x in sorted(out, key=lambda x: x[-1])]


_SCHEMA = (
    "doc_id long, line int, block string, license string, plain_bytes int, conditional_bytes int, "
    "reduction double, missing array<string>, extra array<string>, exact boolean"
)


def scan_licenses(docs: DataFrame, cfg: LicenseConfig = LicenseConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice, at its place in the text: ``(doc_id, line, block, license, plain_bytes,
    conditional_bytes, reduction, missing, extra, exact)``; ``exact`` means no word differs.

    ``line`` is where the notice starts and ``block`` its text, over as many lines as it takes;
    the sizes are those of its lower-case words. Letter case, line breaks and signs don't count.
    Whole texts are read; a null or empty one, or one without notices, gives no rows. Rows of
    equal or null id each give theirs. An empty table gives an empty result. Other columns
    are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(cfg)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += [(doc, *found, not found[6] and not found[7]) for found in scanner.scan(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.where(F.col("text") != "").mapInArrow(kernel, _SCHEMA)
