"""Tokenising whole texts with the tokenizers library, part by remembered part.

A BPE model sees a text part by part: its pre-tokenizer cuts the text into runs of letters,
digits, other signs and blanks, and ids never reach over such a cut. Where a text holds
only characters that every Unicode table classes alike, one pattern finds the same parts.
Each worker remembers, under a bound and from task to task, the ids of the parts it has met and asks the library's
model for the rest. Texts with other characters go piece by blank-separated piece, those
with strings of added tokens go whole. Other kinds of tokenizer encode each text directly.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import groupby

import numpy as np

#: parts of a generation, of two at most, unless told otherwise; one takes some 300 bytes, longer ones are not kept
_REMEMBERED = 100_000
_LONGEST = 64
#: letters that no normaliser recomposes and that lower-case to one letter of their own
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ɏ"
_SIGNS = r"!-/:-@\[-`{-~‐-―‘-„…"
_SAFE = re.compile(f"[{_LETTERS}{_SIGNS}0-9 \t\n\r]*")
_CLITICS = "'(?:s|t|re|ve|m|ll|d)"
#: the parts of such a text, by kind of pre-tokenizer
_BYTE_PARTS = re.compile(rf" ?[{_LETTERS}]+|{_CLITICS}| ?[0-9]+| ?[{_SIGNS}]+|\s+(?!\S)|\s+")
_WORD_PARTS = re.compile(f"[{_LETTERS}]+|{_CLITICS}|[0-9]|[{_SIGNS}]+")
#: a blank with a word on either side: no part of a text reaches over it
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTE_LETTERS = {b: x for b, x in enumerate(_byte_letters())}


class Remembered(dict):
    """What was found for strings, in two generations: what is used again moves to the young one, the rest goes."""

    def __init__(self, find, bound: int):
        super().__init__()
        self.find, self.bound, self.old = find, bound, {}

    def __missing__(self, x: str) -> bytes:
        ids = self.old.get(x)
        if ids is None:
            ids = self.find(x)
            if len(x) > _LONGEST:
                return ids
        self[x] = ids
        return ids

    def age(self) -> None:
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()

    def settle(self) -> None:
        """Keeps the younger half, at the end of a task."""
        self.old = {}


class Encoder:
    """Encodes texts to little-endian ids of ``dtype``, as ``Tokenizer.from_file(path)`` does without
    special tokens around them; ``specials_as_text`` takes strings of special tokens as ordinary text.
    ``remembered`` bounds the parts of a generation, of two at most, whose ids are kept."""

    def __init__(self, path: str, specials_as_text: bool = False, remembered: int | None = None):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = specials_as_text
        self.tok.no_padding()
        self.tok.no_truncation()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model, added = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, spec.get("added_tokens") or []
        #: texts that hold one of these are encoded whole: an added token also cuts its neighbours
        self.added = [a["content"] for a in added if not (specials_as_text and a["special"])]
        plain = all(a["special"] and not a["normalized"] for a in added)
        if plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer"):
            self.parts, self.lead = _BYTE_PARTS, " "
        elif plain and model.get("end_of_word_suffix") == "</w>":
            self.parts, self.lead = _WORD_PARTS, ""
        else:
            self.parts = None
            return
        self.known = Remembered(self._part, remembered or _REMEMBERED)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _direct(self, text: str) -> bytes:
        return self._bytes(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _part(self, x: str) -> bytes:
        shown = x if x.isascii() and x.isalnum() else x.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return self._bytes([t.id for t in self.tok.model.tokenize(shown)])

    def _safe(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.parts.findall(text if self.lead else text.lower())))

    def encode(self, text: str) -> bytes:
        if self.parts is None or any(a in text for a in self.added):
            return self._direct(text)
        self.known.age()
        if _SAFE.fullmatch(text):
            return self._safe(text)
        first, *rest = text.split(" ") if "  " not in text else _BETWEEN.split(text)
        pieces = [first, *(self.lead + x for x in rest)]
        out = []
        for safe, run in groupby(pieces, lambda x: _SAFE.fullmatch(x) is not None):
            own = ("" if self.lead else " ").join(run)
            out.append(self._safe(own) if safe else self._direct(own))
        return b"".join(out)


def settle_encoders() -> None:
    """Keeps of what encoders remember the younger half, at the end of a task."""
    for known in _encoders.values():
        if known.parts is not None:
            known.known.settle()


_encoders: dict[tuple[str, bool, int | None], Encoder] = {}


def encoder(path: str, specials_as_text: bool = False, remembered: int | None = None) -> Encoder:
    """One encoder a file, and way with special tokens, and bound, and worker process."""
    key = (path, specials_as_text, remembered)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
