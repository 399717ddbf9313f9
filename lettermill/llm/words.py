"""Word splitting and shingle hashing shared by the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHED_WORDS = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def forget_words() -> None:
    """Frees the remembered hashes, at the end of a task: workers live on, and others use their memory."""
    _hashes.clear()


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(32))) * _MIX
    return v ^ (v >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``width``-word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of fewer words
    has its whole word sequence as one shingle; one of none, or null, has no shingle.
    """
    # bytes.lower() changes A-Z alone and bytes.split() cuts at exactly these blanks
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out + h[k : n - size + 1 + k])
    return np.unique(out)
