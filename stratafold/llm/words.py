"""Words of a text as numbers."""

from __future__ import annotations

import numpy as np

from stratafold.llm.anchors import gram_hashes, mix

_BASE = 0x100000001B3
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; grown as needed and kept."""
    if len(_POWERS.get(base, ())) < n:
        x = np.full(max(n, 1 << 17), base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


class Words:
    """The words of a text: their bytes with single blanks between, and where each begins."""

    def __init__(self, text: bytes):
        self.joined = b" ".join(text.split())
        data = np.frombuffer(self.joined, np.uint8)
        self.begin = np.concatenate([[0], np.flatnonzero(data == 32) + 1]) if len(data) else np.zeros(0, np.int64)
        self.end = np.concatenate([self.begin[1:] - 1, [len(data)]]) if len(data) else self.begin

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self) -> np.ndarray:
        """One number for each word, equal for equal words."""
        data = np.frombuffer(self.joined, np.uint8).astype(np.uint64) + np.uint64(1)
        if not len(data):
            return np.zeros(0, np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * _powers(_BASE, len(data)), out=total[1:])
        back = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
        return mix((total[self.end] - total[self.begin]) * back[self.begin])

    def piece(self, first: int, words: int) -> bytes:
        return self.joined[self.begin[first] : self.end[first + words - 1]]


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of all words, if they are fewer; empty without words."""
    hashes = Words(text.lower()).hashes()
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, min(size, len(hashes))) + np.uint64(min(size, len(hashes))))
