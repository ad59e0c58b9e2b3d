"""Hashed word and character n-gram features of whole texts, computed on arrays of code points."""

from __future__ import annotations

import numpy as np

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint32(salt * 0x3C6EF372 & 0xFFFFFFFF)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(15))


class Grams:
    """Words of a run of texts, and their features. White space is \\t to \\r and the space.

    ``word_doc`` is the text of each word; ``gram(n)`` gives the hash and the word of every n-gram
    that begins and ends inside a word or on the mark at either side of it.
    """

    def __init__(self, texts: list[str]):
        big = " " + " ".join(texts) + " "
        c = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        space = (c == 32) | ((c >= 9) & (c <= 13))
        self.codes = np.where(space, np.uint32(1), c)
        self.space = space
        first = ~space
        first[1:] &= space[:-1]
        self.starts = np.flatnonzero(first)
        self.word_of = (np.cumsum(first) - 1).astype(np.int32)  # of a character inside a word
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.word_doc = np.searchsorted(ends, self.starts, side="left") if len(texts) else np.zeros(0, int)
        self.n_docs = len(texts)

    def gram(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        c, m = self.codes, len(self.codes) - n + 1
        if m <= 0 or not len(self.starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int32)
        h = np.zeros(m, dtype=np.uint32)
        ok = np.ones(m, dtype=bool)
        for k in range(n):
            h += (c[k : k + m] + np.uint32(k)) * _ODD[k]
            if 0 < k < n - 1:
                ok &= ~self.space[k : k + m]
        inside = 1 if n > 2 else 0
        if n <= 2:
            ok &= ~self.space[:m]
        at = np.flatnonzero(ok)
        return _mixed(h[at], n), self.word_of[at + inside]

    def words(self) -> np.ndarray:
        """A hash of every word."""
        if not len(self.starts):
            return np.zeros(0, np.uint32)
        place = (np.arange(len(self.codes), dtype=np.uint32) - self.starts.astype(np.uint32)[np.maximum(self.word_of, 0)]) * np.uint32(2) + np.uint32(1)
        h = (self.codes + np.uint32(7)) * _ODD[0]
        h = ((h ^ (h >> np.uint32(13))) * _ODD[1] ^ place * _ODD[2]) * _ODD[3]
        h[self.space] = 0
        return _mixed(np.add.reduceat(h, self.starts, dtype=np.uint32), 11)

    def pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of every two neighbouring words of a text, and its first word; a word and itself hash alike whatever the word."""
        at = np.flatnonzero(self.word_doc[1:] == self.word_doc[:-1])
        a, b = words[at], words[at + 1]
        return np.where(a == b, np.uint32(0x5BD1E995), _mixed(a * _ODD[0] + b * _ODD[4], 23)), at
