"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import pyarrow as pa


class WordCache(dict):
    """Results by word, in two generations: when the young one is full it becomes the old one, so frequent words stay."""

    def __init__(self, make: Callable[[str], object], size: int = 500_000, longest: int = 48):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def batches_of_text(texts: list[str], chars: int = 500_000):
    """Runs of whole texts with about so many characters, as (first, texts); a longer text comes alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


_BREAK = re.compile(r"[\t-\r ]")
#: Characters of a text whose features are made at a time (arrays of them take some tens of bytes a character).
PIECE_CHARS = 2_000_000


def pieces_of(text: str, chars: int = PIECE_CHARS):
    """The whole text in pieces of at most ``chars`` characters, cut at white space where there is some."""
    at = 0
    while len(text) - at > chars:
        cut = next((i for i in range(at + chars, at, -1) if _BREAK.match(text, i)), at + chars)
        yield text[at:cut]
        at = cut
    yield text[at:]


def release_unused() -> None:
    """Gives memory back to the system that a fit on the driver has freed; allocators would keep it, beside the JVM, while the application runs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
