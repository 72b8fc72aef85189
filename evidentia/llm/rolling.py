"""Words, word hashes and rolling hashes over many documents at once, in numpy.

Words are maximal runs of bytes other than space and the controls 9 to 13. A rolling hash of n words is put
together from those of powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

from evidentia.llm.common import ship

ship(__name__)

CHUNK_BYTES = 1 << 20


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def mix(a, b):
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def chunked(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Documents in groups of about a megabyte, so that memory follows the longest text and not the batch."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK_BYTES):
            size += len(texts[j] or "")
            j += 1
        yield ids[i:j], [words(t) for t in texts[i:j]]
        i = j


class Doc:
    """The words of several documents in a row: hashes, the document of each word and its place there."""

    def __init__(self, docs: list[list[bytes]]):
        self.sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.n = int(self.starts[-1])
        self.made: dict = {}
        self.powers = {1: np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(docs)), dtype=np.uint64, count=self.n)}

    def of_power(self, p: int):
        if p not in self.powers:
            h = self.of_power(p // 2)
            self.powers[p] = mix(h[: max(0, len(h) - p // 2)], h[p // 2 :])
        return self.powers[p]

    def grams(self, size: int):
        """Hash of the words [i, i + size) for every i at which that many follow, over borders of documents too."""
        if size in self.made:
            return self.made[size]
        n = max(0, self.n - size + 1)
        out, at = None, 0
        for bit in range(size.bit_length() - 1, -1, -1):
            if size >> bit & 1:
                part = self.of_power(1 << bit)[at : at + n]
                out = part if out is None else mix(out, part)
                at += 1 << bit
        self.made[size] = out
        return out

    def inside(self, size: int):
        """The places i where the words [i, i + size) lie in one document."""
        room = np.maximum(self.sizes - size + 1, 0)
        total = int(room.sum())
        base = np.repeat(self.starts[:-1] - np.concatenate([[0], np.cumsum(room)])[:-1], room)
        return np.arange(total) + base

    def doc_at(self, places):
        return np.searchsorted(self.starts, places, side="right") - 1


def leftmost_min(values, width: int):
    """For every window of `width` values the place of its smallest, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        m = len(best) - step
        later = best[step:] < best[:m]
        at = np.where(later, at[step:], at[:m])
        best = np.where(later, best[step:], best[:m])
        size += step
    return at[:n]
