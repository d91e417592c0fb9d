"""Code points and words of a batch of texts as NumPy arrays, so that statistics over many
documents are a few array passes rather than a Python step for each word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point of the basic plane and one for all above: is it a letter?"""
    return np.array([chr(i).isalpha() for i in range(0xFFFF)] + [True])


@lru_cache(1)
def upper_table() -> np.ndarray:
    return np.array([chr(i).isupper() for i in range(0xFFFF)] + [False])


class TextBatch:
    """``points``: the code points of all texts, each text followed by a line end;
    ``start``, ``size``: where each text's points are."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.fromiter(map(len, texts), np.int64, self.n)
        self.start = np.concatenate(([0], np.cumsum(self.size + 1)))[:-1].astype(np.int64)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value for each point over each text."""
        if not self.n:
            return np.zeros(0)
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return total[self.start + self.size] - total[self.start]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of points where ``inside`` holds: start, stop, number of the text.  The
        line end after each text must be outside."""
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        return start, stop, np.searchsorted(self.start, start, side="right") - 1

    def letters(self) -> np.ndarray:
        return letter_table()[np.minimum(self.points, 0xFFFF)]

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the points of each range."""
        n = len(self.points)
        power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE))))
        inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE_INVERSE))))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * power[:n])))
        h = (sums[stop] - sums[start]) * inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))
