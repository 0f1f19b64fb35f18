"""Words of many texts at once, as arrays over one byte buffer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: What separates words: space and the five controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all their bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def polynomial(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``values``, by position within the run; ``lengths`` are the runs' (none empty)."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(values)) - np.repeat(begins, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15 | 1, np.uint64))
    sums = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * powers[place], begins)
    return mix(sums ^ lengths.astype(np.uint64))


@dataclass
class Words:
    """The words of ``texts`` (null: none): runs of bytes that are not white space, never across two texts."""

    texts: list[str | None]

    def __post_init__(self):
        raw = [(t or "").encode() for t in self.texts]
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        self.buffer = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        self.begins = np.cumsum(sizes) - sizes  # of texts; each is followed by one line feed of our own
        space = SPACE[self.buffer]
        edge = np.diff(space.astype(np.int8), prepend=1, append=1)
        self.space = space
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.text = np.searchsorted(self.begins, self.starts, "right") - 1
        self.counts = np.bincount(self.text, minlength=len(self.texts))
        self.first = np.cumsum(self.counts) - self.counts  # of each text, its first word

    @cached_property
    def letters(self) -> np.ndarray:
        """The bytes of all words one after another."""
        return self.buffer[~self.space]

    @cached_property
    def hashes(self) -> np.ndarray:
        return polynomial(self.letters, self.ends - self.starts)

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first words and the hashes of all runs of ``size`` words within a text."""
        h = self.hashes if hashes is None else hashes
        n = len(h) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return at, mix(total[at])
