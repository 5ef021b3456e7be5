"""Hashes of a text's words and word shingles, for whole texts at once in numpy.

A word's hash is a polynomial of its bytes modulo 2^64, from differences of one running sum over the
text, then mixed. Texts are handled in slices of about ``SLICE`` bytes that end at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_tables: list[np.ndarray] = []

#: Byte tables: A-Z to a-z, and white space (or all ASCII that is no letter or digit) to blanks.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\v\f\r" else b for b in range(256))
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        made = []
        for b in (BASE, inverse):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _tables[:] = made
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slices(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > 2 * SLICE and (end := raw.find(b" ", at + SLICE)) >= 0:
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


def word_hashes(text: bytes | None, table: bytes = LOWER) -> np.ndarray:
    """The hash of each word, in order; equal words have equal hashes in every text."""
    out = []
    for raw in _slices((text or b"").translate(table)):
        buf = np.frombuffer(b"".join((b" ", raw, b" ")), dtype=np.uint8)
        space = buf == 32
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not len(edges):
            continue
        power, inverse = _powers(len(buf))
        sums = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)])
        start, end = edges[0::2], edges[1::2]
        out.append(mix((sums[end - 1] - sums[start - 1]) * inverse[start]))
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, dtype=np.uint64), *out])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` words in a row, repeats included; all words, where there are fewer; none for none."""
    if not len(words):
        return words
    out = np.zeros(max(1, len(words) - size + 1), dtype=np.uint64)
    for i in range(min(size, len(words))):
        out = out * np.uint64(BASE) + words[i : i + len(out)]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending; a sort and a comparison are several times faster than ``np.unique``."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def strung(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The parts of flat with these starts and counts, in a row."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Alike:
    """Which of some sets are alike: near(x, free) gives those of ``free`` whose Jaccard similarity with x is enough.

    Elements are numbered once; a set is then compared with all that are left in a few passes over
    their numbers.
    """

    def __init__(self, sets: list[np.ndarray], least: float):
        self.least, self.size = least, np.array([len(x) for x in sets], dtype=np.int64)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(codes, np.cumsum(self.size)[:-1])
        self.mark = np.zeros(int(codes.max(initial=-1)) + 1, dtype=bool)
        self._gather(np.arange(len(sets)))

    def _gather(self, members: np.ndarray) -> None:
        self.members = members
        self.flat = np.concatenate([self.sets[i] for i in members]) if len(members) else np.zeros(0, dtype=np.int64)
        self.ends = np.cumsum(self.size[members])

    def near(self, x: int, free: np.ndarray) -> np.ndarray:
        if 2 * len(free) < len(self.members):
            self._gather(free)
        self.mark[self.sets[x]] = True
        sums = np.r_[0, np.cumsum(self.mark[self.flat])]
        self.mark[self.sets[x]] = False
        shared = sums[self.ends] - sums[self.ends - self.size[self.members]]
        alike = shared >= self.least * (self.size[self.members] + self.size[x] - shared)
        return np.intersect1d(self.members[alike], free, assume_unique=True)
