"""Words and word shingles of Arrow text columns as 64-bit hashes, in numpy.

A word's hash is a polynomial over random byte values modulo 2^64, mixed; a
shingle's is a mix of its words' hashes. Hash equality stands for equality of
words throughout (two of n different shingles share a hash with a chance of
about n^2 / 2^65).
"""

from __future__ import annotations

import numpy as np

from catalogspark.llm.frames import raw

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _fold_case(values: np.ndarray) -> np.ndarray:
    values = values.copy()
    values[65:91] = values[97:123]
    return values


_VALUES = _fold_case(mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95)))

#: Bytes that separate words: white space of ASCII.
BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Bytes that separate words: ASCII but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            run = np.full(size, base, U)
            run[0] = 1
            _powers[i] = np.cumprod(run)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of a text column: `hashes` of all words in order; `first[i]` to
    `first[i + 1]` are those of value i; `starts`, `ends` are byte positions in
    `data`. ASCII capitals count as small letters."""

    def __init__(self, array, separators: np.ndarray):
        data, at = raw(array)
        self.data, self.at = data, at
        inside = ~separators[data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        edges = at[:-1][at[:-1] < at[1:]]  # first bytes of texts that have any
        before[edges] = False
        if len(edges):
            after[edges[1:] - 1] = False
            after[-1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, at)
        power, inverse = _power(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_VALUES[data] * power[:-1] if len(data) else np.zeros(0, U), out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(U))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """-> (hashes, first): the runs of `size` words within each value, in order;
        `first` as of words."""
        return runs(self.hashes, self.first, size)


def runs(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - size + 1
    counts = np.maximum(np.diff(first) - size + 1, 0)
    start = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=start[1:])
    if n <= 0 or not start[-1]:
        return np.zeros(0, U), np.zeros(len(counts) + 1, np.int64)
    both = sequence([hashes[k : k + n] for k in range(size)])
    keep = np.ones(n, bool)
    # a run that begins in the last words of a value would leave it
    for k in range(1, size):
        late = first[1:] - k
        late = late[(late >= first[:-1]) & (late < n)]
        keep[late] = False
    return both[keep], start


def sequence(words: list[np.ndarray]) -> np.ndarray:
    """Hash of the words at equal places of the arrays, taken in order."""
    total = np.full(len(words[0]), len(words), U)
    for word in words:
        total = mix(total * U(0x2545F4914F6CDD1D) + word)
    return total


def sets(words: Words, size: int) -> list[np.ndarray]:
    """The distinct shingles of each value, ascending; a value of fewer words,
    but not none, has its whole sequence as its one shingle."""
    hashes, first = words.shingles(size)
    out = []
    for i in range(len(first) - 1):
        if first[i + 1] > first[i]:
            out.append(np.unique(hashes[first[i] : first[i + 1]]))
        else:
            own = words.hashes[words.first[i] : words.first[i + 1]]
            out.append(sequence([own[k : k + 1] for k in range(len(own))]) if len(own) else own)
    return out
