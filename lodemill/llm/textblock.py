"""Words, lines and their hashes for a whole Arrow column at once, in numpy.

A hash is 64 bits wide: a polynomial over random 64-bit values of the bytes, mixed at the end. Equal bytes have equal
hashes; unequal ones collide with probability about 2**-64 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes up to which a block is hashed at once; a longer one (a single long text) in parts of that size.
PART = 1 << 21

#: Bytes of words when white space is the six ASCII characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words that are runs of digits, letters (lower-cased before) and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, other bytes as they are.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.ones(1 << bits, np.uint64)
        for k in range(bits):
            p[1 << k : 2 << k] = p[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
        out.append(p)
    return out[0], out[1]


def _bits(size: int) -> int:
    return max(16, int(size + 1).bit_length())


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of the values of the bytes before each place, each times the base to the power of its place."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers(_bits(len(data)))[0][: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Half-open byte ranges of the texts, with the text each lies in."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n_texts: int):
        self.starts, self.ends, self.text, self.n_texts = starts, ends, text, n_texts
        self.first = np.searchsorted(text, np.arange(n_texts + 1))

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class TextBlock:
    """The texts of a column one after another; nulls are empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lowered: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(pc.cast(column, pa.large_string()), "")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
        self.at = ends - ends[0]
        self.data = LOWERED[data] if lowered else data
        self.n = len(column)
        self._sums: np.ndarray | None = None

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            self._sums = _sums(self.data)
        return self._sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of byte ranges. Memory beyond the result is bounded by PART, whatever the block's length."""
        if len(self.data) <= PART:
            s = self._prefix()
            return mix((s[ends] - s[starts]) * _powers(_bits(len(self.data)))[1][starts])
        if (starts[1:] < starts[:-1]).any():
            order = np.argsort(starts, kind="stable")
            out = np.empty(len(starts), np.uint64)
            out[order] = self.hashes(starts[order], ends[order])
            return out
        out = np.empty(len(starts), np.uint64)
        size = ends - starts
        long = np.flatnonzero(size > PART)
        for i in long.tolist():
            out[i] = self._long(int(starts[i]), int(ends[i]))
        rest = np.flatnonzero(size <= PART) if len(long) else np.arange(len(starts))
        i = 0
        while i < len(rest):
            base = starts[rest[i]]
            j = int(np.searchsorted(starts[rest], base + PART, "left"))
            own = rest[i:j]
            a, b = starts[own] - base, ends[own] - base
            s = _sums(self.data[base : base + b.max()])
            out[own] = mix((s[b] - s[a]) * _powers(_bits(2 * PART))[1][a])
            i = j
        return out

    def _long(self, start: int, end: int) -> np.uint64:
        total, scale = 0, 1
        for at in range(start, end, PART):
            total += int(_sums(self.data[at : min(end, at + PART)])[-1]) * scale
            scale = scale * pow(_BASE, PART, 1 << 64) % (1 << 64)
        return mix(np.array([total % (1 << 64)], np.uint64))[0]

    def words(self, is_word: np.ndarray) -> Spans:
        m = is_word[self.data]
        opens, closes = m.copy(), m.copy()
        if len(m):
            opens[1:] &= ~m[:-1]
            closes[:-1] &= ~m[1:]
            edge = self.at[1:-1]
            edge = edge[(edge > 0) & (edge < len(m))]
            opens[edge] = m[edge]
            closes[edge - 1] = m[edge - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return Spans(starts, ends, np.searchsorted(self.at, starts, "right") - 1 if self.n else starts, self.n)

    def lines(self) -> Spans:
        r"""Parts between \n; an empty text is one empty line."""
        breaks = np.flatnonzero(self.data == 0x0A)
        # One line begins with each text and one after each break.
        starts = np.concatenate([self.at[:-1], breaks + 1])
        text = np.concatenate([np.arange(self.n), np.searchsorted(self.at, breaks, "right") - 1])
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        ends = np.empty(len(starts), np.int64)
        if len(starts):
            ends[:-1] = starts[1:] - 1
            last = np.append(text[1:] != text[:-1], True)
            ends[last] = self.at[text[last] + 1]
        return Spans(starts, ends, text, self.n)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each text."""
        out = np.zeros(self.n, np.int64)
        full = np.flatnonzero(np.diff(self.at))
        if len(full):
            out[full] = np.add.reduceat(per_byte, self.at[full], dtype=np.int64)
        return out


def windows(values: np.ndarray, spans: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n values in a row within one text, and where each begins."""
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(values) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + values[k : k + size]
    inside = np.flatnonzero(spans.text[:size] == spans.text[n - 1 :])
    return mix(total[inside] + np.uint64(n)), inside


def covered(size: int, begins: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Boolean mask of the places that lie in any range."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, begins + length, -1)
    return np.cumsum(steps[:-1]) > 0


def per_text(flags: np.ndarray, spans: Spans) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[spans.first[1:]] - total[spans.first[:-1]]
