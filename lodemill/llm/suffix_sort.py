"""Suffix order with common-prefix values by induced sorting, with queues that live on disk.

``SuffixOrder`` sorts the suffixes of a text by their first ``cap`` characters (beyond that, order is arbitrary) and
gives each its common prefix with the one before it, up to ``cap``:

* Suffixes are of type L or S as they are larger or smaller than the one that follows them; an S whose predecessor is
  L is a seed. Substrings from seed to seed are named in order; names are paired recursively (each level names pairs
  of the level below) until they differ or cover ``cap`` characters. That sorts the seeds.
* From the seeds all L suffixes are induced in rising order, from those all S suffixes in falling order: the
  predecessor of a suffix goes into the queue of its first character. A queue pops by (character, order of arrival).
  Entries are tuples (position, common prefix with the entry before it in the queue); the common prefix of two
  induced suffixes is one more than the least value between their sources. Entries with the same first character are
  handled in bulk.
* Queues keep a bounded number of bytes in memory and append the rest to a temporary file. The text is a file too.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

ENTRY = np.dtype([("pos", "<i8"), ("lcp", "<i2")])
#: Bytes that a queue keeps in memory, and entries that are handled at once.
QUEUE_BYTES = 32 << 20
BATCH = 1 << 18


class DiskQueue:
    """A monotone priority queue keyed by (character, order of arrival)."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.held = limit, 0
        self.parts: dict[int, list] = defaultdict(list)
        self.file = tempfile.TemporaryFile()

    def push(self, key: int, entries: np.ndarray) -> None:
        if len(entries):
            self.parts[key].append(entries)
            self.held += entries.nbytes
            if self.held > self.limit:
                self._spill()

    def _spill(self) -> None:
        at = self.file.seek(0, 2)
        for parts in self.parts.values():
            for k, p in enumerate(parts):
                if isinstance(p, np.ndarray):
                    self.file.write(p.tobytes())
                    parts[k] = (at, len(p))
                    at += p.nbytes
        self.held = 0

    def _load(self, part: np.ndarray | tuple[int, int]) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(part[1] * ENTRY.itemsize), ENTRY)

    def pop(self, key: int) -> Iterator[np.ndarray]:
        """Everything under a key, oldest first, also what is pushed meanwhile."""
        parts = self.parts.get(key, [])
        k = 0
        while k < len(parts):
            block, n = [], 0
            while k < len(parts) and n < BATCH:
                if isinstance(parts[k], np.ndarray):
                    self.held -= parts[k].nbytes
                block.append(self._load(parts[k]))
                n += len(block[-1])
                parts[k] = np.zeros(0, ENTRY)
                k += 1
            block = np.concatenate(block)
            yield from (block[i : i + BATCH] for i in range(0, n, BATCH))
        self.parts.pop(key, None)

    def read(self, key: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """Everything under a key, in blocks; it stays in the queue. Backwards, the last block comes first."""
        parts = list(self.parts.get(key, []))
        while parts:
            block, n = [], 0
            while parts and n < BATCH:
                block.append(self._load(parts.pop(-1 if backwards else 0)))
                n += len(block[-1])
            yield np.concatenate(block[::-1] if backwards else block)

    def close(self) -> None:
        self.file.close()


class SuffixOrder:
    """text: 2 to 257 for bytes, 1 for the end of a string, and 0 once, as the last value."""

    def __init__(self, text: np.ndarray, cap: int, limit: int = QUEUE_BYTES):
        self.t, self.cap, self.limit = text, cap, limit
        self.chars = np.flatnonzero(np.bincount(text, minlength=258)).tolist()

    def _is_s(self) -> np.ndarray:
        """Types, from the next differing character; the last suffix is S."""
        t, n = self.t, len(self.t)
        rises = np.ones(n, bool)
        rises[:-1] = t[:-1] < t[1:]
        differs = np.ones(n, bool)
        differs[:-1] = t[:-1] != t[1:]
        where = np.flatnonzero(differs)
        return rises[where[np.searchsorted(where, np.arange(n))]]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, up to cap, by looking."""
        out = np.zeros(len(a), np.int64)
        alive = np.arange(len(a))
        for k in range(self.cap):
            p, q = a[alive] + k, b[alive] + k
            ok = (p < len(self.t)) & (q < len(self.t))
            alive, p, q = alive[ok], p[ok], q[ok]
            alive = alive[self.t[p] == self.t[q]]
            if not len(alive):
                break
            out[alive] += 1
        return out

    def _seeds(self) -> np.ndarray:
        """Seed positions in suffix order."""
        s = self._is_s()
        at = np.flatnonzero(s[1:] & ~s[:-1]) + 1
        if len(at) < 2:
            return at
        # Names of the substrings from seed to seed, both included: character and type, six values a word.
        end = np.append(at[1:] + 1, len(self.t))
        length = np.minimum(end - at, self.cap + 6)
        name, word = np.zeros(len(at), np.int64), 0
        while True:
            key = np.zeros(len(at), np.int64)
            for j in range(6):
                k = word * 6 + j
                inside = np.flatnonzero(length > k)
                key *= 1024
                key[inside] += 2 * self.t[at[inside] + k].astype(np.int64) + s[at[inside] + k] + 1
            name = self._renamed(name, key)
            word += 1
            if not (length > word * 6).any():
                break
        # Pairs of names, pairs of pairs, ... : level by level.
        step = 1
        while name.max() + 1 < len(at) and step < len(at) and (at[step:] - at[:-step]).min() < self.cap:
            after = np.full(len(at), -1, np.int64)
            after[:-step] = name[step:]
            name = self._renamed(name, after)
            step *= 2
        return at[np.argsort(name, kind="stable")]

    @staticmethod
    def _renamed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        order = np.lexsort((second, first))
        new = np.ones(len(order), np.int64)
        new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    def _induce(self, sources: Iterator[tuple[np.ndarray, bool]], queue: DiskQueue, larger: bool) -> None:
        """Push the predecessors of the sources that are of the wanted type. sources: (entries in order, whether a
        predecessor with an equal first character has the wanted type too)."""
        least = np.zeros(258, np.int64)  # common prefix with the last pushed entry's source; nothing was pushed yet
        for entries, equal in sources:
            pos, lcp = entries["pos"], entries["lcp"].astype(np.int64)
            before = pos - 1
            c, p = self.t[pos].astype(np.int64), self.t[np.maximum(before, 0)].astype(np.int64)
            ok = (before >= 0) & ((p > c if larger else p < c) | ((p == c) & equal))
            whole = lcp.min()
            idx = np.flatnonzero(ok)
            order = np.argsort(p[idx], kind="stable")
            idx = idx[order]
            keys, first = np.unique(p[idx], return_index=True)
            after = np.minimum(least, whole)
            for key, part in zip(keys.tolist(), np.split(idx, first[1:]) if len(keys) else [], strict=True):
                gap = np.minimum.reduceat(lcp, np.concatenate([[0], part[:-1] + 1]))[: len(part)] if len(part) > 1 else np.array([lcp[: part[0] + 1].min()])
                if len(part) > 1:
                    # reduceat runs the last range to the end; it must stop at its own source.
                    gap[-1] = lcp[part[-2] + 1 : part[-1] + 1].min()
                gap[0] = min(gap[0], least[key])
                out = np.empty(len(part), ENTRY)
                out["pos"], out["lcp"] = pos[part] - 1, np.minimum(gap + 1, self.cap)
                tail = lcp[part[-1] + 1 :]
                after[key] = tail.min() if len(tail) else self.cap
                queue.push(key, out)
            least = after

    def _seamed(self, blocks: Iterator[tuple[np.ndarray, bool]]) -> Iterator[tuple[np.ndarray, bool]]:
        """Blocks of sources in order; the first entry of each is compared with the last of the block before."""
        last = None
        for entries, equal in blocks:
            if not len(entries):
                continue
            entries = entries.copy()
            here = entries["pos"][:1]
            entries["lcp"][0] = 0 if last is None else self._common(here, last)[0]
            last = entries["pos"][-1:].copy()
            yield entries, equal

    def ordered(self) -> Iterator[np.ndarray]:
        """Entries (position, common prefix with the one before) of all suffixes in order, in blocks."""
        seeds = self._seeds()
        first_of = self.t[seeds]
        lows, highs = DiskQueue(self.limit), DiskQueue(self.limit)
        done = DiskQueue(self.limit)  # the L suffixes by first character
        seed_lcp = np.zeros(len(seeds), np.int64)
        if len(seeds) > 1:
            for i in range(1, len(seeds), BATCH):
                j = min(len(seeds), i + BATCH)
                seed_lcp[i:j] = self._common(seeds[i:j], seeds[i - 1 : j - 1])

        def rising() -> Iterator[tuple[np.ndarray, bool]]:
            for c in self.chars:
                for entries in lows.pop(c):
                    done.push(c, entries)
                    yield entries, True
                own = np.flatnonzero(first_of == c)
                for i in range(0, len(own), BATCH):
                    k = own[i : i + BATCH]
                    out = np.empty(len(k), ENTRY)
                    out["pos"], out["lcp"] = seeds[k], seed_lcp[k]
                    yield out, False

        self._induce(self._seamed(rising()), lows, larger=True)
        lows.close()
        small = DiskQueue(self.limit)  # the S suffixes by first character, largest first

        def falling() -> Iterator[tuple[np.ndarray, bool]]:
            for c in reversed(self.chars):
                for entries in highs.pop(c):
                    small.push(c, entries)
                    yield entries, True
                for entries in done.read(c, backwards=True):
                    # Read from the other side, a value belongs to the pair with the entry after it.
                    out = entries[::-1].copy()
                    out["lcp"][1:] = entries["lcp"][::-1][:-1]
                    yield out, False

        last = np.zeros(1, ENTRY)
        last["pos"] = len(self.t) - 1  # the final end is S and nobody's predecessor
        highs.push(0, last)
        self._induce(self._seamed(falling()), highs, larger=False)
        highs.close()

        def blocks() -> Iterator[tuple[np.ndarray, bool]]:
            for c in self.chars:
                for entries in done.read(c):
                    yield entries, True
                for entries in small.read(c, backwards=True):
                    out = entries[::-1].copy()
                    out["lcp"][1:] = entries["lcp"][::-1][:-1]
                    yield out, True

        for entries, _ in self._seamed(blocks()):
            yield entries
        done.close()
        small.close()


def later_repeats(text: np.ndarray, length: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """Positions in text at which a string of ``length`` characters begins that also begins earlier, sorted.

    Strings that hold an end (1 or 0) never count.
    """
    if len(text) <= length:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(text <= 1)
    found, run_min, run = [], -1, []

    def close(run: list[np.ndarray], least: int) -> None:
        if run:
            every = np.concatenate(run)
            found.append(every[every != least])

    for entries in SuffixOrder(text, length, limit).ordered():
        pos = entries["pos"]
        starts = np.flatnonzero(entries["lcp"] < length)
        head = pos[: starts[0]] if len(starts) else pos
        if len(head):
            run.append(head)
            run_min = min(run_min, int(head.min()))
        if not len(starts):
            continue
        close(run if len(run) > 1 or len(run[0]) > 1 else [], run_min) if run else None
        bounds = np.append(starts, len(pos))
        size = np.diff(bounds)
        least = np.minimum.reduceat(pos, starts)
        # All runs but the last are complete; runs of one are nobody's repeat.
        body = slice(starts[0], starts[-1])
        of = np.repeat(np.arange(len(starts) - 1), size[:-1])
        found.append(pos[body][pos[body] != least[:-1][of]])
        run, run_min = [pos[starts[-1] :]], int(least[-1])
    close(run, run_min)
    out = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return out[ends[np.searchsorted(ends, out)] >= out + length]
