"""External suffix sorting by induction, with common prefixes.

A text is an array of symbols in which 0 ends each string (ends differ from one another: no match crosses one).
Suffixes are S-type (smaller than their right neighbour) or L-type; S* are the S-types after an L-type. S* substrings are
named in order, the string of names is sorted by recursion, and from the sorted S* suffixes two sweeps over the
symbols induce all L-types (upwards), then all S-types (downwards). A sweep is a monotone priority queue: one
first-in-first-out queue of (place, common prefix) tuples for each symbol, read in symbol order while later symbols
fill. Queues, text and types lie in files beyond ``memory`` entries. The common prefix of two suffixes
induced one after the other is one more than the least of those between their sources.

Prefixes are counted to ``cap`` at most. Recursion ends where the names are few enough to be ranked in memory.
"""

from __future__ import annotations

import os
import uuid

import numpy as np

BLOCK = 1 << 20


class Queue:
    """First-in-first-out (place, prefix) tuples; full chunks go to a file, each at a known offset."""

    def __init__(self, store: Store):
        self.store, self.chunks, self.read = store, [], 0

    def put(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(pos):
            self.chunks.append(self.store.keep(pos, lcp))

    def _joined(self, chunks):
        got = [self.store.load(c) for c in chunks]
        return got[0] if len(got) == 1 else tuple(np.concatenate(x) for x in zip(*got))

    def _groups(self, chunks):
        """Runs of chunks of about ``BLOCK`` tuples: small ones are read together."""
        group, n = [], 0
        for c in chunks:
            group.append(c)
            n += c[1] if isinstance(c[0], int) else len(c[0])
            if n >= BLOCK:
                yield group
                group, n = [], 0
        if group:
            yield group

    def take(self):
        """What has come in, up to about ``BLOCK`` tuples, or None."""
        group = next(self._groups(self.chunks[self.read:]), None)
        if group is None:
            return None
        self.read += len(group)
        return self._joined(group)

    def all(self):
        """All tuples in order, some at a time."""
        for group in self._groups(self.chunks):
            yield self._joined(group)

    def back(self):
        """All tuples, the last ones first; each block in its order."""
        for group in self._groups(reversed(self.chunks)):
            yield self._joined(group[::-1])

    def __len__(self):
        return len(self.chunks)


class Store:
    """Where queues keep their chunks: in memory up to ``memory`` tuples, then in one file of ``folder``."""

    def __init__(self, folder: str | None, memory: int):
        self.memory, self.folder, self.used, self.file = memory, folder, 0, None

    def keep(self, pos, lcp):
        if self.folder is None or self.used + len(pos) <= self.memory:
            self.used += len(pos)
            return pos, lcp
        if self.file is None:
            os.makedirs(self.folder, exist_ok=True)
            self.path = os.path.join(self.folder, f"queue-{uuid.uuid4().hex}")
            self.file = open(self.path, "w+b")
        at = self.file.seek(0, 2)
        self.file.write(pos.astype("<i8").tobytes())
        self.file.write(lcp.astype("<i4").tobytes())
        return at, len(pos)

    def load(self, chunk):
        if not isinstance(chunk[0], int):
            return chunk
        at, n = chunk
        self.file.seek(at)
        raw = self.file.read(12 * n)
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i4", n, 8 * n)

    def close(self):
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)
            self.file = None


def on_disk(a: np.ndarray, folder: str | None, memory: int) -> np.ndarray:
    if folder is None or len(a) <= memory:
        return a
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"array-{uuid.uuid4().hex}")
    a.tofile(path)
    m = np.memmap(path, a.dtype, "r")
    os.unlink(path)                             # the mapping keeps the bytes until it is dropped
    return m


def types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is S-type, starts of runs of equal symbols)."""
    starts = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])
    up = np.concatenate([t[starts[1:]] > t[starts[:-1]], [True]])
    return np.repeat(up, np.diff(np.concatenate([starts, [len(t)]]))), starts


def doubling(t: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``t`` by their first ``depth`` symbols at least (ranks in memory)."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    n, h = len(t), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        nxt = np.zeros(n, np.int64)
        nxt[:n - h] = rank[h:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key)
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank, h = new, 2 * h
        if rank[order[-1]] == n - 1:
            break
    return order


def names(t: np.ndarray, is_s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the S* substrings that start at ``at``, in their order; ends of strings get names of their own,
    first and by place. Symbols are compared with their type, so no substring begins another one."""
    n = len(at)
    stop = np.concatenate([at[1:], [len(t) - 1]])           # the next S*, included
    ends = t[at] == 0
    name = np.zeros(n, np.int64)
    order, depth = np.flatnonzero(~ends), 0
    group, base = np.zeros(len(order), np.int64), 2 * (int(t.max(initial=0)) + 2)
    at_once = 2 if n * base * base < 1 << 62 else 1
    while len(order):                           # a group is a run of equal beginnings in ``order``
        key = group
        for d in range(depth, depth + at_once):
            p = at[order] + d
            q = np.minimum(p, len(t) - 1)
            key = key * base + np.where(p <= stop[order], t[q].astype(np.int64) * 2 + is_s[q] + 1, 0)
        s = np.argsort(key)
        order, k = order[s], key[s]
        group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        depth += at_once
        if not (at[order] + depth <= stop[order]).any():
            break
    name[ends] = np.arange(ends.sum())
    name[order] = group + int(ends.sum())
    return name


class Sorted:
    """Suffixes of ``t``: ``lists()`` yields (places, prefix with the one before), ascending."""

    def __init__(self, t: np.ndarray, cap: int, ends: np.ndarray | None = None, raw: bytes | None = None,
                 folder: str | None = None, memory: int = 1 << 23):
        """``raw``: a byte for each symbol of ``t``, by which prefixes of S* suffixes are counted; without it they are
        not needed and stay 0. ``ends``: places of the 0 symbols."""
        self.cap, self.store = cap, Store(folder, memory)
        is_s, self.starts = types(t)
        self.n = len(t)
        star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
        reduced = names(t, is_s, star)
        if len(star) <= memory or len(star) > self.n // 2:
            order = doubling(reduced, cap)
        else:
            # names are symbols from 1 on; the last string end closes the string of names
            inner = Sorted(np.concatenate([reduced + 1, [0]]), cap, folder=folder, memory=memory)
            order = np.concatenate([p for p, _ in inner.lists()])
            inner.close()
            order = order[order < len(star)]
        del reduced
        self.t, self.is_s = on_disk(t, folder, memory), on_disk(is_s, folder, memory)
        seeds = star[order]
        lcp = np.zeros(len(seeds), np.int32) if raw is None else self._prefixes(seeds, raw, ends)
        self.symbols = np.unique(t)
        self._sweep_up(seeds, lcp)
        self._sweep_down()

    def _prefixes(self, seeds, raw, ends):
        """Common prefix of each sorted S* suffix with the one before, eight bytes at a time."""
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        left = ends[np.searchsorted(ends, seeds)] - seeds
        room = np.minimum(np.minimum(left[1:], left[:-1]), self.cap)
        lcp = np.zeros(len(seeds), np.int32)
        live = np.flatnonzero(room > 0)
        depth = 0
        while len(live):
            x = words[seeds[live] + depth] ^ words[seeds[live + 1] + depth]
            same = np.full(len(live), 8)
            off = x != 0
            low = x[off] & (~x[off] + np.uint64(1))
            same[off] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
            got = np.minimum(depth + same, room[live])
            lcp[live + 1] = got
            live = live[(same == 8) & (got < room[live])]
            depth += 8
        return lcp

    def _run(self, p: int) -> int:
        """Equal symbols from place ``p`` on."""
        k = np.searchsorted(self.starts, p, side="right")
        return int((self.starts[k] if k < len(self.starts) else self.n) - p)

    def _induce(self, pos, lcp, want_s: bool, queues: dict, since: dict) -> None:
        """Put the left neighbours of the wanted type into the queues of their symbols."""
        for lo in range(0, len(pos), BLOCK):
            p, c = pos[lo:lo + BLOCK], lcp[lo:lo + BLOCK]
            q = p - 1
            at = np.flatnonzero((q >= 0) & (self.is_s[np.maximum(q, 0)] == want_s))
            sym = self.t[q[at]]
            by = np.argsort(sym, kind="stable")
            sym, at = sym[by], at[by]
            cut = np.concatenate([[0], np.flatnonzero(sym[1:] != sym[:-1]) + 1, [len(sym)]]) if len(sym) else [0]
            whole, seen = int(c.min()), set()
            for a, b in zip(cut, cut[1:]):
                d, idx = int(sym[a]), at[a:b]
                seen.add(d)
                tail = idx[-1] + 1 < len(c)
                m = np.minimum.reduceat(c, np.concatenate([[0], idx + 1] if tail else [[0], idx[:-1] + 1]))
                between = m[:len(idx)].astype(np.int32)
                between[0] = min(int(between[0]), since.get(d, -1))
                since[d] = int(m[-1]) if tail else self.cap
                queues.setdefault(d, Queue(self.store)).put(q[idx], np.minimum(between + 1, self.cap).astype(np.int32))
            for d in since:
                if d not in seen:
                    since[d] = min(since[d], whole)

    def _sweep_up(self, seeds, lcp) -> None:
        self.l_types, since = {}, {}
        first = self.t[seeds]
        cuts = np.searchsorted(first, self.symbols), np.searchsorted(first, self.symbols, side="right")
        for c, a, b in zip(self.symbols.tolist(), *cuts):
            queue, last = self.l_types.get(c), None
            while queue is not None and (got := queue.take()) is not None:
                last = int(got[0][-1])
                self._induce(*got, False, self.l_types, since)
            if a < b:
                part = lcp[a:b].copy()
                part[0] = 0 if last is None else min(self._run(last), self._run(int(seeds[a])), self.cap)
                self._induce(seeds[a:b], part, False, self.l_types, since)

    def _sweep_down(self) -> None:
        self.s_types, since = {}, {}
        for c in self.symbols[::-1].tolist():
            queue, last = self.s_types.get(c), None
            while queue is not None and (got := queue.take()) is not None:
                last = int(got[0][-1])
                self._induce(*got, True, self.s_types, since)
            carry = None
            for pos, lcp in self.l_types[c].back() if c in self.l_types else ():
                # downwards, a suffix's prefix is that of the larger one
                edge = carry if carry is not None else (0 if last is None else min(self._run(last), self._run(int(pos[-1])), self.cap))
                carry = int(lcp[0])
                self._induce(pos[::-1], np.concatenate([[edge], lcp[:0:-1]]).astype(np.int32), True, self.s_types, since)

    def lists(self):
        """Ascending blocks of (places, prefix with the suffix before; 0 at the first of a symbol)."""
        if int(self.symbols[0]) == 0 and not self.is_s[self.n - 1]:
            raise ValueError("the text must end with 0")
        for c in self.symbols.tolist():
            last = None
            for pos, lcp in self.l_types[c].all() if c in self.l_types else ():
                last = int(pos[-1])
                yield pos, lcp
            if c in self.s_types:
                carry = None
                for pos, lcp in self.s_types[c].back():
                    # stored downwards: the prefix with the larger one belongs to that one
                    low = int(pos[-1])
                    edge = carry if carry is not None else (0 if last is None else min(self._run(last), self._run(low), self.cap))
                    carry = int(lcp[0])
                    yield pos[::-1], np.concatenate([[edge], lcp[:0:-1]]).astype(np.int32)
            if c == 0:
                yield np.array([self.n - 1]), np.zeros(1, np.int32)

    def close(self):
        self.store.close()


def repeated(strings: list[bytes], width: int, folder: str | None = None, memory: int = 1 << 23) -> list[np.ndarray]:
    """For each string the starts of its ``width``-byte substrings that occur anywhere else in the strings."""
    lens = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lens + 1) - 1
    raw = b"\0".join(strings) + b"\0"
    t = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
    t[ends] = 0
    hit = np.zeros(len(t), bool)
    found = Sorted(t, width, ends, raw + bytes(16), folder, memory)
    before = -1
    for pos, lcp in found.lists():
        same = lcp >= width
        hit[pos[same]] = True
        left = np.concatenate([[before], pos[:-1]])
        hit[left[same]] = True
        before = pos[-1]
    found.close()
    at = ends - lens
    return [np.flatnonzero(hit[a:b]) for a, b in zip(at, ends)]
