"""External suffix sorting of one shard by recursive induced sorting, with common-prefix values.

The string is a file of symbols. Its LMS substrings are named, the string of
names is sorted by recursion, and the sorted LMS suffixes induce the L suffixes
and these the S suffixes. Induction runs on a priority queue of tuples (symbol,
rank of the suffix behind it, position) whose buckets live in an append-only
file: tuples enter in rank order, so a bucket of one symbol is popped ready
sorted and read sequentially. On the last level the queue's output carries
common-prefix values (up to a cap): neighbours induced by suffixes of ranks r <
s share one symbol more than the least value among ranks r + 1 .. s.

The large arrays over the string are memory-mapped files in a temporary folder
that goes with the sorter (a lost executor's task starts over from its shuffled
input), but a shard must fit in memory: typing, the LMS vectors, the bucket
counts and a bucket of one symbol are whole arrays in memory, and the caller
holds the shard's bytes.
"""

from __future__ import annotations

import heapq
import os
import tempfile

import numpy as np

#: Tuples of the queue held in memory before they are written out.
BUFFER = 1 << 20
#: Suffixes of several symbols that are induced together on the upper levels.
BATCH = 1 << 16
#: Most runs of equal symbols in a chain of predecessors inside one batch of several symbols.
DEPTH = 16


class Scratch:
    """Memory-mapped arrays in one temporary folder; small arrays stay in memory.

    A file loses its name once it is open, so its disk is free again with its array.
    """

    def __init__(self, in_memory: int = 1 << 22):
        self._dir = tempfile.TemporaryDirectory(prefix="induced-")
        self._n, self._small = 0, in_memory

    def path(self) -> str:
        self._n += 1
        return os.path.join(self._dir.name, str(self._n))

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self._small:
            return np.zeros(n, dtype)
        path = self.path()
        out = np.memmap(path, dtype, "w+", shape=(n,))
        os.unlink(path)
        return out

    def file(self):
        path = self.path()
        out = open(path, "w+b")
        os.unlink(path)
        return out

    def close(self) -> None:
        self._dir.cleanup()


class BucketQueue:
    """Monotone priority queue of (symbol, rank, position): one first-in first-out run per bucket of symbols."""

    def __init__(self, scratch: Scratch, bounds: np.ndarray, buffer: int):
        self.bounds, self.buffer, self.held = bounds, buffer, 0
        self.memory: dict[int, list[np.ndarray]] = {}
        self.extents: dict[int, list[tuple[int, int]]] = {}
        self.file = scratch.file()

    def push(self, symbols: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> None:
        bucket = np.searchsorted(self.bounds, symbols, "right") - 1
        order = np.argsort(bucket, kind="stable")
        rows = np.stack((symbols, ranks, places), axis=1).astype(np.int64)[order]
        bucket = bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            self.memory.setdefault(int(bucket[a]), []).append(rows[a:b])
        self.held += len(rows)
        if self.held > self.buffer:
            self._spill()

    def _spill(self) -> None:
        self.file.seek(0, 2)
        for b, parts in self.memory.items():
            block = np.concatenate(parts)
            self.extents.setdefault(b, []).append((self.file.tell(), len(block)))
            self.file.write(block.tobytes())
        self.memory, self.held = {}, 0

    def pop(self, bucket: int) -> np.ndarray:
        """The tuples of one bucket in the order of their ranks."""
        parts = []
        for at, n in self.extents.pop(bucket, ()):
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(n * 24), np.int64).reshape(n, 3))
        inner = self.memory.pop(bucket, [])
        self.held -= sum(map(len, inner))
        parts += inner
        return np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)

    def close(self) -> None:
        self.file.close()


def s_types(x: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the last one counts as such."""
    n = len(x)
    smaller = np.empty(n, bool)
    smaller[-1] = True
    smaller[:-1] = x[:-1] < x[1:]
    decided = np.empty(n, bool)
    decided[-1] = True
    decided[:-1] = x[:-1] != x[1:]
    at = np.where(decided, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return smaller[at]


def lms_places(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def lms_names(x: np.ndarray, s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names of the LMS substrings in their order, in text order, and the number of names."""
    bits = int(x.max()).bit_length() + 2
    per = max(1, 63 // bits)
    length = np.append(np.diff(lms) + 1, 1)
    rank = np.zeros(len(lms), np.int64)
    active, done = np.arange(len(lms)), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for j in range(done, done + per):
            inside = j < length[active]
            at = np.where(inside, lms[active] + j, 0)
            key = (key << bits) | np.where(inside, ((x[at].astype(np.int64) << 1) | s[at]) + 1, 0)
        done += per
        order = np.lexsort((key, rank[active]))
        active, key = active[order], key[order]
        old = rank[active]
        new_group = np.concatenate(([True], old[1:] != old[:-1]))
        new_value = new_group | np.concatenate(([True], key[1:] != key[:-1]))
        index = np.arange(len(active))
        group_at = np.maximum.accumulate(np.where(new_group, index, 0))
        value_at = np.maximum.accumulate(np.where(new_value, index, 0))
        rank[active] = old + value_at - group_at
        cuts = np.append(np.flatnonzero(new_value), len(active))
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        active = active[(size > 1) & (length[active] > done)]
    present = np.zeros(len(lms), np.int64)
    present[rank] = 1
    dense = np.cumsum(present) - 1
    return dense[rank], int(dense[-1]) + 1


def _batches(x: np.ndarray, kind: np.ndarray, seeds: np.ndarray, single_from: int | None, size: int) -> np.ndarray:
    """Lower symbols of the buckets, and one past the last symbol."""
    top = int(x.max()) + 1
    counts = np.bincount(x[kind], minlength=top) + np.bincount(x[seeds], minlength=top)
    limit = top if single_from is None else single_from
    low, total = [0], 0
    sums = np.cumsum(counts[:limit])
    while low[-1] < limit:
        at = low[-1]
        before = sums[at - 1] if at else 0
        low.append(min(limit, max(at + 1, int(np.searchsorted(sums, before + size, "right")))))
    return np.array(low[:-1] + list(range(limit, top + 1)) if limit < top else low, np.int64)


def induce(x, kind, seeds, scratch, buffer=BUFFER, batch=BATCH, lcp=None, cap=0, compare=None, single_from=None):
    """Merge the sorted ``seeds`` with the suffixes of ``kind`` that they induce.

    Suffixes of ``kind`` start with a symbol not less than the next one, and
    sort before the seeds of their symbol. Returns places, whether each is a
    seed, and (with ``lcp`` of the seeds) common-prefix values with the suffix
    before. Symbols below ``single_from`` never start a suffix of ``kind``.
    """
    bounds = _batches(x, kind, seeds, single_from, batch)
    queue = BucketQueue(scratch, bounds[:-1], buffer)
    n = int(kind.sum()) + len(seeds)
    out, is_seed = scratch.array(n, np.int64), scratch.array(n, bool)
    values = scratch.array(n, np.uint8) if lcp is not None else None
    seed_symbol = x[seeds]
    seed_cut = np.searchsorted(seed_symbol, bounds)
    base, b = 0, 0
    pending = [(int(bounds[i]), int(bounds[i + 1])) for i in range(len(bounds) - 1)]
    for b, (lo, hi) in enumerate(pending):
        rows = queue.pop(b)
        own = seeds[seed_cut[b]:seed_cut[b + 1]]
        if not len(rows) and not len(own):
            continue
        if hi - lo == 1:
            # the popped tuples, then what each round induces under the same symbol; parents: whose ranks
            rounds, parents, cur, first = [rows[:, 2]], [rows[:, 1]], rows[:, 2], base
            while len(cur):
                ok = cur > 0
                ok[ok] = kind[cur[ok] - 1] & (x[cur[ok] - 1] == lo)
                at = np.flatnonzero(ok)
                first, cur = first + len(cur), cur[at] - 1
                if len(cur):
                    rounds.append(cur)
                    parents.append(at + (first - len(ok)))
            places = np.concatenate((*rounds, own))
            if values is not None:
                _prefix_values(values, base, parents, places, own, lcp[seed_cut[b]:seed_cut[b + 1]], cap, compare)
        else:
            places = _range_order(x, kind, rows, own, hi)
            if values is not None:
                values[base:base + len(places)] = 0  # distinct symbols, or separators
        end = base + len(places)
        out[base:end] = places
        n_own = len(own)
        if hi - lo == 1:
            is_seed[end - n_own:end] = True
        else:
            is_seed[base:end] = ~kind[places]
        ok = places > 0
        before = places[ok] - 1
        ranks = np.arange(base, end)[ok]
        push = kind[before] & (x[before] >= hi)
        queue.push(x[before[push]].astype(np.int64), ranks[push], before[push])
        base = end
    queue.close()
    return out[:base], is_seed[:base], (values[:base] if values is not None else None)


def _range_order(x, kind, rows, own, hi) -> np.ndarray:
    """Order of the suffixes of several symbols: popped tuples, seeds, and what they induce below ``hi``.

    A suffix is compared by the symbols down to its root, a run of one symbol
    being one unit (the shorter run first), then by the root's order.
    """
    place = np.concatenate((rows[:, 2], own))
    seed = np.repeat([0, 1], [len(rows), len(own)])
    order = np.concatenate((rows[:, 1], np.arange(len(own))))
    units = np.zeros((len(place), DEPTH), np.int64)
    units[:, 0] = _unit(x[place], seed)
    levels = [(place, order, units)]
    while True:
        place, order, units = levels[-1]
        ok = place > 0
        ok[ok] = kind[place[ok] - 1] & (x[place[ok] - 1] < hi)
        if not ok.any():
            break
        before, units = place[ok] - 1, units[ok]
        run = x[before] == x[place[ok]]
        if units[~run, -1].any():
            return _chain_order(x, kind, rows, own, hi)
        longer = np.zeros_like(units)
        longer[:, 1:], longer[:, 0] = units[:, :-1], _unit(x[before], 0)
        units[:, 0] += 1
        levels.append((before, order[ok], np.where(run[:, None], units, longer)))
    place, order, units = (np.concatenate(c) for c in zip(*levels))
    used = int((units != 0).any(axis=0).sum())
    return place[np.lexsort((order, *[units[:, j] for j in range(used - 1, -1, -1)]))]


def _unit(symbol: np.ndarray, seed) -> np.ndarray:
    return ((symbol.astype(np.int64) * 2 + seed + 1) << 28) + 1


def _chain_order(x, kind, rows, own, hi) -> np.ndarray:
    """The same order where chains are long: symbol by symbol, each from the ones before."""
    waiting: dict[int, list[np.ndarray]] = {}
    symbols = x[rows[:, 2]]
    for c in np.unique(symbols):
        mine = rows[symbols == c]
        waiting[int(c)] = [mine[np.argsort(mine[:, 1], kind="stable"), 2]]
    seeds = {int(c): own[x[own] == c] for c in np.unique(x[own])}
    out = []
    heap = sorted({*waiting, *seeds})
    while heap:
        c = heapq.heappop(heap)
        cur = np.concatenate(waiting.pop(c)) if c in waiting else np.zeros(0, np.int64)
        done = []
        while len(cur):
            done.append(cur)
            before = cur[cur > 0] - 1
            cur = before[kind[before] & (x[before] == c)]
        done.append(seeds.pop(c, np.zeros(0, np.int64)))
        places = np.concatenate(done)
        out.append(places)
        before = places[places > 0] - 1
        before = before[kind[before] & (x[before] < hi) & (x[before] > c)]
        for d in map(int, np.unique(x[before])):
            if d not in waiting and d not in seeds:
                heapq.heappush(heap, d)
            waiting.setdefault(d, []).append(before[x[before] == d])
    return np.concatenate(out)


def _prefix_values(values, base, parents, places, own, own_values, cap, compare):
    """Common-prefix values of one symbol's suffixes, written at ``base``; ``parents`` holds ranks by round, rising."""
    at, last = base, -1
    for ranks in parents:
        if not len(ranks):
            continue
        lo = int(ranks[0]) if last < 0 else last
        edge = ranks if last < 0 else np.concatenate(([last], ranks))
        got = np.zeros(0, np.int64)
        if len(edge) > 1:
            got = np.minimum(np.minimum.reduceat(values[lo + 1:ranks[-1] + 1], edge[:-1] - lo).astype(np.int64) + 1, cap)
        if last < 0:
            got = np.concatenate(([0], got))
        values[at:at + len(ranks)] = got
        at, last = at + len(ranks), int(ranks[-1])
    if len(own):
        own_values = own_values.copy()
        n_before = len(places) - len(own)
        own_values[0] = compare(places[n_before - 1:n_before], own[:1])[0] if n_before else 0
        values[at:at + len(own)] = own_values


def sort_suffixes(x: np.ndarray, scratch: Scratch, buffer: int = BUFFER, batch: int = BATCH) -> np.ndarray:
    """Sorted places of the LMS suffixes of ``x`` (its last symbol is the only smallest one), by recursion."""
    s = s_types(x)
    lms = lms_places(s)
    if len(lms) <= 1:
        return lms
    names, n = lms_names(x, s, lms)
    if n == len(lms):
        order = np.empty(n, np.int64)
        order[names] = np.arange(n)
        return lms[order]
    reduced = scratch.array(len(names), np.int32)
    reduced[:] = names
    return lms[_all_suffixes(reduced, scratch, buffer, batch)]


def _all_suffixes(x, scratch, buffer, batch) -> np.ndarray:
    s = s_types(x)
    seeds = sort_suffixes(x, scratch, buffer, batch)
    places, is_seed, _ = induce(x, ~s, seeds, scratch, buffer, batch)
    down = places[~is_seed][::-1]
    del places, is_seed
    upside = int(x.max()) - x
    kind = s.copy()
    kind[-1] = False  # nothing induces the last suffix, the smallest
    places, _, _ = induce(upside, kind, down, scratch, buffer, batch)
    return np.concatenate(([len(x) - 1], places[::-1]))


def suffixes_with_prefixes(x: np.ndarray, cap: int, compare, single_from: int, scratch: Scratch,
                           buffer: int = BUFFER, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of ``x`` in order, and how much each shares with the one before (at most ``cap``).

    Symbols below ``single_from`` are separators, each different from all
    others, the last symbol the smallest; give the others in random order, for
    a long run of falling or rising symbols is a long chain to follow. ``compare(a, b)`` gives the capped
    common prefix of suffixes at places a and b.
    """
    s = s_types(x)
    seeds = sort_suffixes(x, scratch, buffer, batch)
    shared = np.zeros(len(seeds), np.uint8)
    shared[1:] = compare(seeds[:-1], seeds[1:])
    places, is_seed, values = induce(x, ~s, seeds, scratch, buffer, batch, shared, cap, compare, single_from)
    down, shared = places[~is_seed][::-1], values[~is_seed][::-1]
    del places, is_seed, values
    shared = np.concatenate(([0], shared[:-1])).astype(np.uint8)
    top = int(x.max())
    kind = s.copy()
    kind[-1] = False
    # upside down the separators come last, one symbol each; they share nothing
    places, _, values = induce(top - x, kind, down, scratch, buffer, batch, shared, cap, compare, 0)
    order = np.concatenate(([len(x) - 1], places[::-1]))
    return order, np.concatenate(([0, 0], values[::-1][:-1])).astype(np.uint8)[:len(order)]
