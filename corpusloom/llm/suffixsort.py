"""External suffix and common-prefix arrays by induced sorting with disk-backed priority queues.

A level sorts the suffixes of a string of symbols. Its leftmost S-type (LMS) suffixes are sorted by their LMS substrings, these are
named, and the string of names is sorted by the same function, level by level, until all names differ or a string of names fits the
memory with `IN_MEMORY` bytes a name: that one is sorted there, by prefix doubling, and ends the recursion. Sorted LMS suffixes
then induce the L-type suffixes in ascending order, and these the S-type ones in descending order. Both inductions are one
routine over a priority queue of tuples (key, place, common prefix): the key is the suffix's first symbol and the rank of the
suffix behind it, so what is popped is in suffix order, and what a popped tuple induces has a larger key.

The common prefix of a suffix with the one before it is carried in its tuple: if two suffixes follow each other in a bucket, theirs
is one more than the smallest among those of the suffixes that induced them and all ranked in between. Values are cut off
at `depth`, so beyond the block at hand that smallest value comes from `depth` + 1 numbers, the last ranks with at most each value. Names that agree come
back from the recursion as a count and are turned into symbols by the places of the LMS suffixes; only what lies beyond
them is compared.

Memory: a queue keeps sorted runs of tuples, at most `memory` bytes of them in memory and the rest in files; popping reads blocks of
`BLOCK` tuples a run at most, and files are merged when there are more than `RUNS`. Texts, types, ranks and results of a
level are as narrow as their numbers allow, and memory-mapped files too once they pass `memory`; a block reads them at its own
places in ascending order.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

BLOCK, RUNS = 1 << 15, 24
#: What `doubled` holds for each name at most: ranks for the common prefixes in four bytes each, and keys, order and their like in eight.
IN_MEMORY = 80


class Space:
    """Arrays and files of one sort: in memory up to a size, memory-mapped files beyond it."""

    def __init__(self, memory: int, folder: str):
        self.memory, self.folder = memory, folder
        self.on_disk = 0  # bytes written so far

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.memory:
            return np.zeros(n, kind)
        self.on_disk += size
        handle, path = tempfile.mkstemp(dir=self.folder)
        os.ftruncate(handle, size)
        out = np.memmap(path, kind, "r+", shape=(n,))
        os.close(handle)
        os.unlink(path)
        return out

    def places(self, n: int, most: int | None = None) -> np.ndarray:
        """An array of n numbers up to `most` (n unless given), as narrow as they allow."""
        return self.array(n, np.min_scalar_type(-1 - (n if most is None else most)))

    def stored(self, rows: np.ndarray) -> np.ndarray:
        out = self.array(rows.size, np.int64).reshape(rows.shape[::-1]).T
        out[:] = rows
        return out


class Queue:
    """A priority queue of tuples (columns of int64, the first one a key that no two tuples share), kept column by column."""

    def __init__(self, space: Space):
        self.space = space
        self.near: list[list] = []  # [sorted rows, next row] in memory, each run at least twice as long as the next
        self.far: list[list] = []  # the same in files
        self.held = 0

    def push(self, rows: np.ndarray, in_order: bool = False) -> None:
        if not len(rows):
            return
        self.near.append([rows if in_order else rows.T[:, rows[:, 0].argsort(kind="stable")].T, 0])
        self.held += rows.nbytes
        while len(self.near) > 1 and len(self.near[-2][0]) - self.near[-2][1] < 2 * (len(self.near[-1][0]) - self.near[-1][1]):
            self.near[-2:] = [[joined(self.near[-2:]), 0]]
        if self.held > self.space.memory:
            merged = joined(self.near)
            self.near, self.held = [[merged, 0]], merged.nbytes
            if self.held > self.space.memory // 2:
                self.far.append([self.space.stored(merged), 0])
                self.near, self.held = [], 0
                if len(self.far) > RUNS:
                    self.merge()

    def merge(self) -> None:
        """Make the files one, a block at a time."""
        near, self.near = self.near, []
        out, at = self.space.array(3 * sum(len(r) - a for r, a in self.far), np.int64).reshape(3, -1).T, 0
        while self.far:
            rows = self.first(BLOCK)
            out[at : at + len(rows)] = rows
            at += len(rows)
            self.drop(int(rows[-1, 0]), BLOCK)
        self.near, self.far = near, [[out, 0]]

    def first(self, most: int) -> np.ndarray:
        """The tuples of smallest keys, in order, at most `most`."""
        runs = self.near + self.far
        if len(runs) == 1:
            rows, a = runs[0]
            return np.asarray(rows[a : a + most])
        if not runs:
            return np.zeros((0, 3), np.int64)
        sizes = [most] * len(runs)
        if ends := [r[a + most - 1, 0] for r, a in runs if a + most <= len(r)]:
            bound = min(ends)  # one run alone has `most` tuples up to this key
            sizes = [int(r[a : a + most, 0].searchsorted(bound, "right")) for r, a in runs]
        columns = np.concatenate([r[a : a + n].T for (r, a), n in zip(runs, sizes, strict=True)], axis=1)
        return columns[:, columns[0].argsort(kind="stable")[:most]].T

    def drop(self, key: int, most: int) -> None:
        """Remove the tuples up to this key, which are among the first `most`."""
        for runs in (self.near, self.far):
            done = False
            for run in runs:
                rows, a = run
                if rows[a, 0] <= key:
                    run[1] += int(rows[a : a + most, 0].searchsorted(key, "right"))
                    done |= run[1] == len(rows)
            if done:
                runs[:] = [r for r in runs if r[1] < len(r[0])]


def joined(runs: list[list]) -> np.ndarray:
    """The tuples that are left in sorted runs, as one run."""
    columns = np.concatenate([r[a:].T for r, a in runs], axis=1)
    return columns[:, columns[0].argsort(kind="stable")].T


def behind(first, values: np.ndarray) -> np.ndarray:
    """The value before each one; `first` before the first."""
    out = np.empty_like(values)
    out[0], out[1:] = first, values[:-1]
    return out


def equal_ahead(text: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols from p and from q on agree, at most `most` of each pair; the end of the text agrees with nothing."""
    out = np.zeros(len(p), np.int64)
    most = np.minimum(most, len(text) - np.maximum(p, q))
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        k = out[open_]
        open_ = open_[text[p[open_] + k] == text[q[open_] + k]]
        out[open_] += 1
        open_ = open_[out[open_] < most[open_]]
    return out


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first .. last] for each pair of places."""
    if int((last - first).sum()) < 32 * len(values):  # cheaper than the table of powers of two
        pairs = np.empty(2 * len(first), np.int64)
        pairs[::2], pairs[1::2] = first, last + 1
        return np.minimum.reduceat(np.append(values, 0), pairs)[::2]
    levels, begin = [values], [0]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        begin.append(begin[-1] + len(levels[-1]))
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    flat, begin = np.concatenate(levels), np.array(begin)
    k = np.frexp(last - first + 1)[1] - 1
    return np.minimum(flat[begin[k] + first], flat[begin[k] + last - (1 << k) + 1])


def induce(text: np.ndarray, flip: int | None, wanted: np.ndarray, seeds: Queue, depth: int, space: Space, end: int | None = None):
    """Blocks (places, seeded, common prefixes with the one before) of the seeds and all they induce, in order.

    A place before a popped one is induced where `wanted` says so. With flip, symbols count downwards from it. depth 0: no prefixes.
    `end`: the symbol whose last place is seeded as what the end of the text induces.
    """
    n_symbols = int(text.max()) + 1 if len(text) else 0
    latest = space.array(n_symbols, np.int64)  # the rank that induced the last suffix of each symbol, less one
    latest[:] = -1
    if end is not None:
        latest[end] = 0
    last = np.full(depth + 1, -1, np.int64)  # the last rank with at most this common prefix
    rank, before, size = 1, None, min(BLOCK, 256)
    while len(rows := seeds.first(size)):
        key = rows[:, 0]
        # What a tuple induces must come behind all that are popped with it: take the first that all do.
        prior = rows[:, 1] - 1
        some = np.flatnonzero(wanted[prior] & (prior >= 0))
        symbol = text[prior[some]].astype(np.int64)
        new = ((symbol if flip is None else flip - symbol) << 33) | (rank + some)
        least = np.full(len(key) + 1, np.iinfo(np.int64).max)
        least[some + 1] = new
        late = key >= np.minimum.accumulate(least)[:-1]
        safe = int(late.argmax())
        if not late[safe]:
            safe = len(key)
        else:
            keep = int(some.searchsorted(safe))
            some, symbol, new = some[:keep], symbol[:keep], new[:keep]
            key, rows = key[:safe], rows[:safe]
        seeds.drop(int(key[-1]), size)
        size = min(BLOCK, max(64, 2 * safe))
        place, shared = rows[:, 1].copy(), rows[:, 2].copy()
        seeded = (key >> 32) & 1 == 1
        carried = np.zeros(len(new), np.int64)
        if depth:
            bucket = key >> 33
            joint = behind(before[0] if before else -1, bucket) == bucket
            turn = joint & (behind(before[1] if before else False, seeded) != seeded)
            shared[~joint] = 0
            at = np.flatnonzero(turn)
            if len(at):  # an L- and an S-type suffix of one symbol agree as long as the shorter run of it
                other = behind(before[2] if before else 0, place)[at]
                runs = [equal_ahead(text, x, x + 1, np.full(len(x), depth)) + 1 for x in (place[at], other)]
                shared[at] = np.minimum(np.minimum(*runs), depth)
            if len(new):
                order = symbol.argsort(kind="stable")
                s, here = symbol[order], some[order]
                same = behind(-1, s) == s
                left = np.where(same, behind(0, here) + rank, latest[s])
                inside = np.flatnonzero(left >= rank)
                smallest = np.minimum(np.minimum.accumulate(shared)[here], last.searchsorted(left, "right"))
                if len(inside):
                    smallest[inside] = range_minima(shared, left[inside] - rank + 1, here[inside])
                carried[order] = np.where(left < 0, 0, np.minimum(smallest + 1, depth))
                latest[s] = here + rank  # the last of equal ones stays
            own = np.full(depth + 1, -1, np.int64)
            own[shared] = rank + np.arange(safe)
            last = np.maximum(last, np.maximum.accumulate(own))
            before = (bucket[-1], seeded[-1], place[-1])
        seeds.push(np.stack([new, place[some] - 1, carried]).T)
        yield place, seeded, shared
        rank += safe


def types(text: np.ndarray, space: Space) -> np.ndarray:
    """True where the suffix is S-type; the end counts as smaller than any symbol."""
    n = len(text)
    out = space.array(n, bool)
    after, own = -1, False  # the symbol behind the block, and its type
    for a in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        x = np.r_[np.asarray(text[a : a + BLOCK]).astype(np.int64), after]
        change = np.flatnonzero(x[:-1] != x[1:])
        rises = x[change] < x[change + 1]
        ends = np.r_[change, len(x) - 2] if not len(change) or change[-1] != len(x) - 2 else change
        kinds = np.r_[rises, own] if len(ends) > len(rises) else rises
        out[a : a + len(x) - 1] = np.repeat(kinds, np.diff(np.r_[-1, ends]))
        after, own = int(x[0]), bool(out[a])
    return out


def both_ways(text: np.ndarray, s_type: np.ndarray, lms: list[np.ndarray], depth: int, space: Space):
    """Blocks (places, common prefixes with the next smaller) of all suffixes in descending order; lms: (places, common prefixes) in order."""
    n = len(text)
    first = Queue(space)
    top = int(text.max())
    for a in range(0, len(lms[0]), BLOCK):
        p = np.asarray(lms[0][a : a + BLOCK], np.int64)
        key = (text[p].astype(np.int64) << 33) | (1 << 32) | np.arange(a, a + len(p))
        first.push(np.stack([key, p, np.asarray(lms[1][a : a + BLOCK], np.int64)]).T)
    first.push(np.array([[int(text[n - 1]) << 33, n - 1, 0]], np.int64))
    l_type = np.logical_not(s_type) if not isinstance(s_type, np.memmap) else space.array(n, bool)
    if isinstance(s_type, np.memmap):
        np.logical_not(s_type, out=l_type)
    count = n - int(np.count_nonzero(s_type))
    found, prefix, at = space.places(count, n), space.places(count + 1, depth), 0
    for place, seeded, shared in induce(text, None, l_type, first, depth, space, int(text[n - 1])):
        own = ~seeded
        k = int(own.sum())
        found[at : at + k], prefix[at : at + k] = place[own], shared[own]
        at += k
    second = Queue(space)
    for b in range(count, 0, -BLOCK):
        a = max(0, b - BLOCK)
        p, shared = np.asarray(found[a:b])[::-1], np.asarray(prefix[a + 1 : b + 1])[::-1]
        key = ((top - text[p].astype(np.int64)) << 33) | (1 << 32) | (count - b + np.arange(b - a))
        second.push(np.stack([key, p, shared]).T)
    yield from induce(text, top, s_type, second, depth, space)


def doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What `sort` gives for a string of names 0, 1, ... that fits in memory: the base of the recursion, by prefix doubling."""
    n, rank, width = len(names), names.astype(np.int64), 1
    ranks = [names.astype(np.int32)]  # by the first one, two, four, ... names
    while True:
        key = rank * (n + 1)
        if width < n:
            key[:-width] += rank[width:] + 1
        order = key.argsort()
        key = key[order]
        rank[order] = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        width *= 2
        if rank[order[-1]] == n - 1:
            break
        if width <= depth:
            ranks.append(rank.astype(np.int32))
    shared = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(ranks) - 1, -1, -1):
        p, q = a + shared[1:], b + shared[1:]
        some = np.flatnonzero(np.maximum(p, q) + (1 << k) <= n)
        shared[1:][some[ranks[k][p[some]] == ranks[k][q[some]]]] += 1 << k
    return order, np.minimum(shared, depth)


def sort(text: np.ndarray, depth: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, common prefixes with the one before, at most depth) of a string of symbols."""
    n = len(text)
    order, shared = space.places(n), space.places(n, depth)
    if n < 2:
        return order, shared
    s_type = types(text, space)
    lms = space.places(int(np.count_nonzero(s_type[1:] & ~s_type[:-1])), n)
    at = 0
    for a in range(0, n - 1, BLOCK):
        x = np.asarray(s_type[a : a + BLOCK + 1])
        p = np.flatnonzero(x[1:] & ~x[:-1]) + a + 1
        lms[at : at + len(p)] = p
        at += len(p)
    m = len(lms)
    ranked, common = space.places(m, n), space.places(m, depth)
    if m:
        # LMS substrings in order: the inductions from LMS suffixes that are sorted by their first symbol only.
        number = space.places(n, m)
        number[lms] = np.arange(m)
        at = m
        for place, _, _ in both_ways(text, s_type, [lms, common], 0, space):
            p = place[place > 0]
            p = p[s_type[p] & ~s_type[p - 1]]
            ranked[at - len(p) : at] = p[::-1]
            at -= len(p)
        names, name = space.places(m), 0
        for a in range(0, m, BLOCK):
            q = np.asarray(ranked[a : a + BLOCK])
            p = behind(ranked[a - 1] if a else q[0], q)
            i, j = number[p].astype(np.int64), number[q].astype(np.int64)
            ends = [np.where(k + 1 < m, lms[np.minimum(k + 1, m - 1)], n) for k in (i, j)]
            size = ends[1] - q
            same = (ends[0] - p == size) & (i + 1 < m) & (j + 1 < m)
            at = np.flatnonzero(same)
            same[at] = equal_ahead(text, p[at], q[at], size[at] + 1) > size[at]
            same[0] &= a > 0
            own = name + np.cumsum(~same)
            names[j], name = own - 1, int(own[-1])
        if name < m:
            inner, agreed = doubled(names, depth) if IN_MEMORY * m <= space.memory else sort(names, depth, space)
        else:
            inner, agreed = space.places(m), space.places(m, depth)
            inner[names] = np.arange(m)
        for a in range(0, m, BLOCK):
            j, k = np.asarray(inner[a : a + BLOCK]).astype(np.int64), np.asarray(agreed[a : a + BLOCK])
            ranked[a : a + len(j)] = lms[j]
            if depth:
                i = behind(inner[a - 1] if a else j[0], j)
                sure = np.minimum(lms[np.minimum(np.maximum(i, j) + k, m - 1) - np.maximum(i, j) + j] - lms[j], depth).astype(np.int64)
                more = equal_ahead(text, lms[i] + sure, lms[j] + sure, depth - sure)
                common[a : a + len(j)] = np.where((np.arange(a, a + len(j)) == 0), 0, sure + more)
    at = n
    for place, _, below in both_ways(text, s_type, [ranked, common], depth, space):
        # In descending order a tuple's common prefix is with the suffix above it.
        order[at - len(place) : at] = place[::-1]
        if at < n:
            shared[at] = below[0]
        shared[at - len(place) + 1 : at] = below[1:][::-1]
        at -= len(place)
    return order, shared


def suffix_array(text: np.ndarray, depth: int, memory: int = 64 << 20, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of text (bytes) in suffix order, common prefixes with the one before, at most depth)."""
    with tempfile.TemporaryDirectory(dir=folder) as at:
        return sort(text, depth, Space(memory, at))
