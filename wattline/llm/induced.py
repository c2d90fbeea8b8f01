"""Suffixes sorted by external induced sorting, with their common prefixes.

Suffix tuples (position, length of the prefix shared with the tuple before) pass through two priority queues, one for suffixes larger than
their successor (L) and one for smaller ones (S). A queue is monotone: what comes out with a symbol puts in the suffix one
place to the left, whose symbol is no smaller (L) or no larger (S). So each symbol has one region of the
queue, of a size known beforehand, filled at its head and read from its start; regions are read and written in sequence. Above
``MEMORY`` bytes a queue is a file in the folder Spark names for spills, gone with the task; the text itself takes two bytes a
symbol in memory. Entries that come from one symbol are handled in waves of at most ``WAVE``.

The order to begin with, that of the leftmost S suffixes, comes from the same induction: it sorts the strings between
them, which are numbered, and where numbers repeat the string of numbers is sorted by recursion. A number is written
as two digits, so that the alphabet stays small at every level. The recursion ends with a string of at most ``BASE`` numbers, which is
sorted in memory by doubling. Common prefixes of these suffixes are measured, all
others are carried: one more than the smallest between the two suffixes they come from.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

MEMORY, WAVE, SMALL, BASE = 1 << 26, 1 << 20, 1 << 10, 1 << 20


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    out = np.empty(len(values), bool)
    out[:1] = True
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def room(n: int, kind) -> np.ndarray:
    """An array of n values, in a nameless file where it's large."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    if n * np.dtype(kind).itemsize <= MEMORY or not folder:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile(dir=folder) as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, kind, "r+", shape=(n,))


def places_of(n: int):
    """The type that holds places in n symbols."""
    return np.int32 if n < 1 << 31 else np.int64


class Kinds:
    """The symbols of a text, where each suffix's leading run of one symbol ends, and whether it is an S suffix."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.text, self.size, n = symbols, size, len(symbols)
        step = np.zeros(n, np.int8)
        step[:-1] = (symbols[1:] > symbols[:-1]).astype(np.int8) - (symbols[1:] < symbols[:-1])
        step[-1] = -1
        kind = places_of(n)
        place = np.arange(n, dtype=kind)
        last = np.where(step != 0, place, kind(n))
        last = np.minimum.accumulate(last[::-1])[::-1]
        self.small = step[last] > 0
        self.run = last + kind(1) - place
        self.first = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1


class Queue:
    """A region of tuples for each symbol: positions and common prefixes in the order they came."""

    def __init__(self, symbols: np.ndarray, size: int, prefixes: bool, total: int):
        count = np.bincount(symbols, minlength=size)
        self.start = np.zeros(size + 1, np.int64)
        np.cumsum(count, out=self.start[1:])
        self.filled = np.zeros(size, np.int64)
        self.place = room(len(symbols), places_of(total))
        self.prefix = room(len(symbols), np.uint8) if prefixes else None

    def push(self, symbols: np.ndarray, places: np.ndarray, prefixes: np.ndarray | None) -> None:
        """Symbols in ascending order; of equal ones in the order they are to come out."""
        at = changes(symbols).nonzero()[0]
        count = np.empty(len(at), np.int64)
        np.subtract(at[1:], at[:-1], out=count[:-1])
        count[-1] = len(symbols) - at[-1]
        own = symbols[at]
        to = np.repeat(self.start[own] + self.filled[own] - at, count) + np.arange(len(symbols))
        self.place[to] = places
        if prefixes is not None:
            self.prefix[to] = prefixes
        self.filled[own] += count

    def of(self, symbol: int, done: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        a = self.start[symbol] + done
        z = min(self.start[symbol] + self.filled[symbol], a + (limit or WAVE))
        return np.asarray(self.place[a:z]), None if self.prefix is None else np.asarray(self.prefix[a:z])


class Source:
    """Entries of one symbol on their way into a queue; ``since`` is the smallest prefix since the last that went to each symbol."""

    def __init__(self, kinds: Kinds, queue: Queue, small: bool, cap: int):
        self.kinds, self.queue, self.small, self.cap = kinds, queue, small, cap
        self.since = np.full(kinds.size, -1, np.int16)

    def take(self, places: np.ndarray, prefixes: np.ndarray | None) -> None:
        kinds = self.kinds
        left = places - 1
        go = ((left >= 0) & (kinds.small[left] == self.small)).nonzero()[0]
        if len(go):
            symbol = kinds.text[left[go]]
            order = np.argsort(symbol, kind="stable")
            symbol, go = symbol[order], go[order]
        if prefixes is None:
            if len(go):
                self.queue.push(symbol, left[go], None)
            return
        if not len(go):
            self.since[self.since >= 0] = np.minimum(self.since[self.since >= 0], prefixes.min())
            return
        new = changes(symbol)
        at, again = new.nonzero()[0], (~new).nonzero()[0]
        final = np.append(at[1:], len(go)) - 1
        shared = np.zeros(len(go), np.int16)
        shared[again] = smallest(prefixes, go[again - 1] + 1, go[again]) + 1
        before = self.since[symbol[at]]
        ahead = np.minimum.accumulate(prefixes)[go[at]]
        shared[at] = np.where(before >= 0, np.minimum(before, ahead) + 1, self.queue.filled[symbol[at]] > 0)
        self.queue.push(symbol, left[go], np.minimum(shared, self.cap).astype(np.uint8))
        known = self.since >= 0
        self.since[known] = np.minimum(self.since[known], prefixes.min())
        behind = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], 255)
        self.since[symbol[at]] = behind[go[final] + 1]


def smallest(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The smallest of values[a] to values[z], ends included."""
    out, level = np.zeros(len(a), values.dtype), np.floor(np.log2(z - a + 1)).astype(np.int64)
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[a[own]], table[z[own] - (1 << k) + 1])
    return out


def induce(kinds: Kinds, seeds: np.ndarray, prefixes: np.ndarray | None, cap: int = 0) -> tuple[Queue, Queue]:
    """Both queues of a text, filled from the leftmost S suffixes in the order given, with their common prefixes."""
    text, run, used = kinds.text, kinds.run, np.flatnonzero(np.bincount(kinds.text, minlength=kinds.size))
    carried = prefixes is not None
    large, small = Queue(text[~kinds.small], kinds.size, carried, len(text)), Queue(text[kinds.small], kinds.size, carried, len(text))
    border = np.searchsorted(text[seeds], np.arange(kinds.size + 1))
    last = np.array([len(text) - 1])
    large.push(text[last], last, np.zeros(1, np.uint8) if carried else None)

    def seam(a: int, b: int) -> int:
        """What an L and an S suffix of one symbol share: the shorter of their leading runs."""
        return min(int(run[a]), int(run[b]), cap)

    for c in used:
        source, done, end = Source(kinds, large, False, cap), 0, None
        while done < large.filled[c]:
            places, own = large.of(c, done)
            source.take(places, own)
            done, end = done + len(places), places[-1]
        for at in range(border[c], border[c + 1], WAVE):
            places = seeds[at : min(at + WAVE, border[c + 1])]
            own = prefixes[at : at + len(places)].copy() if carried else None
            if carried and at == border[c]:
                own[0] = seam(end, places[0]) if end is not None else 0
            source.take(places, own)
    for c in used[::-1]:
        source, done, end = Source(kinds, small, True, cap), 0, None
        while done < small.filled[c]:
            places, own = small.of(c, done)
            source.take(places, own)
            done, end = done + len(places), places[-1]
        n = int(large.filled[c])
        for at in range(0, n, WAVE):  # from the last to the first
            z = n - at
            a = max(0, z - WAVE)
            places, own = large.place[large.start[c] + a : large.start[c] + z][::-1], None
            if carried:
                own = np.empty(z - a, np.uint8)
                own[1:] = large.prefix[large.start[c] + a + 1 : large.start[c] + z][::-1]
                own[0] = large.prefix[large.start[c] + z] if at else seam(end, places[0]) if end is not None else 0
            source.take(places, own)
    return large, small


def named(kinds: Kinds, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the strings from each leftmost S suffix to the next, in text order, and how many there are."""
    text, first = kinds.text, kinds.first
    length = np.diff(np.append(first, len(text)))
    where = np.searchsorted(first, order)
    size = length[where]
    differ = np.ones(len(order), bool)
    differ[1:] = size[1:] != size[:-1]
    # of two strings of one length compare symbol by symbol; the last to the end of the text has no equal
    differ[np.flatnonzero(where == len(first) - 1)] = True
    after = np.flatnonzero(where[:-1] == len(first) - 1) + 1
    differ[after] = True
    open_, k = np.flatnonzero(~differ), 0
    while len(open_):
        unlike = text[order[open_] + k] != text[order[open_ - 1] + k]
        differ[open_[unlike]] = True
        k += 1
        open_ = open_[~unlike]
        open_ = open_[size[open_] >= k]  # the symbol at which the next begins is compared, too
    name = np.empty(len(first), np.int64)
    name[where] = np.cumsum(differ) - 1
    return name, int(differ.sum())


def doubled(name: np.ndarray, deep: int) -> np.ndarray:
    """The suffixes of a string of numbers in ascending order, told apart by their first ``deep`` numbers at least."""
    rank, k, n = name, 1, len(name)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        new = np.cumsum(changes(key[order])) - 1
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= min(deep, n):
            return order


def seeds_of(kinds: Kinds, cap: int | None = None) -> np.ndarray:
    """The leftmost S suffixes in ascending order; those alike in ``cap`` symbols, if given, in any order."""
    first = kinds.first
    if len(first) < 2:
        return first
    by_symbol = first[np.argsort(kinds.text[first], kind="stable")]
    _, small = induce(kinds, by_symbol, None)
    leads = np.zeros(len(kinds.text), bool)
    leads[first] = True
    order = np.concatenate([p[leads[p]] for c in range(kinds.size) for p in [small.of(c, 0, len(kinds.text))[0][::-1]]])
    name, n = named(kinds, order)
    if n == len(first):
        return order
    if len(first) <= BASE:  # a string from one such suffix to the next has two symbols at least
        return first[doubled(name, len(first) if cap is None else -(-cap // 2))]
    if n <= SMALL:
        return first[ranked(name.astype(np.uint16), n)]
    base = int(np.ceil(np.sqrt(n)))
    digits = np.column_stack([name // base, name % base]).ravel().astype(np.uint16)
    places = ranked(digits, base)
    return first[places[places % 2 == 0] // 2]


def ranked(symbols: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in ascending order; one that another begins with comes first."""
    kinds = Kinds(symbols, size)
    large, small = induce(kinds, seeds_of(kinds), None)
    return np.concatenate([x for c in range(size) for x in (large.of(c, 0, len(symbols))[0], small.of(c, 0, len(symbols))[0][::-1])])


def measured(symbols: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Of suffixes in order: the symbols each shares with the one before, at most ``cap`` (below 256)."""
    n, out = len(symbols), np.zeros(len(order), np.uint8)
    padded = np.concatenate([symbols.astype(np.uint16), np.zeros(cap + 4, np.uint16)])
    four = np.ndarray((n + cap + 1,), "<u8", padded.tobytes(), 0, (2,))
    open_, k = np.arange(1, len(order)), 0
    while len(open_) and k < cap:
        a, b = order[open_ - 1] + k, order[open_] + k
        unlike = four[a] ^ four[b]
        same = np.zeros(len(open_), np.int64)
        for bit in (16, 32, 48, 64):
            same += unlike & np.uint64((1 << bit) - 1) == 0
        same = np.minimum(same, n - np.maximum(a, b))
        out[open_] = np.minimum(k + same, cap)
        open_, k = open_[same == 4], k + 4
    return out


def suffixes(symbols: np.ndarray, size: int, cap: int):
    """Runs of suffixes in ascending order, with the symbols (at most ``cap``) that each shares with the one before.

    Suffixes alike in ``cap`` symbols may come in any order.
    """
    kinds = Kinds(symbols, size)
    seeds = seeds_of(kinds, cap)
    large, small = induce(kinds, seeds, measured(symbols, seeds, cap), cap)
    for c in range(size):
        end = None
        for done in range(0, int(large.filled[c]), WAVE):
            places, own = large.of(c, done)
            end = places[-1]
            yield places, own
        n = int(small.filled[c])
        for at in range(0, n, WAVE):
            z = n - at
            a = max(0, z - WAVE)
            places, own = small.place[small.start[c] + a : small.start[c] + z][::-1], np.empty(z - a, np.uint8)
            own[1:] = small.prefix[small.start[c] + a + 1 : small.start[c] + z][::-1]
            own[0] = small.prefix[small.start[c] + z] if at else 0 if end is None else min(int(kinds.run[end]), int(kinds.run[places[0]]), cap)
            yield places, own
