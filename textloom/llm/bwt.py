"""Burrows-Wheeler transform and common prefixes of a collection, built column by column in sequential external files.

Round j inserts, for each string, the symbol before its suffix of length j. The suffixes' rows are two sequential files,
symbols and common-prefix lengths; each round reads the old files front to back, a buffer at a time, and writes the new
ones as it goes. A symbol's next row is its rank among equal symbols (the LF mapping), which is the number of smaller
symbols in the file plus the equal ones read so far; the new row's common prefix with its neighbours is one more than the
least common prefix between the equal symbols before and after it, of which a few numbers per symbol are carried from
buffer to buffer. So a round holds a buffer and one number per string, whatever the collection's size. Strings end in marks
that differ from each other, so no common prefix runs past an end. Common prefixes are counted up to `cap` only.

The files are unnamed scratch files of the task that builds the collection: no other task reads them, they end with it, and
a task that is run again starts anew.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import IO

import numpy as np

#: Rows that are read from a file at once.
BUFFER = 1 << 20
FAR = np.iinfo(np.uint8).max


def _least(lcp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of lcp[first..last] for each pair; lcp has one more entry than there are rows."""
    ends = np.empty(2 * len(first), np.int64)
    ends[::2], ends[1::2] = first, last + 1
    return np.minimum.reduceat(lcp, ends)[::2]


class Scan:
    """One reading of the streams for the rows that insert next: their ranks among equal symbols, and the least common
    prefixes between them and the equal symbols before and after. Buffers come in order; rows ascend."""

    def __init__(self, rows: np.ndarray, total: np.ndarray):
        self.rows, self.done, self.start = rows, 0, 0
        self.total, kinds = total, len(total)  # of each symbol in all
        self.at = np.empty(len(rows), np.int64)  # equal symbols before the row
        self.own = np.empty(len(rows), np.int64)  # the row's symbol
        self.before = np.full(len(rows), -1, np.int64)  # least prefix since the equal symbol before, -1 without
        self.after = np.full(len(rows), -1, np.int64)
        self.seen = np.zeros(kinds, np.int64)  # of each symbol so far
        self.since = np.full(kinds, FAR, np.int64)  # least prefix since its last
        self.waits = np.full(kinds, -1, np.int64)  # the row whose next equal symbol is to come
        self.until = np.full(kinds, FAR, np.int64)  # least prefix since that row

    def read(self, symbols: np.ndarray, common: np.ndarray, last: bool) -> None:
        n = len(symbols)
        whole = last and not self.start
        upto = len(self.rows) if last else int(np.searchsorted(self.rows, self.start + n))
        mine = slice(self.done, upto)
        rows = self.rows[mine] if whole else self.rows[mine] - self.start
        order = np.argsort(symbols, kind="stable")
        marked = np.zeros(n, bool)
        marked[rows] = True
        own, at = symbols[rows], np.empty(len(rows), np.int64)
        at[np.argsort(own, kind="stable")] = np.flatnonzero(marked[order])  # both are in the order of symbol, then row
        own = own.astype(np.int64)
        padded = np.append(common, np.uint8(0))
        near = order[np.maximum(at - 1, 0)]
        i = np.flatnonzero((at > 0) & (symbols[near] == own))
        before, after = np.full(len(rows), -1, np.int64), np.full(len(rows), -1, np.int64)
        if len(i):
            before[i] = _least(padded, near[i] + 1, rows[i])
        near = order[np.minimum(at + 1, n - 1)]
        k = np.flatnonzero((at + 1 < n) & (symbols[near] == own))
        if len(k):
            after[k] = _least(padded, rows[k] + 1, near[k])
        counts = self.total if whole else np.bincount(symbols, minlength=len(self.seen))
        firsts = np.cumsum(counts) - counts
        self.at[mine], self.own[mine] = at - firsts[own] + self.seen[own], own
        if not whole:
            low = np.minimum.accumulate(common).astype(np.int64)
            open_ = np.flatnonzero((before < 0) & (self.seen[own] > 0))
            before[open_] = np.minimum(self.since[own[open_]], low[rows[open_]])
            high = np.append(np.minimum.accumulate(common[::-1])[::-1], FAR).astype(np.int64)
            here = np.flatnonzero(counts)
            head, tail = order[firsts[here]], order[firsts[here] + counts[here] - 1]
            met = self.waits[here] >= 0
            self.after[self.waits[here[met]]] = np.minimum(self.until[here[met]], low[head[met]])
            self.waits[here] = -1
            self.until, self.since = np.minimum(self.until, low[-1]), np.minimum(self.since, low[-1])
            self.since[here] = high[tail + 1]
            open_ = np.flatnonzero((after < 0) & (rows == order[firsts[own] + counts[own] - 1]))
            self.waits[own[open_]], self.until[own[open_]] = open_ + self.done, high[rows[open_] + 1]
        self.before[mine], self.after[mine] = before, after
        self.seen += counts
        self.done, self.start = upto, self.start + n


def _buffers(symbols: IO[bytes], common: IO[bytes], kind: np.dtype, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, symbols, prefixes) of the n rows of two files, in order; a file of no rows is one empty buffer."""
    symbols.seek(0)
    common.seek(0)
    for start in range(0, max(n, 1), BUFFER):
        size = min(BUFFER, n - start)
        yield start, np.fromfile(symbols, kind, size), np.fromfile(common, np.uint8, size)


def build(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, common prefixes) of the strings data[start : start + size], as ranks of their byte values from 1 (0: the end mark).

    symbols[r] comes before the suffix of row r; common[r] is the length that rows r - 1 and r share, at most cap. The
    first len(starts) rows are the empty suffixes.
    """
    m = len(starts)
    values = np.flatnonzero(np.bincount(data, minlength=256))
    rank_of = np.zeros(256, np.uint8 if len(values) < 256 else np.uint16)  # one byte sorts in one pass
    rank_of[values] = np.arange(1, len(values) + 1)
    text, kinds = rank_of[data], len(values) + 1
    symbols, common = text[starts + sizes - 1], np.zeros(m, np.uint8)
    counts = np.bincount(symbols, minlength=kinds)
    active, scan = np.arange(m), Scan(np.arange(m), counts)
    with tempfile.TemporaryFile(buffering=0) as a, tempfile.TemporaryFile(buffering=0) as b, tempfile.TemporaryFile(buffering=0) as c, tempfile.TemporaryFile(buffering=0) as d:
        old, new = (a, b), (c, d)
        symbols.tofile(old[0])
        common.tofile(old[1])
        for start in range(0, m, BUFFER):
            scan.read(symbols[start : start + BUFFER], common[start : start + BUFFER], start + BUFFER >= m)
        for j in range(1, int(sizes.max()) + 1):
            # rows of the next streams, their common prefixes with the rows before and after, and their symbols
            smaller = np.cumsum(counts) - counts
            place = m + smaller[scan.own] + scan.at - counts[0]
            order = np.argsort(place, kind="stable")
            place, active = place[order], active[order]
            before = np.where(scan.before < 0, 0, np.minimum(scan.before + 1, cap))[order]
            after = np.where(scan.after < 0, 0, np.minimum(scan.after + 1, cap))[order]
            last = sizes[active] - 1 - j
            added = np.where(last >= 0, text[starts[active] + np.maximum(last, 0)], 0).astype(text.dtype)
            n = int(counts.sum())
            counts = counts + np.bincount(added, minlength=kinds)
            on = last >= 0
            scan = Scan(place[on], counts)
            ahead = place - np.arange(len(place))  # old rows before each new one
            new[0].seek(0)
            new[1].seek(0)
            for start, own, prefix in _buffers(*old, text.dtype, n):
                final = start + BUFFER >= n
                i, k = int(np.searchsorted(ahead, start)), len(place) if final else int(np.searchsorted(ahead, start + len(own)))
                at = place[i:k] - start - i
                size = len(own) + k - i
                kept = np.ones(size, bool)
                kept[at] = False
                grown, prefixes = np.empty(size, text.dtype), np.empty(size, np.uint8)
                grown[kept], prefixes[kept] = own, prefix
                grown[at] = added[i:k]
                follows = at + 1 < size
                prefixes[at[follows] + 1] = after[i:k][follows]
                prefixes[at] = before[i:k]
                grown.tofile(new[0])
                prefixes.tofile(new[1])
                scan.read(grown, prefixes, final)
            old, new, active = new, old, active[on]
            if not len(active):
                break
        n = int(counts.sum())
        old[0].seek(0)
        old[1].seek(0)
        return np.fromfile(old[0], text.dtype, n), np.fromfile(old[1], np.uint8, n)


def suffix_rows(symbols: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, string, length) of every suffix of at least `least` symbols, by following the LF mapping from the ends."""
    m, n = len(sizes), len(symbols)
    order = np.argsort(symbols, kind="stable")
    step = np.empty(n, np.int64)
    step[order] = np.arange(n)
    step += m - int((symbols == 0).sum())
    rows, strings, found = np.arange(m), np.arange(m), []
    for length in range(1, int(sizes.max()) + 1):
        on = sizes[strings] >= length
        strings, rows = strings[on], step[rows[on]]
        if length >= least:
            found.append((rows, strings, np.full(len(rows), length)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def least_owner(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `width` symbols of every string, the least owner of a string that holds the same window.

    Windows are string after string, each from front to back; also returns each string's first window.
    """
    symbols, common = build(data, starts, sizes, width)
    rows, strings, lengths = suffix_rows(symbols, sizes, width)
    counts = np.maximum(sizes - width + 1, 0)
    first = np.cumsum(counts) - counts
    group = np.cumsum(common < width) - 1
    best = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    by_row = np.full(len(symbols), np.iinfo(np.int64).max)
    by_row[rows] = owners[strings]
    heads = np.flatnonzero(common < width)
    best = np.minimum.reduceat(by_row, heads)
    out = np.empty(int(counts.sum()), np.int64)
    out[first[strings] + sizes[strings] - lengths] = best[group[rows]]
    return out, first
