"""Suffix order of one text in memory, and navigation of its transform, in array operations.

A navigator answers for many rows or intervals at once.  Both kinds keep one sorted array
of numbers (symbol, place): the place of a symbol's k-th occurrence among the rows is at
the symbol's bucket start plus k, so that a step for a chosen symbol is a binary search.
Transform has an entry per row, Runs one per run of equal symbols.
"""

from __future__ import annotations

import numpy as np

#: Bytes that fit in one sort key.
PACKED = 7


def packed_keys(symbols: np.ndarray) -> np.ndarray:
    """The next PACKED symbols (at most 255) of every place as one number, ordered as they are; nothing follows the end."""
    coded = np.concatenate((symbols.astype(np.int64) + 1, np.zeros(PACKED - 1, np.int64)))
    key = np.zeros(len(symbols), np.int64)
    for i in range(PACKED):
        key = key * 257 + coded[i : i + len(symbols)]
    return key


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values, the number of each value among them, and the stable order of the numbers."""
    if len(values) and 0 <= values.min() and values.max() < 1 << 16:
        there = np.bincount(values) > 0
        symbols = np.flatnonzero(there)
        codes = (np.cumsum(there) - 1).astype(np.uint16)[values]
        return symbols, codes.astype(np.int64), np.argsort(codes, kind="stable")
    symbols, codes = np.unique(values, return_inverse=True)
    return symbols, codes.astype(np.int64), np.argsort(codes, kind="stable")


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix order of a text by prefix doubling; suffixes that stand alone in their bucket are not sorted again."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = int(text.max()) <= 255
    key, seen = (packed_keys(text), PACKED) if small else (text.astype(np.int64), 1)
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rows, rank = np.arange(n), np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, rows, 0))
    while True:
        places = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(places):
            return order
        suffix = order[places]
        further = suffix + seen
        then = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        both = rank[suffix] * (n + 1) + then
        moved = np.argsort(both, kind="stable")
        order[places], both = suffix[moved], both[moved]
        first[places] = np.concatenate(([True], both[1:] != both[:-1]))
        rank[order[places]] = np.maximum.accumulate(np.where(first[places], places, 0))
        seen *= 2


class Navigator:
    """Steps between the rows of a transform, around the text.

    start_row is the row of the whole text.  What is before the text is its last
    terminator, whose suffix is the first row: there the order of rows and the order of
    terminators differ, which back() and forward() allow for.
    """

    symbols: np.ndarray
    n: int
    start_row: int

    def code(self, c: np.ndarray) -> np.ndarray:
        """Numbers of symbols; -1 for those that the text does not have."""
        at = np.minimum(np.searchsorted(self.symbols, c), max(len(self.symbols) - 1, 0))
        return np.where(self.symbols[at] == c, at, -1) if len(self.symbols) else np.full(len(c), -1)

    def bucket(self, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Bucket start of each symbol plus how often it is before each row: the step for a chosen symbol."""
        raise NotImplementedError

    def before(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of the symbols before the suffixes of rows."""
        raise NotImplementedError

    def _from_bucket(self, places: np.ndarray) -> np.ndarray:
        """The row whose symbol before is the one that the bucket order has at each place."""
        raise NotImplementedError

    @property
    def _start_place(self) -> int:
        """How many terminators are before the row of the whole text."""
        return int(self.bucket(np.zeros(1, np.int64), np.array([self.start_row]))[0])

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that start a symbol earlier, around the text."""
        rows = np.asarray(rows, np.int64)
        code = self.before(rows)
        to = self.bucket(code, rows)
        moved = np.where(rows == self.start_row, 0, np.where(rows < self.start_row, to + 1, to))
        return np.where(self.symbols[code] == 0, moved, to) if len(rows) else to

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that start a symbol later, around the text."""
        rows = np.asarray(rows, np.int64)
        at = np.where((rows > 0) & (rows <= self._start_place), rows - 1, rows)
        return np.where(rows == 0, self.start_row, self._from_bucket(at))

    def intervals(self, symbols: np.ndarray, sizes: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each pattern (its symbols one after the other, and their number) put before what the intervals stand for; s = e where there are none."""
        codes = self.code(symbols)
        ends, s, e = np.cumsum(sizes), s.astype(np.int64), e.astype(np.int64)
        for done in range(int(sizes.max(initial=0))):
            i = np.flatnonzero((sizes > done) & (s < e))
            if not len(i):
                break
            c = codes[ends[i] - 1 - done]
            known = c >= 0
            s[i[~known]] = e[i[~known]] = 0
            i, c = i[known], c[known]
            s[i], e[i] = self.bucket(c, s[i]), self.bucket(c, e[i])
        return s, np.maximum(s, e)

    def below(self, symbols: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many suffixes are smaller than each pattern (its symbols one after the other, and their number) followed by the suffix of its row; also where the text has no such pattern or symbol."""
        codes, smaller = self.code(symbols), np.searchsorted(self.symbols, symbols)
        ends, rows = np.cumsum(sizes), rows.astype(np.int64)
        for done in range(int(sizes.max(initial=0))):
            i = np.flatnonzero(sizes > done)
            at = ends[i] - 1 - done
            # before a symbol that the text lacks are those of smaller ones, all rows if it is above them
            known, between = codes[at] >= 0, (codes[at] < 0) & (smaller[at] < len(self.symbols))
            moved = np.full(len(i), self.n, np.int64)
            moved[known] = self.bucket(codes[at[known]], rows[i[known]])
            moved[between] = self.bucket(smaller[at[between]], np.zeros(int(between.sum()), np.int64))
            rows[i] = moved
        return rows

    def positions(self, rows: np.ndarray, sample: np.ndarray, level: int) -> np.ndarray:
        """Places of suffixes: all rows step back together until each meets a sampled one."""
        at, out = np.asarray(rows, np.int64).copy(), np.zeros(len(rows), np.int64)
        open_, steps = np.arange(len(at)), 0
        while len(open_):
            met = at[open_] % (1 << level) == 0
            i = open_[met]
            out[i] = (sample[at[i] >> level] + steps) % self.n
            open_, steps = open_[~met], steps + 1
            at[open_] = self.back(at[open_])
        return out


class Transform(Navigator):
    """An entry for every row.  before_: the symbols before the suffixes in order."""

    def __init__(self, before_: np.ndarray, start_row: int):
        self.n, self.start_row, self._stride = len(before_), start_row, len(before_) + 1
        self.symbols, self._codes, by_symbol = coded(before_)
        self._entries = self._codes[by_symbol] * self._stride + by_symbol

    def bucket(self, code, rows):
        return np.searchsorted(self._entries, code * self._stride + rows)

    def before(self, rows):
        return self._codes[rows]

    def first(self, rows):
        """Numbers of the first symbols of the suffixes."""
        return self._entries[rows] // self._stride

    def _from_bucket(self, places):
        return self._entries[places] % self._stride


class Runs(Navigator):
    """An entry for every run: its symbol (head) and first row (start), in order of start, and n rows in all."""

    def __init__(self, heads: np.ndarray, starts: np.ndarray, n: int, start_row: int):
        self.n, self.start_row, self._stride, self._starts = n, start_row, n + 1, starts
        self.symbols, self._codes, by_head = coded(heads)
        lengths = np.diff(np.append(starts, n))
        self._entries = self._codes[by_head] * self._stride + starts[by_head]
        self._lengths = lengths[by_head]
        self._f_starts = np.cumsum(self._lengths) - self._lengths
        self._bucket_starts = self._f_starts[np.searchsorted(self._codes[by_head], np.arange(len(self.symbols)))]

    def bucket(self, code, rows):
        if not len(self._entries):
            return np.zeros(len(rows), np.int64)
        at = np.searchsorted(self._entries, code * self._stride + rows, side="right") - 1
        own = np.maximum(at, 0)
        there = (at >= 0) & (self._entries[own] // self._stride == code)
        inside = np.minimum(rows - self._entries[own] % self._stride, self._lengths[own])
        return np.where(there, self._f_starts[own] + inside, self._bucket_starts[code])

    def before(self, rows):
        return self._codes[np.searchsorted(self._starts, rows, side="right") - 1]

    def first(self, rows):
        """Numbers of the first symbols of the suffixes."""
        return self._entries[np.searchsorted(self._f_starts, rows, side="right") - 1] // self._stride

    def _from_bucket(self, places):
        run = np.searchsorted(self._f_starts, places, side="right") - 1
        return self._entries[run] % self._stride + places - self._f_starts[run]
