"""Suffix order by sampling: sort some suffixes of a shorter text, then all others by them.

Sampled are the beginnings of pieces and the places where a descent turns (a symbol with a
larger one before it and a larger one after its run).  What stands from a place to the next
sampled one, that one's symbol included, is its stretch.  No stretch is the beginning of
another: told by run, with whether each run goes down or up, two stretches differ before
either ends.  So a suffix's order is that of its stretch and then of the sampled suffix
that follows, and sampled suffixes are ordered as the suffixes of a text of stretches'
names, which has a third as many symbols; that one goes the same way, until it is short
or its names are all different.

Runs are told by symbol, direction and length, so that a stretch of bytes has 510 runs at
most.  Over names and wide alphabets a text may rise or fall through thousands of
different symbols, whose stretches would take bytes with the square of that: such a text is
not shortened (see STRETCHED).  All that is done along a text is done inside a piece's row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphrake.functions.running import numbered
from glyphrake.session import checkpoint, prepare
from glyphrake.sources.corpus import ROWS, Corpus, values_of

#: Symbols of a text that is not shortened any more, and the share of a text that its names must not be above.
SHORT, SHRINKS = 1 << 16, 0.8
#: Bytes that stretches may take for each symbol of a text on average; usual texts have 4 to 8.
STRETCHED = 64
#: Lengths of runs that are told in one byte, and what stands for longer ones and for the end of a stretch.
LONGEST, LONG, END = 100, 101, 255
#: Down: the longer run is larger.  Up: the shorter one is, and any is larger than one that goes down.
UP = 1 << 62
STRETCH = "symbol long, mark long, rest binary"


class Runs:
    """The runs of a piece's symbols with its terminator, and the stretches that begin in them."""

    def __init__(self, body: np.ndarray, width: int):
        c = np.append(body.astype(np.int64), 0)
        self.starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        self.symbols, self.ends = c[self.starts], np.append(self.starts[1:], len(c))
        self.up = np.append(self.symbols[1:] > self.symbols[:-1], True)
        #: Runs whose first place is a turn: the terminator is one, whatever is before it.
        self.turns = np.flatnonzero(np.concatenate(([False], self.symbols[1:] < self.symbols[:-1])) & self.up)
        self.n, self._width = len(c), width

    def sampled(self) -> np.ndarray:
        """Sampled places of the body: its first and its turns."""
        turns = self.starts[self.turns]
        turns = turns[turns < self.n - 1]
        return turns if self.n == 1 or (len(turns) and turns[0] == 0) else np.concatenate(([0], turns))

    def stretches(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """symbol, mark and rest of the stretches from some places of the body: the run they stand in from there on, and the runs after it."""
        run = np.searchsorted(self.starts, places, side="right") - 1
        length = self.ends[run] - places
        mark = np.where(self.up[run], UP - length, length)
        # all runs one after the other; before a turn's own run stands the end of stretches that lead to it
        whole, sizes = self.ends - self.starts, np.full(len(self.starts), self._width + 1)
        sizes[whole > LONGEST] += 8
        is_turn = np.zeros(len(self.starts), bool)
        is_turn[self.turns] = True
        lead = np.where(is_turn, self._width + 1, 0)
        at = np.cumsum(sizes + lead) - sizes  # where each run's own bytes begin
        stream = np.zeros(int((sizes + lead).sum()), np.uint8)
        for k in range(self._width):
            digit = (self.symbols >> 8 * (self._width - 1 - k)).astype(np.uint8)
            stream[at + k] = digit
            stream[(at - self._width - 1 + k)[is_turn]] = digit[is_turn]
        stream[(at - 1)[is_turn]] = END
        short = whole <= LONGEST
        told = np.where(short, whole, LONG)
        stream[at + self._width] = np.where(self.up, END - 1 - told, told)
        long = np.flatnonzero(~short)
        if len(long):
            number = np.where(self.up[long], UP - whole[long], whole[long]).astype(">i8").view(np.uint8).reshape(-1, 8)
            stream[at[long, None] + self._width + 1 + np.arange(8)] = number
        # the rest: from the run after this one to the end of the next turn's lead
        turn = self.turns[np.searchsorted(self.turns, run, side="right")]
        begin, end = at[run] + sizes[run], at[turn]
        size = end - begin
        edges = np.concatenate(([0], np.cumsum(size)))
        index = np.arange(edges[-1]) - np.repeat(edges[:-1] - begin, size)
        rest = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(stream[index])])
        return self.symbols[run], mark, rest

    def following(self, places: np.ndarray) -> np.ndarray:
        """For places of the body, which sampled place comes after them (by number; the terminator is the last)."""
        return np.searchsorted(np.append(self.sampled(), self.n - 1), places, side="right")


def _sample_rows(width: int):
    names = ["offset", "k", "symbol", "mark", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Runs(values_of(body), width)
                places = own.sampled()
                for a in range(0, len(places), ROWS):
                    symbol, mark, rest = own.stretches(places[a : a + ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), offset)), pa.array(np.arange(a, a + len(rest))), pa.array(symbol), pa.array(mark), rest], names=names)

    return run


def _all_rows(width: int):
    names = ["pos", "symbol", "mark", "rest", "following"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for offset, body, ranks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own, rank = Runs(values_of(body), width), ranks.values.to_numpy(zero_copy_only=False)
                for a in range(0, own.n - 1, ROWS):
                    places = np.arange(a, min(a + ROWS, own.n - 1))
                    symbol, mark, rest = own.stretches(places)
                    held.append(pa.RecordBatch.from_arrays([pa.array(offset + places), pa.array(symbol), pa.array(mark), rest, pa.array(rank[own.following(places)])], names=names))
                    size += len(places)
                # terminators come first, in the order that they have among the sampled suffixes
                held.append(pa.RecordBatch.from_arrays([pa.array([offset + own.n - 1]), pa.array([0]), pa.array([0]), pa.array([b""]), pa.array([rank[-1]])], names=names))
                if size >= ROWS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def suffix_order(pieces: DataFrame, n: int, max_symbol: int, base, short: int = SHORT) -> DataFrame:
    """pos, sa_row of all suffixes of a text in pieces (offset BIGINT, body; a table: it is read several times).

    n is the number of symbols with terminators.  base orders a Corpus that is not
    shortened any more: that of names, which has a third of the symbols at most times the
    rounds.  What moves is a row for each symbol, with a stretch of a few bytes, once for
    every level; levels shrink to a third on usual texts.
    """
    prepare(pieces.sparkSession)
    width = max(1, -(-max_symbol.bit_length() // 8))
    samples = checkpoint(pieces.mapInArrow(_sample_rows(width), f"offset long, k long, {STRETCH}"), "order-samples")
    # the stretches from all places between two sampled ones, from the length of the first
    bytes_ = samples.agg(F.sum(F.pow(F.octet_length("rest").cast("double"), F.lit(2.0)))).first()[0] or 0
    if bytes_ / (2 * (width + 1)) > STRETCHED * n:
        return base(Corpus(pieces.select(F.col("offset").alias("piece_id"), "body"), max_symbol))
    order = ["symbol", "mark", "rest"]
    names = numbered(checkpoint(samples.groupBy(*order).count(), "order-stretches"), order, "name", label="order-names")
    different, many = names.count(), samples.count()
    named = samples.join(names.select(*order, (F.col("name") + 1).alias("name")), order).groupBy("offset").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("seen"))
    bodies = pieces.select("offset").join(named, "offset", "left").select(F.col("offset").alias("piece_id"), F.coalesce(F.transform("seen", lambda x: x["name"]), F.array().cast("array<bigint>")).alias("body"))
    reduced = Corpus(checkpoint(bodies, "order-reduced"), max(different, 1))
    placed = checkpoint(reduced.with_offsets(), "order-placed")
    m = many + pieces.count()
    if short < m <= SHRINKS * n and different < many:
        ranks = suffix_order(placed.select("offset", "body"), m, different, base, short)
    else:
        ranks = base(reduced)
    # the ranks of a piece's sampled suffixes, its terminator's last
    where = placed.select(F.col("piece_id").alias("offset"), F.posexplode(F.sequence(F.col("offset"), F.col("offset") + F.size("body"))).alias("k", "pos"))
    back = where.join(ranks, "pos").groupBy("offset").agg(F.array_sort(F.collect_list(F.struct("k", "sa_row"))).alias("seen")).select("offset", F.transform("seen", lambda x: x["sa_row"]).alias("ranks"))
    keyed = checkpoint(pieces.select("offset", "body").join(back, "offset").mapInArrow(_all_rows(width), f"pos long, {STRETCH}, following long"), "order-keys")
    return numbered(keyed, [*order, "following"], "sa_row", label="order-rows").select("pos", "sa_row")
