"""Suffix order by cuts: the text is cut where its own symbols say so, one place in RATE or so.

Sampled are the beginnings of pieces and the cuts: places whose WINDOW symbols (one, over
wide alphabets) have a hash that RATE divides.  What stands from a place to the end of the
next cut's window, or to the piece's end, is its stretch.  No stretch is the beginning of
another, as the first cut after a place ends it.  So a suffix's order is that of its stretch
and then of the sampled suffix that follows, and sampled suffixes are ordered as those of a
text of stretches' names, which has an eighth as many symbols and goes the same way, until
it is short.  Texts that the hash does not cut well (too seldom or too often, as in long
repetitions of few symbols) are ordered by their turns (see ``induced``).

Over bytes the first PACKED symbols, up to the piece's end, stand before the rest of a
stretch as one number; where a stretch is shorter, they tell no more than the order does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphrake.functions.running import numbered
from glyphrake.operators.induced import SHORT
from glyphrake.operators.navigate import PACKED, packed_keys
from glyphrake.session import checkpoint, passing, prepare
from glyphrake.sources.corpus import ROWS, Corpus, values_of

#: One place in RATE is a cut; symbols of a window; the share of a text that its names must not be above.
RATE, WINDOW, SHRINKS = 8, 3, 0.5
#: Symbols that stretches may hold for each symbol of a text on average; usual texts have about ten.
STRETCHED = 40
#: Symbols that a task looks at at a time, and those of a partition of pieces.
SYMBOLS, PART = 1 << 18, 1 << 20
NARROW, MIX = 255, np.uint64(0x9E3779B97F4A7C15)
ORDER = ("symbol", "mark", "rest")
STRETCH = "symbol long, mark long, rest binary"
ROW = f"pos long, piece_id long, piece_pos long, f long, l long, {STRETCH}, following long"
ZSTD = {"compression": "zstd"}
#: Rounds of a digest, suffixes that one takes at least, and what its weighted sums are taken by.
ROUNDS, ROUND, MODULUS = 32, 1 << 22, 1_000_000_007


class Cuts:
    """The cuts of some pieces with their terminators, one after the other, and the stretches that begin in them."""

    def __init__(self, bodies: list[np.ndarray], max_symbol: int):
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
        #: Places of terminators and of the first symbols of pieces.
        self.last = np.cumsum(sizes) - 1
        self.first, self.n = self.last - sizes + 1, int(sizes.sum())
        self.symbols = c = np.zeros(self.n, np.int64)
        inside = np.ones(self.n, bool)
        inside[self.last] = False
        c[inside] = np.concatenate(bodies)
        self.piece = np.repeat(np.arange(len(bodies)), sizes)
        self._narrow, self._width = max_symbol <= NARROW, max(1, -(-max_symbol.bit_length() // 8))
        window = WINDOW if self._narrow else 1
        code, whole = np.zeros(max(self.n - window, 0), np.uint64), np.ones(max(self.n - window, 0), bool)
        for k in range(window):
            then = c[k : k + len(code)]
            code, whole = code * np.uint64(256) + then.astype(np.uint64), whole & (then > 0)
        sampled = np.zeros(self.n, bool)
        sampled[: len(code)] = whole & (((code * MIX) >> np.uint64(40)) % np.uint64(RATE) == 0)
        sampled[self.first] = sampled[self.last] = True
        #: Sampled places, terminators among them, and where stretches that come to them end.
        self.sampled = np.flatnonzero(sampled)
        self._ends = self.sampled + np.where(inside[self.sampled], window, 1)
        self._inside = inside

    def following(self, places: np.ndarray) -> np.ndarray:
        """Which sampled place comes after each place, by number; terminators are their own."""
        return np.searchsorted(self.sampled, places, side="right") - ~self._inside[places]

    def lengths(self, places: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Symbols of the stretches from places."""
        return self._ends[following] - places

    def stretches(self, places: np.ndarray, following: np.ndarray) -> list[pa.Array]:
        """symbol, mark and rest of the stretches from places."""
        end, c = self._ends[following], self.symbols
        first, more = (PACKED, PACKED) if self._narrow else (1, 1)
        key, mark = c[places], np.zeros(len(places), np.int64)
        if self._narrow:
            last, key = self.last[self.piece[places]], np.zeros(len(places), np.int64)
            for k in range(first):
                key = key * 257 + np.where(places + k <= last, c[np.minimum(places + k, self.n - 1)] + 1, 0)
        for k in range(first, first + more):
            mark = mark * 256 + np.where(places + k < end, c[np.minimum(places + k, self.n - 1)], 0) if self._narrow else np.where(places + k < end, c[np.minimum(places + k, self.n - 1)], 0)
        size = np.maximum(end - places - first - more, 0) * self._width
        edges = np.concatenate(([0], np.cumsum(size)))
        low = int(places[0])
        some = c[low : int(end.max())]
        stream = some.astype(np.uint8) if self._width == 1 else some.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - self._width :].reshape(-1)
        index = np.arange(edges[-1]) + np.repeat((places - low + first + more) * self._width - edges[:-1], size)
        rest = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(stream[index])])
        return [pa.array(key), pa.array(mark), rest]


def _together(batches: Iterator[pa.RecordBatch], body: int, max_symbol: int) -> Iterator[tuple[pa.RecordBatch, Cuts]]:
    """Rows of pieces, and their cuts: SYMBOLS of them at a time, or one longer piece."""
    for batch in batches:
        held, size, begin = [], 0, 0
        for at, value in enumerate(batch.column(body)):
            held.append(values_of(value))
            size += len(held[-1]) + 1
            if size >= SYMBOLS or at + 1 == batch.num_rows:
                yield batch.slice(begin, at + 1 - begin), Cuts(held, max_symbol)
                held, size, begin = [], 0, at + 1


def _sample_rows(max_symbol: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in _together(batches, 1, max_symbol):
            offset, numbers = rows.column(0).to_numpy(), np.flatnonzero(own.symbols[own.sampled] > 0)
            k = numbers - np.searchsorted(own.sampled, own.first)[own.piece[own.sampled[numbers]]]
            for a in range(0, len(numbers), ROWS):
                places, following = own.sampled[numbers[a : a + ROWS]], numbers[a : a + ROWS] + 1
                columns = [offset[own.piece[places]], k[a : a + ROWS], own.lengths(places, following)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *own.stretches(places, following)], names=["offset", "k", "length", *ORDER])

    return run


def _pairs(own: Cuts) -> np.ndarray:
    """The first two symbols of each suffix as one number; 0 for terminators."""
    return np.where(own.symbols > 0, own.symbols * 256 + np.append(own.symbols[1:], 0), 0)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << 16, np.int64)
    for _, own in _together(batches, 0, NARROW):
        seen += np.bincount(_pairs(own), minlength=len(seen))
    there = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], names=["pair", "n"])


def _all_rows(max_symbol: int, pairs: tuple[int, int] | None = None):
    """pairs: only suffixes whose first two symbols are from the first on and below the last."""
    names = ["pos", "piece_id", "piece_pos", "f", "l", *ORDER, "following"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in _together(batches, 2, max_symbol):
            offset, ids, rank = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(3).flatten().to_numpy()
            c, before = own.symbols, np.concatenate(([0], own.symbols[:-1]))
            before[own.first] = 0
            some = np.arange(own.n) if pairs is None else np.flatnonzero(((p := _pairs(own)) >= pairs[0]) & (p < pairs[1]))
            for a in range(0, len(some), ROWS):
                places = some[a : a + ROWS]
                following, piece = own.following(places), own.piece[places]
                inner = places - own.first[piece]
                # terminators come first, in the order that they have among the sampled suffixes
                columns = (offset[piece] + inner, ids[piece], inner, c[places], before[places])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *own.stretches(places, following), pa.array(rank[following])], names=names)

    return run


def cut_order(pieces: DataFrame, n: int, max_symbol: int, in_memory: Callable[[Corpus], DataFrame], by_turns: Callable[..., DataFrame], short: int = SHORT, keep=checkpoint) -> DataFrame:
    """The suffix table (sa_row, pos, piece_id, piece_pos, f, l) of a text in pieces (offset BIGINT, piece_id BIGINT, body).

    Over bytes it has key, too: the first PACKED symbols up to the piece's end as one number.
    in_memory orders a Corpus of short symbols at most, by_turns one that is not cut well, and
    writes it with keep; both give the same columns.  A row for each symbol moves once; lower levels have an eighth.
    """
    prepare(pieces.sparkSession)
    pieces = checkpoint(pieces.repartition(_tasks(pieces, n), "offset"), "order-pieces")
    ranked = _ranked(pieces, n, max_symbol, in_memory, by_turns, short)
    if ranked is None:
        return by_turns(pieces, n, max_symbol, keep)
    keyed = ranked.mapInArrow(_all_rows(max_symbol), ROW)
    kept = ["pos", "piece_id", "piece_pos", "f", "l", *(["symbol"] if max_symbol <= NARROW else [])]
    rows = numbered(keyed, [*ORDER, "following"], "sa_row", label="order-rows", kept=kept, write=keep)
    return rows.select("sa_row", "pos", "piece_id", "piece_pos", "f", "l", *([F.col("symbol").alias("key")] if max_symbol <= NARROW else []))


def _tasks(pieces: DataFrame, n: int) -> int:
    """Pieces may come in one file: a task for each PART, and one for each core."""
    return max(pieces.sparkSession.sparkContext.defaultParallelism, n // PART)


def _ranked(pieces: DataFrame, n: int, max_symbol: int, in_memory: Callable[[Corpus], DataFrame], by_turns: Callable[..., DataFrame], short: int) -> DataFrame | None:
    """pieces (a table) with ranks, the order of their sampled suffixes, the terminator's last; none if they are not cut well."""
    spark = pieces.sparkSession
    with passing(spark, step=True) as hold:
        samples = checkpoint(pieces.select("offset", "body").mapInArrow(_sample_rows(max_symbol), f"offset long, k long, length long, {STRETCH}"), "order-samples", ZSTD)
        size = samples.agg(F.count("*").alias("many"), F.sum(F.col("length") * F.col("length") / 2).alias("symbols")).first()
        many, m = size["many"], size["many"] + pieces.count()
        # the stretches from all places between two sampled ones, from the length of the first
        if (size["symbols"] or 0) > STRETCHED * n or m > max(SHRINKS * n, short):
            return None
        names = numbered(checkpoint(samples.groupBy(*ORDER).count(), "order-stretches", ZSTD), ORDER, "name", label="order-names", kept=ORDER)
        different = names.count()
        named = samples.join(names.select(*ORDER, (F.col("name") + 1).alias("name")), list(ORDER)).groupBy("offset").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("seen"))
        bodies = pieces.select("offset").join(named, "offset", "left").select(F.col("offset").alias("piece_id"), F.coalesce(F.transform("seen", lambda x: x["name"]), F.array().cast("array<bigint>")).alias("body"))
        reduced = Corpus(hold(bodies, "order-reduced", ZSTD), max(many, 1))
    with passing(spark, step=True) as hold:
        if m <= short:
            ranks = in_memory(reduced)
        else:
            ranks = cut_order(reduced.with_offsets().select("offset", "piece_id", "body"), m, different, in_memory, by_turns, short)
        # the ranks of a piece's sampled suffixes, its terminator's last
        back = ranks.groupBy(F.col("piece_id").alias("offset")).agg(F.array_sort(F.collect_list(F.struct("piece_pos", "sa_row"))).alias("seen")).select("offset", F.transform("seen", lambda x: x["sa_row"]).alias("ranks"))
        return hold(pieces.join(back, "offset").select("offset", "piece_id", "body", "ranks").repartition(_tasks(pieces, n), "offset"), "order-ranked", ZSTD)


def digested(corpus: Corpus, n: int, in_memory: Callable[[Corpus], DataFrame], by_turns: Callable[..., DataFrame], short: int = SHORT, keep=checkpoint, symbols: int = ROUND) -> DataFrame | None:
    """piece_id, n, least, rows, weighted: a piece's suffixes, their least row, the sum of their rows and that of rows times places, by MODULUS.

    The suffix order of a text of bytes, of which no row is written: suffixes are sorted by
    rounds of those whose first two symbols are in a range, ROUNDS at most, and each round
    is added up by piece where it is sorted.  A pair of symbols is never divided, so a
    round has as many as the commonest at least.  None if the text is not cut well.
    """
    spark = corpus.pieces.sparkSession
    prepare(spark)
    with passing(spark, step=True) as hold:
        placed = corpus.with_offsets().select("offset", "piece_id", "body")
        pieces = hold(placed.repartition(_tasks(placed, n), "offset"), "order-pieces", ZSTD)
    ranked = _ranked(pieces, n, corpus.max_symbol, in_memory, by_turns, short)
    if ranked is None:
        return None
    counts = sorted(tuple(r) for r in ranked.select("body").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect())
    most, edges, held = max(symbols, -(-n // ROUNDS)), [0], 0
    for pair, many in counts:
        if held and held + many > most:
            edges, held = [*edges, pair], 0
        held += many
    begin, found = 0, None
    for bounds in zip(edges, [*edges[1:], 1 << 16]):
        with passing(spark, step=True) as hold:
            begin, found = _digested_round(ranked.mapInArrow(_all_rows(corpus.max_symbol, bounds), ROW), begin, found, keep if bounds[1] == 1 << 16 else hold)
    return found


def _digested_round(keyed: DataFrame, begin: int, before: DataFrame | None, write) -> tuple[int, DataFrame]:
    """The digest of the rows before and of some suffixes, which stand from the row begin on, and the row after them."""
    times = lambda a, b: F.pmod(F.pmod(a, F.lit(MODULUS)) * F.pmod(b, F.lit(MODULUS)), F.lit(MODULUS))
    order, inner = [*ORDER, "following"], F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    rows = keyed.select("piece_id", "piece_pos", *order).repartitionByRange(*order).sortWithinPartitions(*order).select("piece_id", "piece_pos", F.monotonically_increasing_id().alias("_place"))
    rows = rows.select(F.shiftright("_place", 33).alias("part"), "piece_id", "piece_pos", inner.alias("inner"))
    parts = checkpoint(rows.groupBy("part", "piece_id").agg(F.count("*").alias("n"), F.min("inner").alias("least"), F.sum("inner").alias("rows"), F.sum("piece_pos").alias("places"), F.sum(times(F.col("inner"), F.col("piece_pos"))).alias("weighted")), "order-round", ZSTD)
    begins = []
    for r in sorted(parts.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        begins.append((r["part"], begin))
        begin += r["n"]
    # a row per partition at most
    known = parts.join(F.broadcast(keyed.sparkSession.createDataFrame(begins, "part long, _begin long")), "part")
    first = F.col("_begin")
    known = known.select("piece_id", "n", (F.col("least") + first).alias("least"), (F.col("rows") + first * F.col("n")).alias("rows"), (F.col("weighted") + times(first, F.col("places"))).alias("weighted"))
    known = known if before is None else known.unionByName(before)
    return begin, write(known.groupBy("piece_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("rows").alias("rows"), F.pmod(F.sum(F.pmod("weighted", F.lit(MODULUS))), F.lit(MODULUS)).alias("weighted")), "order-digest", ZSTD)
