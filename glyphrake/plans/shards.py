"""An index over any number of pieces, cut into shards that are built and searched on their own.

Matches never cross pieces, so any whole pieces make a shard: those that follow each other
in a partition of the input.  A shard is one row: its transform (or the runs of it), sampled positions and the
beginnings of its pieces as bytes.  One task sorts a shard in memory, and a batch of patterns is answered
by reading the shards once, whatever the number of patterns or symbols in them.

A suffix is compared with a pattern no further than its piece goes, so the suffixes of the
whole text below a pattern are those of all shards: intervals of the whole text's suffix
order are sums over shards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.errors import InvalidPatternError
from glyphrake.operators.navigate import Runs, Transform, sorted_suffixes
from glyphrake.plans.index import Pattern, symbols_in
from glyphrake.session import passing, prepare
from glyphrake.sources.corpus import Corpus, values_of

#: Symbols of a shard (a longer piece is a shard of its own), bytes of patterns that are sent to all tasks at once, matches handed on at a time, and those that are read on from.
SHARD, BATCH_BYTES, ROWS, READ = 1 << 21, 16_000_000, 1 << 16, 1 << 10
#: A core's shares that a partition may have before pieces are dealt, shards of a partition then, and parts that copies of a piece are dealt to.
UNEVEN, DEALT, SALTS = 2, 4, 64
#: Parquet looks at the size of a page and a row group after 100 rows, which are hundreds of MB of shards: here after each row, so that a task holds a few shards at a time when it writes and reads.
WRITTEN = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(16 << 20), "compression": "zstd"}
TABLE = "shard long, n long, piece_ids binary, begins binary, before binary, start_row long, positions binary, level int, lengths binary"


def _place_type(n: int) -> str:
    return "<u4" if n < 1 << 32 else "<i8"


def _measured(corpus: Corpus) -> tuple[int, int, int]:
    """Symbols, pieces, and the symbols of the largest partition."""
    n, pieces = corpus.measured()
    parts = corpus.pieces.select(F.spark_partition_id().alias("part"), (corpus.body_length() + 1).alias("size")).groupBy("part").agg(F.sum("size").alias("size"))
    return n, pieces, parts.agg(F.max("size")).first()[0] or 0


def _dealt(corpus: Corpus, n: int, largest: int, shard: int) -> DataFrame:
    """pieces with _size, in partitions that are cut into shards: where they are, or dealt once if one has far more than a core's share.

    Any whole pieces make a shard, so nothing is put in order.  Copies of a piece are dealt to several partitions.
    """
    pieces = corpus.pieces.select("piece_id", "body", (corpus.body_length() + 1).alias("_size"))
    cores = pieces.sparkSession.sparkContext.defaultParallelism
    if largest <= max(shard, UNEVEN * n // cores):
        return pieces
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    return pieces.repartition(max(cores, n // (DEALT * shard)), "piece_id", F.xxhash64("body"), salt)


def _in_shards(shard: int, level: int, wide: bool, by_run: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers of shards: those of the partition, and of the shard inside it
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            begin, sizes = 0, batch.column(2).to_numpy()
            for at, own in enumerate(sizes):
                if size and size + own > shard:
                    yield _built(number, [*held, batch.slice(begin, at - begin)], level, wide, by_run)
                    number, held, size, begin = number + 1, [], 0, at
                size += int(own)
            held.append(batch.slice(begin))
        if size:
            yield _built(number, held, level, wide, by_run)

    return run


def _built(number: int, pieces: list[pa.RecordBatch], level: int, wide: bool, by_run: bool) -> pa.RecordBatch:
    """A shard's row; by_run: before has the symbols of runs, and lengths how many rows each has."""
    pieces = pa.Table.from_batches(pieces)
    bodies = [np.append(values_of(x).astype(np.int64), 0) for x in pieces.column("body")]
    sizes, text = np.fromiter(map(len, bodies), np.int64, len(bodies)), np.concatenate(bodies)
    order, level = sorted_suffixes(text), 0 if len(text) <= 1 << level else level
    before = np.concatenate(([0], text[:-1]))[order].astype("<i8" if wide else "u1")
    lengths = None
    if by_run:
        turns = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        before, lengths = before[turns], np.diff(np.append(turns, len(text))).astype(_place_type(len(text))).tobytes()
    row = (number, len(text), pieces.column("piece_id").to_numpy().astype("<i8").tobytes(), (np.cumsum(sizes) - sizes).astype("<i8").tobytes(), before.tobytes(), int(np.flatnonzero(order == 0)[0]), order[:: 1 << level].astype(_place_type(len(text))).tobytes(), level)
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in row[:-1]] + [pa.array([row[-1]], pa.int32()), pa.array([lengths], pa.binary())], names=[x.split()[0] for x in TABLE.split(", ")])


class Shard:
    """One shard's row, ready to be searched."""

    def __init__(self, row: dict, wide: bool):
        array = lambda name, kind="<i8": np.frombuffer(row[name], kind).astype(np.int64)
        # tables without the column were saved before places were narrow
        self.n, self.level, kind = row["n"], row["level"], _place_type(row["n"]) if "lengths" in row else "<i8"
        self.positions = array("positions", kind)
        self.piece_ids, self.begins = array("piece_ids"), array("begins")
        before = array("before", "<i8" if wide else "u1")
        if row.get("lengths") is None:
            self.navigator = Transform(before, row["start_row"])
        else:
            lengths = array("lengths", kind)
            self.navigator = Runs(before, np.cumsum(lengths) - lengths, self.n, row["start_row"])

    def intervals(self, symbols: np.ndarray, sizes: np.ndarray, ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each pattern; with ends, of those that end a piece: the first rows are the terminators'."""
        last = len(self.begins) if ends else self.n
        return self.navigator.intervals(symbols, sizes, np.zeros(len(sizes), np.int64), np.full(len(sizes), last))

    def matches(self, s: np.ndarray, e: np.ndarray, begins: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pattern number, piece and place in it of the rows of intervals, ROWS of them at a time; with begins, of those that begin a piece."""
        for pattern, piece, place, _ in self._located(s, e, begins, ROWS):
            yield pattern, piece, place

    def _located(self, s: np.ndarray, e: np.ndarray, begins: bool, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        sizes = e - s
        edges = np.concatenate(([0], np.cumsum(sizes)))
        for at in range(0, int(edges[-1]), most):
            nth = np.arange(at, min(at + most, int(edges[-1])))
            pattern = np.searchsorted(edges, nth, side="right") - 1
            rows = s[pattern] + nth - edges[pattern]
            if begins:
                first = self.navigator.symbols[self.navigator.before(rows)] == 0
                pattern, rows = pattern[first], rows[first]
            pos = self.navigator.positions(rows, self.positions, self.level)
            piece = np.searchsorted(self.begins, pos, side="right") - 1
            # begins of empty pieces differ, too: every piece has its terminator
            yield pattern, self.piece_ids[piece], pos - self.begins[piece], rows

    def read_until(self, s: np.ndarray, e: np.ndarray, stops: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """As matches, with the symbols from each on until a stop or its piece's end: rows step forward together, READ of them at a time."""
        for pattern, piece, place, rows in self._located(s, e, False, READ):
            last = np.isin(self.navigator.symbols, [0, *stops])
            open_, at, nth, seen = np.arange(len(rows)), rows, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            while len(open_):
                code = self.navigator.first(at)
                on = ~last[code]
                open_, at = open_[on], at[on]
                nth.append(open_)
                seen.append(self.navigator.symbols[code[on]])
                at = self.navigator.forward(at)
            nth, seen = np.concatenate(nth), np.concatenate(seen)
            edges = np.concatenate(([0], np.cumsum(np.bincount(nth, minlength=len(rows)))))
            yield pattern, piece, place, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(seen[np.argsort(nth, kind="stable")], pa.int64()))


class ShardedIndex:
    """Counts and locates batches of patterns, anywhere in pieces or at their beginnings, ends or as wholes."""

    def __init__(self, corpus: Corpus, level: int = 2, shard: int = SHARD, by_run: bool = False):
        """by_run: shards keep the runs of their transforms instead of a symbol for each row."""
        self.corpus, self.wide = corpus, corpus.wide
        self.n, self.pieces, largest = _measured(corpus)
        spark, wide = corpus.pieces.sparkSession, corpus.wide
        prepare(spark)
        with passing(spark) as keep:
            self.table = keep(_dealt(corpus, self.n, largest, shard).mapInArrow(_in_shards(shard, level, wide, by_run), TABLE), "index-shards", WRITTEN)

    def save(self, path: str) -> None:
        self.table.write.options(**WRITTEN).parquet(f"{path}/shards")
        self.table.sparkSession.createDataFrame([(self.n, self.pieces, self.wide)], "n long, pieces long, wide boolean").write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ShardedIndex:
        index, about = cls.__new__(cls), spark.read.parquet(f"{path}/about").first()
        index.n, index.pieces, index.wide, index.table = about["n"], about["pieces"], about["wide"], spark.read.parquet(f"{path}/shards")
        prepare(spark)
        return index

    def stored_bytes(self) -> int:
        """Bytes of all shards' arrays."""
        kept = [c for c in ("piece_ids", "begins", "before", "positions", "lengths") if c in self.table.columns]
        return self.table.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in kept), F.lit(0)).cast("long"))).first()[0] or 0

    def _answer(self, patterns: Sequence[Pattern], schema: str, reply) -> DataFrame:
        """reply's rows for every shard; patterns travel in batches of BATCH_BYTES, one pass over the shards each."""
        spark, out, wide = self.table.sparkSession, None, self.wide
        ids, held, size = [], [], 0
        for i, pattern in enumerate([*patterns, None]):
            own = None if pattern is None else symbols_in(pattern)
            if own is not None and 0 in own:
                raise InvalidPatternError("a terminator means nothing in a corpus of pieces")
            if ids and (own is None or size + 8 * len(own) > BATCH_BYTES):
                shared = spark.sparkContext.broadcast((np.array(ids), np.array([x for p in held for x in p], np.int64), np.array([len(p) for p in held])))

                def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                    for rows in batches:
                        for at in range(rows.num_rows):
                            for columns in reply(Shard(rows.slice(at, 1).to_pylist()[0], wide), *shared.value):
                                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in schema.split(", ")])

                found = self.table.mapInArrow(run, schema)
                out, ids, held, size = found if out is None else out.unionByName(found), [], [], 0
            if own is not None:
                ids.append(i)
                held.append(own)
                size += 8 * len(own)
        if out is None:
            raise InvalidPatternError("there are no patterns")
        return out

    def count(self, patterns: Sequence[Pattern]) -> DataFrame:
        """pattern_id, n: occurrences in all pieces; patterns without any are left out."""

        def reply(shard: Shard, ids: np.ndarray, symbols: np.ndarray, sizes: np.ndarray):
            s, e = shard.intervals(symbols, sizes, False)
            there = s < e
            yield ids[there], (e - s)[there]

        return self._answer(patterns, "pattern_id long, n long", reply).groupBy("pattern_id").agg(F.sum("n").alias("n"))

    def intervals(self, patterns: Sequence[Pattern]) -> DataFrame:
        """pattern_id, s, e: each pattern's rows in the suffix order of the whole text, also of patterns that have none; a text of no pieces has no rows."""

        def reply(shard: Shard, ids: np.ndarray, symbols: np.ndarray, sizes: np.ndarray):
            below = lambda row: shard.navigator.below(symbols, sizes, np.full(len(sizes), row))
            yield ids, below(0), below(shard.n)

        return self._answer(patterns, "pattern_id long, s long, e long", reply).groupBy("pattern_id").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))

    def refined(self, searches: Sequence[Pattern], more: Sequence[tuple[int, Pattern]]) -> DataFrame:
        """pattern_id, n: for each of more (the number of a search, symbols), how often the symbols stand before the search's matches; those that never do are left out.

        Every shard searches once and refines the rows that it has found.
        """
        first, of = [symbols_in(p) for p in searches], np.array([i for i, _ in more], np.int64)
        if any(0 in p for p in first):
            raise InvalidPatternError("a terminator means nothing in a corpus of pieces")
        own, lengths = np.array([x for p in first for x in p], np.int64), np.array([len(p) for p in first], np.int64)

        def reply(shard: Shard, ids: np.ndarray, symbols: np.ndarray, sizes: np.ndarray):
            s, e = shard.intervals(own, lengths, False)
            s, e = shard.navigator.intervals(symbols, sizes, s[of[ids]], e[of[ids]])
            there = s < e
            yield ids[there], (e - s)[there]

        return self._answer([p for _, p in more], "pattern_id long, n long", reply).groupBy("pattern_id").agg(F.sum("n").alias("n"))

    def locate_until(self, patterns: Sequence[Pattern], stops: Sequence[int]) -> DataFrame:
        """pattern_id, piece_id, piece_pos, symbols of every occurrence: from it on until a stop, however far, or the piece's end."""

        def reply(shard: Shard, ids: np.ndarray, symbols: np.ndarray, sizes: np.ndarray):
            s, e = shard.intervals(symbols, sizes, False)
            for pattern, piece, place, read in shard.read_until(s, e, stops):
                yield ids[pattern], piece, place, read

        return self._answer(patterns, "pattern_id long, piece_id long, piece_pos long, symbols array<long>", reply)

    def locate(self, patterns: Sequence[Pattern], begins: bool = False, ends: bool = False) -> DataFrame:
        """pattern_id, piece_id, piece_pos of every occurrence; with begins and ends, of those that begin and end a piece."""

        def reply(shard: Shard, ids: np.ndarray, symbols: np.ndarray, sizes: np.ndarray):
            for pattern, piece, place in shard.matches(*shard.intervals(symbols, sizes, ends), begins):
                yield ids[pattern], piece, place

        return self._answer(patterns, "pattern_id long, piece_id long, piece_pos long", reply)

