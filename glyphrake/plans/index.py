"""Indexes over a corpus: what each kind offers, and searches that can be refined.

An index is a set of tables in the shared folder.  Searching keeps intervals of rows of
the suffix table; matches and positions are DataFrames.  Up to most_in_memory symbols
(LOCAL, unless the caller says otherwise) the transform (its runs, for kinds that keep
runs) is held in memory as well, and steps are binary searches there; beyond, steps are
as-of joins with the tables.  For many documents see ``shards``, too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.errors import InvalidPatternError, InvalidTextError
from glyphrake.functions.running import numbered, running_sum
from glyphrake.operators import backward, extract, lookup, suffixes, transform
from glyphrake.operators.bits import BitVector, WaveletMatrix
from glyphrake.operators.cuts import MODULUS
from glyphrake.operators.navigate import Navigator, Runs, Transform
from glyphrake.operators.suffixes import LOCAL, first_keys
from glyphrake.session import checkpoint, passing
from glyphrake.sources.corpus import Corpus

Pattern = bytes | str | Sequence[int]


def symbols_in(pattern: Pattern) -> list[int]:
    return list(pattern.encode()) if isinstance(pattern, str) else [int(c) for c in pattern]


class PlainIndex:
    """Counts occurrences in one text and reads the symbols around them."""

    locates, by_piece, by_run = False, False, False

    def __init__(self, corpus: Corpus, level: int = 0, most_in_memory: int | None = None, inner_ends: bool = False, when_asked: bool = False):
        """level: every 2^level-th row keeps its position.  most_in_memory: see the module; 0 keeps everything in tables.

        inner_ends: a kind of one text takes several pieces, whose terminators are symbols
        like others there.  when_asked: the suffix table waits until something asks for it.
        """
        self.corpus, self.most_in_memory, self.inner_ends = corpus, most_in_memory, inner_ends
        self.n, self.pieces = corpus.measured()
        self._check_pieces()
        self.level, self._whole = suffixes.sample_level(self.n, level), None
        if not when_asked:
            self.table

    def as_kind(self, kind: type) -> PlainIndex:
        """Another kind of index of the same text, over the same suffix table."""
        index = kind.__new__(kind)
        for name in ("corpus", "most_in_memory", "n", "pieces", "level"):
            setattr(index, name, getattr(self, name))
        index.inner_ends, index._whole = True, self
        return index

    def _check_pieces(self) -> None:
        if not self.by_piece and self.pieces > 1 and not self.inner_ends:
            raise InvalidTextError("an index of one text can't hold several pieces")

    def save(self, path: str) -> None:
        """Write the suffix table, the corpus and what describes the index; the other tables follow from them."""
        self.table.write.parquet(f"{path}/suffixes")
        self.corpus.pieces.write.parquet(f"{path}/pieces")
        about = [(type(self).__name__, self.n, self.pieces, self.level, self.corpus.max_symbol)]
        self.table.sparkSession.createDataFrame(about, "kind string, n long, pieces long, level int, max_symbol long").write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, level: int | None = None) -> PlainIndex:
        """An index from saved tables, of any kind that its corpus allows; its own level unless another is wanted."""
        about = spark.read.parquet(f"{path}/about").first()
        index = cls.__new__(cls)
        index.corpus, index.n, index.pieces = Corpus(spark.read.parquet(f"{path}/pieces"), about["max_symbol"]), about["n"], about["pieces"]
        index.most_in_memory, index.inner_ends = None, False
        index._check_pieces()
        index.level = about["level"] if level is None else suffixes.sample_level(index.n, level)
        index.table = spark.read.parquet(f"{path}/suffixes")
        return index

    @cached_property
    def table(self) -> DataFrame:
        """The suffix table, built once: pieces and their ends are known without it."""
        if self._whole is not None:
            return self._whole.table
        with passing(self.corpus.pieces.sparkSession) as keep:
            return suffixes.suffix_table(self.corpus, self.n, self.most_in_memory, lambda df, _, *options: keep(df, "index-suffixes", *options))

    @cached_property
    def digest(self) -> DataFrame:
        """piece_id, n, least, rows, weighted: a piece's suffixes, their least row, the sum of their rows and that of rows times places, by cuts.MODULUS.

        The suffix table is not built for it, unless the text can't be ordered by cuts.
        """
        if not self.in_memory and "table" not in self.__dict__ and self._whole is None:
            with passing(self.corpus.pieces.sparkSession) as keep:
                found = suffixes.digest(self.corpus, self.n, self.pieces, keep)
            if found is not None:
                return found
        weighted = F.pmod(F.sum((F.col("sa_row") * F.col("piece_pos")).cast("decimal(38,0)")), F.lit(MODULUS)).cast("long")
        return self.table.groupBy("piece_id").agg(F.count("*").alias("n"), F.min("sa_row").alias("least"), F.sum("sa_row").alias("rows"), weighted.alias("weighted"))

    @cached_property
    def runs(self) -> DataFrame:
        with passing(self.table.sparkSession) as keep:
            return keep(transform.runs(self.table), "index-runs")

    @cached_property
    def _gram_rows(self) -> DataFrame:
        """pos, key, whole, row: the first symbols of suffixes; suffix tables made by cuts have them already."""
        if "key" in self.table.columns:
            return lookup.keyed_rows(self.table)
        with passing(self.table.sparkSession) as keep:
            return keep(lookup.gram_rows(self.corpus, self.table, first_keys), "index-gram-rows")

    @cached_property
    def _gram_starts(self) -> DataFrame:
        if "key" in self.table.columns:
            return self._gram_rows.select("key", (F.col("row") + 1).alias("end"))
        return checkpoint(lookup.gram_starts(self._gram_rows), "index-grams")

    @cached_property
    def _gram_steps(self) -> DataFrame:
        """Steps back by as many symbols; only longer patterns take them."""
        with passing(self.table.sparkSession) as keep:
            return keep(lookup.gram_steps(self._gram_rows, self.n), "index-gram-steps")

    @cached_property
    def steps(self) -> DataFrame:
        """Steps back by one symbol: an entry for each row, or for each run."""
        if self.by_run:
            return lookup.run_steps(self.runs)
        with passing(self.table.sparkSession) as keep:
            return keep(lookup.symbol_steps(self.table), "index-symbol-steps")

    @cached_property
    def matrix(self) -> WaveletMatrix:
        """The transform as a wavelet matrix: any symbol's count before any row, its places, and the symbol of a row."""
        return WaveletMatrix.build(self.table.select(F.col("sa_row").alias("at"), F.col("l").alias("c")), self.n, self.corpus.max_symbol)

    @cached_property
    def c_table(self) -> DataFrame:
        return checkpoint(suffixes.bucket_bounds(suffixes.symbol_counts(self.table, "f"), self.corpus.max_symbol), "index-symbols")

    @cached_property
    def sample(self) -> DataFrame:
        return checkpoint(suffixes.sampled(self.table, self.n, self.level), "index-sample")

    @cached_property
    def back(self) -> DataFrame:
        """sa_row, next_row: one symbol back."""
        with passing(self.table.sparkSession) as keep:
            if self.by_run:
                rows = self.table.sparkSession.range(self.n).withColumnRenamed("id", "sa_row")
                return keep(lookup.run_navigation(rows, self.runs, self.start_row).select("sa_row", F.col("back").alias("next_row")), "index-back")
            return keep(transform.step_back(self.table, self.n), "index-back")

    @cached_property
    def start_row(self) -> int:
        return transform.first_text_row(self.table)

    @cached_property
    def walks(self) -> DataFrame:
        with passing(self.table.sparkSession) as keep:
            walked = lookup.walks(self.back, self.level) if self.by_run else lookup.walks_in_order(self.table, self.n, self.level)
            return keep(walked, "index-walks")

    @property
    def in_memory(self) -> bool:
        return self.n <= (LOCAL if self.most_in_memory is None else self.most_in_memory)

    @cached_property
    def navigator(self) -> Navigator:
        """The transform in memory; only for an index of LOCAL symbols at most."""
        if not self.in_memory:
            raise MemoryError("the transform of this index stays in tables")
        start = self.start_row
        if self.by_run:
            runs = self.runs.select("start", "head").toArrow().sort_by("start")
            return Runs(runs.column("head").to_numpy(), runs.column("start").to_numpy(), self.n, start)
        rows = self.table.select("sa_row", "l").toArrow().sort_by("sa_row")
        return Transform(rows.column("l").to_numpy(), start)

    @cached_property
    def _sample_in_memory(self) -> np.ndarray:
        return self.sample.toArrow().sort_by("sa_row").column("pos").to_numpy()

    def __len__(self) -> int:
        return self.n

    def stored_bytes(self) -> int:
        """Bytes of what the kind keeps: a row's symbol (or a run's head, start and place by head), sampled positions, pieces' ends."""
        symbol = -(-self.corpus.max_symbol.bit_length() // 8)
        kept = self.runs.count() * (symbol + 16) if self.by_run else self.n * symbol
        sampled = -(-self.n >> self.level) if self.locates else 0
        return kept + 8 * (sampled + (self.pieces if self.by_piece else 0))

    def intervals(self, patterns: DataFrame, start: DataFrame | None = None) -> DataFrame:
        """pattern_id, s, e of many patterns (pattern_id, symbols) at once."""
        if self.in_memory:
            return backward.intervals_in_memory(patterns, self.navigator, start)
        rows = backward.with_start(patterns, self.n, start)
        inner = F.exists(F.slice("symbols", F.lit(1), F.greatest(F.size("symbols") - 1, F.lit(0))), lambda x: x == 0)
        by_grams = F.lit(start is None and not self.by_run and not self.corpus.wide) & (F.size("symbols") > 0) & ~inner
        rows = checkpoint(rows.withColumn("by_grams", by_grams), "search-patterns")
        found = [lookup.gram_intervals(rows.where("by_grams"), self._gram_starts, lambda: self._gram_steps)] if not rows.where("by_grams").isEmpty() else []
        if not found or not rows.where("not by_grams").isEmpty():
            found.append(lookup.intervals(rows.where("not by_grams"), self.steps, self.corpus.max_symbol))
        return reduce(DataFrame.unionByName, found)

    def refined(self, searches: DataFrame, patterns: DataFrame) -> DataFrame:
        """pattern_id, s, e of many searches at once: patterns (pattern_id, search_id, symbols) put before searches' intervals (search_id, s, e)."""
        start = patterns.select("pattern_id", "search_id").join(searches.select("search_id", "s", "e"), "search_id").select("pattern_id", "s", "e")
        return self.intervals(patterns.select("pattern_id", "symbols"), start)

    def positions(self, rows: DataFrame) -> DataFrame:
        """pattern_id, sa_row, pos of rows (pattern_id, sa_row), through the sampled positions."""
        rows = rows.select("pattern_id", "sa_row")
        if self.in_memory:
            return backward.located_in_memory(rows, self.navigator, self._sample_in_memory, self.level)
        return lookup.located(rows, self.walks, self.sample, self.n)

    def navigated(self, rows: DataFrame) -> DataFrame:
        """rows (sa_row) with before, first, back, forward: symbols and steps, around the text.  By runs, for kinds that keep them."""
        if self.in_memory:
            return backward.navigated(rows, self.navigator)
        if self.by_run:
            return lookup.run_navigation(rows, self.runs, self.start_row)
        onwards = transform.step_forward(self.table, self.n).withColumnRenamed("next_row", "forward")
        return rows.join(self.table.select("sa_row", F.col("l").alias("before"), F.col("f").alias("first")), "sa_row").join(self.back.withColumnRenamed("next_row", "back"), "sa_row").join(onwards, "sa_row")

    def _search(self, pattern: Pattern, start: tuple[int, int], boundary: bool) -> Search:
        return Search(self, (), start, boundary).search(pattern)

    def search(self, pattern: Pattern) -> Search:
        return self._search(pattern, (0, self.n), False)


class PlainIndexWithLocate(PlainIndex):
    locates = True


class RunIndex(PlainIndex):
    """As PlainIndex, over the runs of the transform."""

    by_run = True


class RunIndexWithLocate(RunIndex):
    locates = True


class PieceIndex(PlainIndex):
    """Counts in many pieces, and searches their beginnings, ends and wholes."""

    by_piece = True

    @cached_property
    def numbered_pieces(self) -> DataFrame:
        """piece, piece_id, begin: pieces in order with the place of their first symbol."""
        with passing(self.corpus.pieces.sparkSession) as keep:
            offsets = self.corpus.in_order().select("piece_id", "_tie", "_size")
            placed = running_sum(checkpoint(offsets, "piece-sizes"), ["piece_id", "_tie"], "_size", "begin", label="piece-begins")
            return keep(numbered(placed, ["begin"], "piece", label="piece-numbers").select("piece", "piece_id", "begin", (F.col("begin") + F.col("_size") - 1).alias("end")), "index-pieces")

    @cached_property
    def ends(self) -> BitVector:
        """A bit for each symbol of the text: is it a terminator?  Ones before a place number its piece."""
        return BitVector.build(self.numbered_pieces.select(F.col("end").alias("at"), F.lit(1).alias("bit")), self.n)

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (its pos) with piece_id and piece_pos, by the ones before each place."""
        found = self.ends.rank(rows, "pos", "piece").join(self.numbered_pieces.select("piece", "piece_id", "begin"), "piece")
        return found.select(*rows.columns, "piece_id", (F.col("pos") - F.col("begin")).alias("piece_pos"))

    def search_prefix(self, pattern: Pattern) -> Search:
        return self._search(pattern, (0, self.n), True)

    def search_suffix(self, pattern: Pattern) -> Search:
        return self._search(pattern, (0, self.pieces), False)

    def search_exact(self, pattern: Pattern) -> Search:
        return self._search(pattern, (0, self.pieces), True)


class PieceIndexWithLocate(PieceIndex):
    locates = True


KINDS = (PlainIndex, PlainIndexWithLocate, RunIndex, RunIndexWithLocate, PieceIndex, PieceIndexWithLocate)


@dataclass(frozen=True)
class Search:
    """A pattern's interval of rows.  Searching again puts symbols before the pattern."""

    index: PlainIndex
    pattern: tuple[int, ...]
    interval: tuple[int, int]
    boundary: bool

    def search(self, pattern: Pattern) -> Search:
        """The search for pattern followed by this search's pattern; first rows and boundary stay."""
        symbols = symbols_in(pattern)
        if self.index.by_piece and 0 in symbols:
            raise InvalidPatternError("a terminator means nothing in a corpus of pieces")
        if not symbols or self.interval[0] >= self.interval[1]:
            return replace(self, pattern=(*symbols, *self.pattern))
        own = self.index
        if own.in_memory:
            s, e = (int(x[0]) for x in own.navigator.intervals(np.array(symbols, np.int64), *(np.array([x]) for x in (len(symbols), *self.interval))))
        else:
            spark = own.table.sparkSession
            start = spark.createDataFrame([(0, *self.interval)], "pattern_id long, s long, e long")
            s, e = own.intervals(backward.pattern_rows(spark, [symbols]), start).select("s", "e").first()
        return replace(self, pattern=(*symbols, *self.pattern), interval=(s, e))

    def count(self) -> int:
        """Rows of the interval; the boundary of a prefix or exact search plays no part."""
        return self.interval[1] - self.interval[0]

    def rows(self) -> DataFrame:
        rows = self.index.table.where((F.col("sa_row") >= self.interval[0]) & (F.col("sa_row") < self.interval[1]))
        return rows.where("l = 0") if self.boundary else rows

    def matches(self) -> DataFrame:
        """Matches in suffix order: sa_row, and what the kind of index offers."""
        rows = self.rows()
        if not self.index.locates:
            return rows.select("sa_row").orderBy("sa_row")
        found = self.index.positions(rows.select(F.lit(0).cast("long").alias("pattern_id"), "sa_row")).select("sa_row", "pos")
        if self.index.by_piece:
            found = found.join(rows.select("sa_row", "piece_id"), "sa_row")
        return found.orderBy("sa_row")

    def forward(self, k: int) -> DataFrame:
        """sa_row, symbols: up to k symbols from each match on; in a corpus of pieces no further than the piece."""
        read = extract.around(self.rows(), self._symbols(), self.index.n, k, False, ("sa_row",))
        return (read.withColumn("symbols", extract.until("symbols", 0)) if self.index.by_piece else read).orderBy("sa_row")

    def forward_until(self, stop: int) -> DataFrame:
        """sa_row, symbols: from each match on until a symbol, however far; in a corpus of pieces no further than the piece."""
        stops = (stop, 0) if self.index.by_piece else (stop,)
        return extract.read_until(self.rows().select("sa_row", "pos"), self._symbols(), self.index.n, stops, ("sa_row",)).orderBy("sa_row")

    def backward_until(self, stop: int) -> DataFrame:
        """sa_row, symbols: before each match, nearest first, until a symbol, however far, through the ends of pieces."""
        return extract.read_until(self.rows().select("sa_row", "pos"), self._symbols(), self.index.n, (stop,), ("sa_row",), backward=True).orderBy("sa_row")

    def backward(self, k: int) -> DataFrame:
        """sa_row, symbols: the k symbols before each match, nearest first."""
        return extract.around(self.rows(), self._symbols(), self.index.n, k, True, ("sa_row",)).orderBy("sa_row")

    def _symbols(self) -> DataFrame:
        return self.index.table.select("pos", F.col("f").alias("c"))
