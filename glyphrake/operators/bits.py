"""Bit vectors in words with counts, and wavelet matrices made of them.

A bit vector is a table of words of 64 bits: word, bits, before (the ones in all words
before).  rank looks one word up and counts inside it; select finds the last word with
fewer ones before it.

A wavelet matrix is cut into blocks of neighbouring symbols.  A block is one row with a bit
vector per bit of the symbols, from the highest down; from level to level the block's
symbols are dealt stably, those with a 0 first.  What a symbol counts in all blocks before
is a table of its own.  So a symbol moves once, to its block, and access, rank and select
read the blocks once for any number of questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glyphrake.functions.asof import asof
from glyphrake.functions.running import running_sum
from glyphrake.session import checkpoint, passing, prepare
from glyphrake.sources.corpus import Corpus, values_of

#: Bits of a word; bits of a block at most; bytes of chunks that are handed on at a time.
WORD, BLOCK_BITS, CHUNKS = 64, 1 << 19, 1 << 20


def _word(at: Column) -> Column:
    return F.shiftright(at, 6)


def _bit(at: Column) -> Column:
    return at.bitwiseAND(F.lit(63)).cast("int")


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _ones_below(bits: Column, at: Column) -> Column:
    """Ones of a word at places smaller than at's."""
    return F.bit_count(bits.bitwiseAND(F.bitwise_not(_shifted(F.lit(-1).cast("long"), _bit(at))))).cast("long")


def _words(rows: DataFrame, n: int) -> DataFrame:
    """word, bits of all words of n bits and the one that place n is in; rows: at, bit."""
    spark = rows.sparkSession
    some = rows.where("bit = 1").groupBy(_word(F.col("at")).alias("word")).agg(F.bit_or(_shifted(F.lit(1).cast("long"), _bit(F.col("at")))).alias("bits"))
    return spark.range(n // WORD + 1).withColumnRenamed("id", "word").join(some, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))


@dataclass(frozen=True)
class BitVector:
    """words: word, bits, before; n bits, ones of which are set."""

    words: DataFrame
    n: int
    ones: int

    @classmethod
    def build(cls, rows: DataFrame, n: int) -> BitVector:
        """From at, bit (0 or 1) for places from 0; places without a row are 0."""
        counted = checkpoint(_words(rows, n).withColumn("count", F.bit_count("bits").cast("long")), "bits-words")
        words = running_sum(counted, ["word"], "count", "before", label="bits").select("word", "bits", "before")
        return cls(words, n, counted.agg(F.sum("count")).first()[0])

    def _looked_up(self, queries: DataFrame, at: str) -> DataFrame:
        """queries with the _bits of a place's word and the ones _before it."""
        words = self.words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"), F.col("before").alias("_before"))
        return queries.withColumn("_word", _word(F.col(at))).join(words, "_word")

    def access(self, queries: DataFrame, at: str, name: str = "bit") -> DataFrame:
        """queries with the bit at a place."""
        there = F.col("_bits").bitwiseAND(_shifted(F.lit(1).cast("long"), _bit(F.col(at)))) != 0
        return self._looked_up(queries, at).select(*queries.columns, there.cast("long").alias(name))

    def rank(self, queries: DataFrame, at: str, name: str = "rank", bit: int = 1) -> DataFrame:
        """queries with how many bits before a place (up to n) are 1, or 0."""
        ones = F.col("_before") + _ones_below(F.col("_bits"), F.col(at))
        return self._looked_up(queries, at).select(*queries.columns, (ones if bit else F.col(at) - ones).alias(name))

    def select(self, queries: DataFrame, nth: str, name: str = "at", bit: int = 1) -> DataFrame:
        """queries with the place of the nth 1 (or 0), from 0; null where there are fewer."""
        bits = F.col("bits") if bit else F.bitwise_not("bits")
        before = F.col("before") if bit else F.col("word") * WORD - F.col("before")
        words = self.words.select(before.alias("_count"), F.col("word").alias("_last"), bits.alias("_b"), before.alias("_n"), F.col("word").alias("_w"))
        # of words that begin with the same count the last one has the bit
        asked = queries.withColumns({"_count": F.col(nth), "_last": F.lit(2**62)})
        found = asof(asked, words, ["_count", "_last"], ["_w", "_b", "_n"], label="bits-found")
        inside = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftright", F.col("_b"), i).bitwiseAND(F.lit(1)) == 1), (F.col(nth) - F.col("_n") + 1).cast("int"))
        there = (F.col(nth) >= 0) & (F.col(nth) < (self.ones if bit else self.n - self.ones))
        return found.select(*queries.columns, F.when(there, F.col("_w") * WORD + F.when(there, inside)).alias(name))


class _Levels:
    """A block's bit vectors, ready to be asked: places and symbols as arrays."""

    def __init__(self, size: int, bits: bytes, levels: Sequence[int]):
        self.size, self.levels = size, levels
        self.words = np.frombuffer(bits, "<u8").reshape(len(levels), -1)
        counted = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counted, axis=1) - counted
        self.zeros = size - counted.sum(axis=1)

    @staticmethod
    def bits_of(c: np.ndarray, levels: Sequence[int]) -> bytes:
        """The words of all levels of some symbols, one more than they fill."""
        out = np.zeros((len(levels), 8 * (len(c) // WORD + 1)), np.uint8)
        for level, b in enumerate(levels):
            bit = (c >> b) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            out[level, : len(packed)] = packed
            c = np.concatenate((c[bit == 0], c[bit == 1]))
        return out.tobytes()

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level, word] + np.bitwise_count(self.words[level, word] & below)

    def _down(self, level: int, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        ones = self._ones(level, at)
        return np.where(one, self.zeros[level] + ones, at - ones)

    def access(self, at: np.ndarray) -> np.ndarray:
        c = np.zeros(len(at), np.int64)
        for level in range(len(self.levels)):
            one = (self.words[level, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            at, c = self._down(level, at, one), c * 2 + one
        return c

    def _traced(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, b in enumerate(self.levels):
            at = self._down(level, at, (c >> b) & 1 == 1)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._traced(c, at) - self._traced(c, np.zeros(len(c), np.int64))

    def select(self, c: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Places of occurrences that are there."""
        at = self._traced(c, np.zeros(len(c), np.int64)) + nth
        for level, b in reversed(list(enumerate(self.levels))):
            one = (c >> b) & 1 == 1
            bits = np.unpackbits(self.words[level].view(np.uint8), bitorder="little")[: self.size]
            by_bit = np.concatenate((np.flatnonzero(bits == 0), np.flatnonzero(bits)))
            # the level below has the places of zeros first, then those of ones
            at = by_bit[at]
        return at


def _symbol_type(max_symbol: int) -> str:
    return "u1" if max_symbol <= 255 else "<i8"


def _chunks_of_symbols(block: int, kind: str):
    """block, at, symbols: neighbouring symbols of one block, from rows at, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(at, kind="stable")
            at, c = at[order], c[order].astype(kind)
            starts = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), (np.diff(at) != 1) | (at[1:] % block == 0))))
            chunks = [x.tobytes() for x in np.split(c, starts[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(at[starts] // block), pa.array(at[starts]), pa.array(chunks, pa.binary())], names=["block", "at", "symbols"])

    return run


def _chunks_of_pieces(block: int, kind: str):
    """The same from offset, body: a piece and its terminator, cut where blocks end."""

    def out(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        at = np.fromiter((x for x, _ in held), np.int64, len(held))
        return pa.RecordBatch.from_arrays([pa.array(at // block), pa.array(at), pa.array([x for _, x in held], pa.binary())], names=["block", "at", "symbols"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for offset, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = np.append(values_of(body), 0).astype(kind)
                edges = [0, *range(block - offset % block, len(c), block), len(c)]
                for begin, end in zip(edges, edges[1:]):
                    held.append((offset + begin, c[begin:end].tobytes()))
                    size += len(held[-1][1])
                    if size >= CHUNKS:
                        yield out(held)
                        held, size = [], 0
            yield out(held)

    return run


BLOCKS = "block long, size long, bits binary, symbols array<bigint>, counts array<bigint>"


def _blocks(kind: str, levels: Sequence[int]):
    """A row for each block from its chunks in order."""

    def row(block: int, chunks: list[bytes]) -> pa.RecordBatch:
        c = np.frombuffer(b"".join(chunks), kind)
        symbols, counts = np.unique(c, return_counts=True)
        columns = [pa.array([block]), pa.array([len(c)]), pa.array([_Levels.bits_of(c, levels)], pa.binary()), *(pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in (symbols, counts))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            for block, chunk in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if held and block != own:
                    yield row(own, held)
                    held = []
                own = block
                held.append(chunk)
        if held:
            yield row(own, held)

    return run


@dataclass(frozen=True)
class WaveletMatrix:
    """blocks: a row for each `block` symbols; counts: c, block, before, count: a symbol's number in all blocks before and in a block that has it; levels: the bits of symbols, the highest first."""

    blocks: DataFrame
    counts: DataFrame
    n: int
    block: int
    levels: Sequence[int]

    @classmethod
    def build(cls, rows: DataFrame, n: int, max_symbol: int) -> WaveletMatrix:
        """From at, c (0 to max_symbol) for every place from 0 up to n."""
        return cls._of_chunks(rows.select("at", "c"), _chunks_of_symbols, n, max_symbol)

    @classmethod
    def of_corpus(cls, corpus: Corpus, n: int) -> WaveletMatrix:
        """Of the whole text of n symbols, by pieces: symbols are no rows."""
        return cls._of_chunks(corpus.with_offsets().select("offset", "body"), _chunks_of_pieces, n, corpus.max_symbol)

    @classmethod
    def _of_chunks(cls, rows: DataFrame, chunks: Callable, n: int, max_symbol: int) -> WaveletMatrix:
        prepare(rows.sparkSession)
        levels = tuple(reversed(range(max(1, max_symbol.bit_length()))))
        # a power of two, so that a task gets its rows of blocks in batches of some 64 MB
        block, kind = 1 << (BLOCK_BITS // len(levels)).bit_length() - 1, _symbol_type(max_symbol)
        with passing(rows.sparkSession) as keep:
            cut = rows.mapInArrow(chunks(block, kind), "block long, at long, symbols binary")
            blocks = keep(cut.repartition("block").sortWithinPartitions("block", "at").mapInArrow(_blocks(kind, levels), BLOCKS), "wavelet-blocks")
            seen = blocks.select("block", F.explode(F.arrays_zip("symbols", "counts")).alias("x")).select(F.col("x.symbols").alias("c"), "block", F.col("x.counts").alias("count"))
            counts = keep(running_sum(seen, ["block"], "count", "before", by="c", label="wavelet-counts").select("c", "block", "before", "count"), "wavelet-counts")
        return cls(blocks, counts, n, block, levels)

    def _block_of(self, at: Column) -> Column:
        """Place n is asked of the last block."""
        return F.least(F.call_function("shiftright", at, F.lit(self.block.bit_length() - 1)), F.lit(max(self.n - 1, 0) // self.block))

    def _inside(self, queries: DataFrame, names: Sequence[str], reply: Callable[[_Levels, dict[str, np.ndarray]], list[np.ndarray]]) -> DataFrame:
        """queries (_block and other BIGINT columns from _ on, none null) with names, reply's answers from their blocks; null where there is no block.

        A block and its questions come together, the block first; a task holds one block and a batch.
        """
        from pyspark.sql.pandas.types import to_arrow_schema

        own, levels = queries.columns, self.levels
        schema = StructType([*queries.schema.fields, *(StructField(x, LongType()) for x in names)])
        blocks = self.blocks.select(F.col("block").alias("_block"), F.lit(False).alias("_ask"), F.col("size").alias("_size"), F.col("bits").alias("_bits"))
        both = queries.withColumn("_ask", F.lit(True)).unionByName(blocks, allowMissingColumns=True)
        asked_of = {c: both.columns.index(c) for c in own if c.startswith("_")}
        at_own, (at_ask, at_size, at_bits) = [both.columns.index(c) for c in own], [both.columns.index(c) for c in ("_ask", "_size", "_bits")]
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, holding = None, None
            for batch in batches:
                ask, block = batch.column(at_ask).to_numpy(zero_copy_only=False), batch.column(asked_of["_block"]).to_numpy()
                edges = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (ask[1:] != ask[:-1])) + 1), len(block)]
                for begin, end in zip(edges, edges[1:]):
                    if begin == end:
                        continue
                    if not ask[begin]:
                        held, holding = _Levels(batch.column(at_size)[begin].as_py(), batch.column(at_bits)[begin].as_py(), levels), block[begin]
                        continue
                    part = batch.slice(begin, end - begin)
                    if held is not None and holding == block[begin]:
                        answers = [pa.array(x, pa.int64(), mask=x < 0) for x in reply(held, {c: part.column(i).to_numpy() for c, i in asked_of.items()})]
                    else:
                        answers = [pa.nulls(len(part), pa.int64()) for _ in names]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at_own), *answers], schema=arrow)

        return both.repartition("_block").sortWithinPartitions("_block", "_ask").mapInArrow(run, schema)

    def _fits(self, c: str) -> Column:
        return (F.col(c) >= 0) & (F.col(c) < F.lit(1 << len(self.levels) if len(self.levels) < 63 else 2**63 - 1))

    def read(self, queries: DataFrame, at: str, ranks: Mapping[str, str] = {}, symbol: str | None = None) -> DataFrame:
        """queries (a table) with the symbol at a place, if it has a name, and for each name in ranks how often a symbol (a column) is before the place (up to n): the blocks are read once for all of them."""
        own, block = queries.columns, self.block
        rows = queries.where((F.col(at) >= 0) & (F.col(at) <= self.n)).withColumns({"_block": self._block_of(F.col(at)), "_at": F.col(at).cast("long")})
        totals = self.counts.select("c", "block", (F.col("before") + F.col("count")).alias("total"))
        for k, c in enumerate(ranks.values()):
            # symbols that are none of the alphabet are looked for as 0 and not counted
            rows = rows.withColumn(f"_c{k}", F.when(self._fits(c), F.col(c).cast("long")).otherwise(F.lit(0).cast("long")))
            entries = totals.select(F.col("c").alias(f"_c{k}"), F.col("block").alias("_block"), F.col("total").alias("_total"))
            rows = asof(rows, entries, [f"_c{k}", "_block"], ["_total"], equal=1, strict=True, label="wavelet-before")
            rows = rows.withColumn(f"_b{k}", F.coalesce("_total", F.lit(0).cast("long"))).drop("_total")
        names = [*(f"_r{k}" for k in range(len(ranks))), *(["_s"] if symbol else [])]

        def reply(levels: _Levels, asked: dict[str, np.ndarray]) -> list[np.ndarray]:
            inner = asked["_at"] - asked["_block"] * block
            found = [levels.rank(asked[f"_c{k}"], inner) for k in range(len(ranks))]
            return [*found, *([np.where(inner < levels.size, levels.access(np.minimum(inner, levels.size - 1)), -1)] if symbol else [])]

        found = self._inside(rows, names, reply)
        counted = [F.when(self._fits(c), F.col(f"_b{k}") + F.coalesce(f"_r{k}", F.lit(0))).otherwise(F.lit(0).cast("long")).alias(name) for k, (name, c) in enumerate(ranks.items())]
        return found.select(*own, *counted, *([F.col("_s").alias(symbol)] if symbol else []))

    def access(self, queries: DataFrame, at: str, name: str = "c") -> DataFrame:
        """queries with the symbol at a place."""
        return self.read(queries, at, symbol=name)

    def rank(self, queries: DataFrame, c: str, at: str, name: str = "rank") -> DataFrame:
        """queries with how often a symbol is before a place (up to n); 0 for symbols beyond the alphabet."""
        return self.read(queries, at, {name: c})

    def select(self, queries: DataFrame, c: str, nth: str, name: str = "at") -> DataFrame:
        """queries (a table) with the place of a symbol's nth occurrence, from 0; null where there are fewer."""
        own, block = queries.columns, self.block
        rows = queries.withColumns({"_c": F.when(self._fits(c), F.col(c).cast("long")).otherwise(F.lit(-1).cast("long")), "_k": F.coalesce(F.col(nth).cast("long"), F.lit(-1).cast("long"))})
        entries = self.counts.select(F.col("c").alias("_c"), F.col("before").alias("_k"), F.col("block").alias("_of"), F.col("before").alias("_before"), F.col("count").alias("_count"))
        found = asof(rows, entries, ["_c", "_k"], ["_of", "_before", "_count"], equal=1, label="wavelet-found")
        inner = F.col("_k") - F.col("_before")
        there = F.coalesce(inner < F.col("_count"), F.lit(False))
        # what isn't there is spread over all blocks
        anywhere = F.pmod(F.col("_k"), F.lit(max(self.n - 1, 0) // block + 1))
        asked = found.select(*own, F.when(there, F.col("_of")).otherwise(anywhere).alias("_block"), F.when(there, F.col("_c")).otherwise(F.lit(0).cast("long")).alias("_c"), F.when(there, inner).otherwise(F.lit(-1).cast("long")).alias("_k"))

        def reply(levels: _Levels, asked: dict[str, np.ndarray]) -> list[np.ndarray]:
            out, some = np.full(len(asked["_k"]), -1), asked["_k"] >= 0
            out[some] = asked["_block"][some] * block + levels.select(asked["_c"][some], asked["_k"][some])
            return [out]

        return self._inside(asked, ["_found"], reply).select(*own, F.col("_found").alias(name))
