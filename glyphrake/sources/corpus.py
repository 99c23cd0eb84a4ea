"""Corpora: pieces of text with their place in the whole.

A corpus is the concatenation of its pieces, each followed by the terminator 0.  Piece
rows stand for that text; it is never put together.  Symbols are the bytes of a BINARY
body, or the members of an ARRAY<BIGINT> body for wider alphabets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from glyphrake.errors import InvalidTextError
from glyphrake.functions.running import running_sum
from glyphrake.functions.symbols import symbols_of
from glyphrake.session import prepare

#: The largest symbol that a BIGINT can hold, and rows of symbols that are handed on at a time.
LARGEST, ROWS = 2**63 - 1, 1 << 16


@dataclass(frozen=True)
class Corpus:
    """pieces: piece_id BIGINT, body BINARY or ARRAY<BIGINT>.  max_symbol bounds the alphabet.

    Pieces stand in order of their ids; those that share an id are pieces of their own,
    in order of a hash of their bodies.
    """

    pieces: DataFrame
    max_symbol: int = 255

    @property
    def wide(self) -> bool:
        return isinstance(self.pieces.schema["body"].dataType, ArrayType)

    def body_length(self) -> Column:
        return F.size("body").cast("long") if self.wide else F.octet_length("body").cast("long")

    def measured(self) -> tuple[int, int]:
        """Symbols of the whole text, terminators included, and pieces: one pass that also checks every symbol."""
        if self.wide:
            zero, above = F.exists("body", lambda x: x.isNull() | (x <= 0)), F.exists("body", lambda x: x > self.max_symbol)
        else:
            zero = F.contains("body", F.lit(bytearray(1)))
            above = F.lit(False) if self.max_symbol >= 255 else F.exists(symbols_of(F.col("body")), lambda x: x > self.max_symbol)
        row = self.pieces.agg(F.sum(self.body_length() + 1).alias("n"), F.count("*").alias("pieces"), F.count_if(zero).alias("zero"), F.count_if(above).alias("above")).first()
        if row["zero"]:
            raise InvalidTextError(f"{row['zero']} pieces hold the terminator 0 or a negative symbol")
        if row["above"]:
            raise InvalidTextError(f"{row['above']} pieces hold symbols above the largest of the alphabet, {self.max_symbol}")
        return row["n"] or 0, row["pieces"]

    def checked(self) -> Corpus:
        """This corpus if every symbol is between 1 and max_symbol."""
        self.measured()
        return self

    def length(self) -> int:
        """Symbols of the whole text, terminators included."""
        return self.pieces.agg(F.sum(self.body_length() + 1)).first()[0] or 0

    def pieces_count(self) -> int:
        return self.pieces.count()

    def in_order(self) -> DataFrame:
        """pieces with _size (terminator included) and _tie, by which those of one id are told apart."""
        return self.pieces.withColumns({"_size": self.body_length() + 1, "_tie": F.xxhash64("body")})

    def with_offsets(self) -> DataFrame:
        """pieces with offset, the place of each piece's first symbol in the whole text."""
        return running_sum(self.in_order(), ["piece_id", "_tie"], "_size", "offset", label="offsets").drop("_size", "_tie")

    def offsets(self) -> DataFrame:
        """piece_id, offset of every piece: bodies stay where they are."""
        return running_sum(self.in_order().select("piece_id", "_tie", "_size"), ["piece_id", "_tie"], "_size", "offset", label="offsets").select("piece_id", "offset")

    def symbols(self) -> DataFrame:
        """One row per symbol of the whole text: pos, c, l, piece_id, piece_pos.

        l is the symbol before (0 at the very beginning); terminators have c 0.
        """
        prepare(self.pieces.sparkSession)
        return self.with_offsets().select("piece_id", "offset", "body").mapInArrow(_symbol_rows, "pos long, c long, l long, piece_id long, piece_pos long")


def values_of(body: pa.Scalar) -> np.ndarray:
    """The symbols of a body: unsigned bytes, or 64-bit integers."""
    if isinstance(body, (pa.ListScalar, pa.LargeListScalar)):
        return body.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(body.as_buffer(), np.uint8)


def _symbol_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("pos", "c", "l", "piece_id", "piece_pos")
    for batch in batches:
        held, size = [], 0
        for piece, offset, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            c = np.append(values_of(body).astype(np.int64), 0)
            place = np.arange(len(c))
            held.append((place + offset, c, np.concatenate(([0], c[:-1])), np.full(len(c), piece), place))
            size += len(c)
            if size >= ROWS:
                yield from _cut(held, names)
                held, size = [], 0
        yield from _cut(held, names)


def _cut(held: list[tuple[np.ndarray, ...]], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(x) for x in zip(*held)]
    for at in range(0, len(columns[0]) if columns else 0, ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + ROWS]) for x in columns], names=list(names))


def _alphabet(max_symbol: int) -> int:
    if not 1 <= max_symbol <= LARGEST:
        raise InvalidTextError(f"the largest symbol must be between 1 and {LARGEST}")
    return max_symbol


def from_table(rows: DataFrame, piece_id: str, text: str, max_symbol: int = 255) -> Corpus:
    """A piece per row: UTF-8 bytes of a STRING, a BINARY as it is, or an ARRAY of integers.

    Rows with a null id or body are no pieces; empty bodies are.  Bodies must not hold the
    terminator: indexes check that when they are built.
    """
    kind = dict(rows.dtypes)[text]
    body = F.encode(F.col(text), "UTF-8") if kind == "string" else F.col(text).cast("array<bigint>") if kind.startswith("array") else F.col(text)
    pieces = rows.select(F.col(piece_id).cast("long").alias("piece_id"), body.alias("body")).where("piece_id is not null and body is not null")
    return Corpus(pieces, _alphabet(max_symbol))


def validated(buffer: Sequence[int], max_symbol: int) -> None:
    """Check a whole text with its terminators; raise InvalidTextError if it can't be indexed.

    A text of no symbols is fine, and so is the terminator alone.  Others must end in
    exactly one terminator and not begin with one.
    """
    n = len(buffer)
    if max(buffer, default=0) > max_symbol:
        raise InvalidTextError("a symbol is above the largest of the alphabet")
    if n == 0 or (n == 1 and buffer[0] == 0):
        return
    if buffer[0] == 0:
        raise InvalidTextError("the text begins with a terminator")
    if buffer[-1] != 0:
        raise InvalidTextError("the text does not end in a terminator")
    if buffer[-2] == 0:
        raise InvalidTextError("the text ends in more than one terminator")


def from_buffer(spark: SparkSession, buffer: bytes | Sequence[int], max_symbol: int = 255) -> Corpus:
    """Pieces of one text in which every piece, the last too, ends in 0.  Empty inner pieces count."""
    validated(buffer, _alphabet(max_symbol))
    pieces, at = [], 0
    while at < len(buffer):
        end = buffer.index(0, at)
        pieces.append((len(pieces), bytes(buffer[at:end]) if isinstance(buffer, (bytes, bytearray)) else list(buffer[at:end])))
        at = end + 1
    kind = "binary" if isinstance(buffer, (bytes, bytearray)) else "array<bigint>"
    return Corpus(spark.createDataFrame(pieces, f"piece_id long, body {kind}"), max_symbol)


def from_events(events: DataFrame, piece_id: str, order: str, kind: str, names: Iterable[str]) -> Corpus:
    """A piece per id: the numbers (from 1) of its event kinds in order."""
    number = F.create_map(*(x for i, name in enumerate(names, 1) for x in (F.lit(name), F.lit(i).cast("long"))))
    rows = events.where(F.col(piece_id).isNotNull()).groupBy(piece_id).agg(F.array_sort(F.collect_list(F.struct(order, number[F.col(kind)].alias("c")))).alias("seen"))
    return from_table(rows.select(piece_id, F.transform("seen", lambda x: x["c"]).alias("symbols")), piece_id, "symbols", max_symbol=len(list(names)))
