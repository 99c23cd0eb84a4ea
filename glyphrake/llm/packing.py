"""Packing tokenised documents into sequences by shortest-pack-first over the length histogram.

Documents are cut at the sequence length; every full piece is a sequence of its own.
What remains of each document is packed by histogram: lengths go longest first, each
into the shortest pack, the one with the most room, if it fits there (packing patterns are
kept by room and count, so the work depends on the number of lengths and not of documents).
Patterns are then joined back to documents by rank: the places that a length has in all
sequences and the pieces of that length meet in order, and so sequences follow the order
of the documents.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.functions.running import numbered
from glyphrake.llm.common import materialize, table

SEQUENCE, END_ID = 1_024, 0
#: The marker string that the tokenizer file knows as one token, and the length from which texts take the plain road.
SPECIAL, LONG_TEXT = "<|endoftext|>", 1_000_000


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    Ids are those of the tokenizer file.  Where its special marker does not occur, the
    ranks file gives the same ids in a quarter of the time (tests compare both).
    """

    #: How both files cut a text before merging: fixed values.
    CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, file: str, ranks_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokenizer = Tokenizer.from_file(file)
        self.fast = tiktoken.Encoding("ranks", pat_str=self.CUTS, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(text) >= LONG_TEXT or SPECIAL in text:
            return self.plain(text)
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(files: tuple[str, str]) -> Encoder:
    """One encoder per worker process and pair of files."""
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long, doc_key long"
#: Sequences that a task lays out at a time, and bits of a place that count the rows of a file.
LAID_OUT, ROW_BITS = 1 << 14, 40


def tokenize_pieces(docs: DataFrame, files: tuple[str, str], sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Cut every document's ids (its text's, then end_id) into pieces of sequence ids and a shorter last one.

    docs: doc_id, text, place (BIGINT, where it stands in order).  Null texts count as empty
    and have the end id alone.
    """
    step, end = sequence * 4, end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, text, place, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    for column, x in zip(out, (doc_id, at // 4, len(part) // 4, zlib.crc32(part), total, place, key), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text", "place", F.xxhash64("doc_id", "text").alias("doc_key")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order, longest first) and how many sequences have each.

    Lengths are placed longest first, each piece into the pack with the most room; where
    not even that one holds the length, all pieces left of it start packs of their own.  Of
    packs with the same room the latest come first.  A step gives a piece each to as many
    packs of a pattern as there are pieces left; a pattern of which only some packs take
    the length is split in two, so that each step adds one pattern at most.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    most = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while most and not by_room.get(most):
                most -= 1
            if most < length:
                by_room.setdefault(capacity - length, []).append(((length,), left))
                most, left = capacity - length, 0
                continue
            pattern, count = by_room[most].pop()
            used = min(count, left)
            if used < count:
                by_room[most].append((pattern, count - used))
            by_room.setdefault(most - length, []).append((pattern + (length,), used))
            left -= used
    return [x for room in sorted(by_room) for x in by_room[room] if x[1]]


def laid_out(spark: SparkSession, patterns: Sequence[tuple[tuple[int, ...], int]]) -> DataFrame:
    """slot_length, moment, packed, slot_offset: a row for every place of every sequence.

    moment (from 0 up to MOMENTS) says when in training the sequence comes: those of a
    pattern are spread evenly.  packed numbers the sequences.
    """
    ends = np.cumsum([count for _, count in patterns], dtype=np.int64)
    shared = spark.sparkContext.broadcast((ends, patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, patterns = shared.value
        for batch in batches:
            number = batch.column(0).to_numpy()
            which = np.searchsorted(ends, number, side="right")
            for p in np.unique(which).tolist():
                lengths, count = patterns[p]
                own = number[which == p]
                moment = ((own - (ends[p] - count) + 0.5) / count * MOMENTS).astype(np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths[:-1])))
                n = len(own)
                columns = (np.tile(np.array(lengths, np.int64), n), np.repeat(moment, len(lengths)), np.repeat(own, len(lengths)), np.tile(offsets.astype(np.int64), n))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["slot_length", "moment", "packed", "slot_offset"])

    return spark.range(int(ends[-1]) if len(ends) else 0).mapInArrow(run, "slot_length long, moment long, packed long, slot_offset long")


#: Steps of training time by which sequences are put in order.
MOMENTS = 1 << 40


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add position, sequence_id and offset to pieces (a table: it is read several times).

    position numbers the pieces in order of place.  Only the histogram comes to the
    driver: a count for each length up to sequence.  Pieces of a length, in order, take the
    places that sequences have for it, in order of time; full pieces are sequences of
    their own.  sequence_id numbers the sequences by the mean position of their pieces.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    histogram.pop(sequence, None)
    placed = numbered(pieces, ["place", "doc_key", "start", "ids_crc32"], "position", label="pack-positions")
    short = numbered(materialize(placed.where(F.col("length") < sequence), "pack-short"), ["position"], "rank", by="length", label="pack-ranks")
    slots = materialize(laid_out(pieces.sparkSession, shortest_pack_first(histogram, sequence)), "pack-slots")
    slots = numbered(slots, ["moment", "packed", "slot_offset"], "slot_rank", by="slot_length", label="pack-slots")
    # a length may have very many pieces: the key has the rank as well
    packed = short.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") == F.col("slot_rank")))
    packed = packed.select(*placed.columns, "packed", F.col("slot_offset").alias("offset"))
    full = placed.where(F.col("length") == sequence).select("*", (-F.col("position") - 1).alias("packed"), F.lit(0).cast("long").alias("offset"))
    together = materialize(packed.unionByName(full), "pack-placed")
    means = materialize(together.groupBy("packed").agg(F.avg("position").alias("mean")), "pack-sequences")
    ids = numbered(means, ["mean", "packed"], "sequence_id", label="pack-ids").select("packed", "sequence_id")
    return together.join(ids, "packed").select(*pieces.columns, "position", "sequence_id", "offset")


def file_order(docs: DataFrame) -> DataFrame:
    """docs, a table read from Parquet, with place: the order of its files by their part numbers, and of the rows in each."""
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    return docs.select("doc_id", "text", (F.shiftleft(part, ROW_BITS) + F.col("_metadata.row_index")).alias("place"))


def pack_documents(docs: DataFrame, files: tuple[str, str] | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, in_order: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence, offset and position.

    position numbers the pieces by where their documents stand: with in_order as rows of
    the Parquet files that docs is read from, else in an order by hash.  Sequences are
    numbered in about the same order, the closer the more pieces there are of a length.  Null texts and texts of no characters have the end
    id alone; null ids are kept; repeated ids are documents of their own.  An empty table
    gives no rows.
    """
    if in_order:
        placed = file_order(docs)
    else:
        placed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("place"))
    pieces = materialize(tokenize_pieces(placed, files or tokenizer_files(), sequence, end_id), "pack-pieces")
    return pack_pieces(pieces, sequence).drop("doc_key", "place")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens: see pack_documents()."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
