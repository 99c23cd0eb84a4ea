"""Sharding by a Feistel permutation of global row numbers.

Every row gets a number from 0 to n - 1.  A balanced Feistel network permutes the
smallest even-bit domain that holds n, and cycle walking repeats it until the value
is below n again, which makes a permutation of exactly 0 .. n - 1.  Shard and slot
are remainder and quotient of the permuted number, so either can be computed from
the other without reading the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.llm.common import buckets_for, hash_bucket, materialize, prefix_sum, table

SHARDS, ROUNDS, SEED = 40, 6, 20_240_229


def _keys(seed: int, rounds: int) -> np.ndarray:
    return _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of shifts and multiplications (wrapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ (_mix(right ^ key) & mask)
    return (right << bits) | left


def permute(rows: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The place of each row number in a permutation of 0 .. n - 1 (or the row number of each place).

    The network swaps its halves at the end, so that it is its own inverse with the keys reversed.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = _keys(seed, rounds)
    keys = keys[::-1] if inverse else keys
    out = _network(np.asarray(rows, dtype=np.uint64), half, keys)
    while (far := out >= n).any():
        out[far] = _network(out[far], half, keys)
    return out.astype(np.int64)


def shard_rows(rows: DataFrame, row_number: str, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add place, shard and slot to rows numbered 0 .. n - 1 in row_number."""

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    return rows.withColumn("place", place(row_number)).withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


def number_rows(docs: DataFrame) -> tuple[DataFrame, int]:
    """One narrow row per document with its size, text checksum and global row number; and their count.

    Null texts count as empty.  Rows are numbered by bucket of the id's hash, then id,
    size and text hash; equal rows are interchangeable.  Null ids are rows like any other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.lit(1).alias("one"))
    narrow = materialize(narrow, "shard-rows")
    n = narrow.count()
    numbered = prefix_sum(narrow, (), hash_bucket(F.xxhash64("doc_id", "text_hash"), buckets_for(n)), (F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash", "size"), "one", "row_number")
    return numbered.drop("one"), n


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, place, shard and slot of every document; shard sizes differ by one at most.

    An empty table gives an empty result.  Columns other than doc_id and text are ignored.
    """
    numbered, n = number_rows(docs)
    return shard_rows(numbered, "row_number", n, shards, seed)


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law of rows: see shard_documents()."""
    placed = shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
