"""Helpers shared by the training-data operators.

Scratch tables (materialize) go to the folder named in ``spark.checkpoint.dir``, which
every executor and the driver can reach.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphrake.session import checkpoint as materialize  # noqa: F401
from glyphrake.session import prepare as ship

#: Rows that one bucket of a two-level prefix sum is meant to hold, and the bounds on the number of buckets.
ROWS_PER_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 2_000, 64, 65_536


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def buckets_for(rows: int) -> int:
    return max(MIN_BUCKETS, min(MAX_BUCKETS, rows // ROWS_PER_BUCKET))


def hash_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(key, F.lit(buckets))


def prefix_sum(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Add the exclusive running sum of value within each group of by.

    Rows of a group are taken by bucket and then by order.  Sums per bucket
    are added up first, so that a group of any size is spread over the buckets and
    no task needs more than one bucket.  bucket must follow from the row alone (a hash
    by hash_bucket, say).  df is read twice: hand in a table, not a long plan.
    """
    by = list(by)
    dealt = df.withColumn("_bucket", bucket.cast("int"))
    sums = dealt.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    start = sums.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_bucket").alias("_start_bucket"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_bucket") == F.col("_start_bucket")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inner = F.sum(value).over(Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    # the running sum comes first: join and window then share one exchange of the rows
    return dealt.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(start, same).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_bucket", "_start_bucket", "_before", "_inner", *(f"_by{i}" for i in range(len(by))))


def pieces_of(texts: Sequence[str], most_chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about most_chars characters each, one text at least."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most_chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def gathered(batches: Iterator[pa.RecordBatch], most_rows: int = 10_000, most_bytes: int = 24_000_000) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a number of rows and bytes, for work that pays by the batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows > most_rows or sum(b.nbytes for b in held) + batch.nbytes > most_bytes):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Beyond this code point there are no letters; bits of one in a gram; cells of a table in which the grams of some text are numbered.
LAST_LETTER, LETTER_BITS, GRAM_CELLS = 0x34000, 21, 1 << 22


@cache
def small_letters() -> np.ndarray:
    """The small letter of every code point, 0 for what is no letter."""
    out = np.zeros(LAST_LETTER, np.uint32)
    for c in range(LAST_LETTER):
        char = chr(c)
        if char.isalpha():
            small = char.lower()
            out[c] = ord(small) if len(small) == 1 else c
    return out


def gram_key(a, b, c):
    """Three code points (0: no letter) as one number."""
    return (a << 2 * LETTER_BITS) | (b << LETTER_BITS) | c


def distinct_grams(letters: np.ndarray, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of an array of code points, sorted, and the number of each place's among them.

    A gram is a code point with those before and after it; at says where (not at the ends).
    """
    used = np.zeros(LAST_LETTER, bool)
    used[letters] = True
    known = np.flatnonzero(used)
    k = len(known)
    if k**3 > GRAM_CELLS:
        code = letters.astype(np.int64)
        return np.unique(gram_key(code[:-2], code[1:-1], code[2:])[at if isinstance(at, slice) else at - 1], return_inverse=True)
    code = (np.cumsum(used, dtype=np.int32) - 1)[letters]
    cells = (code[:-2] * k + code[1:-1]) * k + code[2:]
    cells = cells[at if isinstance(at, slice) else at - 1]
    there = np.zeros(k**3, bool)
    there[cells] = True
    found = np.flatnonzero(there)
    nth = np.zeros(k**3, np.int32)
    nth[found] = np.arange(len(found))
    return gram_key(known[found // (k * k)], known[found // k % k], known[found % k]), nth[cells]


#: Different grams that a worker counts before it hands them on, and rows of a batch of them.
MOST_HELD, GRAM_ROWS = 1_000_000, 100_000


class GramCounts:
    """Counts of grams that a worker adds up.  taken() gives each gram once and begins anew; it is time for that when full."""

    def __init__(self, most: int = MOST_HELD):
        self._most = most
        self._begin([], [])

    def _begin(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self._keys, self._counts = keys, counts
        self.held, self.full = sum(map(len, keys)), False

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._keys.append(keys)
        self._counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * self._most:
            keys, counts = self.taken()
            self._begin([keys], [counts])
            self.full = len(keys) > self._most

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *self._keys]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([np.zeros(0, np.int64), *self._counts]), minlength=len(keys)).astype(np.int64)
        self._begin([], [])
        return keys, counts


def in_slices(batch: pa.RecordBatch, rows: int = GRAM_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows, so that no reader takes it whole."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
