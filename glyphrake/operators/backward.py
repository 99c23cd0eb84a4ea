"""Backward search of many patterns at once by a transform that fits in memory.

A state is a pattern with its interval of rows; a step takes the next symbol from the
right.  The transform is sent to the tasks, each of which steps its share of the patterns.
What stays in tables is in ``lookup``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.operators.navigate import Navigator
from glyphrake.operators.transform import BLOCK
from glyphrake.session import prepare


def pattern_rows(spark: SparkSession, patterns: Sequence[bytes | Sequence[int]]) -> DataFrame:
    """pattern_id, symbols from the caller's patterns."""
    ids = pa.array(np.arange(len(patterns)))
    symbols = pa.array([list(p) for p in patterns], pa.list_(pa.int64()))
    return spark.createDataFrame(pa.table({"pattern_id": ids, "symbols": symbols}))


def with_start(patterns: DataFrame, n: int, start: DataFrame | None) -> DataFrame:
    """pattern_id, symbols and the first interval: start's (pattern_id, s, e), or all n rows."""
    rows = patterns.select("pattern_id", "symbols")
    return rows.join(start, "pattern_id") if start is not None else rows.withColumns({"s": F.lit(0).cast("long"), "e": F.lit(n).cast("long")})


def intervals_in_memory(patterns: DataFrame, navigator: Navigator, start: DataFrame | None = None) -> DataFrame:
    """As intervals(), in one pass over the patterns; the navigator is sent to all tasks."""
    spark = patterns.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(navigator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, sizes = batch.column(1).flatten().to_numpy(), pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
            s, e = shared.value.intervals(symbols, sizes, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(e)], names=["pattern_id", "s", "e"])

    return with_start(patterns, navigator.n, start).mapInArrow(run, "pattern_id long, s long, e long")


def rows_of(found: DataFrame, table: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of the suffix table in each pattern's interval, by equal joins on blocks of rows."""
    full = found.where("s < e").select("pattern_id", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / block), F.floor((F.col("e") - 1) / block))).alias("_blk"))
    rows = table.withColumn("_blk", F.floor(F.col("sa_row") / block))
    return full.join(rows, "_blk").where("sa_row >= s and sa_row < e").drop("_blk", "s", "e")


def located_in_memory(rows: DataFrame, navigator: Navigator, sample: np.ndarray, level: int) -> DataFrame:
    """rows (its sa_row) with pos, by stepping back to sampled rows in the tasks."""
    prepare(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((navigator, sample))
    at, schema = rows.columns.index("sa_row"), rows.select("*", F.lit(0).cast("long").alias("pos")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.positions(batch.column(at).to_numpy(), known, level))], names=schema.names)

    return rows.mapInArrow(run, schema)


def navigated(rows: DataFrame, navigator: Navigator) -> DataFrame:
    """sa_row, before, first, back, forward: the symbols before and at a suffix, and the rows a symbol earlier and later."""
    prepare(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(navigator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            columns = (at, own.symbols[own.before(at)], own.symbols[own.first(at)], own.back(at), own.forward(at))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["sa_row", "before", "first", "back", "forward"])

    return rows.select("sa_row").mapInArrow(run, "sa_row long, before long, first long, back long, forward long")


def chosen_steps(rows: DataFrame, navigator: Navigator, symbols: Sequence[int]) -> DataFrame:
    """sa_row, c, step: the row that each chosen symbol put before a row's suffix leads to; none for symbols that the text does not have."""
    prepare(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((navigator, np.array(symbols, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chosen = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            for c, code in zip(chosen.tolist(), own.code(chosen).tolist()):
                if code >= 0:
                    step = own.bucket(np.full(len(at), code), at)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), c)), pa.array(step, pa.int64())], names=["sa_row", "c", "step"])

    return rows.select("sa_row").mapInArrow(run, "sa_row long, c long, step long")
