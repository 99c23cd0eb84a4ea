"""The Burrows-Wheeler transform of a corpus: steps between rows, runs, pieces and counts.

table is a suffix table: sa_row, pos, piece_id, piece_pos, f, l.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphrake.functions.running import numbered, running_sum
from glyphrake.operators.suffixes import bucket_bounds, symbol_counts
from glyphrake.session import checkpoint, prepare

#: Rows of a block, by which intervals of rows are joined.
BLOCK = 1_024


def transformed(table: DataFrame) -> DataFrame:
    """sa_row, symbol: the symbol before each suffix in order."""
    return table.select("sa_row", F.col("l").alias("symbol"))


def first_column(table: DataFrame) -> DataFrame:
    return table.select("sa_row", F.col("f").alias("symbol"))


def step_back(table: DataFrame, n: int) -> DataFrame:
    """sa_row, next_row: from each suffix to the one that starts a symbol earlier, around the text."""
    to = table.select(F.col("pos").alias("_to"), F.col("sa_row").alias("next_row"))
    return table.select("sa_row", F.pmod(F.col("pos") - 1, F.lit(n)).alias("_to")).join(to, "_to").select("sa_row", "next_row")


def step_forward(table: DataFrame, n: int, through_ends: bool = True) -> DataFrame:
    """sa_row, next_row: to the suffix a symbol later; null at terminators unless through_ends."""
    to = table.select(F.col("pos").alias("_to"), F.col("sa_row").alias("next_row"))
    rows = table.select("sa_row", F.pmod(F.col("pos") + 1, F.lit(n)).alias("_to"), "f").join(to, "_to")
    return rows.select("sa_row", (F.col("next_row") if through_ends else F.when(F.col("f") != 0, F.col("next_row"))).alias("next_row"))


def piece_ends(table: DataFrame) -> DataFrame:
    """k, piece_id: for the k-th terminator among the symbols before, the piece that it ends.

    The row of the whole text follows the last piece; any other beginning of a piece
    follows the piece before, by place in the text.
    """
    begins = numbered(checkpoint(table.where("piece_pos = 0").select("pos", "piece_id", "sa_row"), "piece-begins"), ["pos"], "at")
    before = begins.select((F.col("at") + 1).alias("at"), F.col("piece_id").alias("ended"))
    last = begins.agg(F.max_by("piece_id", "at")).first()[0]
    ended = begins.join(before, "at", "left").select("sa_row", F.coalesce("ended", F.lit(last)).alias("piece_id"))
    return numbered(checkpoint(ended, "piece-ends"), ["sa_row"], "k").select("k", "piece_id")


def first_text_row(table: DataFrame) -> int:
    """The row of the whole text (0 if there is none)."""
    row = table.where("pos = 0").select("sa_row").first()
    return row[0] if row else 0


def runs(table: DataFrame) -> DataFrame:
    """run, head, start, len, f_start: maximal runs of equal symbols before suffixes.

    f_start is where the run's rows begin once runs are sorted by head.  Neighbouring
    rows share a partition, which finds its runs in one pass; where a run goes on in the
    next partition, the driver adds the parts up, a number per partition.
    """
    spark = table.sparkSession
    prepare(spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, head, size = TaskContext.get().partitionId(), 0, None, 0

        def out(starts: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), part, np.int64)), pa.array(starts), pa.array(heads), pa.array(sizes)], names=["part", "start", "head", "len"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turns = np.flatnonzero(np.concatenate(([head is not None and c[0] != head], c[1:] != c[:-1])))
            if head is None:
                start, head = rows[0], c[0]
            edges = np.concatenate(([-size], turns))
            if len(turns):
                yield out(np.concatenate(([start], rows[turns[:-1]])), np.concatenate(([head], c[turns[:-1]])), np.diff(edges))
                start, head, size = rows[turns[-1]], c[turns[-1]], len(c) - int(turns[-1])
            else:
                size += len(c)
        if head is not None:
            yield out(np.array([start]), np.array([head]), np.array([size]))

    dealt = table.select("sa_row", "l").repartitionByRange("sa_row").sortWithinPartitions("sa_row")
    parts = checkpoint(dealt.mapInArrow(find, "part long, start long, head long, len long"), "run-parts")
    edges = parts.groupBy("part").agg(F.min(F.struct("start", "head", "len")).alias("first"), F.max(F.struct("start", "head")).alias("last")).collect()
    joined, longer, last = [], {}, None
    for r in sorted(edges, key=lambda r: r["part"]):
        if last is not None and r["first"]["head"] == last["head"]:
            joined.append((r["first"]["start"],))
            longer[last["start"]] = longer.get(last["start"], 0) + r["first"]["len"]
            if r["last"]["start"] == r["first"]["start"]:
                continue  # the whole partition belongs to the run before
        last = r["last"]
    whole = parts.select("head", "start", "len")
    if joined:
        # a row per partition at most
        whole = whole.join(F.broadcast(spark.createDataFrame(joined, "start long")), "start", "left_anti")
        whole = whole.join(F.broadcast(spark.createDataFrame(list(longer.items()), "start long, more long")), "start", "left")
        whole = whole.select("head", "start", (F.col("len") + F.coalesce("more", F.lit(0))).alias("len"))
    in_order = numbered(checkpoint(whole, "runs"), ["start"], "run")
    return running_sum(in_order, ["head", "start"], "len", "f_start").select("run", "head", "start", "len", "f_start")


def run_bits(run_table: DataFrame, sorted_by_head: bool = False) -> DataFrame:
    """sa_row, bit: 1 where a run starts, in text order of runs or in order of heads."""
    first = F.col("f_start") if sorted_by_head else F.col("start")
    rows = run_table.select(first.alias("_first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("_i"))
    return rows.select((F.col("_first") + F.col("_i")).alias("sa_row"), F.when(F.col("_i") == 0, 1).otherwise(0).alias("bit"))


def run_counts(run_table: DataFrame, max_symbol: int = 255) -> DataFrame:
    """c, cnt, c0, c1 over runs: how many runs have each head."""
    return bucket_bounds(symbol_counts(run_table, "head"), max_symbol)
