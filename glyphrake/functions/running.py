"""Running sums over any number of rows, also within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glyphrake.session import checkpoint, prepare


def running_sum(rows: DataFrame, order: Sequence[str], value: str, name: str, by: str | None = None, label: str = "running") -> DataFrame:
    """rows with name, the sum of value (BIGINT, not negative) over the rows before, in order, within equal by (BIGINT).

    Rows are dealt by range of by and order, so that a group of any size is spread over
    tasks: each partition adds up its own rows, one after the other, and what a group
    has in earlier partitions is added from one number per partition, which is all that
    the driver sees.  There is one exchange.  Ranges come from a sample, for which rows is
    read once more: hand in a table.
    """
    spark = rows.sparkSession
    prepare(spark)
    keys = [*([by] if by else []), *order]
    schema = StructType([*rows.schema.fields, StructField("_part", LongType()), StructField("_inner", LongType())])
    at_value, at_by = rows.columns.index(value), rows.columns.index(by) if by else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(at_value).to_numpy().astype(np.int64)
            group = batch.column(at_by).to_numpy() if at_by is not None else np.zeros(n, np.int64)
            before = np.cumsum(v) - v
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            base = before[heads]
            if last is not None and group[0] == last:
                base[0] -= held
            inner = before - np.repeat(base, np.diff(np.append(heads, n)))
            held, last = int(inner[-1] + v[-1]), group[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(inner)], names=schema.names)

    table = checkpoint(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), label)
    group = F.col(by) if by else F.lit(0).cast("long")
    ends = table.groupBy("_part").agg(F.min(group).alias("first"), F.max(F.struct(group.alias("last"), (F.col("_inner") + F.col(value)).alias("tail"))).alias("end")).collect()
    carries, held, last = [], 0, None
    for r in sorted(ends, key=lambda r: r["_part"]):
        carry = held if r["first"] == last else 0
        if carry:
            carries.append((r["_part"], r["first"], carry))
        held = r["end"]["tail"] + (carry if r["first"] == r["end"]["last"] else 0)
        last = r["end"]["last"]
    if not carries:
        return table.withColumnRenamed("_inner", name).drop("_part")
    # a row per partition at most
    carried = F.broadcast(spark.createDataFrame(carries, "_from long, _group long, _carry long"))
    placed = table.join(carried, (F.col("_part") == F.col("_from")) & (group == F.col("_group")), "left")
    return placed.select(*(F.col(c) for c in rows.columns), (F.col("_inner") + F.coalesce("_carry", F.lit(0))).alias(name))


def numbered(rows: DataFrame, order: Sequence[str], name: str, by: str | None = None, label: str = "numbers", kept: Sequence[str] | None = None, write=checkpoint) -> DataFrame:
    """rows (kept: only these columns of them) with their number from 0 in order, within equal by.

    Without by, rows are counted where Spark sorts them: a row's number is its place in its
    partition and the rows of the partitions before.
    """
    if by is not None:
        return running_sum(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", name, by, label).drop("_one")
    own = list(kept or rows.columns)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*own).withColumn("_place", F.monotonically_increasing_id())
    table = write(dealt, label)
    # a place is the partition's number and, in the last 33 bits, the row's inside it
    part = F.shiftright("_place", 33)
    begins, total = [], 0
    for r in sorted(table.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        begins.append((r["part"], total))
        total += r["count"]
    inner = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    if not any(b for _, b in begins):
        return table.select(*own, inner.alias(name))
    # a row per partition at most
    small = F.broadcast(rows.sparkSession.createDataFrame(begins, "_from long, _begin long"))
    return table.join(small, part == F.col("_from")).select(*own, (inner + F.col("_begin")).alias(name))
