"""Joins of rows with the last entry of a sorted table that is not above them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glyphrake.session import checkpoint, prepare

#: What a row that leaves a partition is: answered; waiting for the entries before the partition; the partition's last entry.
ANSWERED, WAITING, LAST = 0, 1, 2
#: Different questions that are answered by reading the table once, without an exchange.
FEW = 32


def asof(queries: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str], equal: int = 0, strict: bool = False, label: str = "asof") -> DataFrame:
    """queries with columns (BIGINT) of the last row of table that is not above them in keys (strict: that is below).

    Null where there is no such row, or where it differs in one of the first `equal` keys.
    Rows of both sides are dealt by range of the keys, so that a key of any frequency is
    spread over tasks; each partition is read once in order, and what its first rows need
    from earlier partitions is one entry per partition, which is all that the driver sees.
    There is one exchange.  Ranges come from a sample, for which both sides are read once
    more: hand in tables.  FEW different questions go to the tasks instead, each of which
    reads its part of the table as it lies.
    """
    asked = queries.select(*keys).distinct().limit(FEW + 1).collect()
    if len(asked) <= FEW:
        return _few(queries, table, keys, columns, equal, strict, asked)
    spark, kept = queries.sparkSession, [f"_{c}" for c in (*keys[:equal], *columns)]
    prepare(spark)
    entries = table.select(*keys, *(F.col(c).cast("long").alias(k) for c, k in zip((*keys[:equal], *columns), kept)), F.lit(strict).alias("_later"), F.lit(True).alias("_entry"))
    asked = queries.withColumns({"_later": F.lit(not strict), "_entry": F.lit(False)})
    both = asked.unionByName(entries, allowMissingColumns=True)
    own = queries.columns
    # a key that is narrower on one side is as wide as on the other from here on
    schema = StructType([*(StructField(c, both.schema[c].dataType) for c in own), *(StructField(k, LongType()) for k in kept), StructField("_part", LongType()), StructField("_state", LongType())])
    at_entry, at_own, at_kept = both.columns.index("_entry"), [both.columns.index(c) for c in own], [both.columns.index(k) for k in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def out(columns: list[pa.Array], values: list[np.ndarray], known: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
            kept_ = [pa.array(v, pa.int64(), mask=~known) for v in values]
            return pa.RecordBatch.from_arrays([*columns, *kept_, pa.array(np.full(len(state), part)), pa.array(state)], names=schema.names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            entry = batch.column(at_entry).to_numpy(zero_copy_only=False)
            last = np.maximum.accumulate(np.where(entry, np.arange(n), -1))
            values = [batch.column(i).fill_null(0).to_numpy() for i in at_kept]
            ask = np.flatnonzero(~entry)
            if len(ask):
                own_last, found = last[ask], [v[np.maximum(last[ask], 0)] for v in values]
                if held is not None:
                    found = [np.where(own_last < 0, h, f) for h, f in zip(held, found)]
                known = (own_last >= 0) | (held is not None)
                taken = pa.array(ask)
                yield out([batch.column(i).take(taken) for i in at_own], found, known, np.where(known, ANSWERED, WAITING))
            if last[-1] >= 0:
                held = [v[last[-1]] for v in values]
        if held is not None:
            yield out([pa.nulls(1, both_arrow.field(i).type) for i in at_own], [np.array([h]) for h in held], np.ones(1, bool), np.array([LAST]))

    from pyspark.sql.pandas.types import to_arrow_schema

    both_arrow = to_arrow_schema(both.schema)
    dealt = both.repartitionByRange(*keys, "_later").sortWithinPartitions(*keys, "_later")
    met = checkpoint(dealt.mapInArrow(run, schema), label)
    carried, before = [], None
    lasts = {r["_part"]: tuple(r[k] for k in kept) for r in met.where(F.col("_state") == LAST).select("_part", *kept).collect()}
    waiting = [r[0] for r in met.where(F.col("_state") == WAITING).select("_part").distinct().collect()]
    for part in sorted({*lasts, *waiting}):
        if part in waiting and before is not None:
            carried.append((part, *before))
        before = lasts.get(part, before)
    answers = met.where(F.col("_state") != LAST)
    if carried:
        # a row per partition at most
        small = F.broadcast(spark.createDataFrame(carried, ", ".join(["_from long", *(f"_c{k} long" for k in kept)])))
        answers = answers.join(small, (F.col("_part") == F.col("_from")) & (F.col("_state") == WAITING), "left")
        value = lambda k: F.coalesce(F.col(k), F.col(f"_c{k}"))
    else:
        value = F.col
    same = F.lit(True)
    for c in keys[:equal]:
        same = same & (value(f"_{c}") == F.col(c))
    return answers.select(*own, *(F.when(same, value(f"_{c}")).alias(c) for c in columns))


def _few(queries: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str], equal: int, strict: bool, asked: list) -> DataFrame:
    """asof() of a few different questions: for each the last entry below it, in one pass over the table."""
    entry = F.struct(*keys, *(F.col(c).cast("long").alias(f"_{c}") for c in columns))

    def below(question) -> Column:
        out = F.lit(not strict)
        for key, value in reversed(list(zip(keys, question))):
            out = (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & out)
        return out

    asked = [q for q in asked if None not in q]
    found = table.agg(*(F.max(F.when(below(q), entry)).alias(f"q{i}") for i, q in enumerate(asked))).first() if asked else []
    rows = []
    for question, last in zip(asked, found):
        same = last is not None and all(last[k] == question[k] for k in keys[:equal])
        rows.append((*question, *(last[f"_{c}"] if same else None for c in columns)))
    schema = StructType([*(StructField(f"_key_{k}", queries.schema[k].dataType) for k in keys), *(StructField(f"_found_{c}", LongType()) for c in columns)])
    answers = F.broadcast(queries.sparkSession.createDataFrame(rows, schema))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    return queries.join(answers, same, "left").select(*queries.columns, *(F.col(f"_found_{c}").alias(c) for c in columns))
