"""Suffix order of a corpus, and what follows from it.

The text is shortened to the names of its stretches until it is short (see ``induced``);
the short text is ordered by prefix doubling.  There a suffix's rank is the first row of
the bucket of suffixes that agree on the symbols seen so far.  A round splits every bucket
by the rank of the suffix that begins where those symbols end.  Only suffixes that share a
bucket take part in a round and are written again; a suffix alone in its bucket is written
once.  Rows before a suffix are counted over distinct pairs of ranks, so that no task holds
a bucket, however many suffixes are in it.  Texts of most_in_memory symbols or fewer (none,
if it is 0) are sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphrake.functions.running import running_sum
from glyphrake.operators.cuts import cut_order, digested
from glyphrake.operators.induced import SHORT, suffix_order
from glyphrake.operators.navigate import PACKED, packed_keys, sorted_suffixes
from glyphrake.session import checkpoint, prepare
from glyphrake.sources.corpus import ROWS, Corpus, values_of

#: Symbols that one task sorts or navigates in memory, and symbols of an alphabet whose buckets one task adds up.
LOCAL, FEW_SYMBOLS = 1 << 22, 1 << 16
TABLE = "sa_row long, pos long, piece_id long, piece_pos long, f long, l long"


def symbol_counts(symbols: DataFrame, column: str = "c", up_to: int | None = None) -> DataFrame:
    """c, cnt: how often each symbol occurs; with up_to also those up to it that do not."""
    counts = symbols.groupBy(F.col(column).alias("c")).agg(F.count("*").alias("cnt"))
    if up_to is None:
        return counts
    return symbols.sparkSession.range(up_to + 1).withColumnRenamed("id", "c").join(counts, "c", "left").select("c", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def bucket_bounds(counts: DataFrame, max_symbol: int = 255) -> DataFrame:
    """counts with c0, the symbols smaller than c, and c1, those up to c.  One row per symbol of the alphabet."""
    if max_symbol > FEW_SYMBOLS:
        return running_sum(checkpoint(counts, "symbols"), ["c"], "cnt", "c0").select("c", "cnt", "c0", (F.col("c0") + F.col("cnt")).alias("c1"))
    running = F.sum("cnt").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("c1", running).withColumn("c0", F.col("c1") - F.col("cnt")).select("c", "cnt", "c0", "c1")


def suffix_types(symbols: DataFrame) -> DataFrame:
    """pos, type, is_lms: S where the next different symbol is larger, and at the end; else L.

    is_lms: an S with an L on its left, that is with a larger symbol before it.
    Neighbouring places share a partition, which knows the next different symbol of all
    but its last run; for that run the driver looks at the first symbols of the
    partitions after it, two numbers each.
    """
    spark = symbols.sparkSession
    prepare(spark)
    names = ["part", "pos", "c", "l", "following"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last = TaskContext.get().partitionId(), [], None
        # the last run of what was read so far waits for what comes
        for batch in batches:
            c = batch.column(1).to_numpy()
            goes_on = not len(c) or (last in (None, c[0]) and (c == c[0]).all())
            last = c[-1] if len(c) else last
            held.append(batch)
            if not goes_on:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                c = whole.column(1).to_numpy()
                turns = np.flatnonzero(c[1:] != c[:-1]) + 1
                yield out(part, whole.slice(0, turns[-1]), np.repeat(c[turns], np.diff(turns, prepend=0)))
                held = [whole.slice(turns[-1])]
        for batch in held:
            yield out(part, batch, None)

    def out(part: int, batch: pa.RecordBatch, following: np.ndarray | None) -> pa.RecordBatch:
        then = pa.array(following) if following is not None else pa.nulls(batch.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int64)), *batch.columns, then], names=names)

    dealt = symbols.select("pos", "c", "l").repartitionByRange("pos").sortWithinPartitions("pos")
    rows = checkpoint(dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names)), "suffix-types")
    edges = rows.groupBy("part").agg(F.min_by("c", "pos").alias("first"), F.max_by("c", "pos").alias("last"), F.min(F.when(F.col("following").isNotNull(), F.struct("pos", "following")))["following"].alias("turn")).collect()
    after, then, ends = None, None, []
    for r in sorted(edges, key=lambda r: -r["part"]):
        # after: the first symbol of the partitions that follow; then: the next different one
        ends.append((r["part"], after if after != r["last"] else then))
        if r["turn"] is not None:
            after, then = r["first"], r["turn"]
        elif r["first"] != after:
            after, then = r["first"], after
    ends = F.broadcast(spark.createDataFrame(ends, "part long, after long"))
    larger = F.coalesce("following", "after")
    kind = F.when(larger.isNull() | (larger > F.col("c")), "S").otherwise("L")
    typed = rows.join(ends, "part").select("pos", "c", "l", kind.alias("type"))
    return typed.select("pos", "type", ((F.col("type") == "S") & (F.col("l") > F.col("c")) & (F.col("pos") > 0)).alias("is_lms"))


def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, key, depth: the symbols up to the piece's end, PACKED of a byte alphabet at most, as one number."""
    for batch in batches:
        held, size = [], 0
        for offset, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            wide = isinstance(body, (pa.ListScalar, pa.LargeListScalar))
            c = np.append(values_of(body).astype(np.int64), 0)
            place = np.arange(len(c))
            depth = np.ones(len(c), np.int64) if wide else np.minimum(PACKED, len(c) - place)
            held.append((place + offset, c if wide else packed_keys(c), depth))
            size += len(c)
            if size >= ROWS:
                yield from _out(held)
                held, size = [], 0
        yield from _out(held)


def _out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(x) for x in zip(*held)]
    for at in range(0, len(columns[0]) if columns else 0, ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + ROWS]) for x in columns], names=["pos", "key", "depth"])


def doubled_ranks(corpus: Corpus) -> DataFrame:
    """pos, sa_row of every suffix of the whole text, in lexicographic order of symbols.

    Plain order of the text with its terminators: suffixes go on through terminators, and
    the one at the end is the shortest.  depth is how many symbols the suffixes of a
    bucket are known to share; buckets differ in it, since the first keys end where
    pieces end.  Rounds grow with the logarithm of the longest repeated passage.
    """
    prepare(corpus.pieces.sparkSession)
    keyed = checkpoint(corpus.with_offsets().select("offset", "body").mapInArrow(first_keys, "pos long, key long, depth long"), "suffix-keys")
    counts = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n")), "suffix-counts")
    starts = running_sum(counts, ["key"], "n", "r", label="suffix-starts")
    state = checkpoint(keyed.join(starts, "key").select("pos", "r", "depth", (F.col("n") == 1).alias("done")), "suffix-ranks")
    finished: list[DataFrame] = []
    while True:
        finished.append(state.where("done").select("pos", "r"))
        open_ = state.where("not done").select("pos", "r", "depth")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, finished).select("pos", F.col("r").alias("sa_row"))
        known = reduce(DataFrame.unionByName, [x.withColumn("depth", F.lit(0).cast("long")) for x in finished], open_)
        known = known.select(F.col("pos").alias("_at"), F.col("r").alias("r2"), F.col("depth").alias("more"))
        pairs = open_.withColumn("_at", F.col("pos") + F.col("depth")).join(known, "_at", "left")
        pairs = checkpoint(pairs.select("pos", "r", F.coalesce("r2", F.lit(-1).cast("long")).alias("r2"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "suffix-pairs")
        counts = checkpoint(pairs.groupBy("r", "r2").agg(F.count("*").alias("n")), "suffix-counts")
        inner = running_sum(counts, ["r2"], "n", "inner", by="r", label="suffix-starts")
        state = checkpoint(pairs.join(inner, ["r", "r2"]).select("pos", (F.col("r") + F.col("inner")).alias("r"), "depth", (F.col("n") == 1).alias("done")), "suffix-ranks")


def _sorted_in_memory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix table of a text that fits in memory, from its pieces in order."""
    bodies, ids = [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        bodies += [np.append(values_of(x).astype(np.int64), 0) for x in batch.column(1)]
    if not ids:
        return
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    text = np.concatenate(bodies)
    order = sorted_suffixes(text)
    piece_ids, starts = np.repeat(np.array(ids), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.concatenate(([0], text[:-1]))
    for at in range(0, len(order), ROWS):
        pos = order[at : at + ROWS]
        columns = (np.arange(at, at + len(pos)), pos, piece_ids[pos], pos - starts[pos], text[pos], before[pos])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in TABLE.split(", ")])


def _with_symbols(ranks: DataFrame, corpus: Corpus) -> DataFrame:
    """The suffix table from pos, sa_row."""
    symbols = checkpoint(corpus.symbols(), "suffix-symbols")
    return ranks.join(symbols, "pos").select("sa_row", "pos", "piece_id", "piece_pos", F.col("c").alias("f"), "l")


def _in_one_task(corpus: Corpus) -> DataFrame:
    whole = corpus.in_order().repartition(1).sortWithinPartitions("piece_id", "_tie").select("piece_id", "body")
    return whole.mapInArrow(_sorted_in_memory, TABLE)


def _by_turns(short: int):
    def by_turns(placed: DataFrame, n: int, max_symbol: int, write) -> DataFrame:
        own = Corpus(placed.select("piece_id", "body"), max_symbol)
        return write(_with_symbols(suffix_order(placed.select("offset", "body"), n, max_symbol, doubled_ranks, short), own), "suffix-rows")

    return by_turns


def suffix_rows(corpus: Corpus, n: int, pieces: int, short: int = SHORT, keep=checkpoint) -> DataFrame:
    """The suffix table, by way of shorter texts.  What it is written with can be handed in."""
    if n <= short or n == pieces:
        return keep(_with_symbols(doubled_ranks(corpus), corpus), "suffix-rows")
    return cut_order(corpus.with_offsets().select("offset", "piece_id", "body"), n, corpus.max_symbol, _in_one_task, _by_turns(short), short, keep)


def digest(corpus: Corpus, n: int, pieces: int, keep=checkpoint, short: int = SHORT) -> DataFrame | None:
    """piece_id, n, least, rows, weighted of a text of bytes (see ``cuts.digested``), or none if its order comes only as a table."""
    if n <= short or n == pieces or corpus.wide:
        return None
    return digested(corpus, n, _in_one_task, _by_turns(short), short, keep)


def suffix_ranks(corpus: Corpus, short: int = SHORT) -> DataFrame:
    """pos, sa_row of every suffix of the whole text."""
    return suffix_rows(corpus, *corpus.measured(), short).select("pos", "sa_row")


def suffix_table(corpus: Corpus, n: int | None = None, most_in_memory: int | None = None, keep=checkpoint) -> DataFrame:
    """sa_row, pos, piece_id, piece_pos, f, l: the suffixes in order with first symbol and the symbol before; larger byte texts also have their first symbols as key."""
    if (corpus.length() if n is None else n) <= (LOCAL if most_in_memory is None else most_in_memory):
        prepare(corpus.pieces.sparkSession)
        return keep(_in_one_task(corpus), "index-suffixes")
    return suffix_rows(corpus, *corpus.measured(), keep=keep)


def inverse(table: DataFrame) -> DataFrame:
    """pos, sa_row: the row of every suffix."""
    return table.select("pos", "sa_row")


def sample_level(n: int, level: int) -> int:
    """The level that is used: a text no longer than two to the level keeps all rows."""
    return 0 if n <= 1 << level else level


def sampled(table: DataFrame, n: int, level: int) -> DataFrame:
    """sa_row, pos of every row whose number is a multiple of two to the level."""
    return table.where(F.col("sa_row") % (1 << sample_level(n, level)) == 0).select("sa_row", "pos")
