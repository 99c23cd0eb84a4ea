"""Symbols around matches, read forwards and backwards.

A match is a row with its place in the whole text.  Going back never ends: it crosses
terminators into the piece before, and from the first piece to the last.  Going forward
stops before the terminator in a corpus of pieces and wraps around otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphrake.session import checkpoint

#: Symbols that are read of a match in the first round of an open-ended reading.
FIRST_REACH = 16


def around(matches: DataFrame, symbols: DataFrame, n: int, k: int, backward: bool, keys: tuple[str, ...]) -> DataFrame:
    """keys, symbols: up to k symbols from each match on (or before it, nearest first), by joining places with symbols."""
    step = F.col("_j") if not backward else -F.col("_j") - 1
    places = matches.select(*keys, "pos", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_j"))
    places = places.select(*keys, "_j", F.pmod(F.col("pos") + step, F.lit(n)).alias("_at"))
    found = places.join(symbols.select(F.col("pos").alias("_at"), "c"), "_at")
    read = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_j", "c"))).alias("_read"))
    return read.select(*keys, F.transform("_read", lambda x: x["c"]).alias("symbols"))


def forward_in_piece(matches: DataFrame, pieces: DataFrame, k: int) -> DataFrame:
    """matches with taken: up to k bytes from each match on, within its piece."""
    bodies = pieces.select("piece_id", "body")
    return matches.join(bodies, "piece_id").withColumn("taken", F.substring("body", F.col("piece_pos").cast("int") + 1, k)).drop("body")


def until(symbols_column: str, stop: int):
    """The symbols before the first stop symbol (all, if there is none)."""
    at = F.array_position(symbols_column, F.lit(stop).cast("long"))
    return F.when(at > 0, F.slice(symbols_column, F.lit(1), (at - 1).cast("int"))).otherwise(F.col(symbols_column))


def read_until(matches: DataFrame, symbols: DataFrame, n: int, stops: Sequence[int], keys: tuple[str, ...], backward: bool = False) -> DataFrame:
    """keys, symbols: from each match (keys, pos) on, or before it, until the first of some symbols; around the text once, if it has none of them.

    A match that has not met a stop reads on, twice as far as in the round before: rounds
    are logarithmic in the longest reading, and no match reads over three times too much.
    """
    open_ = checkpoint(matches.select(*keys, F.col("pos").alias("_origin"), F.lit(0).cast("long").alias("_done")), "read-open")
    parts, reach, taken = [], FIRST_REACH, 0
    while not open_.isEmpty():
        own = min(reach, n - taken)
        origin = F.col("_origin") + F.col("_done") if not backward else F.col("_origin") - F.col("_done")
        read = around(open_.withColumn("pos", F.pmod(origin, F.lit(n))), symbols, n, own, backward, (*keys, "_origin", "_done"))
        at = F.array_position("_c", F.lit(True)) - 1
        flagged = read.withColumn("_c", F.transform("symbols", lambda x: x.isin(*stops)))
        rows = checkpoint(flagged.select(*keys, "_origin", "_done", at.alias("_at"), F.when(at >= 0, F.slice("symbols", F.lit(1), at.cast("int"))).otherwise(F.col("symbols")).alias("symbols")), "read-part")
        parts.append(rows.select(*keys, "_done", "symbols"))
        taken, reach = taken + own, reach * 2
        open_ = rows.where("_at < 0").select(*keys, "_origin", (F.col("_done") + own).alias("_done")).where(F.lit(taken < n))
    if not parts:
        return matches.select(*keys, F.array().cast("array<bigint>").alias("symbols"))
    joined = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_done", "symbols"))).alias("_parts"))
    return joined.select(*keys, F.flatten(F.transform("_parts", lambda x: x["symbols"])).alias("symbols"))
