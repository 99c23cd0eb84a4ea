"""Search and steps over tables: every answer is the last entry of a sorted table below a question.

Putting symbols before the suffixes of an interval of rows moves both of its bounds.  A
bound moves to the number of suffixes that are smaller than those symbols followed by the
bound's suffix.  With entries (symbols before a suffix, its row) in order, that is one more
than the place of the last entry below (symbols, bound).  Entries may have several symbols
packed in one number: then a round takes as many.  Over runs an entry stands for a run, and
what the bound is inside it is added.

Rounds take all patterns together.  Bounds that patterns share (those with a common ending
do) are asked once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphrake.functions.asof import asof
from glyphrake.functions.running import numbered
from glyphrake.operators.navigate import PACKED
from glyphrake.session import checkpoint, prepare

#: The base in which PACKED bytes and the nothing after a piece are one number.
BASE = 257


def gram_rows(corpus, table: DataFrame, first_keys) -> DataFrame:
    """pos, key, whole, row: the first symbols of every suffix (up to its piece's end) as one number, whether none is missing, and its row."""
    prepare(corpus.pieces.sparkSession)
    keyed = corpus.with_offsets().select("offset", "body").mapInArrow(first_keys, "pos long, key long, depth long")
    whole = F.lit(False) if corpus.wide else (F.col("depth") == PACKED) & (F.col("key") % BASE != 1)
    return keyed.select("pos", "key", whole.alias("whole")).join(table.select("pos", F.col("sa_row").alias("row")), "pos")


def keyed_rows(table: DataFrame) -> DataFrame:
    """The same of a suffix table that has its keys: a key of PACKED symbols whose last is none or a terminator is not whole."""
    return table.select("pos", "key", (F.col("key") % BASE > 1).alias("whole"), F.col("sa_row").alias("row"))


def gram_starts(grams: DataFrame) -> DataFrame:
    """key, end: how many suffixes are not above the key."""
    return grams.groupBy("key").agg((F.max("row") + 1).alias("end"))


def gram_steps(grams: DataFrame, n: int) -> DataFrame:
    """key, at, to: from the row at back by PACKED symbols, which are key, to the row to.

    Where a key lacks symbols it is no pattern's; its entries stand by where they lead.
    """
    onwards = grams.select(F.pmod(F.col("pos") - PACKED, F.lit(n)).alias("pos"), F.col("row").alias("from"))
    rows = grams.join(onwards, "pos")
    return rows.select("key", F.when(F.col("whole"), F.col("from")).otherwise(F.col("row")).alias("at"), F.col("row").alias("to"))


def symbol_steps(table: DataFrame) -> DataFrame:
    """key, at, to: the same for one symbol, around the text."""
    return numbered(checkpoint(table.select(F.col("l").alias("key"), F.col("sa_row").alias("at")), "steps-symbols"), ["key", "at"], "to", label="steps")


def run_steps(runs: DataFrame) -> DataFrame:
    """key, at, to, len, begin, symbol: an entry for each run."""
    return runs.select(F.col("head").alias("key"), F.col("start").alias("at"), F.col("f_start").alias("to"), "len", F.col("start").alias("begin"), F.col("head").alias("symbol"))


def stepped(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """questions (key, at) with moved: the number of suffixes smaller than the key's symbols followed by the suffix of row at."""
    if "len" in entries.columns:
        found = asof(questions, entries, ["key", "at"], ["to", "len", "begin", "symbol"], strict=True, label="step")
        inside = F.greatest(F.least(F.col("at") - F.col("begin"), F.col("len")), F.lit(0))
        # of a smaller symbol's last run all rows count
        return found.select(*questions.columns, F.coalesce(F.col("to") + F.when(F.col("symbol") == F.col("key"), inside).otherwise(F.col("len")), F.lit(0).cast("long")).alias("moved"))
    found = asof(questions, entries, ["key", "at"], ["to"], strict=True, label="step")
    return found.select(*questions.columns, F.coalesce(F.col("to") + 1, F.lit(0).cast("long")).alias("moved"))


def packed(symbols: Column, fill: int) -> Column:
    """PACKED bytes, fill for those that are missing, as one number."""
    padded = F.concat(F.transform(symbols, lambda x: x + 1), F.array_repeat(F.lit(fill).cast("long"), F.greatest(F.lit(PACKED) - F.size(symbols), F.lit(0))))
    return F.aggregate(padded, F.lit(0).cast("long"), lambda acc, x: acc * BASE + x)


def _moved(state: DataFrame, key: Column, taken: Column, going: Column, entries: DataFrame) -> DataFrame:
    """The state after one step of the patterns that are going; taken symbols are done with."""
    known = checkpoint(state.withColumns({"_key": F.when(going, key), "_going": going}), "search-asked")
    bounds = known.where("_going").select(F.col("_key").alias("key"), F.explode(F.array("s", "e")).alias("at")).distinct()
    moved = stepped(checkpoint(bounds, "search-bounds"), entries)
    answer = lambda bound: moved.select(F.col("key").alias("_key"), F.col("at").alias(bound), F.col("moved").alias(f"_{bound}"))
    out = known.join(answer("s"), ["_key", "s"], "left").join(answer("e"), ["_key", "e"], "left")
    return checkpoint(out.select("pattern_id", "symbols", *(F.coalesce(F.col(f"_{b}"), F.col(b)).alias(b) for b in ("s", "e")), (F.col("done") + F.when(F.col("_going"), taken).otherwise(F.lit(0))).alias("done")), "search-state")


def intervals(patterns: DataFrame, entries: DataFrame, max_symbol: int) -> DataFrame:
    """pattern_id, s, e of patterns (pattern_id, symbols, s, e) after putting their symbols, one a round, before what their intervals stand for.

    Symbols beyond the alphabet empty the interval.  There are as many rounds as the
    longest pattern has symbols, none for patterns whose interval is empty.
    """
    strange = F.exists("symbols", lambda x: (x < 0) | (x > max_symbol))
    state = checkpoint(patterns.select("pattern_id", "symbols", F.when(strange, F.lit(0)).otherwise(F.col("s")).alias("s"), F.when(strange, F.lit(0)).otherwise(F.col("e")).alias("e"), F.lit(0).alias("done")), "search-state")
    going = (F.size("symbols") > F.col("done")) & (F.col("s") < F.col("e"))
    while not state.where(going).isEmpty():
        state = _moved(state, F.try_element_at("symbols", F.when(going, -(F.col("done") + 1)).otherwise(F.lit(1))), F.lit(1), going, entries)
    return state.select("pattern_id", "s", F.greatest("s", "e").alias("e"))


def gram_intervals(patterns: DataFrame, starts: DataFrame, steps: Callable[[], DataFrame]) -> DataFrame:
    """pattern_id, s, e of patterns of bytes (pattern_id, symbols) without a terminator except at their ends, PACKED symbols a round.

    The last symbols come first, so many that those before are whole keys: rows whose keys
    begin with them are one range of keys.  Patterns of no symbols are not asked here; steps
    makes the table that only longer patterns take.
    """
    size = F.size("symbols")
    some = F.pmod(size - 1, F.lit(PACKED)) + 1
    last = F.slice("symbols", size - some + 1, some)
    strange = F.exists("symbols", lambda x: (x < 0) | (x > 255))
    first = checkpoint(patterns.select("pattern_id", "symbols", some.alias("done"), strange.alias("strange"), F.when(~strange, packed(last, 0)).alias("low"), F.when(~strange, packed(last, BASE - 1)).alias("high")), "search-first")
    asked = first.where("not strange").select(F.explode(F.array(F.struct(F.col("low").alias("key")), F.struct((F.col("high") + 1).alias("key")))).alias("x")).select("x.key").distinct()
    found = asof(checkpoint(asked, "search-bounds"), starts, ["key"], ["end"], strict=True, label="search-starts")
    answer = lambda k, bound: found.select((F.col("key") - int(k == "high")).alias(k), F.coalesce("end", F.lit(0).cast("long")).alias(bound))
    state = first.join(answer("low", "s"), "low", "left").join(answer("high", "e"), "high", "left")
    state = checkpoint(state.select("pattern_id", "symbols", *(F.coalesce(b, F.lit(0).cast("long")).alias(b) for b in ("s", "e")), "done"), "search-state")
    going = (F.size("symbols") > F.col("done")) & (F.col("s") < F.col("e"))
    while not state.where(going).isEmpty():
        chunk = F.slice("symbols", F.when(going, F.size("symbols") - F.col("done") - PACKED + 1).otherwise(F.lit(1)), PACKED)
        state = _moved(state, packed(chunk, 0), F.lit(PACKED), going, steps())
    return state.select("pattern_id", "s", F.greatest("s", "e").alias("e"))


def around_the_start(row: Column, moved: Column, symbol: Column, start_row: int) -> Column:
    """moved, for rows whose symbol before is a terminator, as the text has them: what is before the whole text is its last terminator, the first row."""
    shifted = F.when(row == start_row, F.lit(0)).when(row < start_row, moved + 1).otherwise(moved)
    return F.when(symbol == 0, shifted).otherwise(moved).cast("long")


def run_navigation(rows: DataFrame, runs: DataFrame, start_row: int) -> DataFrame:
    """rows (sa_row) with before, first, back, forward, by the runs: the symbols before and at a suffix, and the rows a symbol earlier and later, around the text.

    A row's run is the last that starts at or before it; among runs in order of heads it
    is the last whose rows begin there at or before it.
    """
    own = rows.columns
    by_start = runs.select(F.col("start").alias("_at"), "head", F.col("f_start").alias("to"), F.col("start").alias("begin"))
    found = asof(rows.withColumn("_at", F.col("sa_row")), by_start, ["_at"], ["head", "to", "begin"], label="runs-back")
    back = around_the_start(F.col("sa_row"), F.col("to") + F.col("sa_row") - F.col("begin"), F.col("head"), start_row)
    known = checkpoint(found.select(*own, F.col("head").alias("before"), back.alias("back")), "runs-back")
    # terminators among the symbols before rows up to the row of the whole text
    ends = runs.where("head = 0").agg(F.sum(F.greatest(F.least(F.col("start") + F.col("len"), F.lit(start_row)) - F.col("start"), F.lit(0)))).first()[0] or 0
    by_head = runs.select(F.col("f_start").alias("_at"), "head", F.col("start").alias("to"), F.col("f_start").alias("begin"))
    at = F.when((F.col("sa_row") > 0) & (F.col("sa_row") <= ends), F.col("sa_row") - 1).otherwise(F.col("sa_row"))
    found = asof(known.withColumn("_at", at), by_head, ["_at"], ["head", "to", "begin"], label="runs-forward")
    forward = F.when(F.col("sa_row") == 0, F.lit(start_row)).otherwise(F.col("to") + F.col("_at") - F.col("begin"))
    return found.select(*own, "before", F.col("head").alias("first"), "back", forward.cast("long").alias("forward"))


def walks(back: DataFrame, level: int) -> DataFrame:
    """sa_row, met, steps: the sampled row that each row comes to by stepping back (sa_row, next_row), and how many steps that takes.

    Every round doubles the steps of all rows that have not met a sampled one, so rounds
    are logarithmic in the longest walk.
    """
    sampled = F.col("sa_row") % (1 << level) == 0
    state = checkpoint(back.select("sa_row", F.when(sampled, F.col("sa_row")).otherwise(F.col("next_row")).alias("met"), F.when(sampled, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("steps")), "walks")
    finished = []
    while True:
        there = F.col("met") % (1 << level) == 0
        finished.append(state.where(there))
        open_ = state.where(~there)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, finished)
        every = reduce(DataFrame.unionByName, finished, open_)
        further = every.select(F.col("sa_row").alias("met"), F.col("met").alias("_met"), F.col("steps").alias("_steps"))
        state = checkpoint(open_.join(further, "met").select("sa_row", F.col("_met").alias("met"), (F.col("steps") + F.col("_steps")).alias("steps")), "walks")


def walks_in_order(table: DataFrame, n: int, level: int) -> DataFrame:
    """The same from a whole suffix table: stepping back goes through the text, so a row comes to the sampled place at or before its own, around the text."""
    sampled = table.where(F.col("sa_row") % (1 << level) == 0).select("pos", F.col("sa_row").alias("met"), F.col("pos").alias("there"))
    last = sampled.agg(F.max(F.struct("pos", "met")).alias("last")).first()["last"]
    found = asof(table.select("sa_row", "pos"), sampled, ["pos"], ["met", "there"], label="walks")
    return found.select("sa_row", F.coalesce("met", F.lit(last["met"])).alias("met"), F.pmod(F.col("pos") - F.coalesce("there", F.lit(last["pos"])), F.lit(n)).alias("steps"))


def located(rows: DataFrame, walk_table: DataFrame, sample: DataFrame, n: int) -> DataFrame:
    """rows (its sa_row) with pos: the sampled position at the end of the walk and the steps to there."""
    met = rows.join(walk_table, "sa_row").join(sample.select(F.col("sa_row").alias("met"), "pos"), "met")
    return met.select(*rows.columns, F.pmod(F.col("pos") + F.col("steps"), F.lit(n)).alias("pos"))
