"""Column functions that find patterns in a STRING or BINARY column.

Occurrences of literal patterns may overlap, and their places are byte offsets from 0;
those of regular expressions do not overlap, and their places count characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of an array that are summed up at a time.
CHUNK = 64


def overlaps_itself(pattern: str | bytes) -> bool:
    """Whether two occurrences of the pattern can overlap (some proper prefix is also a suffix)."""
    return any(pattern[:n] == pattern[-n:] for n in range(1, len(pattern)))


def quoted(pattern: str) -> str:
    """The pattern as a regular expression that looks ahead for it without moving on."""
    return "(?=\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E)"


def count_in_text(text: Column, pattern: str) -> Column:
    """Occurrences in a STRING column.  An empty pattern occurs before every byte and at the end."""
    if not pattern:
        return F.octet_length(text).cast("long") + 1
    if overlaps_itself(pattern):
        return F.regexp_count(text, F.lit(quoted(pattern))).cast("long")
    # without overlaps, taking all occurrences out tells how many there were
    return F.expr("0").cast("long") + ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(pattern), F.lit("")))) / F.lit(len(pattern.encode()))).cast("long")


def places_in_bytes(body: Column, pattern: Column) -> Column:
    """The offsets of a BINARY pattern in a BINARY column, by comparing at every offset."""
    last = F.octet_length(body) - F.octet_length(pattern)
    offsets = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(offsets, lambda i: body.substr(i + 1, F.octet_length(pattern)) == pattern)


def segments_before(text: Column, pattern: str) -> Column:
    """The text cut before every occurrence of a pattern; overlapping occurrences cut, too."""
    return F.split(text, quoted(pattern))


def _sums_before(sizes: Column, start: Column) -> Column:
    """start plus the sum of the array's members before each."""
    held = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("seen"))
    return F.aggregate(sizes, held, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))["seen"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(sizes: Column) -> Column:
    """The sum of an ARRAY<BIGINT>'s members before each.

    A running sum copies its array at every step, so the members are summed up in chunks:
    the work grows with their number, not its square.
    """

    def summed(chunks: Column) -> Column:
        starts = _sums_before(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0).cast("long"))
        return F.flatten(F.zip_with(chunks, starts, _sums_before))

    return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda i: F.slice(sizes, i * CHUNK + 1, F.lit(CHUNK))), summed)


def regex_matches(text: Column, pattern: str, *groups: int) -> Column:
    """ARRAY of start, end (exclusive), found, g1, ...: leftmost matches without overlaps, in characters.

    pattern must not match nothing.  The text is cut at the matches, and what is between
    them and they themselves are measured; a text without matches is only looked at once.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("long"))
    cut = F.struct(between.alias("between"), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (0, *groups)))

    def placed(x: Column) -> Column:
        # sizes of matches; what is after the last counts as one of no size
        sizes = F.concat(F.transform(x["g0"], lambda m: F.char_length(m).cast("long")), F.array(F.lit(0).cast("long")))
        whole = F.zip_with(x["between"], sizes, lambda a, b: F.struct(a.alias("before"), b.alias("size")))
        return let(whole, lambda w: F.zip_with(w, sums_before(F.transform(w, lambda m: m["before"] + m["size"])), lambda m, s: F.struct((s + m["before"]).alias("start"), (s + m["before"] + m["size"]).alias("end"))))

    def rows(x: Column) -> Column:
        zipped = F.arrays_zip(F.slice(placed(x), F.lit(1), F.size(x["g0"])).alias("at"), *(x[f"g{g}"].alias(f"g{g}") for g in (0, *groups)))
        return F.transform(zipped, lambda m: F.struct(m["at"]["start"].alias("start"), m["at"]["end"].alias("end"), m["g0"].alias("found"), *(m[f"g{g}"].alias(f"g{g}") for g in groups)))

    kind = "array<struct<start:bigint,end:bigint,found:string" + "".join(f",g{g}:string" for g in groups) + ">>"
    return F.when(text.rlike(pattern), let(cut, rows)).when(text.isNotNull(), F.array().cast(kind))
