"""Pattern search by scanning pieces: no index, one pass over the bodies.

One or a few literal patterns become expressions that stay inside generated code.  A
batch of patterns goes through an automaton that finds them all, overlaps included, in
one pass; very large batches go in blocks of a checked size.  A table of longer patterns
is found by anchors: each pattern is known by one of its byte n-grams, texts are hashed
at every place, and where an anchor is found the whole pattern is compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphrake.errors import InvalidPatternError
from glyphrake.functions.matching import count_in_text, segments_before, sums_before
from glyphrake.session import checkpoint, prepare

#: Bytes of patterns that one automaton is built from, and what a short one costs besides its own.
BATCH_BYTES, SHORT_COST = 16_000_000, 16
#: Bytes of an anchor, patterns whose anchors are sent to all tasks at a time, bytes of text hashed at a time (and longer patterns' lengths more), cells that say which anchors may be there.
ANCHOR, ANCHORS, STRETCH, CELLS = 24, 1_000_000, 1 << 20, 1 << 22
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_POWERS: list[np.ndarray] = []


def count(rows: DataFrame, text: str, patterns: Sequence[str]) -> DataFrame:
    """pattern, n over all rows of a STRING column; patterns without hits have 0."""
    sums = rows.agg(*(F.sum(count_in_text(F.col(text), p)).alias(f"n{i}") for i, p in enumerate(patterns)))
    pairs = F.array(*(F.struct(F.lit(p).alias("pattern"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n")) for i, p in enumerate(patterns)))
    return sums.select(F.explode(pairs).alias("x")).select("x.pattern", "x.n")


def places(text: Column, pattern: str) -> Column:
    """Byte offsets of a pattern in a STRING column, overlaps included, by cutting before each occurrence."""
    if not pattern:
        return F.sequence(F.lit(0).cast("long"), F.octet_length(text).cast("long"))
    begins = sums_before(F.transform(segments_before(text, pattern), lambda x: F.octet_length(x).cast("long")))
    hits = F.filter(begins, lambda at, i: (i > 0) | F.startswith(text, F.lit(pattern)))
    return F.when(F.contains(text, F.lit(pattern)), hits)


def locate(rows: DataFrame, text: str, patterns: Sequence[str], *keep: str) -> DataFrame:
    """keep's columns, pattern and byte_pos of every occurrence of a few patterns in a STRING column: one pass for all."""
    found = F.array(*(F.struct(F.lit(p).alias("pattern"), places(F.col(text), p).alias("places")) for p in patterns))
    hits = rows.select(*keep, F.explode(found).alias("x")).select(*keep, "x.pattern", F.explode("x.places").alias("byte_pos"))
    return hits


def starting_with(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose text starts with the pattern: a filter that reaches the Parquet reader."""
    return rows.where(F.col(text).startswith(pattern))


def ending_with(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    return rows.where(F.col(text).endswith(pattern))


def equal_to(rows: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Rows whose whole text is a pattern of the table: an equal join."""
    return rows.join(patterns, F.col(text) == F.col(pattern))


def boundary_counts(rows: DataFrame, text: str, patterns: Sequence[str]) -> DataFrame:
    """pattern, kind, interval_count, match_count for prefix and exact searches.

    interval_count ignores where a piece begins, as a bare count of such a search does;
    match_count has the matches that listing them gives.
    """
    cells = []
    for i, p in enumerate(patterns):
        starts, ends, whole = F.col(text).startswith(p), F.col(text).endswith(p), F.col(text) == p
        for kind, interval, match in (("prefix", count_in_text(F.col(text), p), starts), ("exact", ends.cast("long"), whole)):
            cells.append((p, kind, F.coalesce(F.sum(interval), F.lit(0)).alias(f"i{i}{kind}"), F.count_if(match).alias(f"m{i}{kind}")))
    sums = rows.agg(*(x for c in cells for x in c[2:]))
    pairs = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(kind).alias("kind"), F.col(f"i{patterns.index(p)}{kind}").alias("interval_count"), F.col(f"m{patterns.index(p)}{kind}").alias("match_count")) for p, kind, _, _ in cells))
    return sums.select(F.explode(pairs).alias("x")).select("x.*")


def locate_batch(pieces: DataFrame, patterns: Sequence[tuple[int, bytes]], piece_id: str = "piece_id", body: str = "body") -> DataFrame:
    """pattern_id, piece_id, piece_pos of every occurrence of every pattern in BINARY bodies.

    The patterns are the caller's and travel in blocks of BATCH_BYTES; every block is one
    pass.  Patterns that repeat under several ids are found under each.
    """
    if any(not p for _, p in patterns):
        raise InvalidPatternError("an empty pattern occurs everywhere; ask for lengths instead")
    out, block, held = None, [], 0
    for item in [*patterns, None]:
        if item is None or (block and held + len(item[1]) > BATCH_BYTES):
            found = _automaton_pass(pieces.select(F.col(piece_id).cast("long"), body), block)
            out = found if out is None else out.unionByName(found)
            block, held = [], 0
        if item is not None:
            block.append(item)
            held += len(item[1])
    return out


def _automaton_pass(pieces: DataFrame, patterns: list[tuple[int, bytes]]) -> DataFrame:
    shared = pieces.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, list[int]] = {}
        for pattern_id, pattern in shared.value:
            ids.setdefault(pattern.decode("latin-1"), []).append(pattern_id)
        automaton = ahocorasick.Automaton()
        for pattern, own in ids.items():
            automaton.add_word(pattern, (own, len(pattern)))
        if ids:
            automaton.make_automaton()
        for batch in batches:
            out: tuple[list[int], list[int], list[int]] = ([], [], [])
            for piece, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = body.as_py()
                if raw and ids:
                    for end, (own, size) in automaton.iter(bytes(raw).decode("latin-1")):
                        for pattern_id in own:
                            for column, x in zip(out, (pattern_id, piece, end - size + 1)):
                                column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["pattern_id", "piece_id", "piece_pos"])

    return pieces.mapInArrow(run, "pattern_id long, piece_id long, piece_pos long")


class _Hashes:
    """Polynomial hashes of any stretch of some bytes, modulo 2^64."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if not _POWERS or len(_POWERS[0]) <= n:
            _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1 << 16), b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
        power, self._inverse = _POWERS
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))

    def of(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (self._sums[first + size] - self._sums[first]) * self._inverse[first]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pattern_id, anchor, at, size, whole: the n-gram of each pattern with the smallest hash, its place, and the whole pattern's length and hash."""
    for batch in batches:
        out: list[list[int]] = [[], [], [], []]
        for body in batch.column(1):
            raw = np.frombuffer(body.as_buffer(), np.uint8)
            hashes = _Hashes(raw)
            grams = hashes.of(np.arange(len(raw) - ANCHOR + 1), ANCHOR)
            at = int(grams.argmin())
            for column, x in zip(out, (grams[at].view(np.int64), at, len(raw), hashes.of(np.array([0]), len(raw))[0].view(np.int64))):
                column.append(int(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["pattern_id", "anchor", "at", "size", "whole"])


def locate_table(pieces: DataFrame, patterns: DataFrame, piece_id: str = "piece_id", body: str = "body") -> DataFrame:
    """pattern_id, piece_id, piece_pos of every occurrence in BINARY bodies of a table of patterns (pattern_id, body).

    Patterns of ANCHOR bytes or more are found by anchors: four numbers for each pattern
    are sent to the tasks, in blocks of ANCHORS patterns with one pass each.  What is found by
    hash is compared with the pattern, byte by byte.  Shorter patterns go through
    an automaton, in blocks of BATCH_BYTES with one pass each.  Null and empty patterns are found nowhere.
    """
    spark = pieces.sparkSession
    prepare(spark)
    patterns = patterns.select(F.col("pattern_id").cast("long").alias("pattern_id"), "body").where("body is not null and octet_length(body) > 0")
    known = checkpoint(patterns.where(F.octet_length("body") >= ANCHOR).mapInArrow(_anchors, "pattern_id long, anchor long, at long, size long, whole long"), "anchors")
    texts = pieces.select(F.col(piece_id).cast("long").alias("piece_id"), F.col(body).alias("body"))
    longs, out = known.count(), None
    blocks = -(-longs // ANCHORS)
    block = F.pmod(F.xxhash64("anchor"), F.lit(max(blocks, 1)))
    for i in range(blocks):
        found = _anchored(texts, known.where(block == i).toArrow())
        out = found if out is None else out.unionByName(found)
    if out is not None:
        out = out.join(patterns.withColumnRenamed("body", "wanted"), "pattern_id").where(F.col("seen") == F.col("wanted")).select("pattern_id", "piece_id", "piece_pos")
    for found in _short_blocks(texts, patterns.where(F.octet_length("body") < ANCHOR)):
        out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.limit(0).select(F.col("piece_id").alias("pattern_id"), "piece_id", F.col("piece_id").alias("piece_pos"))


def _short_blocks(texts: DataFrame, short: DataFrame) -> Iterator[DataFrame]:
    """Occurrences of short patterns, a block of them at a time: the driver holds BATCH_BYTES of patterns on average and no more than one block."""
    size = short.agg(F.sum(F.octet_length("body") + SHORT_COST)).first()[0] or 0
    blocks = -(-size // BATCH_BYTES)
    for i in range(blocks):
        own = [(r["pattern_id"], bytes(r["body"])) for r in short.where(F.pmod(F.xxhash64("body"), F.lit(blocks)) == i).collect()]
        if own:
            found = _automaton_pass(texts, own)
            # with several blocks each is done with before the next one comes
            yield checkpoint(found, "short-found") if blocks > 1 else found


def _anchored(texts: DataFrame, known: pa.Table) -> DataFrame:
    """pattern_id, piece_id, piece_pos, seen: stretches with the hashes of patterns."""
    columns = [known.column(c).to_numpy() for c in ("anchor", "pattern_id", "at", "size", "whole")]
    order = np.argsort(columns[0], kind="stable")
    shared = texts.sparkSession.sparkContext.broadcast([x[order] for x in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, ids, at, size, whole = shared.value
        cells = np.zeros(CELLS, bool)
        cells[(anchors.view(np.uint64) >> np.uint64(42)).astype(np.int64)] = True

        longest = int(size.max(initial=0))

        def search(stretches: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            pieces, bases, limits, bodies = zip(*stretches)
            raw = np.frombuffer(b"".join(bodies), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)))
            hashes = _Hashes(raw)
            grams = hashes.of(np.arange(max(len(raw) - ANCHOR + 1, 0)), ANCHOR)
            places = np.flatnonzero(cells[(grams >> np.uint64(42)).astype(np.int64)])
            own = grams[places].view(np.int64)
            lo, hi = np.searchsorted(anchors, own), np.searchsorted(anchors, own, side="right")
            # every pattern of an anchor, with the place where it would begin
            times = hi - lo
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
            places = np.repeat(places, times)
            begin, end = places - at[nth], places - at[nth] + size[nth]
            piece = np.searchsorted(ends, places, side="right")
            first = ends[piece] - np.array([len(x) for x in bodies], np.int64)[piece]
            fits = (begin >= first) & (end <= ends[piece]) & (begin - first < np.array(limits)[piece])
            begin, end, nth, piece, first = (x[fits] for x in (begin, end, nth, piece, first))
            same = hashes.of(begin, size[nth]).view(np.int64) == whole[nth] if len(begin) else np.zeros(0, bool)
            begin, end, nth, piece, first = (x[same] for x in (begin, end, nth, piece, first))
            seen = [raw[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(ids[nth]), pa.array(np.array(pieces, np.int64)[piece]), pa.array(begin - first + np.array(bases, np.int64)[piece]), pa.array(seen, pa.binary())], names=["pattern_id", "piece_id", "piece_pos", "seen"])

        for batch in batches:
            stretches, held = [], 0
            for piece, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole_body = body.as_py() or b""
                # a long text goes in stretches that overlap by the longest pattern; a match counts where it begins
                for base in range(0, len(whole_body), STRETCH):
                    stretches.append((piece, base, STRETCH, whole_body[base : base + STRETCH + longest]))
                    held += len(stretches[-1][3])
                    if held >= STRETCH:
                        yield search(stretches)
                        stretches, held = [], 0
            if stretches:
                yield search(stretches)

    return texts.where("piece_id is not null").mapInArrow(run, "pattern_id long, piece_id long, piece_pos long, seen binary")


def counted_symbols(pieces: DataFrame, patterns: Sequence[Sequence[int]], piece_id: str = "piece_id", body: str = "body") -> DataFrame:
    """piece_id, pattern_id, n for ARRAY bodies: occurrences of symbol sequences, pieces without any left out."""
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("pattern_id"), occurrences(F.col(body), p).alias("n")) for i, p in enumerate(patterns)))
    return pieces.select(piece_id, F.explode(cells).alias("x")).select(piece_id, "x.pattern_id", "x.n").where("n > 0")


def occurrences(body: Column, pattern: Sequence[int]) -> Column:
    """How often a sequence of symbols occurs in an ARRAY, overlaps included."""
    last = F.size(body) - len(pattern)
    places = F.when(last >= 0, F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    wanted = F.array(*(F.lit(c).cast("long") for c in pattern))
    return F.size(F.filter(places, lambda i: F.slice(body, i, len(pattern)) == wanted)).cast("long")
