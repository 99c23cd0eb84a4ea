"""Vectors compressed to codes: a codebook for each part, in whole numbers.

Components are scaled to integers and vectors cut into equal parts.  Each part position
has a codebook; a part's code is the nearest entry.  Most entries are ruled out without
looking at all components: over blocks of a part, the squared distance is that of the
block means (times the block's length) plus that of what is left of both, and the lengths
of the rests bound the latter from below.  Blocks go from coarse to fine; the entry of the
least bound is measured, and an entry stays while its bound is not above the least
distance measured, so the nearest entry and all its ties stay, and those get exact integer
distances.

Vectors are read in place, once a round; what moves is one row for each component of each
codebook and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.llm.common import gathered, materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 4_096, 8, 16, 6
#: Scaled components end here; beyond SMALL their squares are worked out in Python's integers.
LARGEST, SMALL = 1 << 40, 1 << 26
#: Rows whose components a task adds up before it hands the sums on: they stay within 64 bits.
SUMMED = 1 << 20
MOST_LONG = 2**63 - 1


def scaled_vectors(vectors: DataFrame, label: str = "label") -> tuple[DataFrame, int]:
    """vec_id, label, x (ARRAY<BIGINT>: floor of SCALE times each component) of usable vectors, and their length.

    Vectors that are null or empty, that hold null or non-finite components or have a
    length other than the commonest take no part.
    """
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = lengths[0]["width"] if lengths else 0
    return rows.where(F.size("x") == width), width


def part_slices(width: int, parts: int = PARTS) -> list[slice]:
    """Equal consecutive parts; where the length can't be divided the first ones have one component more."""
    ends = np.cumsum([width // parts + (i < width % parts) for i in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


class Blocks:
    """Sums over blocks of so many components, and the length of what the block means leave of each row."""

    def __init__(self, rows: np.ndarray, size: int):
        edges = np.arange(0, rows.shape[1], size)
        lengths = np.diff(np.append(edges, rows.shape[1]))
        sums = np.add.reduceat(rows, edges, axis=1)
        self.means, self.lengths = sums / lengths, lengths.astype(np.float64)
        # whole numbers until the root, so that nothing is lost where means say nearly all
        left = [(n * np.square(rows[:, a : a + n]).sum(axis=1) - np.square(sums[:, i])) / n for i, (a, n) in enumerate(zip(edges.tolist(), lengths.tolist()))]
        self.rest = np.sqrt(np.sum(left, axis=0))

    def least(self, other: Blocks, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of pairs of rows."""
        return (np.square(self.means[q] - other.means[r]) * self.lengths).sum(axis=1) + np.square(self.rest[q] - other.rest[r])


def _firsts(q: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each q (in order) the place of its first least value."""
    if not len(q):
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    least = np.minimum.reduceat(values, heads)
    first = np.flatnonzero(values == np.repeat(least, np.diff(np.append(heads, len(q)))))
    return first[np.searchsorted(first, heads)]


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each point's nearest entry (ties: the first), its exact squared distance, and how many pairs were measured exactly."""
    n, k = len(points), len(entries)
    q, r = np.divmod(np.arange(n * k), k)
    small = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) <= SMALL

    def exact(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        difference = points[q] - entries[r] if small else points[q].astype(object) - entries[r].astype(object)
        return (difference * difference).sum(axis=1)

    size, best = points.shape[1], np.full(n, np.inf)
    while small and k > 1 and n and size >= 2:
        lower = Blocks(points, size).least(Blocks(entries, size), q, r)
        likeliest = _firsts(q, lower)
        best[q[likeliest]] = np.minimum(best[q[likeliest]], exact(q[likeliest], r[likeliest]))
        stay = lower <= best[q] * (1 + 1e-9) + 1e-6
        q, r = q[stay], r[stay]
        size //= 2
    # pairs of a point stand in order of entries: the first with the least distance
    distance = exact(q, r)
    own = _firsts(q, distance)
    return r[own], distance[own], len(q)


def _points(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def first_codebooks(rows: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """The vectors with the smallest ids (null ids last; among equal ids by components): entry, component."""
    return np.array([r["x"] for r in rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()], np.int64).reshape(-1, width)


def improved(rows: DataFrame, books: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; entries without any stay."""
    slices, (k, width) = part_slices(books.shape[1], parts), books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, held = np.zeros((k, width), np.int64), np.zeros((k, parts), np.int64), 0

        def out() -> pa.RecordBatch:
            columns = (np.repeat(np.arange(k), width), np.tile(np.arange(width), k), sums.ravel(), np.repeat(counts, [s.stop - s.start for s in slices], axis=1).ravel())
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["entry", "at", "total", "n"])

        for batch in gathered(batches):
            points = _points(batch.column(0), width)
            for i, s in enumerate(slices):
                own = nearest_entries(points[:, s], shared.value[:, s])[0]
                np.add.at(sums[:, s], own, points[:, s])
                counts[:, i] += np.bincount(own, minlength=k)
            held += len(points)
            if held >= SUMMED:
                yield out()
                sums, counts, held = np.zeros_like(sums), np.zeros_like(counts), 0
        if held:
            yield out()

    # as many rows as the codebooks have components come to the driver
    added = rows.select("x").mapInArrow(add, "entry long, at long, total long, n long").groupBy("entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in added.where("n > 0").collect():
        out[r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def trained(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after some rounds; rows is read once a round: hand in a table."""
    books = first_codebooks(rows, width, entries)
    for _ in range(rounds):
        better = improved(rows, books, parts)
        if (better == books).all():
            break
        books = better
    return books


def coded(rows: DataFrame, books: np.ndarray, parts: int = PARTS) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error: the squared distance to what the code stands for (2^63 - 1 at most)."""
    slices, width = part_slices(books.shape[1], parts), books.shape[1]
    shared, schema = rows.sparkSession.sparkContext.broadcast(books), rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)], "U2")
        for batch in gathered(batches):
            points, codes, error = _points(batch.column(2), width), [], 0
            for s in slices:
                own, distance, _ = nearest_entries(points[:, s], shared.value[:, s])
                codes.append(digits[own])
                error = distance.astype(object) + error if distance.dtype == object else distance + error
            code = [""] * len(points)
            if codes:
                code = ["".join(x) for x in zip(*codes)]
            error = np.minimum(error, MOST_LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], names=schema.names)

    return rows.select("vec_id", "label", "x").mapInArrow(run, schema)


def books_digest(books: np.ndarray, parts: int = PARTS) -> str:
    """SHA-256 of all components by part, entry and place."""
    numbers = [str(x) for s in part_slices(books.shape[1], parts) for entry in books for x in entry[s].tolist()]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(vectors: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every usable vector, and the codebooks.

    See scaled_vectors() for what is usable.  Null ids are kept and never among the first
    entries while others are there; rows that share an id or a vector are vectors of their
    own; with fewer vectors than entries the codebooks are that small; other columns are
    not read; an empty table gives no rows.  Components end at 2^40 once scaled.
    """
    rows, width = scaled_vectors(vectors, label)
    if not width:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((0, 0), np.int64)
    rows = materialize(rows, "codes-vectors")
    books = trained(rows, width, parts, entries, rounds)
    return materialize(coded(rows, books, parts), "codes"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings with their errors and those of their labels: see compress()."""
    codes, books = compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    # one row a label, a table of its own: Spark can split a label of any size on the other side
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = materialize(sums, "codes-labels").withColumnRenamed("label", "_label")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in DuckDB, every distance worked out."""
    square = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"parts AS MATERIALIZED (SELECT row, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) r(p))",
        f"e0 AS MATERIALIZED (SELECT p, row - 1 AS entry, x AS c FROM parts WHERE row <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT row, p, x, best.entry AS entry, best.d AS d FROM (SELECT row, p, any_value(x) AS x, min({{'d': d, 'entry': entry}}) AS best FROM (SELECT row, p, x, entry, {square} AS d FROM parts JOIN e{i} USING (p)) GROUP BY row, p))")
        if i < ROUNDS:
            mean = "(sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"m{i} AS (SELECT p, entry, list(m ORDER BY i) AS c FROM (SELECT p, entry, i, ({mean})::BIGINT AS m FROM a{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, entry, i) GROUP BY p, entry)")
            steps.append(f"e{i + 1} AS MATERIALIZED (SELECT e{i}.p, e{i}.entry, coalesce(m{i}.c, e{i}.c) AS c FROM e{i} LEFT JOIN m{i} ON m{i}.p = e{i}.p AND m{i}.entry = e{i}.entry)")
    steps.append(f"coded AS (SELECT row, string_agg(printf('%02x', entry::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY row)")
    steps.append(f"digest AS (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM e{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), digest"


ORACLE_SQL = _sql()
