"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Vectors are normalised, rotated by a random orthogonal matrix and dealt to the lists of
their nearest centres.  A query first scans its few nearest lists, which gives a bound on
the distance of its neighbours; with that bound it scans the other lists that it probes.
Rotated vectors are read in blocks of columns: after a rotation the distance over some
columns tells the whole distance up to a known error, so that a test on the partial
distance abandons most candidates early.  What is left is scored exactly on the original
vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphrake.llm.common import gathered, materialize, table

#: Neighbours, share of the lists that a query probes and least number of them, lists that give the bound, confidence of the test, columns of a block.
NEIGHBOURS, PROBED_SHARE, LEAST_PROBED, FIRST_LISTS, CONFIDENCE, BLOCK = 5, 0.45, 40, 3, 2.1, 16
#: Vectors that centres are fitted on at most, most lists, rounds of the fit, bytes of queries that meet all vectors at a time.
SAMPLE, MOST_LISTS, ROUNDS, QUERY_BYTES = 20_000, 4_096, 8, 16_000_000
#: Vectors and queries whose distances are taken at once, pairs that are scored or remembered at a time.
ROW_TILE, QUERY_TILE, PAIRS = 512, 1_024, 100_000
SEED = 20_240_229


class Frame:
    """The rotation and the centres of the lists, in rotated coordinates."""

    def __init__(self, sample: np.ndarray, lists: int):
        drawn, width = np.random.default_rng(SEED), sample.shape[1]
        self.rotation = np.linalg.qr(drawn.standard_normal((width, width)))[0].astype(np.float32)
        points = self.rotated(sample)
        centres = points[drawn.choice(len(points), min(lists, len(points)), replace=False)]
        for _ in range(ROUNDS):
            own = (points @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
        self.centres = centres.astype(np.float32)

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)) @ self.rotation


class Queries:
    """A block of queries: ids, vectors, how near a centre must be to be probed first and at all, and bounds on squared distances."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, frame: Frame, probes: int):
        self.ids, self.vectors, self.length = ids, vectors, np.linalg.norm(vectors, axis=1)
        self.rotated = frame.rotated(vectors)
        cuts = []
        for at in range(0, len(ids), QUERY_TILE):
            near = -np.sort(-(self.rotated[at : at + QUERY_TILE] @ frame.centres.T), axis=1)
            cuts.append(near[:, [min(FIRST_LISTS, near.shape[1]) - 1, probes - 1]])
        # a hair lower, so that the same product by another route is not above its own cut
        self.first_cut, self.cut = (np.concatenate(cuts) - 1e-6).T
        self.bound = np.full(len(ids), np.inf, np.float32)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, each by the power of two that takes its largest component below 1.

    That changes no cosine and no digit, and squares can be summed whatever the magnitude.
    """
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True, initial=0))[1])


def valid_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows with an id and a usable vector, and the common length.

    Vectors that are null or zero, that hold null or non-finite components or have a
    length other than the commonest take no part.
    """
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = lengths[0]["width"] if lengths else 0
    return rows.where(F.size("embedding") == width), width


def scan(rows: np.ndarray, queries: np.ndarray, bound: np.ndarray, confidence: float = CONFIDENCE, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of unit vectors whose squared distance may be within the query's bound.

    Partial squared distances grow block by block; a pair goes when its partial distance
    is above the bound even with the error allowed for the columns not yet read.  While
    most pairs of a tile are left, a block is one product of matrices; then each pair is
    followed on its own.
    """
    width, found = rows.shape[1], []
    for a in range(0, len(queries), QUERY_TILE):
        own, limits = queries[a : a + QUERY_TILE], bound[a : a + QUERY_TILE]
        for b in range(0, len(rows), ROW_TILE):
            tile = rows[b : b + ROW_TILE]
            partial, q, r = np.zeros((len(own), len(tile)), np.float32), None, None
            for at in range(0, width, block):
                end = min(at + block, width)
                slack = (1 + confidence / math.sqrt(end)) ** 2 * end / width if end < width else 1 + 1e-5
                if q is None:
                    x, y = own[:, at:end], tile[:, at:end]
                    partial += (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
                    alive = partial <= (limits * slack + 1e-5)[:, None]
                    if end >= width or alive.mean() < 0.25:
                        q, r = np.nonzero(alive)
                        values = partial[q, r]
                else:
                    values = values + ((own[q, at:end] - tile[r, at:end]) ** 2).sum(axis=1)
                    alive = values <= limits[q] * slack + 1e-5
                    q, r, values = q[alive], r[alive], values[alive]
            found.append((q + a, r + b))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in range(2))


def best(query: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k candidates with the largest values; an id counts once, with its best value; ties go to the smaller id."""
    order = np.lexsort((-value, ids, query))
    query, ids, value = query[order], ids[order], value[order]
    once = np.concatenate(([True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])))[: len(query)]
    query, ids, value = query[once], ids[once], value[once]
    order = np.lexsort((ids, -value, query))
    query, ids, value = query[order], ids[order], value[order]
    heads = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))[: len(query)])
    rank = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
    return query[rank < k], ids[rank < k], value[rank < k]


def _searched(index: DataFrame, block: Queries, frame: Frame, width: int, k: int, confidence: float, first: bool) -> DataFrame:
    """query_id, vec_id, score: the k best of every query in each task, from its first lists or from all that it probes."""
    shared = index.sparkSession.sparkContext.broadcast((block, frame))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frame_ = shared.value
        bound, cut = own.bound.copy(), own.first_cut if first else own.cut
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def kept() -> tuple[np.ndarray, ...]:
            query, ids, value = best(*(np.concatenate(x) for x in zip(*held)), k)
            # a query with k candidates needs no others that are farther
            full = np.flatnonzero(np.bincount(query, minlength=len(bound)) >= k)
            if len(full):
                last = np.full(len(bound), np.inf)
                np.minimum.at(last, query, value)
                bound[full] = np.minimum(bound[full], 2 - 2 * last[full] + 1e-5)
            return query, ids, value

        for batch in gathered(batches):
            ids, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            vectors = _matrix(batch.column(1), width)
            points, length = frame_.rotated(vectors), np.linalg.norm(vectors, axis=1)
            heads = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
            for begin, end in zip(heads.tolist(), [*heads[1:].tolist(), len(lists)]):
                asking = np.flatnonzero(own.rotated @ frame_.centres[lists[begin]] >= cut)
                q, r = scan(points[begin:end], own.rotated[asking], bound[asking], confidence)
                q, r = asking[q], r + begin
                other = own.ids[q] != ids[r]
                q, r = q[other], r[other]
                for at in range(0, len(q), PAIRS):
                    i, j = q[at : at + PAIRS], r[at : at + PAIRS]
                    held.append((i, ids[j], (vectors[j] * own.vectors[i]).sum(axis=1) / (length[j] * own.length[i])))
                    count += len(i)
                    if count > 2 * PAIRS:
                        held = [kept()]
                        count = min(len(held[0][0]), PAIRS)
        if held:
            query, ids, value = kept()
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[query]), pa.array(ids), pa.array(value)], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, an id once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, probed_share: float = PROBED_SHARE, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by cosine in double precision.

    Candidates are all vectors with another id; ties go to the smaller id.  Unusable
    vectors take no part on either side (see valid_vectors).  An id that several rows have
    is one candidate, as near as its nearest row; as a query it asks once, for the least
    of its vectors.  Empty tables on either side give no rows.  Centres are fitted on a
    sample of SAMPLE vectors at most, drawn by hash of the id; every vector is indexed.

    Of equal vectors only the k + 1 smallest ids can be anyone's neighbours, so a crowd
    of copies is a few rows.  Vectors stand in ranges of lists, where a long list is cut;
    they stay in place while queries come to them in blocks of QUERY_BYTES, so what is
    shuffled grows with vectors and queries and not with their product.
    """
    spark = vectors.sparkSession
    rows, width = valid_vectors(vectors)
    wanted, query_width = valid_vectors(queries)
    if not width or not query_width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = materialize(wanted.where(F.size("embedding") == width).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")), "vectors-queries")
    few = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    rows = materialize(rows.withColumn("nth", few).where(F.col("nth") <= k + 1).dropDuplicates(["embedding", "vec_id"]).select("vec_id", "embedding"), "vectors-distinct")
    n, asking = rows.count(), wanted.count()
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("draw"), "vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))) if n > SAMPLE else rows
    sample = drawn.orderBy("vec_id").toArrow()
    frame = Frame(_matrix(sample.column("embedding").combine_chunks(), width), max(1, min(MOST_LISTS, round(4 * math.sqrt(n)))))
    lists = len(frame.centres)
    probes = min(lists, max(LEAST_PROBED, math.ceil(probed_share * lists)))
    shared = spark.sparkContext.broadcast(frame)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = shared.value.rotated(_matrix(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((points @ shared.value.centres.T).argmax(axis=1).astype(np.int32))], names=["vec_id", "embedding", "list"])

    dealt = materialize(rows.mapInArrow(assign, "vec_id long, embedding array<double>, list int"), "vectors-lists")
    spread = F.xxhash64("vec_id")
    index = materialize(dealt.repartitionByRange("list", spread).sortWithinPartitions("list", spread), "vectors-index")
    blocks, out = max(1, -(-asking * width * 12 // QUERY_BYTES)), None
    for i in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        if not own.num_rows:
            continue
        block = Queries(own.column("query_id").to_numpy(), _matrix(own.column("embedding").combine_chunks(), width), frame, probes)
        # the k-th best of the first lists bounds what the other lists can add; a block of queries has a bounded number of them
        first = _top(_searched(index, block, frame, width, k, confidence, True), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        order = np.argsort(block.ids)
        at = order[np.searchsorted(block.ids[order], first.column("query_id").to_numpy())]
        block.bound[at] = (2 - 2 * first.column("score").to_numpy() + 1e-5).astype(np.float32)
        found = materialize(_searched(index, block, frame, width, k, confidence, False), "vectors-found") if blocks > 1 else _searched(index, block, frame, width, k, confidence, False)
        out = found if out is None else out.unionByName(found)
    return _top(out, k)


def op6_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50, among all others: see nearest()."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
