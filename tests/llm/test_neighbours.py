"""Recall and scores against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphrake.llm import neighbours
from glyphrake.llm.common import ship


def test_recall_and_scores(spark):
    ship(spark)
    drawn = np.random.default_rng(4)
    centres = drawn.standard_normal((20, 32))
    x = (centres[drawn.integers(0, 20, 3_000)] + 0.7 * drawn.standard_normal((3_000, 32))) * drawn.uniform(0.1, 9, (3_000, 1))
    x = x.astype(np.float32).astype(np.float64)
    x[1_000:1_400] = x[1_000]  # a crowd of equal vectors
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    old, neighbours.QUERY_BYTES = neighbours.QUERY_BYTES, 8_000  # several blocks of queries
    try:
        rows = neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), probed_share=0.3).collect()
    finally:
        neighbours.QUERY_BYTES = old
    length = np.linalg.norm(x, axis=1)
    hits = total = 0
    for q in range(0, 3_000, 50):
        score = (x * x[q]).sum(axis=1) / (length * length[q])
        score[q] = -2
        best = np.lexsort((np.arange(3_000), -score))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in own)
        total += 5
        hits += sum(abs(s - score[b]) < 1e-9 for (_, _, s), b in zip(own, best))
    assert hits / total >= 0.9


def test_scan_keeps_the_nearest():
    drawn = np.random.default_rng(1)
    rows = drawn.standard_normal((2_500, 48)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    queries = rows[:20]
    distance = 2 - 2 * queries @ rows.T
    bound = np.sort(distance, axis=1)[:, 5] + 1e-5
    q, r = neighbours.scan(rows, queries, bound)
    for i in range(20):
        own = set(r[q == i].tolist())
        assert len(set(np.argsort(distance[i], kind="stable")[:6].tolist()) - own) <= 1 and len(own) <= 6
    assert neighbours.scan(rows[:0], queries, bound)[0].tolist() == []


def test_best_counts_an_id_once():
    query, ids, value = neighbours.best(np.array([1, 0, 1, 1, 0, 1]), np.array([7, 3, 7, 2, 9, 5]), np.array([0.5, 0.1, 0.9, 0.9, 0.1, 0.2]), 2)
    assert list(zip(query, ids, value)) == [(0, 3, 0.1), (0, 9, 0.1), (1, 2, 0.9), (1, 7, 0.9)]


def test_repeated_rows(spark):
    """A repeated id is one candidate and asks once; copies of a vector lose no smaller id."""
    ship(spark)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [1.0, 0.3]), (4, [1.0, 0.4]), (5, [1.0, 0.5]), (6, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.rank, r.vec_id) for r in neighbours.nearest(vectors, vectors.where("vec_id = 0")).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    # the query 1 asks for the least of its vectors, (0, 1)
    got = sorted((r.rank, r.vec_id) for r in neighbours.nearest(vectors, vectors.where("vec_id = 1")).collect())
    assert got == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 0)]
    crowd = spark.range(3_000).selectExpr("id as vec_id", "array(1.0, if(id < 2990, 0.5, 0.001 * id)) as embedding")
    for r in neighbours.nearest(crowd, crowd.where("vec_id in (0, 2, 2000)")).groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).collect():
        assert r.ids == sorted([x for x in range(6) if x != r.query_id][:5])


def test_vectors_of_any_magnitude(spark):
    """Cosines of very large and very small vectors are those of the directions."""
    ship(spark)
    same = [(50, 1e200), (100, 1e-200), (150, 1.0), (200, 1e308), (250, 5e-324)]
    rows = [(i, [m, m, 0.0, 0.0]) for i, m in same] + [(i, [1.0, -float(i), 0.5, 2.0]) for i in range(1, 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), probed_share=1.0).collect()
    ids = [i for i, _ in same]
    for query in ids:
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert {x[1] for x in own[:4]} == {i for i in ids if i != query}
        assert all(x[2] == pytest.approx(1, abs=1e-12) for x in own[:4])
