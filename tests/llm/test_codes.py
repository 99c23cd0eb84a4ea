"""Codes and codebooks against a plain version in Python's integers."""

import hashlib
import math
import os

import numpy as np
import pytest

from glyphrake.llm import codes
from glyphrake.llm.common import ship

TABLES = "/root/testdata/sf0.001"


def plain(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """vec_id -> (code, error) and the digest; rows: (vec_id, vector) with different ids and usable vectors."""
    scaled = {i: [math.floor(4096 * float(x)) for x in v] for i, v in sorted(rows)}
    width = len(next(iter(scaled.values()))) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in scaled.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(x, book):
        distances = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(v[p], books[p])[0] for v in cut.values()]
            for k in range(len(books[p])):
                mine = [v[p] for v, o in zip(cut.values(), own) if o == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = {}
    for i, v in cut.items():
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found)
    return out, hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_nearest_is_exact(seed):
    """Bounds never rule out the nearest entry or a tie before it."""
    drawn = np.random.default_rng(seed)
    width = int(drawn.integers(1, 20))
    spread = [3, 200, 5_000, codes.SMALL, codes.SMALL * 4, 50][seed]
    points, entries = (drawn.integers(-spread, spread, (n, width)) for n in (400, 16))
    entries[5], points[:30] = entries[2], entries[drawn.integers(0, 16, 30)]
    if seed == 5:
        points, entries = points // 25 * 25, entries // 25 * 25
    own, distance, measured = codes.nearest_entries(points, entries)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in entries] for x in points]
    assert own.tolist() == [d.index(min(d)) for d in want] and [int(x) for x in distance] == [min(d) for d in want]
    assert 400 <= measured <= 6_400


def test_most_entries_are_ruled_out():
    drawn = np.random.default_rng(1)
    entries = drawn.integers(-4_000, 4_000, (16, 16))
    points = entries[drawn.integers(0, 16, 2_000)] + drawn.integers(-300, 300, (2_000, 16))
    assert codes.nearest_entries(points, entries)[2] < 1.2 * 2_000


def test_against_a_plain_version(spark):
    ship(spark)
    drawn = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(drawn.permutation(300) - 40, drawn.normal(0, 0.2, (300, 32)))]
    vectors = spark.createDataFrame([(i, v, int(i) % 3 or None) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(5)
    # the table holds floats: the same numbers go to both
    want, digest = plain([(r.vec_id, r.embedding) for r in vectors.collect()])
    found, books = codes.compress(vectors)
    assert {r.vec_id: (r.code, r.error) for r in found.collect()} == want
    assert codes.books_digest(books) == digest


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    ship(spark)
    rows = [(0, [1.0] * 8, 1), (0, [1.0] * 8, 1), (None, [2.0] * 8, None), (3, None, 1), (4, [nan] * 8, 1), (5, [inf] + [0.0] * 7, 1), (6, [None] + [0.0] * 7, 1), (7, [], 1), (8, [1.0] * 9, 1), (9, [0.0] * 8, None), (10, [1e30] * 8, 2)]
    vectors = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    found, books = codes.compress(vectors)
    got = {(r.vec_id, r.label, r.code, r.error) for r in found.collect()}
    assert found.count() == 5 and {x[0] for x in got} == {0, None, 9, 10} and all(x[3] == 0 for x in got) and len(books) == 5
    assert (0, 1, "00" * 8, 0) in got and (None, None, "04" * 8, 0) in got
    assert codes.compress(vectors.limit(0))[0].count() == 0
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.label_error for r in codes.op12_vector_codes(spark, str(tmp_path)).collect()} == {0}
    # far apart and few entries: the error has a largest value
    far, _ = codes.compress(spark.createDataFrame([(i, [1e30 * (-1) ** i] * 16, 1) for i in range(3)], "vec_id long, embedding array<double>, label int"), entries=1)
    assert max(r.error for r in far.collect()) == codes.MOST_LONG


def test_parts_of_other_lengths(spark):
    assert [s.stop - s.start for s in codes.part_slices(21)] == [3] * 5 + [2] * 3
    assert [s.stop - s.start for s in codes.part_slices(3)] == [1] * 3 + [0] * 5
    found, _ = codes.compress(spark.createDataFrame([(i, [float(i), 1.0, -float(i)], None) for i in range(20)], "vec_id long, embedding array<double>, label int"))
    assert all(len(r.code) == 16 for r in found.collect())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{TABLES}/embeddings.parquet')")
    columns = "vec_id, code, error, label_error, codebooks_sha256"
    want = con.execute(f"SELECT {columns} FROM ({codes.ORACLE_SQL}) q").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in codes.op12_vector_codes(spark, TABLES).select(*columns.split(", ")).collect())
