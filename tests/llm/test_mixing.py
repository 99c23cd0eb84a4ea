"""Targets, positions and the training order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphrake.llm import mixing, packing


def test_inverse_of_the_integral(spark):
    for knots in (*mixing.SCHEDULES, ((0, 0), (0.2, 3), (0.7, 0), (1, 1))):
        times = np.linspace(0, 1, 4_001)
        weight = np.interp(times, *zip(*knots))
        share = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
        share /= share[-1]
        rows = spark.createDataFrame([(float(s),) for s in share[1:-1:97]], "s double").select("s", mixing.position_of(F.col("s"), knots).alias("t")).collect()
        assert all(abs(np.interp(r.t, times, share) - r.s) < 1e-3 for r in rows)


@pytest.mark.parametrize("knots", [((0, 1),), ((0, 0), (1, 0)), ((0, 1), (0, 2)), ((0, -1), (1, 3))])
def test_bad_schedules(knots):
    with pytest.raises(ValueError):
        mixing.integrated(knots)


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1_000, 10, 1], [5, 0, 700, 90, 3], [1], [0, 0]])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")).orderBy("source").collect()
    target, cap, weight, total = [0.0] * len(sizes), [3 * n for n in sizes], [i % 3 + 1 for i in range(len(sizes))], sum(sizes)
    open_, left = set(range(len(sizes))), float(total)
    while open_:
        each = left / sum(weight[i] for i in open_)
        over = {i for i in open_ if weight[i] * each > cap[i]}
        for i in over or open_:
            target[i] = cap[i] if over else weight[i] * each
        left -= sum(target[i] for i in over)
        open_ = open_ - over if over else set()
    assert [r.target for r in rows] == pytest.approx(target)


def test_hot_source_and_order(spark):
    docs = spark.range(3_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('s', id % 11) end as source")
    plan = mixing.plan_mix(docs).collect()
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in own) - own[0].target) <= 7
    assert all(r.copies <= 3 for r in plan)
    assert {(r.doc_id, tuple(r.positions)) for r in plan} == {(r.doc_id, tuple(r.positions)) for r in mixing.plan_mix(docs).collect()}
    order = [r.position for r in mixing.mix_sources(docs).collect()]
    assert order == sorted(order) and len(order) == sum(r.copies for r in plan) and 0 <= order[0] and order[-1] <= 1


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    assert "Python" not in mixing.plan_mix(docs)._jdf.queryExecution().toString()


def test_one_id_in_two_sources(spark):
    """Rows alike but for their source are placed as often as the plan says for each source."""
    schema = "doc_id long, text string, source string, extra long"
    rows = [(1, "a b c", "x", 1), (1, "a b c", "y", 2), (1, "a b c", None, 3)] * 3 + [(i, "w " * (i % 5 + 1), "x" if i % 4 else "y", i) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, schema)
    plan, got = {}, {}
    for r in mixing.plan_mix(docs).collect():
        plan[r.doc_id, r.source] = plan.get((r.doc_id, r.source), 0) + r.copies
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
        assert r.doc_id > 1 or {"x": 1, "y": 2, None: 3}[r.source] == r.extra
    assert got == {k: n for k, n in plan.items() if n}


def test_rows_and_files_follow_the_schedule(spark, tmp_path):
    """The order of mixed documents, also once written and read, is that of the positions: fading sources come early, rising ones late."""
    docs = spark.range(900).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "concat('s', id % 3) as source")
    order = [(r.doc_id, r.epoch) for r in mixing.mix_sources(docs).collect()]
    mixed = mixing.mixed_documents(docs)
    assert [r.doc_id for r in mixed.collect()] == [d for d, _ in order]
    mixed.write.parquet(str(tmp_path / "m"))
    placed = packing.file_order(spark.read.parquet(str(tmp_path / "m"))).orderBy("place").collect()
    assert [r.doc_id for r in placed] == [d for d, _ in order]
    third = len(order) // 3
    share = lambda part, kind: sum(d % 3 == kind for d, _ in part) / len(part)
    assert share(order[:third], 0) > 1.5 * share(order[-third:], 0) and share(order[-third:], 2) > 1.5 * share(order[:third], 2)
