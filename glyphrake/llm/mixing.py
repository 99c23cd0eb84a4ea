"""Mixing sources to target weights with a time-varying curriculum, in DataFrame functions only.

Each source has a weight that changes over training time (0 to 1) along straight
lines between knots.  The integral of that line is the source's cumulative demand
for words.  Documents of a source form a reproducible stream, repeated as often as
needed; a document's place in the stream, put through the inverse of the demand,
is its training position, and a range sort by position gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphrake.llm.common import buckets_for, materialize, prefix_sum, table, unused

#: A word; null texts have none.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights dealt to the sources in code point order, again and again.
WEIGHTS = (1.0, 2.0, 3.0)
#: For each weight the (time, factor) knots of its schedule: fading, level and rising sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
#: No document is taken more often than this.
MOST_REPEATS = 3


def integrated(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Pieces of a schedule: start, length, weight at the start, slope, share of the integral before it (the whole is 1)."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("times must rise and weights must not be negative")
        pieces.append((t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (t1 - t0) * (w0 + w1) / 2
    if not area > 0:
        raise ValueError("a schedule needs a positive integral")
    return [(t, d, w / area, s / area, a / area) for t, d, w, s, a in pieces]


def position_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's integral reaches share (0 to 1): the inverse of the cumulative demand."""
    out = None
    for t, length, w, s, before in reversed(integrated(knots)):
        rest = F.greatest(share - F.lit(before), F.lit(0.0))
        # w x + s x^2 / 2 = rest, in the form that stays exact when s is 0
        x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + 2 * s * rest, F.lit(0.0)))))
        at = F.lit(t) + F.least(x, F.lit(length))
        out = at if out is None else F.when(share >= F.lit(held_before), out).otherwise(at)
        held_before = before
    return out


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST_REPEATS) -> DataFrame:
    """Add kind, weight and target to one row per source (source, source_size).

    Targets share share of all words by weight.  None is above most times its source's
    size: taking sources by rising size per weight, the sources at their limit come
    first, and the level at which the others stop follows from running sums.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    kinds = F.create_map(*(x for i, w in enumerate(weights) for x in (F.lit(i), F.lit(float(w)))))
    rows = sizes.withColumn("kind", ((F.row_number().over(ordered) - 1) % len(weights)).cast("int"))
    rows = rows.withColumn("weight", kinds[F.col("kind")]).withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fills_at", F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy("fills_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    demand = F.sum("source_size").over(everyone) * F.lit(float(share))
    left = demand - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level at which this source and all that fill later would stop
    rows = rows.withColumn("level", left / weight_left)
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(everyone)["level"]
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))).drop("cap", "fills_at", "level")


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = 1.0, most: int = MOST_REPEATS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: keep's columns, doc_id, source, size, source_size, target, copies, positions.

    positions has the training position of every copy.  A copy is taken if its middle
    lies before the target in its source's repeated stream, so that a source misses its
    target by half a document at most and only whole documents are taken.  Texts that
    are null or have no words have size 0 and no copies.  Null sources form one source,
    the last.  Repeated ids are documents of their own.  An empty table gives no rows.
    """
    narrow = docs.select(*keep, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    narrow = materialize(narrow.withColumn("order_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    per_source = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    # buckets are ranges of the key, so that they follow each other as the keys do
    bucket = F.shiftright(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") * buckets_for(narrow.count()), 32)
    streamed = prefix_sum(narrow, ["source"], bucket, ("order_key", "doc_id", "size", *keep), "size", "before")
    per_source = per_source.withColumnRenamed("source", "its_source")
    # hot sources: the few sources' rows go to all tasks only while small, else the join is split by size at run time
    rows = streamed.join(per_source, F.col("source").eqNullSafe(F.col("its_source")), "left").drop("its_source")
    middle = F.col("before") + F.col("size") / 2
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size")))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("copies", copies)
    nth = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))

    def position(i: Column) -> Column:
        share_at = (i * F.col("source_size") + middle) / F.col("target")
        out = position_of(share_at, schedules[0])
        for kind, knots in enumerate(schedules[1:], 1):
            out = F.when(F.col("kind") == kind, position_of(share_at, knots)).otherwise(out)
        return out

    return rows.withColumn("positions", F.transform(nth, position)).drop("weight", "kind", "before", "order_key")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The training order: one row per taken copy with its epoch and position, range-sorted by position."""
    plan = plan_mix(docs, **options)
    copies = plan.select("*", F.posexplode("positions").alias("epoch", "position")).drop("positions", "copies")
    return copies.orderBy("position", "doc_id", "epoch")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs in training order: each document as often as the mix takes it, with its own columns.

    Texts are dealt once by id, source and text to meet their positions and once by range of
    position.  Rows alike in all three are told apart by number, in order of their other
    columns, so that each is placed once.  The order of rows is the training order, and files
    written from them have it, in the files by name and in the rows of each.
    """
    key, nth, places, place, rest = (unused(docs, c) for c in ("_text_hash", "_nth", "_places", "_place", "_rest"))
    keyed = docs.withColumns({key: F.xxhash64("text"), rest: F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns))})
    alike = Window.partitionBy("doc_id", "source", key)
    plan = plan_mix(keyed, keep=[key, rest], **options).withColumn(nth, F.row_number().over(alike.orderBy(rest, "positions")))
    plan = plan.where(F.size("positions") > 0).select(*(F.col(c).alias(f"{key}_{i}") for i, c in enumerate(("doc_id", "source", key, nth))), F.col("positions").alias(places))
    rows = keyed.withColumn(nth, F.row_number().over(alike.orderBy(rest)))
    same = F.lit(True)
    for i, c in enumerate(("doc_id", "source", key, nth)):
        same = same & F.col(c).eqNullSafe(F.col(f"{key}_{i}"))
    placed = rows.join(plan, same).select(*docs.columns, F.explode(places).alias(place))
    return placed.orderBy(place, "doc_id").select(*docs.columns)


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each and the training positions of its copies; see plan_mix()."""
    plan = plan_mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    rows = plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(F.get("positions", F.lit(i)).alias(f"position_{i + 1}") for i in range(MOST_REPEATS)))
    return rows.orderBy(F.col("position_1").asc_nulls_last(), "doc_id")


def _inverse_sql(knots: Sequence[tuple[float, float]]) -> str:
    whens = []
    for t, length, w, s, before in reversed(integrated(knots)):
        rest = f"greatest(u - {before!r}::DOUBLE, 0::DOUBLE)"
        x = f"CASE WHEN {rest} <= 0 THEN 0::DOUBLE ELSE 2 * {rest} / ({w!r}::DOUBLE + sqrt(greatest({w * w!r}::DOUBLE + {2 * s!r}::DOUBLE * {rest}, 0::DOUBLE))) END"
        whens.append(f"WHEN u >= {before!r}::DOUBLE THEN {t!r}::DOUBLE + least({x}, {length!r}::DOUBLE)")
    return f"CASE {' '.join(whens)} END"


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS order_key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS kind FROM sources),
capped AS (
  SELECT *, kind + 1.0::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap,
         source_size * 3.0::DOUBLE / (kind + 1.0::DOUBLE) AS fills_at FROM weighted),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(cap) OVER w, 0)) / ((SELECT sum(weight) FROM capped) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM capped
  WINDOW w AS (ORDER BY fills_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, kind, source_size, least(cap, weight * (SELECT arg_min(level, fills_at) FROM levels WHERE level <= fills_at)) AS target FROM levels),
streamed AS (
  SELECT s.*, t.kind, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY order_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size / 2.0::DOUBLE AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(0, ceil((target - middle) / source_size)) ELSE 0 END::BIGINT AS copies FROM streamed),
nth AS (SELECT copied.*, i, (i * source_size + middle) / target AS u FROM copied, range(0, 3) r(i)),
placed AS (
  SELECT *, CASE WHEN i < copies THEN CASE kind {' '.join(f'WHEN {i} THEN {_inverse_sql(k)}' for i, k in enumerate(SCHEDULES))} END END AS position FROM nth)
SELECT doc_id, size, source_size, target, copies * size AS taken,
       max(position) FILTER (i = 0) AS position_1, max(position) FILTER (i = 1) AS position_2, max(position) FILTER (i = 2) AS position_3
FROM placed GROUP BY doc_id, source, order_key, size, source_size, target, copies, middle
"""
