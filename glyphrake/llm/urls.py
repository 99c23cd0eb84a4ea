"""URL filter: rules, and a character language-model ratio where no rule fits.

Two variable-order Markov models, one of accepted and one of rejected URLs, are
smoothed from order to order by the number of different continuations.  A URL's score
is the difference of their log likelihoods per character; the bound between accepted
and rejected is calibrated on URLs that neither model has seen.  URLs that rules
decide are the examples.

The models are a table of all grams (a context and the character after it) of all URLs,
which grows with them; it is joined with the URLs' grams and never sent around.  Only the
values of the most frequent grams, whose number is bounded by their share, are sent to
the tasks, which spares most rows of the join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphrake.llm.common import materialize, table

#: (verdict, host, path) of the registered query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Longest context, bins and width of the calibration, fold for calibration, grams that a worker counts before it hands them on.
ORDER, BINS, WIDTH, FOLDS, HELD = 4, 2_001, 4.0, 5, 200_000
#: A gram that makes up this share of all is sent to the tasks: there are no more than the inverse.
FREQUENT = 1 / 50_000
#: What stands before and after a URL, and the probability of any character before anything is known.
EDGE, UNIFORM = "\n", 1 / 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host or one above it and starts the path, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, its_host, its_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(its_path)
        rule = F.when(fits, F.lit(its_host + its_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams_of(text: str) -> list[str]:
    """Every character of the text and its end, each after the ORDER characters before it."""
    padded = EDGE * ORDER + text + EDGE
    return [padded[i : i + ORDER + 1] for i in range(len(text) + 1)]


def _counted(texts: DataFrame) -> DataFrame:
    """gram, n, n0, n1: how often each gram occurs in all URLs, and in examples of either side (texts: text, side or null, times)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter[str]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for side, found in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([side] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["gram", "side", "n"])
            held.clear()

        for batch in batches:
            for text, side, times in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(-1 if side is None else side, Counter())
                for gram in grams_of(text):
                    own[gram] += times
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    found = texts.select("text", "side", "times").mapInArrow(count, "gram string, side int, n long")
    sides = [F.coalesce(F.sum(F.when(F.col("side") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in (0, 1)]
    return found.groupBy("gram").agg(F.sum("n").alias("n"), *sides)


def gram_values(grams: DataFrame) -> DataFrame:
    """gram, n, value: the log probability of its last character after the others as accepted less that as rejected.

    grams: gram, n, n0, n1.  Shorter contexts follow from longer ones by leaving out the
    first character.  Order by order, a gram's counts meet those of its context (the
    grams with one context are as many as there are characters) and the probability that
    the next shorter context gives.
    """
    levels = [grams.select("gram", "n0", "n1")]
    for _ in range(ORDER):
        shorter = levels[0].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        levels.insert(0, shorter)
    before = None
    for k, level in enumerate(levels):
        context = Window.partitionBy(F.expr(f"substring(gram, 1, {k})"))
        level = level.withColumns({f"{what}{i}": x for i in (0, 1) for what, x in (("all", F.sum(f"n{i}").over(context)), ("kinds", F.count_if(F.col(f"n{i}") > 0).over(context)))})
        if before is not None:
            level = level.join(before, F.expr("substring(gram, 2)") == F.col("tail"))
        p = [F.col(f"q{i}") if before is not None else F.lit(UNIFORM) for i in (0, 1)]
        new = [F.when(F.col(f"all{i}") > 0, (F.col(f"n{i}") + F.col(f"kinds{i}") * p[i]) / (F.col(f"all{i}") + F.col(f"kinds{i}"))).otherwise(p[i]) for i in (0, 1)]
        before = level.select(F.col("gram").alias("tail"), *(x.alias(f"q{i}") for i, x in enumerate(new)))
    return grams.join(before, F.col("gram") == F.col("tail")).select("gram", "n", (F.ln("q0") - F.ln("q1")).alias("value"))


def scores(texts: DataFrame, values: DataFrame) -> DataFrame:
    """key, score of every text (text, key): the values of its grams, per character with the end.

    Values of frequent grams are added up where the text is; the others' by a join.
    """
    spark = texts.sparkSession
    total = values.agg(F.sum("n")).first()[0] or 0
    frequent = values.where(F.col("n") >= FREQUENT * total).select("gram", "value").toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(frequent.column("gram").to_pylist(), frequent.column("value").to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sums, sizes, rest = [], [], []
            for text in batch.column(0).to_pylist():
                own = grams_of(text)
                found = [known.get(g) for g in own]
                sums.append(float(sum(v for v in found if v is not None)))
                sizes.append(len(own))
                rest.append(list(Counter(g for g, v in zip(own, found) if v is None).items()))
            kind = pa.list_(pa.struct([("gram", pa.string()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums, pa.float64()), pa.array(sizes, pa.int64()), pa.array([[{"gram": g, "times": n} for g, n in x] for x in rest], kind)], names=["key", "value", "chars", "rest"])

    found = materialize(texts.select("text", "key").mapInArrow(run, "key string, value double, chars long, rest array<struct<gram:string,times:bigint>>"), "url-sums")
    rare = found.select("key", F.explode("rest").alias("x")).select("key", "x.gram", "x.times")
    rare = rare.join(values.select("gram", F.col("value").alias("own")), "gram").select("key", (F.col("own") * F.col("times")).alias("value"), F.lit(0).cast("long").alias("chars"))
    # the order of a sum is not fixed: what it changes is rounded off
    return found.select("key", "value", "chars").unionByName(rare).groupBy("key").agg(F.round(F.sum("value") / F.sum("chars"), 9).alias("score"))


def calibrated(scored: DataFrame) -> float:
    """The bound with the fewest errors on (side, score), each class counting as a whole; the middle of the best bins."""
    place = F.least(F.greatest(F.round((F.col("score") / WIDTH + 1) / 2 * (BINS - 1)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    grid = np.zeros((2, BINS))
    for r in scored.groupBy("side", place.alias("place")).agg(F.sum("times").alias("n")).collect():
        grid[r["side"], r["place"]] = r["n"]
    if not grid.sum(axis=1).all():
        return 0.0
    grid /= grid.sum(axis=1, keepdims=True)
    # side 0 is accepted: an error below the bound; side 1 is rejected: an error from the bound on
    errors = np.concatenate(([0], np.cumsum(grid[0])))[:-1] + np.cumsum(grid[1][::-1])[::-1]
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(((best[0] + best[-1]) / 2 / (BINS - 1) * 2 - 1) * WIDTH)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages' page_id with host, path, rule, verdict and the score of the model ratio.

    Null URLs and URLs without :// have an empty host and path and fit no rule.  The
    models learn from and score the whole URL, as it is written; null counts as empty.
    Four folds of five of the ruled URLs are counted, as often as they occur; the fifth
    sets the bound.  Equal URLs have equal scores.  Without examples of both classes what
    no rule decides is allowed.  Repeated rows stay; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("ruled", verdict)
    rows = rows.withColumn("text", F.coalesce("url", F.lit("")))
    # a key of 128 bits stands for the text
    rows = rows.withColumn("key", F.md5("text")).drop("url")
    side = (F.col("ruled") == "block").cast("int")
    texts = materialize(rows.groupBy("text", "key", side.alias("side")).agg(F.count("*").alias("times")), "url-texts")
    seen = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)) != 0
    values = materialize(gram_values(materialize(_counted(texts.withColumn("side", F.when(seen, F.col("side")))), "url-grams")), "url-values")
    scored = materialize(texts.join(scores(texts, values), "key").select("key", "score", "times", F.when(~seen, F.col("side")).alias("side")), "url-scores")
    examples = texts.where(seen & F.col("side").isNotNull()).groupBy("side").count().count()
    bound = calibrated(scored.where("side is not null")) if examples == 2 else 0.0
    judged = F.when(F.col("score") >= bound, "allow").otherwise("block") if examples == 2 else F.lit("allow")
    return rows.join(scored.select("key", "score"), "key").select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' URLs by rule or by model: see judge()."""
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))
