"""Scanning against plain search, and on streams."""

import random

import pytest

from glyphrake.functions.matching import count_in_text, places_in_bytes
from glyphrake.operators import scan
from glyphrake.streaming.scan import hits_per_piece
from pyspark.sql import functions as F

TEXTS = ["aaaa", "", "abcabcab", "a.b$1 a.b$1", "éßéßé", r"a\Eb a\Eb", "x" * 300, "tion" * 90]
PATTERNS = ["aa", "a", "abcab", "a.b$1", "éßé", r"a\Eb", "xx", "tion", "zzz", "A"]


def naive(text, pattern):
    raw, wanted = text.encode(), pattern.encode()
    return [i for i in range(len(raw) - len(wanted) + 1) if raw[i : i + len(wanted)] == wanted]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "id long, text string")


def test_count(rows):
    got = {r.pattern: r.n for r in scan.count(rows, "text", PATTERNS).collect()}
    assert got == {p: sum(len(naive(t, p)) for t in TEXTS) for p in PATTERNS}


def test_count_of_the_empty_pattern(rows):
    assert rows.where("id = 0").select(count_in_text(F.col("text"), "")).first()[0] == 5


@pytest.mark.parametrize("pattern", PATTERNS)
def test_locate(rows, pattern):
    got = sorted((r.id, r.byte_pos) for r in scan.locate(rows, "text", [pattern, "zzz"], "id").collect())
    assert got == [(i, at) for i, t in enumerate(TEXTS) for at in naive(t, pattern)]


def test_locate_is_one_scan(rows, spark, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    plan = scan.locate(spark.read.parquet(str(tmp_path / "t")), "text", PATTERNS, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_table_of_patterns(rows, spark, monkeypatch):
    """Long patterns by anchors (some with one anchor in common), short ones by automaton, texts in stretches, blocks of anchors."""
    drawn = random.Random(9)
    word = lambda n: "".join(drawn.choice("abé ") for _ in range(n))
    texts = [word(drawn.randint(0, 900)) for _ in range(40)] + ["xy" * 200, None]
    patterns = [t[a : a + drawn.randint(1, 120)] for t in texts[:40] if t for a in [drawn.randrange(len(t))]] + ["xy" * 12, "xy" * 30, "no such text in any of them at all", "", None]
    pieces = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select(F.col("id").alias("piece_id"), F.encode("t", "UTF-8").alias("body"))
    table = spark.createDataFrame(list(enumerate(patterns)), "id long, t string").select(F.col("id").alias("pattern_id"), F.encode("t", "UTF-8").alias("body"))
    want = sorted((k, i, at) for k, p in enumerate(patterns) if p for i, t in enumerate(texts) if t for at in naive(t, p))
    assert sorted(tuple(r) for r in scan.locate_table(pieces, table).collect()) == want
    monkeypatch.setattr(scan, "ANCHORS", 20)
    assert sorted(tuple(r) for r in scan.locate_table(pieces, table).collect()) == want
    assert scan.locate_table(pieces, table.limit(0)).count() == 0


def test_stretches_of_a_long_text(spark):
    pattern = "the pattern that lies across the border"
    texts = ["x" * (scan.STRETCH - 10) + pattern + "y" * scan.STRETCH + pattern]
    pieces = spark.createDataFrame([(1, bytearray(texts[0].encode()))], "piece_id long, body binary")
    table = spark.createDataFrame([(5, bytearray(pattern.encode()))], "pattern_id long, body binary")
    assert sorted(r.piece_pos for r in scan.locate_table(pieces, table).collect()) == naive(texts[0], pattern)


def test_batch_and_byte_scan(rows):
    pieces = rows.select(F.col("id").alias("piece_id"), F.encode("text", "UTF-8").alias("body"))
    want = sorted((k, i, at) for k, p in enumerate(PATTERNS) for i, t in enumerate(TEXTS) for at in naive(t, p))
    assert sorted(tuple(r) for r in scan.locate_batch(pieces, [(k, p.encode()) for k, p in enumerate(PATTERNS)]).collect()) == want
    byte = pieces.where("body is not null").select("piece_id", F.explode(places_in_bytes(F.col("body"), F.lit(b"aa"))).alias("at"))
    assert sorted((r.piece_id, r.at) for r in byte.collect()) == [(i, at) for i, t in enumerate(TEXTS) for at in naive(t, "aa")]


def test_bytes_that_are_no_text(spark):
    pieces = spark.createDataFrame([(1, bytearray(b"\xff\xfe\xff\xfe\xff"))], "piece_id long, body binary")
    assert sorted(r.piece_pos for r in scan.locate_batch(pieces, [(0, b"\xff\xfe\xff")]).collect()) == [0, 2]


def test_boundaries(spark):
    parts = spark.createDataFrame([("foo",), ("bar",), ("foo",), ("fo",)], "p string")
    got = {(r.pattern, r.kind): (r.interval_count, r.match_count) for r in scan.boundary_counts(parts, "p", ["o", "foo"]).collect()}
    assert got == {("o", "prefix"): (5, 0), ("o", "exact"): (3, 0), ("foo", "prefix"): (2, 2), ("foo", "exact"): (2, 2)}


def test_prefix_filter_reaches_the_reader(spark, tmp_path):
    spark.createDataFrame([("The x",), ("y",)], "text string").write.parquet(str(tmp_path / "t"))
    found = scan.starting_with(spark.read.parquet(str(tmp_path / "t")), "text", "The ")
    assert "StringStartsWith" in found._jdf.queryExecution().toString() and found.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aaa"), (2, "b")], "id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = hits_per_piece(stream, "id", "text", ["aa", "b"]).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.sql("select * from hits").collect()) == [(1, "aa", 2), (2, "b", 1)]


def test_regex_matches(spark):
    """Starts, ends and groups as the standard library finds them, characters beyond 16 bits included."""
    import random
    import re

    from glyphrake.functions.matching import regex_matches

    drawn, pattern = random.Random(4), "(a+)(b?)"
    texts = ["", "zzz", None, "aab", "🙂aa🙂b", *("".join(drawn.choices("aab🙂é \n", k=drawn.randint(0, 400))) for _ in range(60))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", regex_matches(F.col("t"), pattern, 1, 2).alias("m")).collect()
    for r in rows:
        want = None if r.t is None else [(m.start(), m.end(), m[0], m[1], m[2]) for m in re.finditer(pattern, r.t)]
        assert (r.m if r.m is None else [tuple(x) for x in r.m]) == want
