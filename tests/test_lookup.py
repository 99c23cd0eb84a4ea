"""What stays in tables, against plain loops: as-of joins, bits, wavelet matrices, suffix order, search, steps and walks."""

import random

import pytest
from pyspark.sql import functions as F

from glyphrake.functions.asof import asof
from glyphrake.operators import backward, lookup, suffixes
from glyphrake.operators.bits import BitVector, WaveletMatrix
from glyphrake.plans.index import PieceIndexWithLocate, PlainIndexWithLocate, RunIndexWithLocate
from glyphrake.sources.corpus import from_buffer


def naive(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]


@pytest.fixture
def many_parts(spark):
    """Partitions stay as small as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("equal, strict", [(0, False), (0, True), (1, False), (1, True)])
def test_asof(spark, many_parts, equal, strict):
    drawn = random.Random(equal + 2 * strict)
    entries = sorted({(drawn.choice([0, 0, 0, 3, 5]), drawn.randint(0, 300)) for _ in range(150)})
    table = spark.createDataFrame([(g, i, 10 * i + g) for g, i in entries], "g long, i long, v long")
    asked = [(k, drawn.randint(-1, 6), drawn.randint(-5, 310), None if k % 3 else f"q{k}") for k in range(400)]
    got = {r.k: (r.t, r.v) for r in asof(spark.createDataFrame(asked, "k long, g long, i long, t string"), table, ["g", "i"], ["v"], equal, strict).collect()}
    for k, g, i, t in asked:
        below = [e for e in entries if (e < (g, i) if strict else e <= (g, i))]
        want = 10 * below[-1][1] + below[-1][0] if below and (not equal or below[-1][0] == g) else None
        assert got[k] == (t, want)
    assert asof(table.select("g", "i"), table.limit(0), ["g", "i"], ["v"]).where("v is not null").count() == 0


@pytest.mark.parametrize("n", [1, 64, 500])
def test_bits(spark, n):
    drawn = random.Random(n)
    bits = [int(drawn.random() < 0.3) for _ in range(n)]
    vector = BitVector.build(spark.createDataFrame([x for x in enumerate(bits)], "at long, bit long"), n)
    asked = spark.range(n + 1).withColumnRenamed("id", "i")
    got = {r.i: (r.ones, r.zeros) for r in vector.rank(vector.rank(asked, "i", "ones"), "i", "zeros", 0).collect()}
    assert got == {i: (sum(bits[:i]), i - sum(bits[:i])) for i in range(n + 1)}
    assert {r.i: r.bit for r in vector.access(asked.where(F.col("i") < n), "i").collect()} == dict(enumerate(bits))
    for bit in (0, 1):
        places = [i for i, b in enumerate(bits) if b == bit]
        assert {r.i: r["at"] for r in vector.select(asked, "i", "at", bit).collect()} == {i: places[i] if i < len(places) else None for i in range(n + 1)}


def test_wavelet_matrix(spark):
    drawn = random.Random(8)
    symbols = [drawn.choice([0, 3, 3, 3, 9, 12]) for _ in range(200)]
    matrix = WaveletMatrix.build(spark.createDataFrame(list(enumerate(symbols)), "at long, c long"), 200, 12)
    assert len(matrix.levels) == 4
    assert {r.i: r.c for r in matrix.access(spark.range(200).withColumnRenamed("id", "i"), "i").collect()} == dict(enumerate(symbols))
    asked = spark.createDataFrame([(drawn.choice([0, 3, 5, 9, 12, 77]), drawn.randint(0, 200)) for _ in range(80)], "s long, i long")
    for r in matrix.rank(asked, "s", "i").collect():
        assert r["rank"] == symbols[: r.i].count(r.s)
    asked = asked.withColumn("i", F.col("i") % 60)
    for r in matrix.select(asked, "s", "i").collect():
        places = [i for i, c in enumerate(symbols) if c == r.s]
        assert r["at"] == (places[r.i] if r.i < len(places) else None)


def bodies_of(seed):
    drawn = random.Random(seed)
    bodies = [bytes(drawn.choice(b"ab" if seed % 2 else b"abcd") for _ in range(drawn.choice([0, 1, drawn.randint(0, 30)]))) for _ in range(10)]
    bodies[0], bodies[-1] = bodies[0] or b"a", bodies[-1] or b"b"
    bodies[3] = bodies[5] = b"abc" * 20
    # runs of over a hundred that go up and down
    bodies[7], bodies[8] = b"a" * 300 + b"b" + b"a" * 120, b"b" * 250 + b"a"
    return bodies


@pytest.mark.parametrize("seed", range(3))
def test_order_by_sampled_suffixes(spark, seed):
    text = b"".join(b + b"\0" for b in bodies_of(seed))
    rows = suffixes.suffix_ranks(from_buffer(spark, text), short=(0, 40, 200)[seed]).orderBy("sa_row").collect()
    assert [r.pos for r in rows] == sorted(range(len(text)), key=lambda i: text[i:])


def test_order_of_wide_symbols(spark):
    drawn = random.Random(9)
    text = [drawn.choice([1, 70_000, 70_001, 2**40]) for _ in range(150)] * 2 + [0]
    rows = suffixes.suffix_ranks(from_buffer(spark, text, 2**40), short=20).orderBy("sa_row").collect()
    assert [r.pos for r in rows] == sorted(range(len(text)), key=lambda i: text[i:])


def test_order_of_long_rises_and_falls(spark, monkeypatch):
    """A text of hundreds of rising symbols is ordered without its stretches, which would be long."""
    from glyphrake.operators import induced

    text = [*range(1, 400), *range(500, 200, -1), *range(1, 400), 0]
    monkeypatch.setattr(induced, "_all_rows", None)
    rows = suffixes.suffix_ranks(from_buffer(spark, text, 600), short=20).orderBy("sa_row").collect()
    assert [r.pos for r in rows] == sorted(range(len(text)), key=lambda i: text[i:])


def test_order_of_terminators(spark):
    text = b"ba\0\0\0ba\0ba\0b\0ba\0"
    rows = suffixes.suffix_ranks(from_buffer(spark, text), short=0).orderBy("sa_row").collect()
    assert [r.pos for r in rows] == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.fixture(scope="module")
def text():
    return b"".join(b + b"\0" for b in bodies_of(2))


@pytest.fixture(scope="module")
def pieces(spark, text):
    return PieceIndexWithLocate(from_buffer(spark, text), 2, most_in_memory=0)


@pytest.fixture(scope="module", params=[PlainIndexWithLocate, RunIndexWithLocate, PieceIndexWithLocate])
def index(request, pieces):
    return pieces.as_kind(request.param)


PATTERNS = [b"a", b"ab", b"abcabcabcabcabcabcab", b"abcabca", b"abcabcab", b"cab\0", b"zz", b"", b"a" * 64, b"b" * 15, [98, 500], b"\0a"]


def test_intervals(spark, index, text):
    got = {r.pattern_id: (r.s, r.e) for r in index.intervals(backward.pattern_rows(spark, PATTERNS)).collect()}
    order = sorted(range(len(text)), key=lambda i: text[i:])
    for i, p in enumerate(PATTERNS[:-1]):
        rows = [k for k, at in enumerate(order) if text[at:].startswith(bytes(p))] if not isinstance(p, list) else []
        assert got[i][1] - got[i][0] == len(rows) and (not rows or got[i][0] == rows[0]), p
    # with a terminator before it: around the text, as steps are
    assert got[len(PATTERNS) - 1][1] - got[len(PATTERNS) - 1][0] == len(naive(text[-1:] + text, b"\0a"))


def test_refined_searches(spark, index, text):
    """Many searches and what is put before them, at once."""
    first = index.intervals(backward.pattern_rows(spark, [b"ab", b"c", b"q"])).withColumnRenamed("pattern_id", "search_id")
    more = [(0, 0, b"c"), (1, 0, b"abc"), (2, 1, b"abcab"), (3, 2, b"a"), (4, 1, b"")]
    rows = spark.createDataFrame([(i, s, list(p)) for i, s, p in more], "pattern_id long, search_id long, symbols array<bigint>")
    got = {r.pattern_id: r.e - r.s for r in index.refined(first, rows).collect()}
    assert got == {i: len(naive(text, p + (b"ab", b"c", b"q")[s])) for i, s, p in more}


def test_steps_from_every_row(spark, index, text):
    n, order = len(text), sorted(range(len(text)), key=lambda i: text[i:])
    row = {at: k for k, at in enumerate(order)}
    got = {r.sa_row: (r.before, r["first"], r.back, r.forward) for r in index.navigated(spark.range(n).withColumnRenamed("id", "sa_row")).collect()}
    assert got == {k: (text[at - 1], text[at], row[(at - 1) % n], row[(at + 1) % n]) for k, at in enumerate(order)}


def test_positions_by_doubled_walks(spark, index, text):
    rows = spark.range(len(text)).select(F.lit(0).cast("long").alias("pattern_id"), F.col("id").alias("sa_row"))
    assert [r.pos for r in index.positions(rows).orderBy("sa_row").collect()] == sorted(range(len(text)), key=lambda i: text[i:])


def test_rounds_are_few(spark, pieces, monkeypatch):
    """A pattern of 64 symbols takes a round for its end and nine for the rest; walks of up to 300 steps take ten."""
    asked, closed = [], []
    asof_, checkpoint = lookup.asof, lookup.checkpoint
    monkeypatch.setattr(lookup, "asof", lambda *a, **k: asked.append(k["label"]) or asof_(*a, **k))
    monkeypatch.setattr(lookup, "checkpoint", lambda df, label: closed.append(label) or checkpoint(df, label))
    assert pieces.intervals(backward.pattern_rows(spark, [b"a" * 64, b"a" * 57, b"ab"])).count() == 3
    assert asked == ["search-starts"] + ["step"] * 9
    chain = spark.range(300).selectExpr("id as sa_row", "case when id = 0 then 299 else id - 1 end as next_row")
    found = lookup.walks(chain, 9)
    assert {r.sa_row: (r.met, r.steps) for r in found.collect()} == {i: (0, i) for i in range(300)}
    assert closed.count("walks") <= 10


def test_a_run_index_reads_no_rows(spark, pieces, monkeypatch):
    """Search, steps and walks over runs never build what has an entry for each row."""
    index = pieces.as_kind(RunIndexWithLocate)
    for name in ("symbol_steps", "gram_rows", "gram_steps"):
        monkeypatch.setattr(lookup, name, None)
    assert index.search("abc").count() > 0 and index.steps.count() == index.runs.count() < index.n
    assert index.search("ab").matches().count() == index.search("ab").count()


def test_wavelet_matrix_of_the_transform(spark, pieces, text):
    """The symbol before a row and its count before it, by the matrix as by sorting."""
    order = sorted(range(len(text)), key=lambda i: text[i:])
    before = [text[at - 1] for at in order]
    rows = spark.range(0, len(text), 5).withColumnRenamed("id", "sa_row")
    assert {r.sa_row: r.c for r in pieces.matrix.access(rows, "sa_row").collect()} == {k: before[k] for k in range(0, len(text), 5)}
    got = {r.sa_row: r["rank"] for r in pieces.matrix.rank(rows.withColumn("c", F.lit(98).cast("long")), "c", "sa_row").collect()}
    assert got == {k: before[:k].count(98) for k in range(0, len(text), 5)}


def test_reading_until_a_symbol(spark, index, text):
    search = index.search("ab")
    order = sorted(range(len(text)), key=lambda i: text[i:])
    twice = text * 2
    for stop in (ord("c"), ord("d"), 7):
        got = {r.sa_row: bytes(r.symbols) for r in search.forward_until(stop).collect()}
        for k, taken in got.items():
            whole = twice[order[k] : order[k] + len(text)]
            if index.by_piece:
                whole = whole[: whole.index(0)]
            assert taken == (whole[: whole.index(stop)] if stop in whole else whole)
        assert len(got) == search.count()
    back = {r.sa_row: bytes(r.symbols) for r in search.backward_until(ord("d")).collect()}
    for k, taken in back.items():
        whole = twice[order[k] : order[k] + len(text)][::-1]
        assert taken == (whole[: whole.index(ord("d"))] if ord("d") in whole else whole)


def test_order_by_cuts(spark, monkeypatch):
    """Texts that the hash cuts well never send a row for each symbol's turn: no joins of ranks with symbols."""
    turns = []
    monkeypatch.setattr(suffixes, "_with_symbols", lambda ranks, corpus, own=suffixes._with_symbols: turns.append(corpus) or own(ranks, corpus))
    drawn = random.Random(3)
    words = [bytes(drawn.choice(b"abcdefgh") for _ in range(drawn.randint(1, 6))) for _ in range(40)]
    bodies = [b" ".join(drawn.choice(words) for _ in range(drawn.randint(1, 60))) for _ in range(12)]
    bodies[4] = bodies[9] = bodies[0]
    bodies[5] = b""
    text = b"".join(b + b"\0" for b in bodies)
    rows = suffixes.suffix_rows(from_buffer(spark, text), len(text), len(bodies), 600).orderBy("sa_row").collect()
    assert [r.pos for r in rows] == sorted(range(len(text)), key=lambda i: text[i:]) and not turns
    assert all(r.f == text[r.pos] and r.l == (text[r.pos - 1] if r.pos else 0) for r in rows)
    assert [r.key for r in rows] == sorted(r.key for r in rows)


@pytest.mark.parametrize("most", [12, 2**40])
def test_wavelet_matrix_in_blocks(spark, many_parts, monkeypatch, most):
    """Blocks are joined for what crosses them: symbols that some lack, places at their edges, the end of the text."""
    from glyphrake.operators import bits

    monkeypatch.setattr(bits, "BLOCK_BITS", 16 * most.bit_length())
    drawn = random.Random(most)
    symbols = [drawn.choice([0, 3, 3, 9, most]) for _ in range(150)] + [3] * 50 + [1]
    rows = list(enumerate(symbols))
    drawn.shuffle(rows)
    matrix, n = WaveletMatrix.build(spark.createDataFrame(rows, "at long, c long").repartition(3), len(symbols), most), len(symbols)
    assert matrix.blocks.count() == -(-n // matrix.block) > 5
    asked = spark.createDataFrame([(s, i) for s in (-1, 0, 1, 3, 5, most, 2**62) for i in range(0, n + 1, 3)] + [(3, n), (1, n)], "s long, i long")
    for r in matrix.read(asked, "i", {"ones": "s"}, "c").collect():
        assert r.ones == symbols[: r.i].count(r.s) and r.c == (symbols[r.i] if r.i < n else None)
    for r in matrix.select(asked, "s", "i").collect():
        places = [i for i, c in enumerate(symbols) if c == r.s]
        assert r["at"] == (places[r.i] if r.i < len(places) else None)


def test_wavelet_matrix_of_pieces_moves_no_symbols(spark, monkeypatch):
    """The matrix of a text is made of bytes of its pieces: each level took an exchange of a row for every symbol before."""
    from glyphrake.operators import bits

    monkeypatch.setattr(bits, "BLOCK_BITS", 8 * 64)
    text = b"".join(bytes(random.Random(i).choices(b"abc", k=(0, 1, 63, 64, 200)[i % 5])) + b"\0" for i in range(20))
    text = text.lstrip(b"\0")
    matrix = WaveletMatrix.of_corpus(from_buffer(spark, text), len(text))
    assert matrix.blocks.count() == -(-len(text) // 64)
    asked = spark.range(len(text)).select(F.col("id").alias("i"), F.lit(98).cast("long").alias("b"))
    for r in matrix.read(asked, "i", {"bs": "b"}, "c").collect():
        assert r.c == text[r.i] and r.bs == text[: r.i].count(b"b")


def test_the_end_of_an_empty_document(spark, monkeypatch):
    """Before it is the terminator of the document before, as in the SQL; the row had the empty document's id."""
    from glyphrake import catalog

    monkeypatch.setattr(catalog, "_INDEXES", {})
    monkeypatch.setattr(catalog, "_read", lambda spark, sf_dir, name: spark.createDataFrame([(3, ""), (5, "e b"), (6, ""), (7, ""), (8, "e")], "doc_id long, text string"))
    got = catalog.wavelet_documents(spark, "").select("doc_id", "blanks", "symbol", "next_e").collect()
    assert sorted(map(tuple, got)) == [(5, 1, 0, 7), (5, 1, 98, 7), (6, 1, 0, 7), (8, 1, 101, 7)]
