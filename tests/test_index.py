"""The index against known values and against plain search."""

import random

import numpy as np
import pytest

from glyphrake import session
from glyphrake.errors import InvalidPatternError, InvalidTextError
from glyphrake.functions.running import numbered, running_sum
from glyphrake.operators import backward, suffixes, transform
from glyphrake.operators.navigate import Runs, Transform, sorted_suffixes
from glyphrake.plans import index as index_module
from glyphrake.plans.index import PieceIndex, PieceIndexWithLocate, PlainIndex, PlainIndexWithLocate, RunIndex, RunIndexWithLocate
from glyphrake.plans.shards import ShardedIndex
from glyphrake.sources.corpus import from_buffer, from_table, validated

LOREM = (
    b"Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
    b"Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat."
    b"Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur."
    b"Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.\0"
)


def naive(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]


@pytest.fixture(scope="module")
def mississippi(spark):
    return RunIndexWithLocate(from_buffer(spark, b"mississippi\0"), 1)


def test_suffixes_and_transform(mississippi):
    rows = mississippi.table.orderBy("sa_row").collect()
    assert [r.pos for r in rows] == [11, 10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2]
    assert bytes(r.l for r in rows) == b"ipssm\0pissii"
    runs = mississippi.runs.orderBy("run").collect()
    assert bytes(r["head"] for r in runs) == b"ipsm\0pisi"
    bits = lambda by_head: "".join(str(r.bit) for r in transform.run_bits(mississippi.runs, by_head).orderBy("sa_row").collect())
    assert (bits(False), bits(True)) == ("111011111010", "111101111010")
    assert {chr(r.c): r.c0 for r in transform.run_counts(mississippi.runs).collect()} == {"\0": 0, "i": 1, "m": 4, "p": 5, "s": 7}


def test_steps(mississippi):
    back = {r.sa_row: r.next_row for r in mississippi.back.collect()}
    seen = [0]
    while back[seen[-1]]:
        seen.append(back[seen[-1]])
    assert seen[1:] + [0] == [1, 6, 7, 2, 8, 10, 3, 9, 11, 4, 5, 0]
    forward = transform.step_forward(mississippi.table, mississippi.n)
    assert [r.next_row for r in forward.orderBy("sa_row").collect()] == [5, 0, 7, 10, 11, 4, 1, 6, 2, 3, 8, 9]


def test_intervals_and_refining(mississippi):
    want = {"iss": (3, 5), "ppi": (7, 8), "si": (8, 10), "ssi": (10, 12)}
    assert {p: mississippi.search(p).interval for p in want} == want
    assert mississippi.search("si").search("s").interval == want["ssi"]
    assert mississippi.search("").count() == 12
    assert mississippi.search("xyz").count() == 0
    assert [r.pos for r in mississippi.search("si").matches().collect()] == [6, 3]
    assert len(mississippi) == 12 and mississippi.stored_bytes() > 0


def test_lorem(spark):
    search = PlainIndexWithLocate(from_buffer(spark, LOREM), 2).search("dolor")
    assert search.count() == 4
    assert [r.pos for r in search.matches().collect()] == [246, 12, 300, 103]
    assert bytes(search.backward(16).first().symbols)[::-1] == b"Duis aute irure "
    assert bytes(search.forward(20).collect()[3].symbols) == b"dolore magna aliqua."


def test_pieces(spark):
    bodies = [b"Twinkle star\nstar dark\n", b"", b"little star\n", b"star"]
    index = PieceIndexWithLocate(from_buffer(spark, b"".join(b + b"\0" for b in bodies)), 2)
    ids = lambda search: sorted(r.piece_id for r in search.matches().collect())
    assert ids(index.search("star")) == [0, 0, 2, 3]
    assert ids(index.search_prefix("star")) == [3] and index.search_prefix("star").count() == 4
    assert ids(index.search_suffix("star")) == [3]
    assert ids(index.search_suffix("\n")) == [0, 2]
    assert ids(index.search_exact("star")) == [3] and ids(index.search_exact("")) == [1]
    assert index.search_suffix("").count() == 4
    # going back crosses into the piece before; going on stops at the end
    first = index.search_prefix("star")
    assert bytes(first.backward(3).first().symbols) == b"\0\nr"
    assert bytes(first.forward(9).first().symbols) == b"star"
    with pytest.raises(InvalidPatternError):
        index.search("a\0b")


def test_kinds_differ_in_what_they_offer(spark):
    corpus = from_buffer(spark, b"text\0")
    for kind, locates in ((PlainIndex, False), (RunIndex, False), (PieceIndex, False), (PlainIndexWithLocate, True), (RunIndexWithLocate, True), (PieceIndexWithLocate, True)):
        index = kind(corpus)
        assert len(index) == 5 and index.stored_bytes() > 0
        assert ("pos" in index.search("t").matches().columns) == locates
        assert hasattr(index, "search_prefix") == kind.by_piece


def drawn_bodies(seed, alphabet=b"abc", most=30, pieces=12):
    drawn = random.Random(seed)
    bodies = [bytes(drawn.choice(alphabet) for _ in range(drawn.choice([0, 1, drawn.randint(0, most)]))) for _ in range(pieces)]
    bodies[0], bodies[-1] = bodies[0] or b"a", bodies[-1] or b"b"
    return drawn, bodies


def wanted(bodies, pattern, kind):
    """(piece, place) of all occurrences, or of those that begin, end or make up a piece."""
    fits = {"any": lambda b, i: True, "prefix": lambda b, i: i == 0, "suffix": lambda b, i: i + len(pattern) == len(b), "exact": lambda b, i: b == pattern}[kind]
    return sorted((p, i) for p, b in enumerate(bodies) for i in naive(b, pattern) if fits(b, i))


@pytest.fixture
def in_tables(monkeypatch):
    """Nothing counts as small enough for memory."""
    monkeypatch.setattr(suffixes, "LOCAL", 0)
    monkeypatch.setattr(index_module, "LOCAL", 0)


@pytest.mark.parametrize("seed", range(12))
def test_random_pieces_against_plain_search(spark, seed):
    drawn, bodies = drawn_bodies(seed, b"ab" if seed % 2 else b"abcd")
    text = b"".join(b + b"\0" for b in bodies)
    index = PieceIndexWithLocate(from_buffer(spark, text), drawn.randint(0, 3))
    begins = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
    assert [r.pos for r in index.table.orderBy("sa_row").collect()] == sorted(range(len(text)), key=lambda i: text[i:])
    searches = {"any": index.search, "prefix": index.search_prefix, "suffix": index.search_suffix, "exact": index.search_exact}
    for kind, search in searches.items():
        for pattern in (drawn.choice([b"a", b"ab", b"ba"]), bodies[drawn.randrange(12)][:3] or b"b"):
            got = search(pattern).matches().collect()
            assert sorted((r.piece_id, r.pos - begins[r.piece_id]) for r in got) == wanted(bodies, pattern, kind)


@pytest.mark.parametrize("seed", range(3))
def test_tables_answer_as_memory_does(spark, seed, in_tables):
    """Suffix order by rounds, steps by joins, positions by walking: all through tables."""
    drawn, bodies = drawn_bodies(seed)
    bodies[3] = bodies[5] = b"abc" * 20  # a long repeated passage takes several rounds
    text = b"".join(b + b"\0" for b in bodies)
    index = PieceIndexWithLocate(from_buffer(spark, text), seed)
    assert [r.pos for r in index.table.orderBy("sa_row").collect()] == sorted(range(len(text)), key=lambda i: text[i:])
    patterns = [b"a", b"abcabc", b"cab", b"zz", b""]
    rows = backward.pattern_rows(spark, patterns)
    got = {r.pattern_id: (r.s, r.e) for r in index.intervals(rows).collect()}
    counts = [len(naive(text, p)) for p in patterns[:-1]] + [len(text)]
    assert [got[i][1] - got[i][0] for i in range(5)] == counts
    found = index.positions(backward.rows_of(index.intervals(rows.where("pattern_id < 3")), index.table.select("sa_row")))
    assert sorted((r.pattern_id, r.pos) for r in found.collect()) == [(i, at) for i in range(3) for at in naive(text, patterns[i])]


def test_wide_symbols_in_tables(spark, in_tables):
    index = PlainIndexWithLocate(from_buffer(spark, [500, 1, 300, 500, 1, 500, 1, 0], max_symbol=500))
    assert sorted(r.pos for r in index.search([500, 1]).matches().collect()) == [0, 3, 5]


@pytest.mark.parametrize("seed", range(6))
def test_navigators_agree_with_the_text(seed):
    """Both kinds, texts of one and of many pieces: every step from every row."""
    _, bodies = drawn_bodies(seed, b"aab", 40, 1 + 5 * (seed % 2))
    text = np.frombuffer(b"".join(b + b"\0" for b in bodies), np.uint8).astype(np.int64)
    order, n = sorted_suffixes(text), len(text)
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    before = text[order - 1]
    starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    for own in (Transform(before, int(row[0])), Runs(before[starts], starts, n, int(row[0]))):
        rows = np.arange(n)
        assert (own.symbols[own.before(rows)] == before).all() and (own.symbols[own.first(rows)] == text[order]).all()
        assert (own.back(rows) == row[(order - 1) % n]).all() and (own.forward(rows) == row[(order + 1) % n]).all()
        for c in own.symbols:
            at = np.arange(n + 1)
            want = (text < c).sum() + np.concatenate(([0], np.cumsum(before == c)))
            assert (own.bucket(np.full(n + 1, own.code(np.array([c]))[0]), at) == want).all()
        for level in range(3):
            assert (own.positions(rows, order[:: 1 << level], level) == order).all()


@pytest.mark.parametrize("seed", range(4))
def test_shards_against_plain_search(spark, seed):
    drawn, bodies = drawn_bodies(seed, b"ab", 25, 40)
    rows = spark.createDataFrame([(7 * i, bytearray(b)) for i, b in enumerate(bodies)], "id long, body binary")
    index = ShardedIndex(from_table(rows, "id", "body"), level=seed, shard=60)
    assert index.table.count() >= 3 and index.stored_bytes() > 0
    patterns = [b"a", b"ab", b"bba", b"abab", bodies[0], b"x"]
    for kind in ("any", "prefix", "suffix", "exact"):
        got = index.locate(patterns, kind in ("prefix", "exact"), kind in ("suffix", "exact")).collect()
        assert sorted((r.pattern_id, r.piece_id // 7, r.piece_pos) for r in got) == sorted((i, *x) for i, p in enumerate(patterns) for x in wanted(bodies, p, kind))
    assert {r.pattern_id: r.n for r in index.count(patterns).collect()} == {i: len(w) for i, p in enumerate(patterns) if (w := wanted(bodies, p, "any"))}
    with pytest.raises(InvalidPatternError):
        index.count([b"a\0"])


def test_saved_shards_and_wide_symbols(spark, tmp_path):
    rows = spark.createDataFrame([(1, [700, 2, 700]), (2, []), (3, [2, 700])], "id long, body array<int>")
    ShardedIndex(from_table(rows, "id", "body", max_symbol=700), shard=4).save(str(tmp_path / "ix"))
    index = ShardedIndex.load(spark, str(tmp_path / "ix"))
    assert sorted(tuple(r) for r in index.locate([[700], [2, 700]]).collect()) == [(0, 1, 0), (0, 1, 2), (0, 3, 1), (1, 1, 1), (1, 3, 0)]


def test_running_sums_of_hot_groups(spark):
    """A group that holds most rows is split over partitions and summed up all the same."""
    drawn = random.Random(6)
    rows = [(0 if drawn.random() < 0.7 else drawn.randint(1, 5), i, drawn.randint(0, 9)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(8)
    want, held = [], {}
    for g, i, v in sorted(rows):
        want.append((g, i, held.get(g, 0)))
        held[g] = held.get(g, 0) + v
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_sum(df, ["i"], "v", "before", by="g")
        assert sorted((r.g, r.i, r.before) for r in got.collect()) == want
        assert got.inputFiles() and len(got.inputFiles()) > 1
        assert sorted((r.i, r.k) for r in numbered(df, ["i"], "k").collect()) == [(i, i) for i in range(3_000)]
        # runs and types that go on from partition to partition
        text = b"a" * 300 + b"b" * 500 + b"ab" * 20 + b"c" * 400 + b"\0"
        corpus = from_buffer(spark, text)
        index = RunIndex(corpus)
        bwt = [r.l for r in index.table.orderBy("sa_row").collect()]
        starts = [i for i in range(len(bwt)) if not i or bwt[i] != bwt[i - 1]]
        runs = index.runs.orderBy("run").collect()
        assert [(r.run, r["head"], r.start, r.len) for r in runs] == [(k, bwt[i], i, j - i) for k, (i, j) in enumerate(zip(starts, starts[1:] + [len(bwt)]))]
        kinds = ["S"] * len(text)
        for i in range(len(text) - 2, -1, -1):
            kinds[i] = "S" if text[i] < text[i + 1] or (text[i] == text[i + 1] and kinds[i + 1] == "S") else "L"
        assert [r.type for r in suffixes.suffix_types(corpus.symbols()).orderBy("pos").collect()] == kinds
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_saved_index(spark, tmp_path):
    PieceIndex(from_buffer(spark, b"abra\0cadabra\0")).save(str(tmp_path / "ix"))
    index = PieceIndexWithLocate.load(spark, str(tmp_path / "ix"), level=1)
    assert (index.level, index.corpus.max_symbol, index.pieces) == (1, 255, 2)
    assert sorted(r.pos for r in index.search("abra").matches().collect()) == [0, 8]
    with pytest.raises(InvalidTextError):
        PlainIndex.load(spark, str(tmp_path / "ix"))


def test_wide_symbols(spark):
    index = PlainIndexWithLocate(from_buffer(spark, [500, 1, 300, 500, 1, 0], max_symbol=500))
    assert sorted(r.pos for r in index.search([500, 1]).matches().collect()) == [0, 3]
    assert index.search([7]).count() == 0


@pytest.mark.parametrize("text", [b"unended", b"two\0ends\0\0", b"\0begins with one", b"q"])
def test_invalid_texts(spark, text):
    with pytest.raises(InvalidTextError, match="invalid text"):
        from_buffer(spark, text)


@pytest.mark.parametrize("kind, bodies, most, why", [("binary", [bytearray(b"ab"), bytearray(b"a\0b")], 255, "terminator"), ("string", ["ok", "a\0b"], 255, "terminator"), ("binary", [bytearray(b"\x05\x09")], 8, "above"), ("array<int>", [[1, 0, 2]], 9, "terminator"), ("array<int>", [[3, -1]], 9, "terminator"), ("array<int>", [[1, 10]], 9, "above"), ("array<int>", [[1, None]], 9, "terminator")])
def test_invalid_tables(spark, kind, bodies, most, why):
    """What can't be a symbol inside a table's bodies is an error for every kind of index."""
    corpus = from_table(spark.createDataFrame(list(enumerate(bodies)), f"id long, body {kind}"), "id", "body", max_symbol=most)
    for build in (PieceIndex, PieceIndexWithLocate, ShardedIndex, lambda c: c.checked()):
        with pytest.raises(InvalidTextError, match=why):
            build(corpus)


def test_other_texts(spark):
    validated(b"", 255)
    validated(b"\0", 255)
    with pytest.raises(InvalidTextError):
        from_buffer(spark, [9, 0], max_symbol=5)
    with pytest.raises(InvalidTextError):
        from_buffer(spark, b"a\0", max_symbol=0)
    with pytest.raises(InvalidTextError):
        PlainIndex(from_buffer(spark, b"a\0b\0"))
    assert from_buffer(spark, b"").length() == 0


@pytest.mark.parametrize("text", [b"ccaabbaabbaadd\0", b"m\0\0a\0", b"aaaaaaaaaaaaaab\0", b"bbbbbbbbbbbbbbb\0"])
def test_types(spark, text):
    kinds, n = ["S"] * len(text), len(text)
    for i in range(n - 2, -1, -1):
        kinds[i] = "S" if (text[i], kinds[i + 1]) < (text[i + 1], "L") and text[i] < text[i + 1] or (text[i] == text[i + 1] and kinds[i + 1] == "S") else "L"
    rows = suffixes.suffix_types(from_buffer(spark, text).symbols()).orderBy("pos").collect()
    assert [r.type for r in rows] == kinds
    assert [r.is_lms for r in rows] == [i > 0 and kinds[i] == "S" and kinds[i - 1] == "L" for i in range(n)]


@pytest.mark.parametrize("n, level, used", [(10, 1, 1), (8, 2, 2), (25, 3, 3), (10, 4, 0)])
def test_sampling(spark, n, level, used):
    rows = spark.range(n).selectExpr("id as sa_row", "id as pos")
    assert suffixes.sample_level(n, level) == used
    assert sorted(r.sa_row for r in suffixes.sampled(rows, n, level).collect()) == list(range(0, n, 1 << used))


def test_null_rows_are_no_pieces(spark):
    corpus = from_table(spark.createDataFrame([(1, "ab"), (2, None), (None, "x"), (3, "")], "id long, t string"), "id", "t")
    assert sorted((r.piece_id, r.offset) for r in corpus.with_offsets().collect()) == [(1, 0), (3, 3)]
    corpus.checked()


def test_repeated_ids_are_pieces_of_their_own(spark):
    index = PieceIndexWithLocate(from_table(spark.createDataFrame([(1, "ab"), (1, "ab"), (1, "b"), (0, "a")], "id long, t string"), "id", "t"))
    assert (index.pieces, index.n) == (4, 10)
    assert sorted(r.piece_id for r in index.search("b").matches().collect()) == [1, 1, 1]
    assert [r.piece_id for r in index.search_exact("b").matches().collect()] == [1]


def test_what_is_written_on_the_way_is_removed(spark, in_tables, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_dir", lambda spark: f"file://{tmp_path}")
    index = PlainIndexWithLocate(from_buffer(spark, b"abracadabra abracadabra\0"))
    assert [x.name.rsplit("-", 1)[0] for x in (tmp_path / "glyphrake").iterdir()] == ["index-suffixes"]
    assert sorted(r.pos for r in index.search("abra").matches().collect()) == [0, 7, 12, 19]


def test_passing_keeps_what_is_kept(spark, tmp_path, monkeypatch):
    """An inner block's table stays, so does another thread's; a block that fails leaves nothing."""
    from threading import Thread

    monkeypatch.setattr(session, "scratch_dir", lambda spark: f"file://{tmp_path}")
    rows, others = spark.range(3), []
    with session.passing(spark) as keep:
        session.checkpoint(rows, "way")
        with session.passing(spark) as inner:
            session.checkpoint(rows, "inner-way")
            kept_inside = inner(rows, "inner-kept")
        kept = keep(rows, "kept")
        thread = Thread(target=lambda: others.append(session.checkpoint(rows, "thread")))
        thread.start()
        thread.join()
    left = lambda: sorted(x.name.rsplit("-", 1)[0] for x in (tmp_path / "glyphrake").iterdir())
    assert left() == ["inner-kept", "kept", "thread"]
    assert kept.count() == kept_inside.count() == others[0].count() == 3
    with pytest.raises(ValueError):
        with session.passing(spark) as keep:
            session.checkpoint(rows, "way")
            raise ValueError
    assert left() == ["inner-kept", "kept", "thread"]


def test_pieces_and_their_ends_do_not_ask_for_the_suffix_order(spark, monkeypatch):
    """piece_bits and wavelet_documents read pieces and symbols: they built a suffix table before that they never read."""
    from glyphrake import catalog
    from glyphrake.operators import suffixes

    monkeypatch.setattr(suffixes, "suffix_table", None)
    monkeypatch.setattr(catalog, "_INDEXES", {})
    monkeypatch.setattr(catalog, "_read", lambda spark, sf_dir, name: spark.createDataFrame([(7, "a b"), (3, ""), (5, "e")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in catalog.piece_bits(spark, "").collect()) == [(0, 0, 0, 1), (1, 2, 1, 1), (2, 6, 2, 1)]
    assert sorted(tuple(r) for r in catalog.wavelet_documents(spark, "").select("doc_id", "blanks", "symbol", "next_e").collect()) == [(5, 0, 101, 1), (7, 1, 98, None)]


def test_shards_are_written_and_read_a_few_at_a_time(spark):
    """Row groups end at their size, not after a hundred shards of any size."""
    import pyarrow.parquet as pq

    drawn = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, drawn.integers(1, 256, 1 << 20, np.uint8).tobytes()) for i in range(24)], "id long, body binary").coalesce(1)
    index = ShardedIndex(from_table(rows, "id", "body"), shard=1 << 20)
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.table.inputFiles()]
    assert sum(m.num_rows for m in sizes) >= 24
    assert max(m.row_group(i).total_byte_size for m in sizes for i in range(m.num_row_groups)) < 24 << 20


@pytest.mark.parametrize("by_run", [False, True])
def test_intervals_of_the_whole_text_from_shards(spark, by_run):
    """Rows below and up to a pattern add up over shards, also where a shard lacks a pattern or its symbols."""
    drawn, bodies = drawn_bodies(5, b"bd", 25, 40)
    bodies[2:4] = [b"bbbb", b"zdz"]
    index = ShardedIndex(from_table(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "id long, body binary"), "id", "body"), shard=60, by_run=by_run)
    text = b"".join(b + b"\0" for b in bodies)
    order = sorted(text[i:] for i in range(len(text)))
    patterns = [b"b", b"bd", b"dbb", b"a", b"c", b"bc", b"cb", b"z", b"zd", b"bz", b"\xff", bodies[0]]
    got = {r.pattern_id: (r.s, r.e) for r in index.intervals(patterns).collect()}
    assert index.table.count() >= 3
    for i, p in enumerate(patterns):
        below = sum(x < p for x in order)
        assert got[i] == (below, below + sum(x.startswith(p) for x in order))


def _without_suffix_order(spark, monkeypatch):
    from glyphrake import catalog
    from glyphrake.operators import suffixes

    monkeypatch.setattr(suffixes, "suffix_table", None)
    monkeypatch.setattr(catalog, "_INDEXES", {})
    monkeypatch.setattr(catalog, "_read", lambda spark, sf_dir, name: spark.createDataFrame([(7, "on the station"), (3, ""), (5, "banana né"), (None, "on"), (9, None)], "doc_id long, text string"))
    return catalog


def test_intervals_over_runs_of_documents_do_not_ask_for_the_suffix_order(spark, monkeypatch):
    """intervals_documents_runs ordered all suffixes of the corpus by one sort before."""
    got = _without_suffix_order(spark, monkeypatch).intervals_documents_runs(spark, "").collect()
    text = "\0banana né\0on the station\0".encode()
    below = {p: sum(text[i:] < p.encode() for i in range(len(text))) for p in ("on", "the", "anan", "é")}
    assert {tuple(r) for r in got} == {("on", 2, below["on"]), ("the", 1, below["the"]), ("anan", 1, below["anan"]), ("é", 1, below["é"]), ("zzqx", 0, None)}


def test_intervals_of_documents_do_not_ask_for_the_suffix_order(spark, monkeypatch):
    """intervals_documents wrote a row for each symbol of the corpus before."""
    got = _without_suffix_order(spark, monkeypatch).intervals_documents(spark, "").collect()
    text = "\0banana né\0on the station\0".encode()
    below = {p: sum(text[i:] < p.encode() for i in range(len(text))) for p in ("on", "the", "anan", "é")}
    assert {tuple(r) for r in got} == {("on", 2, below["on"]), ("the", 1, below["the"]), ("anan", 1, below["anan"]), ("é", 1, below["é"]), ("zzqx", 0, None)}


def test_places_in_documents_do_not_ask_for_the_suffix_order(spark, monkeypatch):
    """locate_documents joined rows of one suffix table before."""
    got = _without_suffix_order(spark, monkeypatch).locate_documents(spark, "").collect()
    assert sorted(tuple(r) for r in got) == [("anan", 5, 1), ("né", 5, 7), ("tion", 7, 10)]


def test_refining_in_documents_does_not_ask_for_the_suffix_order(spark, monkeypatch):
    """refine_documents searched the suffix table of the whole text before."""
    got = _without_suffix_order(spark, monkeypatch).refine_documents(spark, "").collect()
    assert sorted(tuple(r) for r in got) == [("anné", 0), ("ati", 1), ("e", 1), ("onti", 0), ("que", 0), ("the", 1), ("zzqxti", 0)]


def test_refined_counts_add_up_over_shards(spark):
    drawn, bodies = drawn_bodies(4, b"ab", 25, 40)
    index = ShardedIndex(from_table(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "id long, body binary"), "id", "body"), shard=60)
    searches, more = [b"a", b"ba", b"x"], [(0, b"b"), (1, b"a"), (0, b""), (2, b"a"), (1, b"xb"), (1, b"bb")]
    got = {r.pattern_id: r.n for r in index.refined(searches, more).collect()}
    assert got == {i: n for i, (s, m) in enumerate(more) if (n := sum(len(naive(b, m + searches[s])) for b in bodies))}
    with pytest.raises(InvalidPatternError):
        index.refined([b"\0"], [(0, b"a")])


def test_reading_on_in_documents_does_not_ask_for_the_suffix_order(spark, monkeypatch):
    """until_documents read from a row for each symbol of the corpus before."""
    catalog = _without_suffix_order(spark, monkeypatch)
    monkeypatch.setattr(catalog, "_read", lambda spark, sf_dir, name: spark.createDataFrame([(7, "x anan y. z"), (3, ""), (5, "banana né"), (8, "anan"), (6, "anan."), (None, "anan"), (9, None)], "doc_id long, text string"))
    assert sorted(tuple(r) for r in catalog.until_documents(spark, "").collect()) == [(5, 1, 9), (6, 0, 4), (7, 2, 6), (8, 0, 4)]


@pytest.mark.parametrize("most", [1, 1024])
@pytest.mark.parametrize("by_run", [False, True])
def test_reading_on_in_shards(spark, monkeypatch, by_run, most):
    """Until a stop or the piece's end, also at the ends of shards, and few matches at a time."""
    from glyphrake.plans import shards

    monkeypatch.setattr(shards, "READ", most)
    drawn, bodies = drawn_bodies(6, b"abc", 25, 40)
    index = ShardedIndex(from_table(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "id long, body binary"), "id", "body"), shard=60, by_run=by_run)
    patterns, stops = [b"a", b"cb", b"z"], [99, 120]
    got = sorted((r.pattern_id, r.piece_id, r.piece_pos, bytes(r.symbols)) for r in index.locate_until(patterns, stops).collect())
    assert got == sorted((i, k, at, b[at:].split(b"c")[0]) for i, p in enumerate(patterns) for k, b in enumerate(bodies) for at in naive(b, p))


def test_the_order_of_documents_is_digested_by_rounds(spark, monkeypatch):
    """suffix_order_documents wrote a row for each symbol and sorted them in one exchange before; empty and equal texts, and copies, too."""
    from glyphrake.operators import cuts

    rounds, one = [], cuts._digested_round
    monkeypatch.setattr(cuts, "_digested_round", lambda *a: rounds.append(1) or one(*a))
    monkeypatch.setattr(cuts.digested, "__defaults__", (*cuts.digested.__defaults__[:-1], 400))
    monkeypatch.setattr(suffixes.digest, "__defaults__", (*suffixes.digest.__defaults__[:-1], 100))
    drawn = random.Random(3)
    words = ["on", "the", "station", "né", "red", "widget", "banana", "quality", "a"]
    texts = [" ".join(drawn.choices(words, k=drawn.randint(0, 25))) for _ in range(40)] + ["", "the"]
    texts += texts[:6]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    index = PieceIndexWithLocate(from_table(rows, "id", "body"), most_in_memory=0, when_asked=True)
    got = {r.piece_id: (r.n, r.least, r.rows, r.weighted) for r in index.digest.collect()}
    assert "table" not in index.__dict__ and len(rounds) > 5
    bodies = [t.encode() + b"\0" for t in texts]
    text, owners = b"".join(bodies), [(k, i) for k, b in enumerate(bodies) for i in range(len(b))]
    row = {at: r for r, at in enumerate(sorted(range(len(text)), key=lambda i: text[i:]))}
    want = {k: [] for k in range(len(texts))}
    for at, (k, i) in enumerate(owners):
        want[k].append((row[at], i))
    assert got == {k: (len(x), min(r for r, _ in x), sum(r for r, _ in x), sum(r * i for r, i in x) % 1_000_000_007) for k, x in want.items()}


def test_shards_are_cut_where_pieces_are(spark, monkeypatch):
    """Bodies were exchanged twice before; only partitions far above a core's share are dealt again."""
    from glyphrake.plans import shards

    dealt, plans = shards._dealt, []
    monkeypatch.setattr(shards, "_dealt", lambda *a: plans.append(out := dealt(*a)) or out)
    rows = spark.createDataFrame([(i, "abc" * (i % 5)) for i in range(400)], "id long, body string")
    for corpus in (from_table(rows.repartition(2 * spark.sparkContext.defaultParallelism), "id", "body"), from_table(rows.coalesce(1), "id", "body")):
        index = ShardedIndex(corpus, shard=100)
        assert (index.n, index.pieces, index.table.agg({"n": "sum"}).first()[0]) == (2800, 400, 2800)
        assert index.table.agg({"n": "max"}).first()[0] <= 100 and index.table.select("shard").distinct().count() == index.table.count() >= 28
        assert {r.pattern_id: r.n for r in index.count(["ab", "ca"]).collect()} == {0: 800, 1: 480}
    exchanges = [x._jdf.queryExecution().sparkPlan().toString().count("Repartition") + x._jdf.queryExecution().sparkPlan().toString().count("Exchange") for x in plans]
    assert exchanges == [1, 1]


def test_places_over_runs_of_documents_do_not_ask_for_the_suffix_order(spark, monkeypatch):
    """locate_documents_runs walked all rows of one suffix order before."""
    got = _without_suffix_order(spark, monkeypatch).locate_documents_runs(spark, "").collect()
    assert sorted(tuple(r) for r in got) == [("anan", 5, 1), ("né", 5, 7), ("tion", 7, 10)]


def test_places_in_shards_of_runs(spark, tmp_path):
    """Shards of runs locate as those with a symbol for each row, also saved, and over wide symbols."""
    drawn, bodies = drawn_bodies(2, b"ab", 25, 40)
    rows = spark.createDataFrame([(7 * i, bytearray(b)) for i, b in enumerate(bodies)], "id long, body binary")
    ShardedIndex(from_table(rows, "id", "body"), level=2, shard=60, by_run=True).save(str(tmp_path / "ix"))
    index, patterns = ShardedIndex.load(spark, str(tmp_path / "ix")), [b"a", b"bba", bodies[0], b"x"]
    assert index.stored_bytes() > 0
    for kind in ("any", "exact"):
        got = index.locate(patterns, kind == "exact", kind == "exact").collect()
        assert sorted((r.pattern_id, r.piece_id // 7, r.piece_pos) for r in got) == sorted((i, *x) for i, p in enumerate(patterns) for x in wanted(bodies, p, kind))
    wide = spark.createDataFrame([(1, [700, 2, 700]), (2, []), (3, [2, 700])], "id long, body array<int>")
    index = ShardedIndex(from_table(wide, "id", "body", max_symbol=700), shard=4, by_run=True)
    assert sorted(tuple(r) for r in index.locate([[700], [2, 700]]).collect()) == [(0, 1, 0), (0, 1, 2), (0, 3, 1), (1, 1, 1), (1, 3, 0)]


def test_equal_pieces_of_one_id_share_out_their_places(spark):
    """Bodies are joined to places by id and hash: copies come once each, and not all to one shard."""
    rows = spark.createDataFrame([(1, "ab")] * 40 + [(0, "b"), (1, "b")], "id long, body string")
    index = ShardedIndex(from_table(rows, "id", "body"), shard=12)
    assert index.table.agg({"n": "sum"}).first()[0] == index.n == 124 and index.table.count() > 5
    assert {r.pattern_id: r.n for r in index.count(["a", "b"]).collect()} == {0: 40, 1: 42}
