"""Symbols beyond 63 bits, and texts made by rule as tables."""

import random
from collections import Counter
from decimal import Decimal

from glyphrake.operators import scan
from glyphrake.plans.index import PieceIndexWithLocate
from glyphrake.sources.dictionary import Dictionary
from glyphrake.sources.generators import generated_pieces


def test_unsigned_symbols_of_64_bits(spark):
    drawn = random.Random(2)
    alphabet = [1, 5, 2**63, 2**63 + 1, 2**64 - 1]
    bodies = {i: [drawn.choice(alphabet) for _ in range(drawn.randint(0, 25))] for i in range(8)}
    rows = spark.createDataFrame([(i, [Decimal(x) for x in b]) for i, b in bodies.items()] + [(None, []), (99, None)], "id long, body array<decimal(20,0)>")
    dictionary = Dictionary.of(rows, "body")
    assert [(int(r.symbol), r.code) for r in dictionary.codes.orderBy("code").collect()] == [(x, k) for k, x in enumerate(alphabet, 1)]
    corpus = dictionary.corpus(rows, "id", "body")
    index = PieceIndexWithLocate(corpus, 1, most_in_memory=0)
    # the order is that of the symbols themselves
    text = [x for i in sorted(bodies) for x in [*bodies[i], 0]]
    assert [r.pos for r in index.table.orderBy("sa_row").collect()] == sorted(range(len(text)), key=lambda i: text[i:])
    wanted = [[2**64 - 1], [2**63, 1], [5, 2**63 + 1], [7], [1, 2**63 + 2]]
    patterns = spark.createDataFrame([(i, [Decimal(x) for x in p]) for i, p in enumerate(wanted)], "pattern_id long, symbols array<decimal(20,0)>")
    got = {r.pattern_id: r.e - r.s for r in index.intervals(dictionary.patterns(patterns)).collect()}
    assert got == {i: sum(b[k : k + len(p)] == p for b in bodies.values() for k in range(len(b))) for i, p in enumerate(wanted)}


def test_generated_pieces(spark):
    """The same whatever the partitions, lengths within bounds, shares about as asked."""
    made = generated_pieces(spark, 300, 0, 90, {48: 0.2, 49: 0.7, 0x80: 0.1}, seed=3)
    rows = {r.piece_id: bytes(r.body) for r in made.collect()}
    assert rows == {r.piece_id: bytes(r.body) for r in generated_pieces(spark, 300, 0, 90, {48: 0.2, 49: 0.7, 0x80: 0.1}, seed=3).repartition(7).collect()}
    assert rows != {r.piece_id: bytes(r.body) for r in generated_pieces(spark, 300, 0, 90, {48: 0.2, 49: 0.7, 0x80: 0.1}, seed=4).collect()}
    sizes, counts = Counter(map(len, rows.values())), Counter(b"".join(rows.values()))
    assert min(sizes) >= 0 and max(sizes) <= 90 and len(sizes) > 60
    total = sum(counts.values())
    assert set(counts) == {48, 49, 0x80} and all(abs(counts[c] / total - s) < 0.02 for c, s in ((48, 0.2), (49, 0.7), (0x80, 0.1)))


def test_short_patterns_in_blocks(spark, monkeypatch):
    """Patterns too short for anchors, a few at a time: the same occurrences as all at once."""
    bodies = [(i, bytearray(f"abc abd {i} xyz".encode())) for i in range(20)]
    pieces = spark.createDataFrame(bodies, "piece_id long, body binary")
    patterns = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate([b"ab", b"abd", b"xyz", b"1", b"q", b"ab"])], "pattern_id long, body binary")
    read = lambda: sorted(tuple(r) for r in scan.locate_table(pieces, patterns).collect())
    whole = read()
    monkeypatch.setattr(scan, "BATCH_BYTES", 30)
    assert read() == whole and len(whole) == 20 * 2 * 2 + 20 + 20 + sum(str(i).count("1") for i in range(20))
