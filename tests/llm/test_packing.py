"""Token ids against the tokenizer, packing against its histogram, pieces against their documents."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from glyphrake.llm import packing
from glyphrake.llm.common import ship

TABLE = "/root/testdata/sf0.001/documents.parquet"
BITS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "1", "99", ".", "!!", "é", "ß", "日本", "\r\n", "\xa0", "\x0b", "\x1c", "\x85", "\u2003", "\u200b", "\u3000", "-", "I'll", "<|endoftext|>", "🙂"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_files()[0])


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_same_ids_on_odd_texts(tokenizer):
    drawn, encoder = random.Random(1), packing.encoder(packing.tokenizer_files())
    for _ in range(3_000):
        text = "".join(drawn.choice(BITS) for _ in range(drawn.randint(0, 14)))
        assert encoder.encode(text) == ids_of(tokenizer, text), text


def test_same_ids_on_documents(tokenizer):
    if not os.path.exists(TABLE):
        pytest.skip("no tables")
    encoder = packing.encoder(packing.tokenizer_files())
    for text in pq.read_table(TABLE)["text"].to_pylist():
        assert encoder.encode(text) == ids_of(tokenizer, text)


@pytest.mark.parametrize("seed", range(20))
def test_patterns_hold_the_histogram(seed):
    drawn = random.Random(seed)
    histogram = {drawn.randint(1, 63): drawn.randint(1, 500) for _ in range(drawn.randint(1, 40))}
    patterns = packing.shortest_pack_first(histogram, 64)
    assert all(sum(p) <= 64 and count > 0 for p, count in patterns)
    assert {n: sum(p.count(n) * count for p, count in patterns) for n in histogram} == histogram


def one_at_a_time(histogram, capacity):
    """Each piece into the pack with the most room, the latest of those; packs that a length starts wait for the next length."""
    packs = []  # (room, when it came to that room, lengths)
    clock = 0
    for length in sorted(histogram, reverse=True):
        started = []
        for _ in range(histogram[length]):
            clock += 1
            best = max(packs, default=None)
            if best is None or best[0] < length:
                started.append((capacity - length, clock, (length,)))
            else:
                packs.remove(best)
                packs.append((best[0] - length, clock, (*best[2], length)))
        packs += started
    return Counter(p for _, _, p in packs)


@pytest.mark.parametrize("seed", range(12))
def test_patterns_against_one_piece_at_a_time(seed):
    drawn = random.Random(seed)
    histogram = {drawn.randint(1, 63): drawn.randint(1, 30) for _ in range(drawn.randint(1, 25))}
    got = Counter()
    for pattern, count in packing.shortest_pack_first(histogram, 64):
        got[pattern] += count
    assert got == one_at_a_time(histogram, 64)


def test_the_shortest_pack_comes_first():
    assert sorted(packing.shortest_pack_first({900: 1, 600: 1, 100: 1}, 1_024)) == [((600, 100), 1), ((900,), 1)]


def test_places_of_all_sequences(spark):
    ship(spark)
    patterns = [((9, 5, 2), 3), ((8, 8), 2), ((16,), 1)]
    rows = packing.laid_out(spark, patterns).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.packed, []).append((r.slot_offset, r.slot_length, r.moment))
    assert [tuple(x[1] for x in sorted(by_sequence[i])) for i in range(6)] == [(9, 5, 2)] * 3 + [(8, 8)] * 2 + [(16,)]
    assert all(sum(x[1] for x in sorted(own)[:k]) == own_at for own in by_sequence.values() for k, (own_at, _, _) in enumerate(sorted(own)))
    assert [by_sequence[i][0][2] / packing.MOMENTS for i in range(6)] == pytest.approx([1 / 6, 1 / 2, 5 / 6, 1 / 4, 3 / 4, 1 / 2])
    assert packing.laid_out(spark, []).count() == 0


def test_sequences_follow_the_documents(spark, tmp_path):
    """Read from files in order: early documents are in early sequences, whatever their lengths."""
    ship(spark)
    drawn = random.Random(3)
    docs = [(i, " ".join(drawn.choice(["alpha", "beta", "gamma"]) for _ in range(drawn.choice([1, 30, 200, 200, 700, 2_000])))) for i in range(1_500)]
    drawn_ids = list(range(1_500))
    drawn.shuffle(drawn_ids)
    spark.createDataFrame([(drawn_ids[i], t, i) for i, t in docs], "doc_id long, text string, nth long").repartitionByRange(5, "nth").sortWithinPartitions("nth").write.parquet(str(tmp_path / "d"))
    rows = packing.pack_documents(spark.read.parquet(str(tmp_path / "d")), in_order=True).collect()
    where = {d: i for i, d in enumerate(drawn_ids)}
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.position, r.start)) if r.start == 0] == drawn_ids
    last = max(r.sequence_id for r in rows)
    assert sorted({r.sequence_id for r in rows}) == list(range(last + 1))
    off = [abs(where[r.doc_id] / 1_500 - r.sequence_id / last) for r in rows]
    assert sum(off) / len(off) < 0.03 and max(off) < 0.2


def test_a_text_of_over_a_million_characters(spark, tokenizer):
    text = "alpha beta " * 100_000
    assert len(text) >= packing.LONG_TEXT and packing.encoder(packing.tokenizer_files()).encode(text) == ids_of(tokenizer, text)


def test_little_padding():
    drawn = random.Random(0)
    histogram = {n: drawn.randint(1, 60) for n in range(1, 1_024)}
    patterns = packing.shortest_pack_first(histogram, 1_024)
    assert sum(n * c for n, c in histogram.items()) / (1_024 * sum(c for _, c in patterns)) > 0.98


def test_pieces_join_to_their_documents(spark, tokenizer):
    ship(spark)
    drawn = random.Random(2)
    docs = {i: " ".join(drawn.choice(["alpha", "beta", "gamma", "δέλτα"]) for _ in range(drawn.choice([0, 1, 50, 3_000]))) for i in range(60)}
    rows = packing.pack_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    by_doc, filled = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert set(by_doc) == set(docs) and max(filled.values()) <= 1_024
    for doc_id, pieces in by_doc.items():
        ids = ids_of(tokenizer, docs[doc_id]) + bytes(4)
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids) // 4)
            assert zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert at == len(ids) // 4
