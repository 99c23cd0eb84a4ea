"""Removed words against brute force over all windows."""

import hashlib
import random

import pytest

from glyphrake.llm import substrings
from glyphrake.llm.common import ship


def brute(docs, window):
    first = {}
    words = {i: t.split() for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [w for k, w in enumerate(own) if k not in gone]
        out[i] = (len(own), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    """Passages shared by many, copies with edits, and words that repeat within a document."""
    ship(spark)
    drawn = random.Random(seed)
    word = lambda: drawn.choice("abcdefgh") * drawn.randint(1, 2)
    passages = [[word() for _ in range(drawn.randint(8, 40))] for _ in range(6)] + [["x"] * 30]
    docs, last = [], ["seed"]
    for i in range(60):
        own = []
        for _ in range(drawn.randint(0, 5)):
            own += drawn.choice(passages) if drawn.random() < 0.6 else [word() for _ in range(drawn.randint(1, 15))]
        if drawn.random() < 0.3:
            own = list(last)
            own[drawn.randrange(len(own))] = "edit"
        last = own or ["seed"]
        docs.append((i * 3, "  ".join(own)))
    drawn.shuffle(docs)
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=10, seed_words=4).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(docs, 10)
    for r in got:
        assert hashlib.sha256(" ".join(r.text_kept.split()).encode()).hexdigest() == r.kept_sha256


def test_blanks_stay(spark):
    shared = " ".join(f"w{i}" for i in range(12))
    rows = substrings.remove_repeats(spark.createDataFrame([(1, shared), (2, f"Before\n\t{shared}  after \n")], "doc_id long, text string"), window=10, seed_words=4)
    assert {r.doc_id: r.text_kept for r in rows.collect()} == {1: shared, 2: "Before\n\tafter \n"}
