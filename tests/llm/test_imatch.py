"""Fingerprints against a plain reading of the method, and the order of documents."""

import hashlib
import random
from collections import Counter

import pytest

from glyphrake.llm import imatch
from glyphrake.llm.common import ship

SYLLABLES = "ka lo mi ren sut vo pel dar tin gos".split()


@pytest.fixture(scope="module")
def texts():
    drawn = random.Random(3)
    vocabulary = ["".join(drawn.choices(SYLLABLES, k=drawn.randint(1, 3))) for _ in range(900)]
    out = {7 * i - 50: " ".join(drawn.choices(vocabulary, k=drawn.randint(30, 300))) for i in range(240)}
    out[5_000] = out[-50]
    return out


@pytest.fixture(scope="module")
def rows(spark, texts):
    ship(spark)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    old, imatch.RANGE = imatch.RANGE, 20
    try:
        return {r.doc_id: r for r in imatch.edited_fingerprints(docs, imatch.lexicon(docs)).collect()}
    finally:
        imatch.RANGE = old


def test_lexicon_is_the_band(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    df = Counter(w for t in texts.values() for w in set(t.split()))
    n = len(texts)
    want = {imatch._term_hash(w) for w, c in df.items() if max(2, 0.02 * n) <= c <= 0.3 * n}
    assert set(imatch.lexicon(docs, 0.02, 0.3).sent.tolist()) == want


def test_edited_texts_and_neighbours(rows, texts):
    order = sorted(texts, reverse=True)
    for i, doc_id in enumerate(order):
        text, following = texts[doc_id], order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[following][:half]
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == imatch.likeness(r.fingerprint, rows[following].fingerprint)
        assert r.near_edited == imatch.likeness(r.fingerprint, r.edited_fingerprint)


def test_equal_texts_and_edits(rows):
    assert rows[5_000].fingerprint == rows[-50].fingerprint
    own = [r for r in rows.values()]
    assert sum(r.near_edited > r.near_next for r in own) > 0.9 * len(own)


def test_likeness():
    a = "f" * 16 + "0001" * 2 + "0000" * 2
    assert imatch.likeness(a, a) == 1
    assert imatch.likeness(a, "e" * 16 + "0001" + "0002" + "0000" * 2) == 0.5
    assert imatch.likeness(a, "e" * 16 + "0000" * 4) == 0


def plain_fingerprint(text, lexicon):
    """The method in plain numbers: sorted distinct terms of the lexicon, hashed whole and by subset."""
    import re

    import xxhash

    def mix(x):
        x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 % 2**64
        x = (x ^ (x >> 27)) * 0x81DADEF4BC2DD44D % 2**64
        return x ^ (x >> 33)

    terms = set(re.findall(r"\w+", text.lower()))
    own = sorted(xxhash.xxh64_intdigest(t.encode()) for t in (terms & lexicon or terms))
    if not own:
        return "0" * (16 + 4 * imatch.SUBSETS)
    digest = lambda hashes: xxhash.xxh64_intdigest(b"".join(h.to_bytes(8, "little") for h in hashes))
    out = [f"{digest(own):016x}"]
    for k in range(imatch.SUBSETS):
        drawn = [h for h in own if mix(h ^ ((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) < int(imatch.SHARES[k % len(imatch.SHARES)] * 2**64)]
        out.append(f"{digest(drawn) % 65_535 + 1:04x}" if drawn else "0000")
    return "".join(out)


def test_fingerprints_against_a_plain_version(rows, texts):
    df = Counter(w for t in texts.values() for w in set(t.split()))
    n = len(texts)
    lexicon = {w for w, c in df.items() if max(2, imatch.LEAST_SHARE * n) <= c <= max(2, imatch.MOST_SHARE * n)}
    order = sorted(texts, reverse=True)
    for i, doc_id in enumerate(order):
        text, following = texts[doc_id], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        assert rows[doc_id].fingerprint == plain_fingerprint(text, lexicon)
        assert rows[doc_id].edited_fingerprint == plain_fingerprint(text[: len(text) - half] + following[:half], lexicon)


@pytest.mark.parametrize("most", [0, 60])
def test_terms_that_are_not_sent_are_joined(spark, monkeypatch, most):
    """Whatever part of the lexicon is sent, fingerprints and likenesses are the same; without ids, too."""
    monkeypatch.setattr(imatch, "RANGE", 20)
    drawn = random.Random(8)
    texts = {7 * i - 50: " ".join(f"w{int(drawn.paretovariate(0.6))}" for _ in range(drawn.randint(5, 80))) for i in range(150)}
    texts[900] = texts[-50]
    docs = spark.createDataFrame([*texts.items(), (None, texts[-50]), (None, texts[-43]), (None, None)], "doc_id long, text string").repartition(4)
    columns = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    read = lambda words: sorted((tuple([r.doc_id, *(r[c] for c in columns)]) for r in imatch.edited_fingerprints(docs, words).collect()), key=repr)
    whole = imatch.lexicon(docs)
    monkeypatch.setattr(imatch, "MOST_TERMS", most)
    some = imatch.lexicon(docs)
    assert whole.rest is None and len(whole.sent) > 100 and len(some.sent) <= most and len(some.sent) + some.rest.count() == len(whole.sent)
    assert read(some) == read(whole)
