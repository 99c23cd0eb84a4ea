"""The search against all label sequences, scripts, spans, and held-out accuracy."""

import os
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from glyphrake.llm import langid
from glyphrake.llm.common import in_slices, ship

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_against_all_sequences(seed):
    drawn = np.random.default_rng(seed)
    sizes, width = [5, 0, 1, 7], 3
    scores = drawn.normal(0, 4, (sum(sizes), width)).astype(np.float32)
    labels = langid.viterbi(scores, np.repeat(np.arange(4), sizes), 4, switch=3.0)
    value = lambda own, seq: sum(float(own[i, x]) for i, x in enumerate(seq)) - 3.0 * sum(a != b for a, b in zip(seq, seq[1:]))
    at = 0
    for n in sizes:
        own = scores[at : at + n]
        best = max((value(own, s) for s in product(range(width), repeat=n)), default=0)
        assert value(own, labels[at : at + n].tolist()) == pytest.approx(best, abs=1e-4)
        at += n


def test_scripts_and_spans(spark):
    ship(spark)
    rows = [(3 * i, t, lang) for i, (t, lang) in enumerate([("the house by the water was old", "en"), ("вода у старого дома была чистой", "ru"), ("das alte Haus am Wasser war schön", "de")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = langid.train(docs)
    model = trained[0]
    text = "the old house by the water 123 дом у старой воды the water was old"
    found = langid.identify(spark.createDataFrame([(1, text), (2, "漢字"), (3, "42!")], "doc_id long, text string"), trained, spans=True).orderBy("doc_id").collect()
    assert [(text[s.start : s.end], s.lang) for s in found[0].spans] == [("the old house by the water", "en"), ("дом у старой воды", "ru"), ("the water was old", "en")]
    assert found[0].lang_pred == "en" and 0.5 < found[0].score < 1
    assert found[1].lang_pred in model.languages and found[1].score > 0
    assert (found[2].lang_pred, found[2].score, found[2].spans) == ("und", 0.0, [])


def test_held_out_accuracy(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    rows = langid.op10_language_spans(spark, TABLES).where("held_out").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang").collect()}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97


def test_a_long_unbroken_word_counts(spark):
    """200,000 letters in one word, seen and unseen, alone and beside others."""
    ship(spark)
    rows = [(3 * i, t, lang) for i, (t, lang) in enumerate([("the house by the water was old", "en"), ("вода у старого дома была чистой", "ru"), ("das alte Haus am Wasser war schön", "de")] * 40)]
    trained = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = trained[0]
    texts = ["qxzjk" * 40_000, "водаустарогодома" * 12_500, "漢字假名" * 50_000, "das Haus " + "водаустарогодома" * 12_500]
    found = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trained, spans=True).orderBy("doc_id").collect()
    assert [r.lang_pred in model.languages for r in found] == [True] * 4 and [r.lang_pred for r in found[1::2]] == ["ru", "ru"]
    assert [r.score for r in found[:3]] == [1.0] * 3
    assert [[(s.start, s.end) for s in r.spans] for r in found] == [[(0, 200_000)]] * 3 + [[(0, 8), (9, 200_009)]]
    assert found[3].spans[0].lang == "de"


ROWS = [(3 * i, t, lang) for i, (t, lang) in enumerate([("The house by the water was old", "en"), ("вода у старого дома была чистой", "ru"), ("das alte Haus am Wasser war schön", "de"), ("水辺の家は古い 漢字 假名", "ja"), ("42 ...", "xx")] * 30)]


def test_word_scores_against_dictionaries(spark):
    """Trigrams of real letters, counted in plain dictionaries."""
    import math
    import re

    ship(spark)
    model, _ = langid.train(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "ja", "ru"] and model.complete
    counts = {lang: {} for lang in model.languages}

    def grams(word):
        padded = f"\0{word.lower()}\0"
        return [padded[i : i + 3] for i in range(len(word))]

    import zlib

    for doc_id, text, lang in ROWS:
        if zlib.crc32(str(doc_id).encode()) % 3 != 1:
            for word in re.findall(r"[^\W\d_]+", text):
                for g in grams(word):
                    counts.get(lang, {})[g] = counts.get(lang, {}).get(g, 0) + 1
    kinds = len({g for own in counts.values() for g in own})
    words = langid.Words(["house Wasser вода zebra 漢字"])
    got = model.score(words)
    for i, word in enumerate(["house", "Wasser", "вода", "zebra", "漢字"]):
        want = [sum(math.log((counts[x].get(g, 0) + langid.SMOOTH) / (sum(counts[x].values()) + langid.SMOOTH * (kinds + 1))) for g in grams(word)) for x in model.languages]
        fits = np.isfinite(got[i])
        want = np.array(want) - max(w for w, f in zip(want, fits) if f)
        assert fits.any() and np.allclose(got[i][fits], want[fits], atol=1e-3)


@pytest.mark.parametrize("entries", [4, 60, 200])
def test_rarer_trigrams_come_by_a_join(spark, entries, monkeypatch):
    """With few trigrams sent to the tasks, all results are the same."""
    ship(spark)
    docs = spark.createDataFrame([*ROWS, (1_000, "the house das Haus вода 漢字", None), (1_001, None, None), (1_002, "zzz the house das Haus вода 漢字", None), (1_002, "zzz the house das Haus вода 漢字", None)], "doc_id long, text string, lang string")
    want = sorted(map(tuple, langid.identify(docs, langid.train(docs), spans=True).collect()), key=repr)
    monkeypatch.setattr(langid, "ENTRIES", entries)
    trained = langid.train(docs)
    assert not trained[0].complete
    assert sorted(map(tuple, langid.identify(docs, trained, spans=True).collect()), key=repr) == want


def test_grams_are_handed_on_before_they_are_too_many():
    """Counts in several parts are those of one: a task holds a bounded number of grams, of all languages together."""
    rows = [(("en", "ru", "de")[i % 3], " ".join(chr((97, 1072, 97)[i % 3] + (i * k) % 26) * 2 + chr(97 + k % 7) for k in range(30))) for i in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows[i : i + 20])], names=["lang", "text"]) for i in range(0, len(rows), 20)]

    def added(found):
        out = Counter()
        for b in found:
            for lang, key, n in zip(*(c.to_pylist() for c in b.columns)):
                out[lang, key] += n
        return +out

    whole, parts = list(langid.counted(iter(batches))), list(langid.counted(iter(batches), most=100))
    assert len(parts) > len(whole) == 3 and added(parts) == added(whole) and len(added(whole)) > 500


def test_batches_of_grams_are_small():
    batch = pa.RecordBatch.from_arrays([pa.array(range(25))], names=["key"])
    assert [b.num_rows for b in in_slices(batch, 10)] == [10, 10, 5]
