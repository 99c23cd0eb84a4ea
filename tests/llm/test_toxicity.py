"""Restoring hidden words, and held-out accuracy of the classifier."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphrake.llm import toxicity
from glyphrake.llm.common import ship

CALM = "the river runs slowly past old houses and people walk along with dogs while children play near water every summer evening".split()
RUDE = ["blockhead", "nitwit", "dimbulb", "numskull", "rotter"]


def hidden(word, drawn):
    kind = drawn.randrange(4)
    if kind == 0:
        return word.translate(str.maketrans("oiest", "01357"))
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return ".".join(word)
    i = drawn.randrange(len(word))
    return word[:i] + word[i] * 4 + word[i + 1 :]


@pytest.fixture(scope="module")
def corpus(spark):
    ship(spark)
    drawn, docs, labels = random.Random(5), [], []
    for i in range(900):
        words = [drawn.choice(CALM) + drawn.choice(["", "", "", "ed", "ly"]) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                word = drawn.choice(RUDE)
                words.insert(drawn.randrange(len(words)), word if i % 2 else hidden(word, drawn))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


@pytest.fixture(scope="module")
def model(corpus):
    return toxicity.character_model(corpus[0])


@pytest.mark.parametrize("seen, meant", [("n1tw1t", "nitwit"), ("n i t w i t", "nitwit"), ("n.i.t.w.i.t", "nitwit"), ("nitttttwit", "nitwit"), ("bl0ckh3ad", "blockhead"), ("r0tt3r", "rotter"), ("river", "river")])
def test_restore(model, seen, meant):
    assert toxicity.restore(seen, model) == meant


def test_search_finds_the_cheapest_path(model):
    """Against all paths of a short token."""
    from itertools import product

    def cost(text):
        a = b = 0
        total = 0.0
        for c in [*text, None]:
            s = toxicity._letter(c) if c else 0
            total += model.cost(a, b, s)
            a, b = b, s
        return total

    options = {"n": [("n", 0)], "1": [("i", toxicity.COST_LOOKALIKE), ("l", toxicity.COST_LOOKALIKE), ("", toxicity.COST_DROPPED), ("1", toxicity.COST_KEPT)], "-": [("", toxicity.COST_STRAY), ("-", toxicity.COST_KEPT)], "t": [("t", 0)], "w": [("w", 0)]}
    token = "n1-tw1t"
    best = min(("".join(x[0] for x in path) for path in product(*(options[c] for c in token))), key=lambda w: min(cost(w) + sum(x[1] for x in path) for path in product(*(options[c] for c in token)) if "".join(x[0] for x in path) == w))
    assert toxicity.restore(token, model) == best


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    rows = toxicity.toxicity(docs, labels).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([p == t for p, t in held]) > 0.97
    assert {r.doc_id for r in rows} == set(truth)


def test_keep_clean_keeps_clean(corpus):
    docs, labels, truth = corpus
    kept = [truth[r.doc_id] for r in toxicity.keep_clean(docs, labels).collect()]
    assert kept.count(0) >= 590 and kept.count(1) <= 20


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels, _ = corpus
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("seen", ["nitwi7", "n1tw17", "nniittwwiitt", "NNitwit!", "nit wit", "n\ti\nt w  i\u00a0t", "ni tw it", "n1 tw 1t"])
def test_hidden_forms_come_to_the_word(model, seen):
    reader = toxicity.Reader(model)
    assert "nitwit" in {w for token in reader.tokens(f"children {seen} children") for w in reader.words(token)}


def test_final_doubled_and_split_forms_are_found(spark, corpus):
    forms = [lambda w: w[:2] + w[2:].translate(str.maketrans("tse", "753")), lambda w: "".join(c * 2 for c in w), lambda w: w[:3] + " \t" + w[3:6] + "\n" + w[6:], lambda w: "  ".join(w[k : k + 2] for k in range(0, len(w), 2))]
    rows = [(i, " ".join([*CALM[:9], f(w), *CALM[9:], f(v), *CALM[:5]])) for i, (f, w, v) in enumerate((f, w, v) for f in forms for w in RUDE for v in RUDE)]
    rows += [(1000 + i, " ".join(CALM[i:] + CALM[:i])) for i in range(len(CALM))]
    model, classifier = toxicity.learn(*corpus[:2])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(docs, model, classifier).collect()}
    assert sum(found[i] for i in range(100)) >= 95 and not any(found[i] for i in found if i >= 1000)


def test_outlines_lose_no_feature(corpus):
    model, classifier = toxicity.learn(*corpus[:2])
    wanted = frozenset(classifier.weights)
    plain, narrowed = toxicity.Reader(model, wanted), toxicity.Reader(model, wanted, classifier.outlines)
    for seen in [f(w) for w in RUDE for f in (lambda w: "".join(c * 2 for c in w), lambda w: w[:2] + " " + w[2:4] + " " + w[4:], lambda w: "go " + w[:3] + " " + w[3:6] + " " + w[6:])] + CALM:
        assert plain.read(seen) == narrowed.read(seen)


def test_contradictory_labels(spark, corpus):
    """An id with both labels is toxic, in whatever order its labels come."""
    docs = corpus[0]
    rows = [(0, 0), (0, 1), (2, 1), (2, 0), (2, 0), (3, 0), (3, None)]
    for order in (rows, rows[::-1]):
        labels = spark.createDataFrame(order, "doc_id long, toxic int")
        got = {r.doc_id: r.toxic for r in toxicity.labelled_sample(docs, labels).collect()}
        assert got and all(t == (0 if i == 3 else 1) for i, t in got.items())


def test_costs_against_dictionaries(spark):
    """Letters of any alphabet keep apart; probabilities after a context sum to 1."""
    import math
    from collections import Counter

    ship(spark)
    texts = ["Abba éa, 漢字 漢a", "b ab", None, "привет ab"]
    model = toxicity.character_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    coded = [ord(c.lower()) if c.isalpha() else 0 for c in "\n\n".join(["", *(t or "" for t in texts), ""])]
    three = Counter(zip(coded, coded[1:], coded[2:]))
    left = lambda f: sum((Counter({f(g): n}) for g, n in three.items()), Counter())
    two, one, after_two, after_one = left(lambda g: g[1:]), left(lambda g: g[2]), left(lambda g: g[:2]), left(lambda g: g[1])
    total, kinds = sum(three.values()), len(one) + 1
    for g in [*three, (ord("a"), ord("b"), ord("é")), (5, 6, 7)]:
        p1 = (one[g[2]] + 1) / (total + kinds)
        p2 = (two[g[1:]] + 20 * p1) / (after_one[g[1]] + 20)
        assert model.cost(*g) == pytest.approx(-math.log((three[g] + 20 * p2) / (after_two[g[:2]] + 20)))
    assert sum(math.exp(-model.cost(ord("a"), ord("b"), c)) for c in one) + math.exp(-model.cost(ord("a"), ord("b"), 5)) == pytest.approx(1)


@pytest.mark.parametrize("most", [0, 100])
def test_counts_that_are_not_sent_are_joined(spark, corpus, monkeypatch, most):
    """Scores by whole counts, however few of them go to the tasks; copies, null ids and odd texts among the rows."""
    docs, labels, _ = corpus
    odd = [(0, CALM[0] + " n1tw1t"), (0, CALM[0] + " n1tw1t"), (None, "r 0 t t e r"), (None, None), (5_000, ""), (5_001, "bl0ckh3ad " * 2_000), (5_002, "漢1字 éa0 .. !!!!!!")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = lambda: Counter((r.doc_id, r.held_out, r.predicted, round(r.score, 9)) for r in toxicity.toxicity(docs, labels).collect())
    whole = rows()
    monkeypatch.setattr(toxicity, "MOST_GRAMS", most)
    assert sum(whole.values()) == 907 and rows() == whole
    model = toxicity.character_model(docs)
    assert len(model.keys) <= most and model.rarer.count() > 300
    with pytest.raises(toxicity.Lacking):
        toxicity.restore("q1z", model)


def test_pipeline_drops_by_whole_counts(spark, corpus, docs_of, tmp_path, monkeypatch):
    """The first stage keeps the same rows, with all their columns, however few counts go to the tasks."""
    import corpus_pipeline

    docs, labels, _ = corpus
    odd = [(1, "go n.i.t.w.i.t"), (1, "go n.i.t.w.i.t"), (None, None), (None, " river ".join(map(" ".join, RUDE))), (5_000, "")]
    odd += [(6_000 + i, f"{w[:k]}{w[k] * 5}{w[k + 1:]}") for i, (w, k) in enumerate((w, k) for w in RUDE for k in range(len(w)))]
    odd += [(7_000 + i, " ".join(CALM[i])) for i in range(len(CALM))]
    docs = docs_of(spark, [*docs.collect(), *odd])
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = lambda: Counter(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect())
    whole = kept()
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 0)
    assert sum(whole.values()) > 500 and kept() == whole


def test_classifier_against_plain_steps():
    """The fit comes to where a plain descent comes to."""
    drawn = np.random.default_rng(0)
    dense = drawn.random((60, 5)) < 0.4
    y = (dense[:, 0] | (dense[:, 1] & (drawn.random(60) < 0.8))).astype(float)
    doc, feature = np.nonzero(dense)
    weights, constant = toxicity._regress(doc, feature, y, 5, 4_000)
    w, c = np.zeros(5), 0.0
    for _ in range(60_000):
        pull = y - 1 / (1 + np.exp(-(c + dense @ w)))
        w = np.maximum(0, w + 0.02 * (dense.T @ pull - toxicity.RIDGE * w))
        c += 0.02 * pull.sum()
    assert np.allclose(weights, w, atol=0.02) and abs(constant - c) < 0.05


def test_grams_are_handed_on_before_they_are_too_many():
    """Counts in several parts are those of one: a task holds a bounded number of grams."""
    texts = ["".join(chr(97 + (i * k) % 26) for k in range(40)) + " é漢" * (i % 3) for i in range(300)] + [None, ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20], pa.string())], names=["text"]) for i in range(0, len(texts), 20)]

    def added(found):
        out = Counter()
        for b in found:
            for key, n in zip(*(c.to_pylist() for c in b.columns)):
                out[key] += n
        return out

    whole, parts = list(toxicity.counted(iter(batches))), list(toxicity.counted(iter(batches), most=100))
    assert len(parts) > len(whole) and added(parts) == added(whole)
    assert sum(n for key, n in added(parts).items() if key >> 42 < toxicity.LAST_TWO) == sum(len(t or "") + 2 for t in texts)
