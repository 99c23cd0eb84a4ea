"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from glyphrake.llm import imatch, langid, mixing, neighbours, packing, sharding, simhash, substrings, toxicity, urls
from glyphrake.llm.common import ship


@pytest.fixture(scope="module")
def odd(spark, docs_of, odd_rows):
    ship(spark)
    return docs_of(spark, odd_rows).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, None), (None, 1), (1, 1)], "doc_id long, toxic int")


def test_toxicity(odd, none, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_mixing(odd, none):
    rows = mixing.plan_mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.copies == len(r.positions) <= 3 for r in rows)
    assert all(r.copies == 0 for r in rows if r["size"] == 0)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix_sources(none).count() == 0
    placed = mixing.mixed_documents(odd)
    assert placed.columns == odd.columns
    assert placed.count() == sum(r.copies for r in rows)


def test_imatch(odd, none):
    rows = imatch.edited_fingerprints(odd, imatch.lexicon(odd)).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 9)}) == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.edited_sha256 for r in rows if r.doc_id in (2, 3)} == {empty}
    assert imatch.edited_fingerprints(none, imatch.lexicon(none)).count() == 0
    alone = odd.where("doc_id = 8")
    assert imatch.edited_fingerprints(alone, imatch.lexicon(alone)).first().near_next == 1


def test_substrings(odd, none):
    out = substrings.remove_repeats(odd)
    rows = {(r.doc_id, r.n_words): r for r in out.collect()}
    assert out.count() == odd.count()
    assert rows[5, 20_000].n_removed == 20_000 and rows[4, 20_000].n_removed == 0
    assert rows[3, 0].text_kept is None and rows[2, 0].text_kept == ""
    assert substrings.remove_repeats(none).count() == 0
    kept = substrings.without_repeats(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 0 and kept.count() == odd.count() - 1
    assert kept.where("doc_id = 7").first()["spans"] == "s"


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "no scheme", "h"), (3, "http://A.Com/en/7?x=/y", "h"), (None, "s://example.net/de/81#z", "h"), (5, "://x.org", "h"), (5, "://x.org", "h"), (6, "http://" + "x" * 50_000, "h")], "page_id long, url string, host string")
    rows = urls.judge(pages).collect()
    assert len(rows) == 7 and all(r.verdict in ("allow", "block") for r in rows)
    by_id = {r.page_id: r for r in rows}
    assert (by_id[1].host, by_id[1].path, by_id[1].rule) == ("", "", None)
    assert (by_id[3].host, by_id[3].path, by_id[3].rule, by_id[3].verdict) == ("a.com", "/en/7", "com/en/", "block")
    assert (by_id[None].rule, by_id[None].verdict) == ("example.net/de/8", "block")
    assert (by_id[5].host, by_id[5].path) == ("x.org", "")
    assert urls.judge(pages.limit(0)).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (None, [1.0, 0.1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    found = neighbours.nearest(vectors, vectors.where("vec_id in (0, 2, 4)"), probed_share=1.0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 2), (0, 2, 3), (0, 3, 1), (2, 1, 3), (2, 2, 0), (2, 3, 1)]
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    assert neighbours.nearest(vectors, vectors.limit(0)).count() == 0


def test_simhash(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    component = {r.doc_id: r.component_id for r in rows}
    assert component[5] == 4 and component[9] == 1 and component[3] == component[6] == 2
    assert {bytes(r.fingerprint) for r in rows if r.doc_id in (2, 3, 6)} == {bytes(8)}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 4, 7, 8] and ids.count(None) == 2


def test_sharding(odd, none):
    rows = sharding.shard_documents(odd, shards=5).collect()
    assert sorted(r.row_number for r in rows) == list(range(odd.count())) == sorted(r.place for r in rows)
    for shard in range(5):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {16} and {r.text_crc32 for r in rows if r.doc_id in (2, 3)} == {0}
    assert sharding.shard_documents(none).count() == 0


def test_packing(odd, none):
    rows = packing.pack_documents(odd).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in whole.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id in (2, 3)] == [(1, 1)] * 2
    assert packing.pack_documents(none).count() == 0


def test_language(odd, none):
    model = langid.train(odd)
    rows = langid.identify(odd, model, spans=True).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred, r.score, r.spans) == ("und", 0.0, []) for r in rows if r.doc_id in (2, 3, 6))
    assert langid.identify(none, model).count() == 0
    nothing = langid.train(none)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
