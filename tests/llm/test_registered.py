"""The registered queries on the smallest tables, and the pipeline against plain versions of its stages."""

import os

import pytest

import corpus_pipeline
from glyphrake.llm import catalog, mixing, simhash
from glyphrake.llm.common import materialize

TABLES = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id held_out score predicted", "op2": "doc_id size source_size target taken", "op3": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op4": "doc_id n_words n_removed kept_sha256",
    "op5": "page_id host path rule verdict", "op6": "query_id rank vec_id score", "op7": "doc_id fingerprint component_id", "op8": "doc_id size text_crc32 law shard slot grown_shard",
    "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10": "doc_id held_out lang_pred score", "op11": "doc_id n_assign n_access n_hex base_sha256 spans", "op12": "vec_id code error label_error codebooks_sha256",
    "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_columns_and_rows(spark, documents, name):
    rows = catalog.QUERIES[name](spark, TABLES)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(rows.columns)
    n = rows.count()
    if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op7", "op8", "op10", "op11", "op13"):
        assert n == documents.count() and rows.select("doc_id").distinct().count() == documents.select("doc_id").distinct().count()
    else:
        assert n > 0


def test_mix_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{TABLES}/documents.parquet')")
    columns = "doc_id, size, source_size, target, taken, position_1, position_2, position_3"
    want = sorted(con.execute(f"SELECT {columns} FROM ({mixing.ORACLE_SQL}) q").fetchall(), key=repr)
    got = sorted((tuple(r) for r in mixing.op2_curriculum_mix(spark, TABLES).select(*columns.split(", ")).collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y if x is None else x == pytest.approx(y)


def test_pipeline(spark, documents):
    """Each stage on what the one before kept."""
    stages, docs = dict(corpus_pipeline.STAGES), documents
    assert list(stages) == ["toxicity", "near_copies", "repeated_passages", "source_mix", "packing"]
    for name in list(stages)[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stages[name](spark, docs, TABLES), "test")
        after = docs.collect()
        assert docs.columns == documents.columns and after
        assert {r.doc_id for r in after} <= set(before)
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{TABLES}/labels.parquet").where("toxic = 1").collect()}
            clean = set(before) - {r.doc_id for r in after}
            assert len(clean - toxic) <= 0.1 * len(before)
        if name == "near_copies":
            texts = [r.text for r in after]
            assert len(texts) == len(set(texts)) and {min(i for i, r in before.items() if r.text == t) for t in texts} == {r.doc_id for r in after}
        if name == "repeated_passages":
            first = {}
            words = {i: r.text.split() for i, r in before.items()}
            for i in sorted(words):
                for k in range(len(words[i]) - 49):
                    first.setdefault(tuple(words[i][k : k + 50]), i)
            kept = {r.doc_id: r.text.split() for r in after}
            for i, own in words.items():
                gone = {k + j for k in range(len(own) - 49) if first[tuple(own[k : k + 50])] < i for j in range(50)}
                assert kept.get(i, []) == [w for k, w in enumerate(own) if k not in gone]
        if name == "source_mix":
            copies = {}
            for r in after:
                assert before[r.doc_id] == r
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            plan = {r.doc_id: r.copies for r in mixing.plan_mix(spark.createDataFrame(list(before.values()), documents.schema)).collect() if r.copies}
            assert copies == plan
    rows = stages["packing"](spark, docs, TABLES).collect()
    # sequences follow the order that the mix has written
    last = max(r.sequence_id for r in rows)
    by_place = sorted((r for r in rows if r.start == 0), key=lambda r: r.position)
    assert [r.doc_id for r in by_place] == [r.doc_id for r in after]
    assert sum(abs(r.sequence_id / last - i / len(by_place)) for i, r in enumerate(by_place)) / len(by_place) < 0.2  # a third by chance; few pieces of each length here
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_fingerprints_of_the_query(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in simhash.op7_simhash_components(spark, TABLES).limit(40).collect():
        assert r.fingerprint == simhash.simhash(texts[r.doc_id]).hex()
