"""Token alignment against a plain version that compares all byte ranges."""

import hashlib
import os
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from glyphrake.llm import alignment
from glyphrake.llm.common import ship

TABLES = "/root/testdata/sf0.001"
BITS = ["a", "the", "The quick brown", " ", "  ", "\n", "\t", "'s", "é", "ß", "日本語", "\r\n", "\xa0", "　", "-", "I'll", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "🙂", "token", "ing", "12345", "\x00", "\x07"]


def decoder():
    """Bytes of the characters that the first tokenizer's vocabulary is written in."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@pytest.fixture(scope="module")
def both():
    files, chars = alignment.tokenizer_files(), decoder()
    a, b = Tokenizer.from_file(files.first), sentencepiece.SentencePieceProcessor(model_file=files.second)
    a.encode_special_tokens = True

    def tokens(text):
        """[(id, start, end)] of both, or None."""
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids[1])]
        if any(b"".join(x) != (" " + text).encode() for x in raw):
            return None
        out = []
        for own, parts in zip(ids, raw):
            at, placed = 0, []
            for i, part in zip(own, parts):
                placed.append((i, at, at + len(part)))
                at += len(part)
            out.append(placed)
        return out

    return tokens


def plain(texts, tokens):
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    own, documents = {}, Counter()
    for key, text in texts.items():
        found = tokens(text)
        links = [(x[0], y[0]) for x in found[0] for y in found[1] if x[1] < y[2] and y[1] < x[2]] if found else []
        own[key] = found, links
        documents.update(set(links))
    most = Counter()
    for (a, _), n in documents.items():
        most[a] = max(most[a], n)
    out = {}
    for key, (found, links) in own.items():
        if not found:
            out[key] = (0, 0, 0, 0, 0, 0, "")
            continue
        groups, i, j = [], 0, 0
        ends = sorted({x[2] for x in found[0]} & {y[2] for y in found[1]})
        for end in ends:
            first, second = [], []
            while i < len(found[0]) and found[0][i][2] <= end:
                first.append(str(found[0][i][0]))
                i += 1
            while j < len(found[1]) and found[1][j][2] <= end:
                second.append(str(found[1][j][0]))
                j += 1
            groups.append(",".join(first) + "|" + ",".join(second))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out[key] = len(found[0]), len(found[1]), len(ends), len(links), sum(documents[x] == most[x[0]] for x in links), sum(documents[x] for x in links), digest
    return out, documents, most


COLUMNS = ("n_first", "n_second", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def checked(spark, texts, both, **options):
    ship(spark)
    documents, pairs = alignment.align(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), **options)
    want, counts, most = plain(texts, both)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in documents.collect()} == want
    assert {(r.first, r.second): (r.documents, r.best) for r in pairs.collect()} == {k: (n, n == most[k[0]]) for k, n in counts.items()}
    return want


def test_against_a_plain_version(spark, both, monkeypatch):
    drawn = random.Random(6)
    texts = {i: "".join(drawn.choices(BITS, k=drawn.randint(0, 20))) for i in range(150)}
    texts |= {200: "", 201: None, 202: "▁ is not a blank", 203: "x" * 300, 204: " ", 205: "a", 206: "the the the the", 207: "the the the the"}
    want = checked(spark, texts, both)
    assert want[202] == want[201] == want[200] == (0, 0, 0, 0, 0, 0, "") and want[204][0] > 0


def test_small_chunks_and_many_tasks(spark, both, monkeypatch):
    """Rows that are cut, several tasks a stripe, counts handed on early."""
    for name, value in (("CHUNK_CHARS", 300), ("ROW_LINKS", 16), ("COUNTED", 100), ("SCORED_BYTES", 200)):
        monkeypatch.setattr(alignment, name, value)
    drawn = random.Random(7)
    checked(spark, {i: " ".join(drawn.choices("the cat sat on the mat with pleasure unbelievably".split(), k=drawn.randint(1, 40))) for i in range(60)}, both, stripes=5)


def test_bytes_of_every_id():
    own = alignment.tokenizers(alignment.tokenizer_files())
    chars = decoder()
    for i, raw in enumerate(own.first_bytes):
        if own.plain.id_to_token(i) != "<|endoftext|>":
            assert raw == bytes(chars[c] for c in own.plain.id_to_token(i))


def test_odd_rows(spark, docs_of, odd_rows):
    ship(spark)
    odd = docs_of(spark, odd_rows)
    documents, _ = alignment.align(odd)
    rows = documents.collect()
    assert len(rows) == odd.count()
    assert all(r.n_links == 0 and r.groups_sha256 == "" for r in rows if r.doc_id in (2, 3))
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (1, 9)}) == 1 and len({tuple(r)[1:] for r in rows if r.doc_id in (4, 5)}) == 1
    documents, pairs = alignment.align(odd.limit(0))
    assert documents.count() == 0 and pairs.count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_the_query_on_documents(spark, both):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    some = {i: t for i, t in texts.items() if len(t) < 3_000}
    checked(spark, some, both)
    rows = alignment.op13_token_alignment(spark, TABLES).collect()
    own = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in rows}
    want, _, _ = plain(some, both)
    assert all(own[i] == (*w[:4], w[6]) for i, w in want.items())
