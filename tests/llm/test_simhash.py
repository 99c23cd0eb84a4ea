"""Fingerprints and links against brute force."""

import random

import numpy as np
import pytest
import xxhash

from glyphrake.llm import simhash
from glyphrake.llm.common import ship
from glyphrake.llm.components import connected_components


def plain(text, shingle=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return bytes(8)
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)).to_bytes(8, "big")


@pytest.mark.parametrize("text", ["", "one", "Two Words", "A b C d é É", "x\ty\nz  w", "a b c a b c a b c"])
def test_fingerprint(text):
    assert simhash.simhash(text) == plain(text)


def groups(values, distance):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(values)):
        out.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("distance, crowded", [(1, 10**9), (2, 10**9), (2, 20), (3, 20)])
def test_links_connect_what_all_links_would(spark, distance, crowded):
    """Chains, crowds around a few centres and strangers; with crowded small, the finer keys do the work."""
    ship(spark)
    drawn = random.Random(distance)
    values = [drawn.getrandbits(64) for _ in range(150)]
    for _ in range(6):
        value = drawn.getrandbits(64)
        for _ in range(60):
            values.append(value)
            for _ in range(drawn.randint(1, 3)):
                value ^= 1 << drawn.randrange(64 if drawn.random() < 0.5 else 16)
    values = list(dict.fromkeys(values))
    nodes = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(values)], "node long, fingerprint binary")
    old, simhash.CROWDED = simhash.CROWDED, crowded
    try:
        roots = {r.node: r.root for r in connected_components(simhash.link_fingerprints(nodes, 64, distance)).collect()}
    finally:
        simhash.CROWDED = old
    found = {}
    for i in range(len(values)):
        found.setdefault(roots.get(i, i), set()).add(i)
    assert {frozenset(g) for g in found.values()} == groups(values, distance)
    assert all(min(g) == root for root, g in found.items())


def test_budgets_never_drop_a_close_pair():
    drawn = np.random.default_rng(3)
    a = drawn.integers(0, 256, (4_000, 8), dtype=np.uint8)
    b = a.copy()
    for _ in range(2):
        b[np.arange(4_000), drawn.integers(0, 8, 4_000)] ^= np.uint8(1) << drawn.integers(0, 8, 4_000).astype(np.uint8)
    hit = np.zeros(4_000, bool)
    for start in range(8):
        hit |= simhash.within(a, b, 2, np.full(4_000, start))
    assert hit.all() and simhash.within(a, b, 2).all()


def test_long_chain_of_components(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    rows = connected_components(edges).collect()
    assert {r.node for r in rows} == set(range(201)) and {r.root for r in rows} == {0}


def test_one_of_each_group_of_near_copies_stays(spark):
    drawn = random.Random(8)
    texts = [" ".join(drawn.choice("abcdefghij") + str(drawn.randrange(50)) for _ in range(400)) for _ in range(30)]
    docs = []
    for i, text in enumerate(texts):
        docs.append((i, text))
        words = text.split()
        for k in range(3):
            words[drawn.randrange(400)] = f"edit{k}"
            docs.append((100 + 3 * i + k, " ".join(words)))
    kept = {r.doc_id for r in simhash.first_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(range(30)) <= kept and len(kept) <= 33


def test_star_of_edited_copies(spark):
    """Copies like the original but not each other are a crowd by distance; all go but those that the recall of the keys, 95 %, leaves out."""
    drawn, words = random.Random(4), [f"w{i}" for i in range(400)]
    rows = [(500, words)]
    for i in range(400):
        own = list(words)
        for at in drawn.sample(range(400), 6):
            own[at] = f"edit{i}x{at}"
        rows.append((i if i < 200 else 600 + i, own))
    sets = {i: {tuple(x[k : k + 5]) for k in range(396)} for i, x in rows}
    parent = {i: i for i in sets}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in sets:
        for j in sets:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {find(i) for i in sets}
    kept = {r.doc_id for r in simhash.first_of_each(spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")).collect()}
    assert want <= kept and len(kept) <= len(want) + 20


@pytest.mark.parametrize("rows", [2_000_000, 700])
def test_a_huge_crowd_of_different_fingerprints(spark, rows, monkeypatch):
    """Thousands of different copies of one text and of another, in chunks and in runs that don't fit: two stay."""
    ship(spark)
    monkeypatch.setattr(simhash, "RUN_ROWS", rows)
    monkeypatch.setattr(simhash, "CROWD", 300)
    drawn, docs = random.Random(5), []
    for k in range(2):
        words = [f"w{k}x{i}" for i in range(300)]
        for i in range(1_500):
            own = list(words)
            for at in drawn.sample(range(300), 2):
                own[at] = f"edit{i}"
            docs.append((2 * i + k, " ".join(own)))
    strangers = [(10_000 + i, " ".join(f"s{drawn.randrange(10**6)}" for _ in range(80))) for i in range(500)]
    kept = {r.doc_id for r in simhash.first_of_each(spark.createDataFrame(docs + strangers, "doc_id long, text string")).collect()}
    assert {i for i, _ in strangers} <= kept
    assert {0, 1} <= kept and len(kept) <= 502 + 15


def test_a_divided_key_loses_no_link(spark, monkeypatch):
    """Keys of more than three fingerprints in parts: what is connected is the same."""
    ship(spark)
    drawn = np.random.default_rng(4)
    base = drawn.integers(0, 256, (300, 32), dtype=np.uint8)
    base[150:] = base[0] ^ (drawn.random((150, 32)) < 0.3) * drawn.integers(0, 256, (150, 32), dtype=np.uint8)
    near = base.copy()
    near[np.arange(300), drawn.integers(0, 32, 300)] ^= 1
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(np.concatenate((base, near)))]
    nodes = spark.createDataFrame(rows, "node long, fingerprint binary")

    def connected(run_rows):
        monkeypatch.setattr(simhash, "RUN_ROWS", run_rows)
        parent = list(range(600))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for r in simhash.link_fingerprints(nodes, 256, 12, 0.99).collect():
            parent[find(r.a)] = find(r.b)
        return [find(i) for i in range(600)]

    whole, parts = connected(2_000_000), connected(3)
    same = lambda x: {tuple(j for j in range(600) if x[j] == x[i]) for i in range(600)}
    assert same(parts) == same(whole) and sum(whole[i] == whole[i + 300] for i in range(300)) > 290


def test_chunks_share_their_hubs():
    drawn = np.random.default_rng(2)
    middle = drawn.integers(0, 2**63, 4, dtype=np.uint64)
    words = np.repeat(middle[None], 5_000, axis=0)
    for _ in range(6):
        words[np.arange(5_000), drawn.integers(0, 4, 5_000)] ^= np.uint64(1) << drawn.integers(0, 64, 5_000).astype(np.uint64)
    words[77] = middle
    chunks = simhash._chunks(np.arange(5_000), words)
    assert all(len(c) <= simhash.CROWD + simhash.HUBS and 77 in c for c in chunks)
    assert set(np.concatenate(chunks).tolist()) == set(range(5_000))


def _sets(spark, rows):
    return spark.createDataFrame(rows, "node long, shingles array<long>")


@pytest.mark.parametrize("crowd", [7, 400])
def test_links_between_chunks(spark, crowd, monkeypatch):
    """Whatever the chunks have connected, the links between them connect what all similar pairs would."""
    ship(spark)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    drawn, rows = random.Random(11), []
    for k in range(30):
        for i in range(1 + k % 4):  # copies of a variant are 0.8 alike and more, variants are not
            rows.append((100 * k + i, sorted({*range(60), *range(1_000 * (k + 1), 1_000 * (k + 1) + 30), -100 * k - i - 1})))
    rows.append((9_000, list(range(60))))
    drawn.shuffle(rows)
    split = [(n, 1 + n % 2) for n, _ in rows] + [(n, 3) for n, _ in rows]
    known = [(a, b) for a, _ in rows for b, _ in rows if a > b and a // 100 == b // 100 and drawn.random() < 0.3]
    links = spark.createDataFrame(known, "a long, b long")
    found = simhash._across(links, spark.createDataFrame(split, "node long, split long"), _sets(spark, rows), 0.8)
    by_node, roots = dict(rows), {r.node: r.root for r in connected_components(links.unionByName(found)).collect()}
    for a in by_node:
        for b in by_node:
            alike = 10 * len({*by_node[a]} & {*by_node[b]}) >= 8 * len({*by_node[a]} | {*by_node[b]})
            assert (roots.get(a, a) == roots.get(b, b)) == alike, (a, b)


def test_links_between_chunks_of_nothing(spark):
    links = spark.createDataFrame([], "a long, b long")
    assert simhash._across(links, spark.createDataFrame([], "node long, split long"), _sets(spark, []), 0.8).count() == 0


def test_pairs_in_a_crowd_that_no_hub_is_like(spark):
    """Thousands of variants of one text, each twice: of every two one goes."""
    ship(spark)
    drawn, docs, pairs = random.Random(6), [], 2_000
    base = [f"w{i}" for i in range(150)]
    for k in range(pairs):
        own = list(base)
        own[60:74] = [f"v{k}x{i}" for i in range(14)]  # a variant is 0.78 like another, and 0.93 like its copy
        copy = list(own)
        copy[drawn.choice((10, 20, 30, 40, 90, 100, 110, 120))] = f"copy{k}"
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(copy))]
    kept = {r.doc_id for r in simhash.first_of_each(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    both = sum(2 * k in kept and 2 * k + 1 in kept for k in range(pairs))
    assert both == 0


def test_repeated_ids_with_different_texts(spark):
    """One row of an id stays, the same whatever the order of rows."""
    rows = [(1, "a first text of some words", "x"), (1, "another text with other words", "x"), (1, "another text with other words", "y"), (2, "a third one", "z"), (None, "a third one", "z")]
    found = [sorted((tuple(r) for r in simhash.first_of_each(spark.createDataFrame(order, "doc_id long, text string, more string")).collect()), key=repr) for order in (rows, rows[::-1])]
    assert found[0] == found[1] and sorted(str(r[0]) for r in found[0]) == ["1", "2", "None"]
