"""The permutation and its inverse."""

import os
import zlib

import numpy as np
import pytest

from glyphrake.llm import sharding
from glyphrake.llm.sharding import permute

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1_000, 65_537])
def test_permutation_and_inverse(n):
    rows = np.arange(n)
    places = permute(rows, n)
    assert sorted(places.tolist()) == list(range(n))
    assert (permute(places, n, inverse=True) == rows).all()
    assert n < 100 or (permute(rows, n, seed=1) != places).any()


def test_it_shuffles():
    places = permute(np.arange(100_000), 100_000)
    shards = np.bincount(places[:10_000] % 40, minlength=40)
    assert 180 < shards.min() and shards.max() < 320


def test_no_rows():
    assert len(permute(np.arange(0), 0)) == 0


def plain_place(number, n):
    """One row's place, by the network in plain numbers, walked until it is below n."""
    mask64 = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask64
        return x ^ (x >> 31)

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [mix(((r + 1) * 0x9E3779B97F4A7C15 + sharding.SEED) & mask64) for r in range(sharding.ROUNDS)]
    while True:
        left, right = number >> half, number & ((1 << half) - 1)
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & ((1 << half) - 1))
        number = right << half | left
        if number < n:
            return number


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_the_query_against_a_plain_version(spark):
    """Sizes and checksums of the texts, shard and slot of every row, all computed apart."""
    texts = {}
    for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        texts.setdefault(r.doc_id, []).append((len(raw) + 16, zlib.crc32(raw)))
    rows = sharding.op8_feistel_sharding(spark, TABLES).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r["size"], r.text_crc32))
        place = plain_place(r.row_number, len(rows))
        assert (r.shard, r.slot, r.law, r.grown_shard) == (place % 40, place // 40, "rows", None)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in texts.items()}
    assert sorted(r.row_number for r in rows) == list(range(len(rows)))
    assert sorted((r.shard, r.slot) for r in rows) == sorted((i % 40, i // 40) for i in range(len(rows)))
