"""Texts and patterns made by rule, for tests and measurements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_text(n: int, probability: float = 0.5, seed: int = 0) -> bytes:
    """n symbols, terminator included: 0 with the probability, else 1 (the digits)."""
    drawn = np.random.default_rng(seed).random(max(n - 1, 0)) < probability
    return np.where(drawn, ord("0"), ord("1")).astype(np.uint8).tobytes() + b"\0" * (n > 0)


def binary_patterns(length: int) -> list[bytes]:
    """All sequences of so many binary digits."""
    return [f"{i:0{length}b}".encode() for i in range(2**length)]


def random_text(n: int, symbols: bytes, seed: int = 0) -> bytes:
    """Pieces of random symbols: n symbols in all, none of them a leading or doubled terminator, and one at the end."""
    drawn = np.random.default_rng(seed)
    text = np.frombuffer(bytes(sorted(set(symbols) - {0})), np.uint8)[drawn.integers(0, len(set(symbols) - {0}), n)]
    ends = np.flatnonzero(drawn.random(n) < 0.05)
    ends = ends[(ends > 0) & (ends < n - 2)]
    text = text.copy()
    text[ends[np.concatenate(([True], np.diff(ends) > 1))[: len(ends)]]] = 0
    text[n - 1] = 0
    return text.tobytes()


def generated_pieces(spark: SparkSession, pieces: int, least: int, most: int, shares: dict[int, float], seed: int = 0) -> DataFrame:
    """piece_id, body (BINARY): pieces of least to most bytes, drawn with the given shares (which add up to 1).

    Bytes follow from seed, piece and place by hash, so that texts of any size are made by
    the tasks that read them, always the same.
    """
    drawn = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30))
    length = F.lit(least) + (drawn(F.lit("length"), "id") % (most - least + 1)).cast("int")
    limits, held = [], 0.0
    for symbol, share in list(shares.items())[:-1]:
        held += share
        limits.append((symbol, round(held * (1 << 30))))

    def symbol_at(i):
        place, out = drawn("id", i), None
        for symbol, limit in limits:
            out = F.when(place < limit, F.lit(f"{symbol:02x}")) if out is None else out.when(place < limit, F.lit(f"{symbol:02x}"))
        last = F.lit(f"{list(shares)[-1]:02x}")
        return last if out is None else out.otherwise(last)

    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    return spark.range(pieces).select(F.col("id").alias("piece_id"), F.unhex(F.array_join(F.transform(places, symbol_at), "")).alias("body"))
