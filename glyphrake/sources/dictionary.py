"""Symbols of any kind as numbers in the same order.

Indexes hold symbols as BIGINT.  Unsigned 64-bit symbols (DECIMAL(20,0)), strings, dates or
whatever Spark can sort are numbered from 1 in their order, so that suffixes of coded texts
are in the order of the texts, and a text has no larger symbols than it has different ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphrake.functions.running import numbered
from glyphrake.session import checkpoint
from glyphrake.sources.corpus import Corpus


@dataclass(frozen=True)
class Dictionary:
    """codes: symbol, code (from 1, in order of symbols)."""

    codes: DataFrame
    size: int

    @classmethod
    def of(cls, rows: DataFrame, body: str) -> Dictionary:
        """Of all symbols in an ARRAY column; null members are no symbols."""
        symbols = checkpoint(rows.select(F.explode(body).alias("symbol")).where("symbol is not null").distinct(), "symbols")
        codes = numbered(symbols, ["symbol"], "code", label="symbol-codes").select("symbol", (F.col("code") + 1).alias("code"))
        return cls(codes, codes.count())

    def coded(self, rows: DataFrame, key: str, body: str, name: str = "body") -> DataFrame:
        """key, name: each row's symbols as codes, in order; 0 for those that the dictionary does not have and for null.

        Keys must differ from row to row.  Symbols are joined, whatever the size of the
        dictionary; a row's symbols come together again as they were one row's before.
        """
        places = rows.select(key, F.posexplode_outer(body).alias("_at", "symbol"))
        found = places.join(self.codes, "symbol", "left")
        whole = found.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("code", F.lit(0).cast("long")).alias("code"))))).alias("_seen"))
        return whole.select(key, F.transform("_seen", lambda x: x["code"]).alias(name))

    def corpus(self, rows: DataFrame, piece_id: str, body: str) -> Corpus:
        """A piece per row with an id and a body; null members are errors once the corpus is checked."""
        known = rows.where(F.col(piece_id).isNotNull() & F.col(body).isNotNull())
        pieces = self.coded(known, piece_id, body).select(F.col(piece_id).cast("long").alias("piece_id"), "body")
        return Corpus(checkpoint(pieces, "coded-pieces"), max(self.size, 1))

    def patterns(self, rows: DataFrame, body: str = "symbols") -> DataFrame:
        """pattern_id, symbols of patterns (pattern_id, body): symbols that the texts do not have are beyond the alphabet, so that nothing matches."""
        coded = self.coded(rows, "pattern_id", body, "symbols")
        return coded.select("pattern_id", F.transform("symbols", lambda c: F.when(c == 0, F.lit(self.size + 1)).otherwise(c)).alias("symbols"))
