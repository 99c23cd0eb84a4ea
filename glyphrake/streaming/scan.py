"""Pattern search on streams: the scan has no state, so it runs on a stream as it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphrake.functions.matching import count_in_text


def hits_per_piece(pieces: DataFrame, piece_id: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """piece_id, pattern, n of pieces that hold a pattern; pieces may be a stream (append mode)."""
    cells = F.array(*(F.struct(F.lit(p).alias("pattern"), count_in_text(F.col(text), p).alias("n")) for p in patterns))
    return pieces.select(piece_id, F.explode(cells).alias("x")).select(piece_id, "x.pattern", "x.n").where("n > 0")
