"""Column functions on symbols: unsigned integers, or the bytes of a BINARY column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(body: Column, place: Column | int) -> Column:
    """The byte at a 0-based place as BIGINT."""
    at = F.lit(place) if isinstance(place, int) else place
    return F.conv(F.hex(body.substr((at + 1).cast("int"), F.lit(1))), 16, 10).cast("long")


def symbols_of(body: Column) -> Column:
    """All bytes of body as an array of BIGINT."""
    places = F.when(F.octet_length(body) > 0, F.sequence(F.lit(0), F.octet_length(body) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: byte_at(body, i))


def to_bytes(symbol: Column) -> Column:
    """The lowest eight bits of a symbol as one byte (higher bits are cut off)."""
    return F.unhex(F.lpad(F.hex(narrowed(symbol, 8)), 2, "0"))


def narrowed(symbol: Column, bits: int) -> Column:
    """The lowest bits of a symbol, as a conversion to a narrower unsigned type has it."""
    return symbol.cast("long").bitwiseAND(F.lit((1 << bits) - 1))


def log2_floor(value: Column) -> Column:
    """The integer part of the binary logarithm of a positive integer."""
    return F.length(F.bin(value.cast("long"))) - 1


def bits_for(largest: Column) -> Column:
    """Bits that symbols up to largest take."""
    return log2_floor(largest) + 1


def modular_add(a: Column, b: Column, m: Column | int) -> Column:
    return F.pmod(a + b, F.lit(m) if isinstance(m, int) else m)


def modular_sub(a: Column, b: Column, m: Column | int) -> Column:
    return F.pmod(a - b, F.lit(m) if isinstance(m, int) else m)
