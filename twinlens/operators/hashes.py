"""Distances of bit hashes kept as longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share_of_ones(h: Column, bits: int) -> Column:
    """Ones over twice the bits: as if a digit of four bits had eight, so at most a half."""
    return F.bit_count(h) / F.lit(2.0 * bits)


def entropy(h: Column, bits: int) -> Column:
    p = share_of_ones(h, bits)
    return F.when((p == 0) | (p == 1), F.lit(0.0)).otherwise(-(p * F.log(p) + (1 - p) * F.log(1 - p)))


def cross_entropy(a: Column, b: Column, bits: int) -> Column:
    p, q = share_of_ones(a, bits), share_of_ones(b, bits)
    return F.when((q == 0) | (q == 1), F.lit(0.0)).otherwise(-(p * F.log(q) + (1 - p) * F.log(1 - q)))


def symmetric_cross_entropy(a: Column, b: Column, bits: int) -> Column:
    return (cross_entropy(a, b, bits) + cross_entropy(b, a, bits)) / 2


def of_hex(c: Column) -> Column:
    """Up to 16 hexadecimal digits as a long, the top bit its sign."""
    return F.conv(c, 16, -10).cast("long")


def hex_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal strings of equal length, 16 digits at a time."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(a), F.lit(1)), F.lit(16))
    return F.aggregate(at, F.lit(0), lambda s, i: s + F.bit_count(of_hex(F.substring(a, i, F.lit(16))).bitwiseXOR(of_hex(F.substring(b, i, F.lit(16))))))
