"""64-bit row hashes that tell nulls, blanks and column borders apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tagged(c: Column) -> Column:
    """Text of a value in which null and every string differ."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def row_hash64(cols: Sequence[Column], seed: str = "") -> Column:
    """xxhash64 over the tagged values; another seed gives an independent hash."""
    return F.xxhash64(F.lit(seed), *[tagged(c) for c in cols])


def additive_halves(h: Column) -> tuple[Column, Column]:
    """Two sums of non-negative halves of a 64-bit hash.

    Adding halves as bigint can't overflow below 2^31 rows in one partition,
    is free of order, and needs no decimal arithmetic.
    """
    mask = F.lit(0xFFFFFFFF)
    return F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(mask))
