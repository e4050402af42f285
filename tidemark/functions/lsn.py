"""Log sequence numbers written as ``HI/LO`` in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LSN_PATTERN = r"^\s*[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\s*$"


def lsn_to_int(value: str) -> int:
    """``HI/LO`` to HI * 2^32 + LO; ValueError for other text."""
    hi, _, lo = value.strip().partition("/")
    return (int(hi, 16) << 32) + int(lo, 16)


def int_to_lsn(value: int) -> str:
    return f"{value >> 32:X}/{value & 0xFFFFFFFF:X}"


def max_lsn(*values: str | None) -> str | None:
    """The greatest of the given positions; nulls don't count."""
    found = [v for v in values if v is not None]
    return max(found, key=lsn_to_int) if found else None


def lsn_col(c: Column) -> Column:
    """bigint of an LSN column, whatever its letter case, blanks or leading zeros.

    Null for null or malformed text, and for positions of 2^63 and beyond.
    """
    parts = F.split(F.trim(c), "/")
    hi = F.conv(parts[0], 16, 10).cast("bigint")
    lo = F.conv(parts[1], 16, 10).cast("bigint")
    return F.when(c.rlike(LSN_PATTERN) & (hi < F.lit(1 << 31)), hi * F.lit(1 << 32) + lo)


def lsn_text(c: Column) -> Column:
    """The usual spelling of an integer position."""
    hi = F.hex(F.shiftrightunsigned(c, 32))
    lo = F.hex(c.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.concat_ws("/", hi, lo)
