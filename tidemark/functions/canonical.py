"""Canonical text of values and the SHA-256 row hash over it.

Scalars stay in Catalyst.  Only nested values (structs, maps, arrays, variants) pass
through an Arrow-batched function, because their canonical form is ASCII JSON with sorted
keys that no built-in function writes.
"""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXT = "<NULL>"
SEPARATOR = "|"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _scientific(text: Column) -> Column:
    """(digits, point) of a number's text: 0.digits times ten to the point."""

    def of(p: Column) -> Column:
        whole, every = p["whole"], F.concat(p["whole"], p["frac"])
        return let(
            F.struct(every.alias("every"), F.regexp_replace(every, "^0+", "").alias("led"), (F.length(whole) + p["exp"]).alias("at")),
            lambda q: F.struct(F.regexp_replace(q["led"], "0+$", "").alias("digits"), (q["at"] - F.length(q["every"]) + F.length(q["led"])).alias("point")),
        )

    bare = F.regexp_replace(F.lower(text), "^-", "")
    mantissa = F.split_part(bare, F.lit("e"), F.lit(1))
    exponent = F.coalesce(F.regexp_replace(F.split_part(bare, F.lit("e"), F.lit(2)), r"\+", "").try_cast("int"), F.lit(0))
    return let(F.struct(F.split_part(mantissa, F.lit("."), F.lit(1)).alias("whole"), F.split_part(mantissa, F.lit("."), F.lit(2)).alias("frac"), exponent.alias("exp")), of)


def _uncommon(c: Column, write) -> Column:
    """Text of a double from its fewest digits, where the plain cast won't do.

    Before version 19 Java sometimes writes more digits than it takes, so all numbers of
    digits are tried, fewest first.  The common case stays in generated code.
    """
    text = c.cast("string")
    common = ~text.contains("E") & (F.length(text) <= 17)

    def shortest(n: Column) -> Column:
        tried = F.array(*[F.format_string(f"%.{k}e", n["c"]) for k in range(17)])
        fewest = F.get(F.filter(tried, lambda t: t.try_cast("double") == n["c"]), 0)
        return let(F.coalesce(fewest, n["t"]), lambda t: let(_scientific(t), lambda d: F.concat(F.when(n["t"].startswith("-"), "-").otherwise(""), write(d["digits"], d["point"]))))

    return F.when(c.isNull() | common | F.isnan(c) | F.abs(c).isin(float("inf")), text).otherwise(let(F.struct(c.alias("c"), text.alias("t")), shortest))


def _positional(digits: Column, point: Column) -> Column:
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    padded = F.rpad(digits, F.greatest(point, F.length(digits)), "0")
    tail = F.substring(padded, point + 1, F.length(padded))
    large = F.concat(F.substring(padded, F.lit(1), point), F.lit("."), F.when(tail == "", "0").otherwise(tail))
    return F.when(digits == "", "0.0").when(point <= 0, small).otherwise(large)


def _exponential(digits: Column, point: Column) -> Column:
    rest, e = F.substring(digits, F.lit(2), F.length(digits)), F.abs(point - 1).cast("string")
    return F.concat(F.substring(digits, 1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(point - 1 < 0, "-").otherwise("+"), F.lpad(e, F.greatest(F.lit(2), F.length(e)), "0"))


def plain_number(c: Column) -> Column:
    """A double's shortest text without an exponent, at least one decimal: 1e7 is 10000000.0."""
    return _uncommon(c, _positional)


def python_double(c: Column) -> Column:
    """A double's text with Python's thresholds for the exponent (1e16, 1e-4)."""
    far = lambda d, p: F.when((p > 16) | (p < -3), _exponential(d, p)).otherwise(_positional(d, p))
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(_uncommon(c, far))


def _iso(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def _plain_json(v: Any) -> Any:
    """A nested value with only JSON types; decimals become strings."""
    if isinstance(v, Mapping):
        return {str(k): _plain_json(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain_json(x) for x in v]
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(bytes(v)).decode("ascii")
    if hasattr(v, "tolist"):
        return _plain_json(v.tolist())
    return v


def canonical_json(v: Any) -> str | None:
    """Compact ASCII JSON with sorted keys."""
    return None if v is None else json.dumps(_plain_json(v), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@F.pandas_udf(T.StringType())
def _canonical_json_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else canonical_json(json.loads(t)))


def canonical_nested(c: Column, kind: T.DataType) -> Column:
    """Canonical text of a nested column.

    Timestamps and decimals inside are written as text first, so that JSON numbers
    don't change them.
    """
    return _canonical_json_text(F.to_json(_stringly(c, kind)))


def _stringly(c: Column, kind: T.DataType) -> Column:
    """The same shape with decimals, dates, times and bytes as their canonical text."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_stringly(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _stringly(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _stringly(x, kind.valueType))
    if isinstance(kind, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return canonical_text(c, kind, null_text=False)
    return c


def canonical_text(c: Column, kind: T.DataType, double_as: str = "plain", null_text: bool = True) -> Column:
    """Text of a value as the row hash sees it; ``<NULL>`` for null.

    ``double_as``: ``plain`` writes doubles as contract decimals (no exponent), ``raw``
    as Python writes floats.  A decimal keeps its scale: 10.5 and 10.50 differ.
    """
    if isinstance(kind, T.BooleanType):
        t = F.when(c, "True").when(~c, "False")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        t = python_double(c.cast("double")) if double_as == "raw" else plain_number(c.cast("double"))
    elif isinstance(kind, T.DateType):
        t = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, T.TimestampNTZType):
        t = _iso(c)
    elif isinstance(kind, T.TimestampType):
        t = F.concat(_iso(F.to_utc_timestamp(c, F.current_timezone())), F.lit("+00:00"))
    elif isinstance(kind, T.BinaryType):
        t = F.regexp_replace(F.base64(c), r"\s", "")
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        t = canonical_nested(c, kind)
    elif isinstance(kind, T.VariantType):
        t = _canonical_json_text(F.to_json(c))
    else:
        t = c.cast("string")
    return F.coalesce(t, F.lit(NULL_TEXT)) if null_text else t


def canonical_row(df: DataFrame, fields: Sequence[str], double_as: str = "plain") -> Column:
    """The fields' texts joined by ``|``; ValueError for a field the frame lacks.

    Texts aren't escaped, so values that hold ``|`` or ``<NULL>`` can collide; that is
    part of the hash's definition.  ``hardened_hash`` has no such collisions.
    """
    if missing := [f for f in fields if f not in df.columns]:
        raise ValueError(f"fields to hash that aren't there: {', '.join(missing)}")
    return F.concat_ws(SEPARATOR, *[canonical_text(F.col(f"`{f}`"), df.schema[f].dataType, double_as) for f in fields])


def row_hash(df: DataFrame, fields: Sequence[str], double_as: str = "plain") -> Column:
    """SHA-256 (hex) of the canonical row."""
    return F.sha2(canonical_row(df, fields, double_as), 256)


def hardened_hash(df: DataFrame, fields: Sequence[str]) -> Column:
    """SHA-256 over length-prefixed texts: no two different rows have one text."""
    part = lambda f: F.when(F.col(f"`{f}`").isNull(), "n;").otherwise((lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t, F.lit(";")))(canonical_text(F.col(f"`{f}`"), df.schema[f].dataType)))
    return F.sha2(F.concat(*[part(f) for f in fields]), 256)
