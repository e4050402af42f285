"""Coercion of source values to contract types, as Catalyst expressions.

Spark's casts accept more than a contract does ('t' as boolean, '2025-1-1' as date), so
text is matched against a pattern before ``try_cast`` looks at it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contract.types import DEFAULT_DECIMAL, UNCOERCED, family

#: What text must look like before it is cast (fixed patterns).
INTEGER_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*$"
DECIMAL_TEXT = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"
NOT_FINITE_TEXT = r"^\s*[+-]?(?i:nan|snan|inf|infinity)\s*$"
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?([zZ]|[+-]\d{2}(:?\d{2})?)?)?$"
TIME_TEXT = r"^([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d{1,6})?)?)?([zZ]|[+-]\d{2}(:?\d{2})?)?$"
BASE64_TEXT = r"^[A-Za-z0-9+/]*={0,2}$"
TRUE_TEXT, FALSE_TEXT = ("true", "1", "yes", "y"), ("false", "0", "no", "n")

MESSAGES = {
    "integer": "expected integer value",
    "decimal": "expected decimal value",
    "boolean": "expected boolean value",
    "timestamp": "expected timestamp value",
    "date": "expected date value",
    "time": "expected time value",
    "json": "expected JSON object or array",
    "array": "expected array value",
    "binary": "expected binary value",
}


def coerce(c: Column, source: T.DataType, contract_type: str | None, json_text: bool = False) -> tuple[Column, str | None]:
    """(coerced value, message if a value that isn't null comes out null).

    ``json_text``: the column holds members of a JSON document as text, so an object or
    array is one by its looks; in a plain string column such text is a string and not
    accepted as json or array.  Integers are 64-bit: text beyond that is refused, and so
    is everything a decimal(38,18) can't hold.  Fractions are cut off, not rounded.
    """
    f, declared = family(contract_type), (contract_type or "").strip().lower()
    text = isinstance(source, T.StringType)
    if f in ("unknown",) or declared in UNCOERCED:
        return c, None
    if f in ("string", "uuid"):
        if isinstance(source, (T.TimestampType, T.TimestampNTZType)):
            whole, micros = F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.date_format(c, "SSSSSS")
            s = F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
            return (F.concat(s, F.lit("+00:00")) if isinstance(source, T.TimestampType) else s), None
        if isinstance(source, T.BooleanType):
            return F.when(c, "True").when(~c, "False"), None
        if isinstance(source, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c), None
        return c.cast("string"), None
    if f == "integer":
        if text:
            return F.when(c.rlike(INTEGER_TEXT), F.regexp_replace(F.trim(c), "_", "").try_cast("bigint")), MESSAGES[f]
        if isinstance(source, T.NumericType):
            return c.try_cast("bigint"), MESSAGES[f]
        return F.lit(None).cast("bigint"), "boolean is not a valid integer" if isinstance(source, T.BooleanType) else MESSAGES[f]
    if f == "decimal":
        if text:
            return F.when(c.rlike(DECIMAL_TEXT), F.regexp_replace(F.trim(c), "_", "").try_cast(DEFAULT_DECIMAL)), MESSAGES[f]
        if isinstance(source, (T.DecimalType, T.DoubleType, T.FloatType)):
            return c, MESSAGES[f]
        return (c.cast(DEFAULT_DECIMAL) if isinstance(source, T.NumericType) else F.lit(None).cast(DEFAULT_DECIMAL)), MESSAGES[f]
    if f == "boolean":
        if isinstance(source, T.BooleanType):
            return c, MESSAGES[f]
        low = F.lower(F.trim(c.cast("string"))) if text else F.lit(None).cast("string")
        return F.when(low.isin(*TRUE_TEXT), True).when(low.isin(*FALSE_TEXT), False), MESSAGES[f]
    if f == "timestamp":
        if isinstance(source, (T.TimestampType, T.TimestampNTZType)):
            return c, MESSAGES[f]
        if text:
            iso = F.regexp_replace(F.regexp_replace(F.trim(c), ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
            return F.when(F.trim(c).rlike(TIMESTAMP_TEXT), iso.try_cast("timestamp")), MESSAGES[f]
        return F.lit(None).cast("timestamp"), MESSAGES[f]
    if f == "date":
        if isinstance(source, T.DateType):
            return c, MESSAGES[f]
        return (F.when(c.rlike(DATE_TEXT), c.try_cast("date")) if text else F.lit(None).cast("date")), MESSAGES[f]
    if f == "time":
        return (F.when(c.rlike(TIME_TEXT), c) if text else F.lit(None).cast("string")), MESSAGES[f]
    if f in ("json", "array"):
        if isinstance(source, T.ArrayType) or f == "json" and isinstance(source, (T.StructType, T.MapType, T.VariantType)):
            return c, MESSAGES[f]
        opens = r"^\s*\[" if f == "array" else r"^\s*[\[{]"
        return (F.when(c.rlike(opens), c) if text and json_text else F.lit(None).cast("string")), MESSAGES[f]
    if isinstance(source, T.BinaryType):
        return c, MESSAGES[f]
    clean = c.rlike(BASE64_TEXT) & (F.length(c) % 4 == 0) if text else None
    return (F.when(clean, F.try_to_binary(c, F.lit("base64"))) if text else F.lit(None).cast("binary")), "expected base64-encoded binary value" if text else MESSAGES[f]
