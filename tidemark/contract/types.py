"""Contract types, their families, and the Spark types that hold them."""

from __future__ import annotations

from pyspark.sql import types as T

from tidemark.contract.model import Contract

#: Contract spellings by family (fixed values).
FAMILIES: dict[str, tuple[str, ...]] = {
    "string": ("string", "text", "char", "varchar", "character varying", "character", "citext"),
    "uuid": ("uuid",),
    "integer": ("integer", "int", "bigint", "smallint", "tinyint", "serial", "bigserial"),
    "decimal": ("decimal", "numeric", "number", "double", "double precision", "float", "float4", "float8", "real", "money"),
    "boolean": ("bool", "boolean"),
    "timestamp": ("datetime", "timestamp", "timestampz", "timestamptz", "timestamp without time zone", "timestamp with time zone"),
    "date": ("date",),
    "time": ("time",),
    "json": ("json", "jsonb"),
    "binary": ("binary", "bytea", "blob"),
}
#: Spellings whose values are taken as they are, though their family is known.
UNCOERCED = ("character", "citext", "tinyint")
DEFAULT_DECIMAL = T.DecimalType(38, 18)


def family(contract_type: str | None) -> str:
    """The family of a contract type; ``unknown`` for none and for spellings not listed."""
    t = (contract_type or "").strip().lower()
    if t.startswith("array"):
        return "array"
    return next((f for f, names in FAMILIES.items() if t in names), "unknown")


def spark_type(contract: Contract, name: str) -> T.DataType:
    """Spark type of a field's column: by the property's schema, else by the contract type."""
    prop = contract.property_schema(name)
    fmt = str(prop.get("format") or "").strip().lower()
    kind = prop.get("type")
    if isinstance(kind, list):
        kind = next((x for x in kind if x != "null"), None)
    if kind == "string" and fmt in ("byte", "binary"):
        return T.BinaryType()
    f = family(contract.field_types.get(name))
    return {
        "integer": T.LongType(),
        "decimal": DEFAULT_DECIMAL,
        "boolean": T.BooleanType(),
        "timestamp": T.TimestampType(),
        "date": T.DateType(),
        "binary": T.BinaryType(),
    }.get(f, T.StringType())


def contract_schema(contract: Contract) -> T.StructType:
    """Schema of the curated table; a column is nullable unless required or a key."""
    return T.StructType([T.StructField(f, spark_type(contract, f), contract.nullable(f)) for f in contract.fields])


def hash_state_schema(contract: Contract) -> T.StructType:
    """Keys and ``row_hash``."""
    return T.StructType([*[T.StructField(k, spark_type(contract, k), False) for k in contract.key_fields], T.StructField("row_hash", T.StringType(), False)])


def hash_state_name(table: str) -> str:
    return f"_hd_state_{table}"[:63]


def source_family(t: T.DataType) -> str:
    """Family of a source column's Spark type."""
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, (T.DecimalType, T.FractionalType)):
        return "decimal"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.BinaryType):
        return "binary"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType, T.VariantType)):
        return "json"
    return "string"


def check_source(schema: T.StructType, contract: Contract) -> None:
    """Raises ValueError naming every field that is missing or of another family.

    Text columns are taken for uuid, time, json and array fields too, since files carry
    those as text; an array may come from JSON; undeclared types take anything.
    """
    have = {f.name: f.dataType for f in schema.fields}
    if missing := [f for f in contract.fields if f not in have]:
        raise ValueError(f"the source lacks fields: {', '.join(missing)}")
    wrong = []
    for f in contract.fields:
        declared = contract.field_types.get(f)
        want, got = family(declared), source_family(have[f])
        if declared and want == "unknown" and declared.strip().lower() not in ("", "unknown"):
            raise ValueError(f"unsupported contract type {declared!r} of field {f}")
        fits = want in ("unknown", got) or (want == "array" and got == "json") or (got == "string" and want in ("uuid", "time", "json", "array"))
        if not fits:
            wrong.append(f"{f}: contract {want}, source {got}")
    if wrong:
        raise ValueError("types that don't match: " + "; ".join(wrong))
