"""Rows held to a contract: normalised values and a list of errors for each.

Works on table rows (columns) and on JSON rows of events (an object as text).  Errors come
in the order of the contract's fields, then the key check, then the schema's violations;
the schema is looked at only where nothing else is wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contract.model import Contract
from tidemark.contract.types import UNCOERCED, family, spark_type
from tidemark.functions.canonical import let, row_hash
from tidemark.functions.coerce import DECIMAL_TEXT, FALSE_TEXT, INTEGER_TEXT, MESSAGES, TRUE_TEXT, coerce
from tidemark.functions.hashes import row_hash64
from tidemark.functions.schema_rules import root_violations

ERROR = "struct<field:string,code:string,message:string,constraint:string,actual_value:string,contract_title:string,contract_description:string>"
NO_ERRORS = f"array<{ERROR}>"


def error(field: str, code: str, message: str) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(message).alias("message"), *[none.alias(n) for n in ("constraint", "actual_value", "contract_title", "contract_description")])


def _listed(parts: Sequence[Column]) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast(NO_ERRORS)


def _row_errors(contract: Contract, basic: list[Column], values: dict[str, Column], kinds: dict[str, T.DataType], strict_optional: bool) -> Column:
    """Errors of the fields; without any, the key check; without that, the schema's."""
    first = _listed(basic)
    null_key = F.lit(False)
    for k in contract.key_fields:
        null_key = null_key | values[k].isNull()
    rules = root_violations(contract.schema_json, [(f, values[f], kinds[f]) for f in contract.fields if f in values], strict_optional)
    schema = F.concat(*rules) if rules else F.array().cast(NO_ERRORS)
    keys = F.array(error(",".join(contract.key_fields), "null_key", "Key fields must not contain null values"))
    return F.when(F.size(first) > 0, first).when(null_key, keys).otherwise(schema)


def validated_rows(df: DataFrame, contract: Contract, strict_optional: bool = True) -> DataFrame:
    """``df`` plus ``normalized`` (struct) and ``errors`` (array).

    A contract field the frame lacks gives every row a ``missing_field`` error.  Columns
    the contract doesn't name stay, whatever they are called: one named ``normalized`` or
    ``errors`` gives way.  An empty frame gives an empty result.
    """
    basic: list[Column] = []
    values: dict[str, Column] = {}
    kinds: dict[str, T.DataType] = {}
    for f in contract.fields:
        if f not in df.columns:
            basic.append(error(f, "missing_field", f"Field '{f}' is absent in extracted row"))
            continue
        raw = F.col(f"`{f}`")
        value, message = coerce(raw, df.schema[f].dataType, contract.field_types.get(f))
        values[f] = value
        kinds[f] = df.select(value.alias("x")).schema["x"].dataType
        bad = []
        if f in contract.required_fields:
            bad.append((raw.isNull(), error(f, "required_field", f"Field '{f}' must not be null")))
        if message:
            bad.append((raw.isNotNull() & value.isNull(), error(f, "invalid_value", message)))
        if bad:
            c = F
            for cond, e in bad:
                c = c.when(cond, e)
            basic.append(c)
    normalized = F.struct(*[values.get(f, F.lit(None).cast(spark_type(contract, f))).alias(f) for f in contract.fields])
    errors = _row_errors(contract, basic, {f: values.get(f, F.lit(None)) for f in contract.fields}, {f: kinds.get(f, T.StringType()) for f in contract.fields}, strict_optional) if all(f in df.columns for f in contract.fields) else _listed(basic)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("normalized", "errors")], normalized.alias("normalized"), errors.alias("errors"))


def json_members(text: Column) -> Column:
    """Members of a JSON object as map<string,variant>; null if it isn't one."""
    return F.try_parse_json(text).try_cast("map<string,variant>")


def coerce_variant(v: Column, contract_type: str | None, shape: Column | None = None) -> tuple[Column, Column | None, str | None]:
    """(value, condition under which it is invalid, message) of a JSON member."""
    f, declared = family(contract_type), (contract_type or "").strip().lower()
    shape = F.schema_of_variant(v) if shape is None else shape
    is_null = v.isNull() | (shape == "VOID")
    get = lambda kind: F.try_variant_get(v, "$", kind)
    text = F.when(shape == "BOOLEAN", F.initcap(get("string"))).when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.to_json(v)).when(is_null, None).otherwise(get("string"))
    if f == "unknown" or declared in UNCOERCED or f in ("string", "uuid"):
        return text, None, None
    is_text, is_number = shape == "STRING", ~is_null & ~shape.isin("STRING", "BOOLEAN") & ~shape.startswith("OBJECT") & ~shape.startswith("ARRAY")
    s = F.when(is_text, get("string"))
    if f == "integer":
        value = F.when(is_number, F.coalesce(F.when(shape == "BIGINT", get("bigint")), get("decimal(38,6)").try_cast("bigint"))).when(s.rlike(INTEGER_TEXT), F.regexp_replace(F.trim(s), "_", "").try_cast("bigint"))
    elif f == "decimal":
        value = F.when(is_number, get("decimal(38,18)")).when(s.rlike(DECIMAL_TEXT), F.regexp_replace(F.trim(s), "_", "").try_cast("decimal(38,18)"))
    elif f == "boolean":
        low = F.lower(F.trim(s))
        value = F.when(shape == "BOOLEAN", get("boolean")).when(low.isin(*TRUE_TEXT), True).when(low.isin(*FALSE_TEXT), False)
    elif f in ("json", "array"):
        value = F.when(shape.startswith("ARRAY") | (shape.startswith("OBJECT") if f == "json" else F.lit(False)), F.to_json(v))
    else:
        value = coerce(s, T.StringType(), contract_type)[0]
    return value, ~is_null & value.isNull(), MESSAGES[f]


def _member(members: Column, name: str, contract: Contract, is_key: bool) -> Column:
    """struct(value, error) of one member; the variant and its type are looked at once."""

    def judge(b: Column) -> Column:
        v, shape = b["v"], b["shape"]
        value, invalid, message = coerce_variant(v, contract.field_types.get(name), shape)
        is_null = v.isNull() | (shape == "VOID")

        def told(x: Column) -> Column:
            e = F.when(~b["there"], error(name, "missing_field", f"{'Key field' if is_key else 'Field'} '{name}' is absent in extracted row"))
            if is_key:
                e = e.when(is_null, error(name, "null_key", f"Key field '{name}' must not be null"))
            elif name in contract.required_fields:
                e = e.when(is_null, error(name, "required_field", f"Field '{name}' must not be null"))
            if message is not None:
                e = e.when(~is_null & x["value"].isNull(), error(name, "invalid_value", message))
            return F.struct(x["value"].alias("value"), e.alias("error"))

        return let(F.struct(value.alias("value")), told)

    v = members[name]
    return let(F.struct(v.alias("v"), F.schema_of_variant(v).alias("shape"), F.map_contains_key(members, name).alias("there")), judge)


def judged_json(members: Column, contract: Contract, strict_optional: bool = True) -> Column:
    """struct(row, errors) of a row that came as a JSON object.

    Kept as one column it is computed once, whatever reads its two parts.
    """
    kinds = {"integer": T.LongType(), "decimal": T.DecimalType(38, 18), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(), "binary": T.BinaryType()}
    of = {f: kinds.get(family(contract.field_types.get(f)), T.StringType()) for f in contract.fields}
    at = {f: f"f{i}" for i, f in enumerate(contract.fields)}

    def judge(p: Column) -> Column:
        values = {f: p[at[f]]["value"] for f in contract.fields}
        errors = _row_errors(contract, [p[at[f]]["error"] for f in contract.fields], values, of, strict_optional)
        return F.struct(F.struct(*[values[f].alias(f) for f in contract.fields]).alias("row"), errors.alias("errors"))

    return let(members, lambda m: let(F.struct(*[_member(m, f, contract, False).alias(at[f]) for f in contract.fields]), judge))


def judged_keys(members: Column, contract: Contract) -> Column:
    """struct(row, errors) of the key part of a JSON object; the schema isn't applied."""
    at = {f: f"f{i}" for i, f in enumerate(contract.key_fields)}

    def judge(p: Column) -> Column:
        return F.struct(F.struct(*[p[at[f]]["value"].alias(f) for f in contract.key_fields]).alias("row"), _listed([p[at[f]]["error"] for f in contract.key_fields]).alias("errors"))

    return let(members, lambda m: let(F.struct(*[_member(m, f, contract, True).alias(at[f]) for f in contract.key_fields]), judge))


def validated_json(members: Column, contract: Contract, strict_optional: bool = True) -> tuple[Column, Column]:
    """(normalized struct, errors) of a row that came as a JSON object."""
    both = judged_json(members, contract, strict_optional)
    return both["row"], both["errors"]


def validated_keys(members: Column, contract: Contract) -> tuple[Column, Column]:
    """(key struct, errors) of the key part of a JSON object."""
    both = judged_keys(members, contract)
    return both["row"], both["errors"]


def numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``row_number`` from 1 in key order, without bringing all rows into one task.

    Rows are range-partitioned and sorted, written to the checkpoint folder, and numbered
    by their partition's offset.  Ties are ordered by a hash over the row.
    """
    from tidemark.session import shared_dir

    plain = [c for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
    order = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    tie = row_hash64([F.col(f"`{c}`") for c in plain])
    ranged = df.withColumn("__tie", tie).repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, "__tie").drop("__tie")
    if not df.sparkSession.sparkContext.getCheckpointDir():
        shared_dir(df.sparkSession, "numbered")
    kept = ranged.withColumn("__part", F.spark_partition_id()).checkpoint()
    counts = sorted((r["__part"], r["n"]) for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    if not offsets:
        return kept.drop("__part").withColumn("row_number", F.lit(0).cast("bigint"))
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __offset bigint"))
    # The low 33 bits count the rows of a partition; kept's partitions are the sorted ones.
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("__at", inner).join(table, "__part").withColumn("row_number", F.col("__offset") + F.col("__at") + 1).drop("__part", "__offset", "__at")


DUPLICATE_SALTS = 16


def with_duplicates(validated: DataFrame, contract: Contract, order: Sequence[Column]) -> DataFrame:
    """Adds ``duplicate_key`` to rows whose key an earlier valid row has.

    Only valid rows compete: an invalid row doesn't reserve its key.  The first by
    ``order`` is kept; rows equal in it are told apart by a hash over their values, so
    the choice is the same in every run.  A key's rows are ranked within salts first and
    only the winners meet, so a key with a third of all rows isn't one task's.
    """
    keys = [F.col("normalized").getField(k) for k in contract.key_fields]
    duplicate = F.array(error(",".join(contract.key_fields), "duplicate_key", "Another row has the same key"))
    tie = F.xxhash64(F.to_json(F.struct(*[F.col("normalized").getField(f) for f in contract.fields])))
    order = [*order, F.col("__tie")]
    rows = validated.withColumn("__tie", tie)
    valid = rows.where(F.size("errors") == 0).withColumn("__salt", F.pmod(F.col("__tie"), F.lit(DUPLICATE_SALTS)))
    ranked = valid.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order)))
    winners = ranked.where("__rank = 1").withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    judged = winners.unionByName(ranked.where("__rank > 1")).withColumn("errors", F.when(F.col("__rank") > 1, duplicate).otherwise(F.col("errors")))
    return rows.where(F.size("errors") > 0).drop("__tie").unionByName(judged.drop("__rank", "__salt", "__tie"))


def error_rows(validated: DataFrame, carry: Sequence[str] = ("row_number",)) -> DataFrame:
    """One row per error, with its place in the row's list."""
    return validated.select(*carry, F.posexplode_outer("errors").alias("error_index", "e")).where("e is not null").select(*carry, "error_index", "e.*")


def accepted_rows(validated: DataFrame, contract: Contract, hash_input: str = "normalized") -> DataFrame:
    """Contract fields and ``row_hash`` of the rows without errors.

    ``hash_input``: ``normalized`` hashes coerced values, ``raw`` the source's own.
    """
    good = validated.where(F.size("errors") == 0)
    if hash_input == "raw":
        hashed = good.withColumn("__hash", row_hash(good, list(contract.effective_hash_fields), "raw"))
        return hashed.select("normalized.*", F.col("__hash").alias("row_hash"))
    if hash_input != "normalized":
        raise ValueError("hash_input must be 'normalized' or 'raw'")
    rows = good.select("normalized.*")
    return rows.withColumn("row_hash", row_hash(rows, list(contract.effective_hash_fields)))


def error_preview(errors: DataFrame, limit: int = 5, order: Sequence[str] = ("row_number", "error_index")) -> list:
    """The first few errors (a report, so it ends at ``limit``)."""
    return errors.orderBy(*order).limit(limit).collect()


def summarize(errors: Sequence) -> str:
    """One line for a log."""
    said = [f"row {e['row_number']}, field {e['field']}, code {e['code']}: {e['message']}" for e in errors]
    return "; ".join(said) or "no validation error details captured"
