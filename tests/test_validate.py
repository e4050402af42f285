"""Compiled expressions against a plain row-by-row oracle written from the same rules."""

import base64
import datetime as dt
import decimal
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.contract.model import Contract
from tidemark.operators.validate import accepted_rows, error_preview, error_rows, json_members, numbered, summarize, validated_json, validated_keys, validated_rows, with_duplicates

SCHEMA = {
    "type": "object",
    "properties": {
        "run": {"type": "integer", "exclusiveMinimum": 0, "title": "Run", "description": "Number of the dive"},
        "taken": {"type": "string", "format": "date"},
        "unit": {"type": "string", "const": "m"},
        "grade": {"type": ["string", "null"], "pattern": "^[A-C]"},
        "depths": {"type": "array", "minItems": 2, "maxItems": 4, "items": {"type": "number", "exclusiveMinimum": 0}},
        "probe": {
            "type": "object", "additionalProperties": False, "required": ["serial", "site"],
            "properties": {"serial": {"type": "integer", "minimum": 1}, "site": {"type": "object", "required": ["lat"], "properties": {"lat": {"type": "number", "minimum": -90, "maximum": 90}, "name": {"type": "string", "minLength": 3, "maxLength": 9}}}},
        },
    },
}
FULL = Contract("soundings", "1", ("run", "taken", "unit", "grade", "depths", "probe"), {"run": "integer", "taken": "date", "unit": "string", "grade": "string", "depths": "array", "probe": "json"}, ("run",), ("run",), schema_json=SCHEMA)
GOOD = {"run": 4, "taken": "2025-02-03", "unit": "m", "grade": "B1", "depths": [0.5, 2], "probe": {"serial": 7, "site": {"lat": 12.5}}}


def judge(spark, rows, contract=FULL, **more):
    df = spark.createDataFrame([(i, None if r is None else r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "i long, j string")
    m = F.coalesce(json_members(F.col("j")), F.create_map().cast("map<string,variant>"))
    n, e = validated_json(m, contract, **more)
    got = df.select("i", n.alias("n"), e.alias("e")).orderBy("i").collect()
    return [[(x["field"], x["code"]) for x in r["e"]] for r in got], got


def test_good_row_and_every_kind_of_violation(spark):
    errors, rows = judge(spark, [
        GOOD,
        GOOD | {"run": 0, "unit": "ft", "grade": "D", "depths": [1], "probe": {"serial": 0, "extra": 1, "site": {"lat": 91, "name": "x"}}},
        GOOD | {"grade": None, "depths": [0, 1, "deep", 2, 3], "probe": {"serial": "x"}},
        GOOD | {"run": "1.5", "taken": "2025-2-3", "depths": "[]", "probe": "{}"},
        {k: v for k, v in GOOD.items() if k != "grade"},
        GOOD | {"run": None},
        "[1]", None, "",
    ])
    assert errors[0] == []
    assert errors[1] == [
        ("run", "schema.exclusive_minimum"), ("unit", "schema.const"), ("grade", "schema.pattern"), ("depths", "schema.min_items"), ("probe.extra", "schema.additional_properties"), ("probe.serial", "schema.minimum"),
        ("probe.site.lat", "schema.maximum"), ("probe.site.name", "schema.min_length"),
    ]
    assert errors[2] == [("depths", "schema.max_items"), ("depths[0]", "schema.exclusive_minimum"), ("depths[2]", "schema.type"), ("probe.site", "schema.required"), ("probe.serial", "schema.type")]
    assert errors[3] == [("run", "invalid_value"), ("taken", "invalid_value"), ("depths", "invalid_value"), ("probe", "invalid_value")]
    assert errors[4] == [("grade", "missing_field")] and errors[5] == [("run", "required_field")]
    assert all(e == [(f, "missing_field") for f in FULL.fields] for e in errors[6:])
    v = rows[1]["e"][0]
    assert v["contract_title"] == "Run" and v["contract_description"] == "Number of the dive" and v["constraint"] == "exclusiveMinimum=0" and v["actual_value"] == "0" and "Contract title: Run." in v["message"]


def test_optional_null_breaks_a_declared_type_unless_told_otherwise(spark):
    c = Contract("c", "1", ("id", "x"), {"id": "integer", "x": "string"}, primary_keys=("id",), schema_json={"type": "object", "properties": {"x": {"type": "string", "minLength": 1}}})
    assert judge(spark, [{"id": 1, "x": None}], c)[0] == [[("x", "schema.type")]]
    assert judge(spark, [{"id": 1, "x": None}, {"id": 1, "x": ""}], c, strict_optional=False)[0] == [[], [("x", "schema.min_length")]]


@pytest.mark.parametrize("schema", [{}, {"type": "array"}, {"type": "object"}, {"properties": {"x": {"type": "integer"}}}])
def test_roots_that_are_not_objects_with_properties_are_skipped(spark, schema):
    c = Contract("c", "1", ("id", "x"), {"id": "integer"}, primary_keys=("id",), schema_json=schema)
    assert judge(spark, [{"id": 1, "x": "text"}], c)[0] == [[]]


def test_constants_compare_numbers_by_value(spark):
    def errors(prop, value):
        c = Contract("c", "1", ("id", "x"), {"id": "integer", "x": "decimal" if not isinstance(value, (bool, str)) else "boolean" if isinstance(value, bool) else "string"}, primary_keys=("id",), schema_json={"type": "object", "properties": {"x": prop}})
        return judge(spark, [{"id": 1, "x": value}], c)[0][0]

    assert errors({"enum": [1.1]}, 1.10) == [] and errors({"const": 1}, 1.0) == []
    assert errors({"const": 1}, True) == [("x", "schema.const")] and errors({"enum": [True]}, True) == []
    assert errors({"const": "1"}, 1) == [("x", "schema.const")]


def python_coerce(v, kind):
    """(ok, value) by the documented rules."""
    if v is None:
        return True, None
    if kind == "integer":
        if isinstance(v, bool) or isinstance(v, (list, dict)):
            return False, None
        try:
            n = int(v)
        except (ValueError, OverflowError):
            return False, None
        return (True, n) if -(2**63) <= n < 2**63 else (False, None)
    if kind == "boolean":
        if isinstance(v, bool):
            return True, v
        low = v.strip().lower() if isinstance(v, str) else None
        return (True, low in ("true", "1", "yes", "y")) if low in ("true", "1", "yes", "y", "false", "0", "no", "n") else (False, None)
    if kind == "decimal":
        if isinstance(v, (bool, list, dict)):
            return False, None
        try:
            d = decimal.Decimal(str(v))
        except decimal.InvalidOperation:
            return False, None
        return (True, d) if d.is_finite() else (False, None)
    if kind == "date":
        try:
            return (True, dt.date.fromisoformat(v)) if isinstance(v, str) and len(v) == 10 else (False, None)
        except ValueError:
            return False, None
    if kind == "binary":
        try:
            return (True, base64.b64decode(v, validate=True)) if isinstance(v, str) else (False, None)
        except ValueError:
            return False, None
    return True, v


def test_coercion_against_plain_rules(spark):
    rng = random.Random(1)
    pool = [None, True, False, 0, 1, -7, 12, 2**63, 3.7, -3.7, 1e3, "12", " 13 ", "1_000", "3.5", "0x1", "", "true", "Yes", "n", "t", "1e3", "-0.50", ".5", "5.", "NaN", "inf", "2025-01-02", "2025-1-2", "2025-13-01", "aGk=", "aGk", "!!!!", [1], {"a": 1}, "abc"]
    for kind in ("integer", "boolean", "decimal", "date", "binary"):
        c = Contract("c", "1", ("id", "x"), {"id": "integer", "x": kind}, primary_keys=("id",))
        values = rng.sample(pool, len(pool))
        errors, rows = judge(spark, [{"id": 1, "x": v} for v in values], c)
        for v, e, r in zip(values, errors, rows):
            ok, value = python_coerce(v, kind)
            assert (e == []) == ok, (kind, v, e)
            if ok and value is not None:
                assert r["n"]["x"] == value or float(r["n"]["x"]) == float(value), (kind, v, r["n"]["x"])


def test_key_rows(spark):
    c = Contract("c", "1", ("a", "b", "z"), {"a": "integer", "b": "integer"}, primary_keys=("a", "b"))
    df = spark.createDataFrame([('{"a":1,"b":"2","z":[]}',), ('{"a":null}',), ('{"a":"x","b":1}',)], "j string")
    _, e = validated_keys(json_members(F.col("j")), c)
    assert [[(x["field"], x["code"]) for x in r["e"]] for r in df.select(e.alias("e")).collect()] == [[], [("a", "null_key"), ("b", "missing_field")], [("a", "invalid_value")]]


TABLE = Contract("t", "1", ("id", "n"), {"id": "string", "n": "integer"}, ("n",), ("id",))


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "id string, n string, errors string, extra int")


def test_duplicates_count_valid_rows_only(spark):
    rows = [("k", "x"), ("k", "1"), ("k", "2"), ("k", "2"), (None, "1"), (None, "1"), ("m", None)]
    v = with_duplicates(validated_rows(numbered(table(spark, rows), ["id"]), TABLE), TABLE, [F.col("row_number")])
    got = sorted(tuple(e["code"] for e in r["errors"]) for r in v.collect())
    assert got == [(), ("duplicate_key",), ("duplicate_key",), ("invalid_value",), ("null_key",), ("null_key",), ("required_field",)]
    assert accepted_rows(v, TABLE).count() == 1


def test_a_key_with_most_rows(spark):
    v = with_duplicates(validated_rows(table(spark, [("k", str(i)) for i in range(400)] + [("l", "1")]), TABLE), TABLE, [F.col("n").cast("int")])
    good = accepted_rows(v, TABLE).collect()
    assert sorted((r["id"], r["n"]) for r in good) == [("k", 0), ("l", 1)] and error_rows(v, ["id"]).count() == 399


def test_missing_column_and_empty_frames(spark):
    v = validated_rows(table(spark, [("a", "1")]).drop("n"), TABLE)
    assert [(e["field"], e["code"]) for e in v.first()["errors"]] == [("n", "missing_field")]
    empty = with_duplicates(validated_rows(numbered(table(spark, []), ["id"]), TABLE), TABLE, [F.col("row_number")])
    assert empty.count() == 0 and accepted_rows(empty, TABLE).columns == ["id", "n", "row_hash"]


def test_row_numbers_and_preview(spark):
    rows = [(f"k{i % 50:02d}", "x" if i % 2 else "1") for i in range(300)]
    n = numbered(table(spark, rows), ["id"])
    got = [(r["row_number"], r["id"]) for r in n.orderBy("row_number").collect()]
    assert [a for a, _ in got] == list(range(1, 301)) and [b for _, b in got] == sorted(r[0] for r in rows)
    shown = error_preview(error_rows(validated_rows(n, TABLE)))
    assert len(shown) == 5 and summarize(shown).startswith("row ") and summarize([]) == "no validation error details captured"


def test_hash_of_raw_and_normalized_values(spark):
    c = Contract("t", "1", ("id", "n"), {"id": "string", "n": "integer"}, primary_keys=("id",), hash_keys=("n",))
    v = validated_rows(table(spark, [("a", " 1_0 ")]), c)
    assert accepted_rows(v, c).first()["row_hash"] != accepted_rows(v, c, "raw").first()["row_hash"]
    with pytest.raises(ValueError):
        accepted_rows(v, c, "other")
