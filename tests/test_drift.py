import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift

CONTRACTS = "contract_id string, version string, published_at timestamp, schema_json string, fields array<string>, field_types map<string,string>, primary_keys array<string>, business_keys array<string>"
LANDED = "contract_id string, version string, file_id long, line_in_file int, landed_at timestamp, payload string, typed string"


def day(n):
    return dt.datetime(2025, 1, n)


def contracts(spark, versions, cid="c"):
    rows = []
    for i, (v, props) in enumerate(versions):
        rows.append((cid, v, day(i + 1), json.dumps({"type": "object", "properties": props}) if props is not None else None, list(props or ["id"]), {}, ["id"], []))
    return spark.createDataFrame(rows, CONTRACTS)


def landed(spark, rows):
    return spark.createDataFrame([("c", v, f, i, day(20), p if p is None or isinstance(p, str) else json.dumps(p), "clash") for i, (v, f, p) in enumerate(rows)], LANDED)


def changes(spark, versions, rows=()):
    got = drift.schema_changes(contracts(spark, versions), landed(spark, rows) if rows else None)
    return sorted((r["version"], r["change"], r["field"], r["old_field"]) for r in got.collect())


ID = {"id": {"type": "integer"}}


def test_added_removed_retyped(spark):
    got = changes(spark, [("v9", ID | {"a": {"type": "string"}, "d": {"type": "string"}}), ("v10", ID | {"a": {"type": ["null", "string"]}, "b": {"type": "number"}, "d": {"type": "string", "format": "date"}})])
    assert got == [("v10", "added", "b", ""), ("v10", "retyped", "d", "")]


def test_versions_follow_publication_and_count_once(spark):
    versions = [("2.0", ID | {"a": {"type": "string"}}), ("1.9", ID), ("2.0", ID | {"a": {"type": "string"}})]
    assert changes(spark, versions) == [("1.9", "removed", "a", "")]


@pytest.mark.parametrize("extra", [{"x-formerName": "a"}, {"$comment": "called a before"}])
def test_noted_renames(spark, extra):
    got = changes(spark, [("1", {"a": {"type": "integer"}} | ID), ("2", ID | {"z": {"type": "string"}, "b": {"type": "integer"} | extra})])
    assert got == [("2", "added", "z", ""), ("2", "renamed", "b", "a")]


def test_described_renames_and_lookalikes(spark):
    got = changes(spark, [("1", ID | {"a": {"type": "number", "description": "Weight."}, "p": {"type": "string", "description": "Place"}}), ("2", ID | {"b": {"type": "number", "description": "Weight"}, "q": {"type": "string", "description": "Price"}})])
    assert got == [("2", "added", "q", ""), ("2", "removed", "p", ""), ("2", "renamed", "b", "a")]


def test_values_decide_where_nothing_is_described(spark):
    versions = [("1", ID | {"a": {"type": "integer"}, "c": {"type": "integer"}}), ("2", ID | {"x": {"type": "integer"}, "y": {"type": "integer"}})]
    rows = [("1", 1, {"id": i, "a": i * 7 + 1, "c": i + 100}) for i in range(9)] + [("2", 2, {"id": str(i), "y": str(i * 7 + 1), "x": 1}) for i in range(9)]
    assert changes(spark, versions, rows) == [("2", "added", "x", ""), ("2", "removed", "c", ""), ("2", "renamed", "y", "a")]
    assert ("2", "renamed", "x", "a") in changes(spark, versions)  # without values: place and type


def test_payloads():
    texts = ('{"a":1,"b":{"c": 2.50, "d":[true,null,"\u00e9"]}}', '{"a":1', '{"a":1} x', '{"a":1} {"b":2}', "{'a':1}", "[1]", "null", "", None, '{"a":null}', '{"a":1,"a":2}', '{"a":NaN}', "[" * 5000, '{"a": 1e2, "b": true}')
    assert [drift.payload_members(t) for t in texts] == [{"a": "1", "b": '{"c":2.50,"d":[true,null,"\u00e9"]}'}, *[None] * 8, {"a": None}, None, None, None, {"a": "1e2", "b": "true"}]


def test_repeated_names_are_found_however_they_hide():
    bad = ['{"a" :1,"b":2,"b":3}', '{"a":"\\"","a":2}', '{"a":{"x":1,"x":2}}', '{"a":[{"x":1,"x":"2"}]}', '{"a":"1","a":"1"}', '{"\\u0061":1,"a":2}']
    good = ['{"a":"x\\"y:\\":"}', '{"a":{"x":{"y":1}},"b":[["c",{"d":"e"}]]}', '{"a" : [ "b", 1 ], "c" : {"d" : "e"}}']
    assert [drift.payload_members(t) for t in bad] == [None] * len(bad)
    assert [drift.payload_members(t) for t in good] == [{"a": 'x"y:":'}, {"a": '{"x":{"y":1}}', "b": '[["c",{"d":"e"}]]'}, {"a": '["b",1]', "c": '{"d":"e"}'}]


def test_both_ways_to_tell_what_can_be_cast_agree(spark):
    texts = [
        "", " ", "1", " 12 ", "-7", "+7", "1.5", ".5", "5.", "1e5", "1e", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "0" * 30 + "1", "abc", "true", " FALSE ", "yes", "[1]", " [", "{}", "x{",
        "2025-02-28", "2025-02-30", "2025-2-3", "2025-02-28T10:00", "2025-02-28 10:00:00", "2025-02-28T10:00:00.123456Z", "2025-02-28T25:00:00Z", "2025-02-30T10:00:00Z", "2025-02-28T10:00:00+02:00", "2025-02-28T10:61",
        "123e4567-e89b-12d3-a456-426614174000", "123e4567e89b12d3a456426614174000", "\u0661",
    ]
    kinds = ["integer", "number", "boolean", "array", "object", "string", "string/date", "string/date-time", "string/uuid", "string/email", "other"]
    df = spark.createDataFrame([(t, k) for t in texts for k in kinds], "v string, k string")
    got = df.select("v", "k", drift.castable(F.col("v"), F.col("k")).alias("ok")).collect()
    assert [(r["v"], r["k"]) for r in got if bool(r["ok"]) != (drift.fits(r["k"]) is None or bool(drift.fits(r["k"])(r["v"])))] == []


def ingest(spark, versions, rows):
    return drift.rescue_ingest(landed(spark, rows), contracts(spark, versions))


V = [("1", ID | {"n": {"type": "integer"}, "d": {"type": "string", "format": "date"}})]


def test_rescue_keeps_what_does_not_fit(spark):
    rows = [("1", 1, {"id": 1, "n": "12", "d": "2025-01-02"}), (None, 1, {"id": 2, "n": 1.5, "d": "soon", "Extra": [1]}), ("1", 1, '{"id": 3'), ("1", 1, None)]
    got = {r["line_in_file"]: r for r in ingest(spark, V, rows).collect()}
    assert got[0]["typed"] == {"id": "1", "n": "12", "d": "2025-01-02"} and got[0]["rescued"] == "{}"
    assert got[1]["typed"] == {"id": "2"} and json.loads(got[1]["rescued"]) == {"n": "1.5", "d": "soon", "Extra": "[1]"}
    assert got[1]["undeclared"] == {"Extra": "[1]"} and got[1]["file_version"] == "1"
    assert not got[2]["well_formed"] and got[2]["rescued"] == '{"id": 3' and got[3]["rescued"] is None
    beyond = drift.undeclared_fields(ingest(spark, V, rows)).collect()
    assert [(r["file_id"], r["field"], r["file_version"]) for r in beyond] == [(1, "Extra", "1")]


def test_file_without_any_version_takes_the_one_in_force(spark):
    versions = [("1", ID), ("2", ID | {"n": {"type": "integer"}})]
    got = ingest(spark, versions, [(None, 5, {"id": 1, "n": 2})]).collect()
    assert got[0]["file_version"] == "2" and got[0]["undeclared"] == {}


def test_promotion_replays_rescued_values(spark):
    rows = [("1", 1, {"id": 1, "x": "7"}), ("1", 1, {"id": 2, "x": "seven"}), ("1", 1, {"id": 3})]
    once = drift.promote(ingest(spark, V, rows), {"x": "integer"})
    got = {r["line_in_file"]: (r["typed"].get("x"), r["rescued"]) for r in once.collect()}
    assert got == {0: ("7", "{}"), 1: (None, '{"x":"seven"}'), 2: (None, "{}")}
    assert drift.promote(once, {"x": "integer"}).select("typed", "rescued").collect() == once.select("typed", "rescued").collect()


def test_one_table_under_current_names(spark):
    versions = [("1", ID | {"a": {"type": "integer"}}), ("2", ID | {"b": {"type": "integer", "x-formerName": "a"}}), ("3", ID | {"c": {"type": "integer", "x-formerName": "b"}})]
    rows = [("1", 1, {"id": 1, "a": 5}), ("2", 2, {"id": 2, "b": 6}), ("3", 3, {"id": 3, "c": 7}), ("1", 4, {"id": 4, "c": 9})]
    c = contracts(spark, versions)
    table = drift.consistent_rows(ingest(spark, versions, rows), drift.current_names(drift.schema_changes(c), c))
    typed = drift.contract_table(table, "c", {"id": "integer", "c": "integer"})
    assert sorted((r["id"], r["c"]) for r in typed.collect() if r["c"]) == [(1, 5), (2, 6), (3, 7)]


def test_empty_and_broken_metadata(spark):
    none = contracts(spark, []) if False else spark.createDataFrame([], CONTRACTS)
    assert drift.schema_changes(none).count() == 0
    assert drift.rescue_ingest(landed(spark, []), none).count() == 0
    assert drift.rescue_ingest(landed(spark, [("1", 1, {"id": 1})]), none).collect()[0]["undeclared"] == {"id": "1"}
    odd = spark.createDataFrame([("c", "1", day(1), "not json", ["id"], {"id": "integer"}, None, None), ("c", None, day(1), None, None, None, None, None), ("c", "2", day(2), None, None, None, None, None)], CONTRACTS)
    assert [(r["change"], r["field"]) for r in drift.schema_changes(odd).collect()] == []


def test_current_kinds_replay_values_under_old_names(spark):
    versions = [("1", ID | {"a": {"type": "integer"}}), ("2", ID | {"b": {"type": "string", "x-formerName": "a"}, "c": {"type": "number"}})]
    rows = [("1", 1, {"id": 1, "a": "many", "c": "2.5", "z": 1}), ("2", 2, {"id": 2, "b": "few", "c": "x"}), ("1", 3, {"id": 3, "a": 4, "b": "five"})]
    c = contracts(spark, versions)
    fields = drift.schema_fields(c)
    names = drift.current_names(drift.schema_changes(c, fields=fields), c, fields)
    kinds = drift.current_kinds(fields, names)
    promoted = drift.promote(drift.stored_ingest(landed(spark, rows), c, fields=fields), kinds)
    got = {r["file_id"]: (dict(r["row"]), r["rescued"]) for r in drift.consistent_rows(promoted, names).collect()}
    assert got == {1: ({"id": "1", "b": "many", "c": "2.5"}, '{"z":"1"}'), 2: ({"id": "2", "b": "few"}, '{"c":"x"}'), 3: ({"id": "3", "b": "five"}, "{}")}


def test_very_long_and_empty_payloads(spark):
    rows = [("1", 1, {"id": 1, "x": "y" * 1_000_000}), ("1", 1, "{}"), ("1", 1, "")]
    got = {r["line_in_file"]: r for r in ingest(spark, V, rows).collect()}
    assert len(got[0]["undeclared"]["x"]) == 1_000_000 and got[1]["well_formed"] and got[1]["rescued"] == "{}" and not got[2]["well_formed"] and got[2]["typed"] == {}


def test_values_of_an_older_type_are_kept_beside_the_column(spark):
    versions = [("1", ID | {"a": {"type": "number"}}), ("2", ID | {"a": {"type": "integer"}})]
    rows = [("1", 1, {"id": 1, "a": 2.5}), ("2", 2, {"id": 2, "a": 3})]
    c = contracts(spark, versions)
    fields = drift.schema_fields(c)
    table = drift.contract_table(drift.consistent_rows(ingest(spark, versions, rows), drift.current_names(drift.schema_changes(c, fields=fields), c, fields)), "c", {"id": "integer", "a": "integer"})
    assert sorted((r["id"], r["a"], r["_untyped"]) for r in table.collect()) == [(1, None, '{"a":"2.5"}'), (2, 3, None)]
