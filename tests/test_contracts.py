import json

import pytest
from pyspark.sql import types as T

from tidemark.contract.model import Contract, ContractPayloadError, contract_type, load_contract_file, parse_registry_payload, parse_table_name, validate_identifier
from tidemark.contract.registry import ContractRegistry, FileRegistry, RegistryHTTPError, RegistryRequestError, Response
from tidemark.contract.types import check_source, contract_schema, family, hash_state_name, hash_state_schema, spark_type

PAYLOAD = {
    "contract": {"id": "sales.orders", "target_layer": "curated"},
    "version": {"version": "1.0.0", "checksum": "abc", "schema_json": {"type": "object", "properties": {"id": {"type": "integer"}, "at": {"type": "string", "format": "date-time"}, "x": {}, "u": {"type": ["null", "number"]}}, "required": ["id", " id ", 3, ""], "x-primaryKey": ["id"], "x-hashKeys": ["at"]}},
}


def simple(**more):
    return Contract(**({"contract_id": "c", "version": "1", "fields": ("id", "status"), "primary_keys": ("id",)} | more))


def test_keys_and_hash_fields():
    c = simple(business_keys=("status",))
    assert c.key_fields == ("id",) and c.effective_hash_fields == ("id", "status")
    assert simple(primary_keys=(), business_keys=("status",)).key_fields == ("status",)
    assert simple(hash_keys=("status",)).effective_hash_fields == ("status",)
    assert not c.nullable("id") and c.nullable("status") and not simple(required_fields=("status",)).nullable("status")


@pytest.mark.parametrize("bad", [{"contract_id": ""}, {"fields": ()}, {"primary_keys": ()}, {"schema_json": []}, {"primary_keys": ("zz",)}, {"hash_keys": ("zz",)}, {"field_types": {"zz": "string"}}, {"required_fields": ("zz",)}])
def test_rules(bad):
    with pytest.raises(ValueError):
        simple(**bad).check()
    simple().check()


def test_registry_payload():
    for p in (PAYLOAD, {"data": PAYLOAD}):
        c = parse_registry_payload(p)
        assert c.fields == ("id", "at", "x", "u") and dict(c.field_types) == {"id": "integer", "at": "timestamp", "u": "decimal"}
        assert c.required_fields == ("id",) and c.primary_keys == ("id",) and c.hash_keys == ("at",)


@pytest.mark.parametrize("path,value", [(("contract", "id"), " "), (("version", "checksum"), None), (("version", "schema_json"), None), (("version", "schema_json", "properties"), {}), (("version", "schema_json", "type"), "array")])
def test_bad_payloads(path, value):
    p = json.loads(json.dumps(PAYLOAD))
    at = p
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    with pytest.raises(ContractPayloadError):
        parse_registry_payload(p)
    with pytest.raises(ContractPayloadError):
        parse_registry_payload([p])


def test_types():
    assert contract_type({"type": "string", "format": "uuid"}) == "uuid" and contract_type({"type": "object"}) == "json" and contract_type({}) is None
    assert [family(x) for x in ("BIGINT", "double precision", "array<x>", "", None, "jsonb", "geo")] == ["integer", "decimal", "array", "unknown", "unknown", "json", "unknown"]
    c = simple(fields=("id", "b", "m"), field_types={"id": "bigint", "m": "money"}, schema_json={"type": "object", "properties": {"b": {"type": "string", "format": "byte"}}})
    assert isinstance(spark_type(c, "b"), T.BinaryType) and contract_schema(c)["m"].dataType == T.DecimalType(38, 18)
    assert hash_state_schema(c).fieldNames() == ["id", "row_hash"] and len(hash_state_name("t" * 80)) == 63


def test_source_check():
    c = simple(field_types={"id": "integer", "status": "string"})
    s = T.StructType().add("id", "long").add("status", "string").add("more", "double")
    check_source(s, c)
    with pytest.raises(ValueError, match="lacks"):
        check_source(T.StructType().add("id", "long"), c)
    with pytest.raises(ValueError, match="id.*status|status"):
        check_source(T.StructType().add("id", "string").add("status", "boolean"), c)
    with pytest.raises(ValueError, match="unsupported"):
        check_source(s, simple(field_types={"id": "geometry"}))


def test_identifiers():
    assert parse_table_name("orders") == ("public", "orders") and parse_table_name("a.b") == ("a", "b")
    for bad in ("a.b.c", 'x"; drop', "1a", ""):
        with pytest.raises(ValueError):
            parse_table_name(bad)
    with pytest.raises(ValueError):
        validate_identifier("a-b")


def registry(answers, **more):
    calls, slept = [], []

    def get(url, headers, timeout):
        calls.append((url, headers))
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    return ContractRegistry("http://r/", get=get, sleep=slept.append, **more), calls, slept


OK = Response(200, json.dumps(PAYLOAD).encode())


def test_registry_retries_with_growing_pauses():
    r, calls, slept = registry([Response(503, b"x"), TimeoutError("t"), Response(429, b""), OK], max_backoff=1.5)
    assert r.fetch("ns", "n").contract_id == "sales.orders" and slept == [0.5, 1.0, 1.5]
    assert calls[0][0] == "http://r/contracts/ns/n/active"


def test_registry_failures():
    r, _, slept = registry([Response(404, b"none")])
    with pytest.raises(RegistryHTTPError) as e:
        r.fetch("ns", "n", "3")
    assert e.value.status == 404 and e.value.endpoint.endswith("/version/3") and not slept
    with pytest.raises(RegistryRequestError):
        registry([OSError("down")] * 4)[0].fetch("a", "b")
    with pytest.raises(ContractPayloadError):
        registry([Response(200, b"<html>")])[0].fetch("a", "b")


def test_registry_tokens():
    r, calls, _ = registry([OK, OK], token_provider=lambda: "made")
    r.fetch("a", "b")
    r.token = "given"
    r.fetch("a", "b")
    assert [c[1]["Authorization"] for c in calls] == ["Bearer made", "Bearer given"]


def test_contract_files(tmp_path):
    (tmp_path / "ns" / "n").mkdir(parents=True)
    (tmp_path / "ns" / "n" / "active.json").write_text(json.dumps(PAYLOAD))
    assert FileRegistry(str(tmp_path)).fetch("ns", "n").version == "1.0.0"
    raw = tmp_path / "raw.json"
    raw.write_text(json.dumps({"contract_id": "c", "fields": ["id"], "primary_keys": ["id"]}))
    assert load_contract_file(str(raw)).fields == ("id",)
    assert load_contract_file(str(tmp_path / "ns" / "n" / "active.json")).contract_id == "sales.orders"
