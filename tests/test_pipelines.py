import datetime as dt
import decimal
import json

import pytest
from pyspark.sql import functions as F

from tidemark.contract.model import Contract, ContractValidationError
from tidemark.operators import delta as d
from tidemark.operators import pipelines as p
from tidemark.session import path_exists, shared_dir
from tidemark.sources import store

C = Contract(
    "sales.orders", "1", ("order_id", "customer_id", "amount", "status", "updated_at"),
    {"order_id": "integer", "customer_id": "integer", "amount": "decimal", "status": "string", "updated_at": "timestamp"}, ("order_id",), ("order_id",), hash_keys=("customer_id", "amount", "status", "updated_at"),
    schema_json={"type": "object", "properties": {"status": {"type": "string", "minLength": 1}}},
)
T0 = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
SOURCE = "order_id long, customer_id long, amount decimal(12,2), status string, updated_at timestamp"


def source(spark, rows):
    return spark.createDataFrame([(k, k * 10, decimal.Decimal(a), s, T0) for k, a, s in rows], SOURCE)


def keys(t):
    return sorted((r["order_id"], r["status"]) for r in t.curated().collect())


def counts(r):
    return tuple(r[k] for k in ("insert_count", "update_count", "unchanged_count", "delete_count"))


FIRST, SECOND = [(1, "1.00", "a"), (2, "2.00", "b"), (3, "3.00", "c")], [(1, "1.00", "a"), (2, "2.50", "b2"), (4, "4.00", "d")]


def test_two_runs_and_a_rerun(spark):
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C)
    assert counts(p.run_hash_diff(source(spark, FIRST), t)) == (3, 0, 0, 0)
    assert counts(p.run_hash_diff(source(spark, SECOND), t)) == (1, 1, 1, 1) and keys(t) == [(1, "a"), (2, "b2"), (4, "d")]
    v = t.version()
    assert counts(p.run_hash_diff(source(spark, SECOND), t)) == (0, 0, 3, 0) and t.version() == v
    assert t.curated().columns == list(C.fields) and t.hash_state().columns == ["order_id", "row_hash"]
    assert counts(p.run_hash_diff(source(spark, []), t)) == (0, 0, 0, 3) and keys(t) == []
    assert keys_at(t, 1) == [1, 2, 3]
    t.vacuum(1)
    assert not path_exists(spark, f"{t.root}/data/v=1/__bucket=0") and path_exists(spark, f"{t.root}/manifests/v={t.version()}.json") and t.curated().count() == 0


def keys_at(t, v):
    return sorted(r["order_id"] for r in t.curated(v).collect())


def test_snapshot_is_landed_merged_and_replayed(spark):
    out = shared_dir(spark, "land")
    r = p.validate_and_land_snapshot(source(spark, FIRST), C, out)
    assert (r["source_row_count"], r["valid_row_count"], r["invalid_row_count"]) == (3, 3, 0)
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C)
    assert counts(p.merge_snapshot(spark, r["accepted_path"], t)) == (3, 0, 0, 0)
    assert counts(p.merge_snapshot(spark, r["accepted_path"], t)) == (0, 0, 3, 0)
    row = t.curated().where("order_id = 2").first()
    assert row["amount"] == decimal.Decimal("2.00") and row["updated_at"] == dt.datetime(2025, 1, 1)
    assert store.get_json(spark, r["manifest_path"])["valid_row_count"] == 3


def test_a_bad_row_rejects_the_snapshot(spark):
    out = shared_dir(spark, "land")
    rows = [(1, "1.00", "a"), (1, "1.00", "again"), (2, "1.00", ""), (None, "1.00", "x")]
    with pytest.raises(ContractValidationError) as e:
        p.validate_and_land_snapshot(source(spark, [(k or 0, a, s) for k, a, s in rows]).withColumn("order_id", F.nullif("order_id", F.lit(0))), C, out)
    assert e.value.invalid_count == 3 and e.value.accepted_path is None and not path_exists(spark, f"{out}/accepted")
    errors = spark.read.json(e.value.error_path).collect()
    assert sorted(r["code"] for r in errors) == ["duplicate_key", "required_field", "schema.min_length"]
    assert len(store.get_json(spark, e.value.manifest_path)["sample_errors"]) == 3


AUDIT = "audit_event_id long, op string, source_txid long, recorded_at timestamp, key_json string, row_before string, row_after string"


def log(spark, rows):
    return spark.createDataFrame([(i, op, 1, T0 + dt.timedelta(minutes=i), k, b, a) for i, op, k, b, a in rows], AUDIT)


def row(i, s, amount="1.10"):
    return json.dumps({"order_id": i, "customer_id": str(i), "amount": amount, "status": s, "updated_at": "2025-01-01T00:00:00.5Z"})


def test_audit_delta_from_log_to_table(spark):
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C)
    rows = [(1, "I", '{"order_id":1}', None, row(1, "a")), (2, "I", '{"order_id":2}', None, row(2, "b")), (3, "U", '{"order_id":3}', row(2, "b"), row(3, "c")), (4, "I", None, None, None)]
    r = p.land_audit_delta(log(spark, rows), C, shared_dir(spark, "delta"))
    assert (r["source_event_count"], r["normalized_event_count"], r["upsert_event_count"], r["delete_event_count"], r["invalid_event_count"]) == (4, 4, 3, 1, 1)
    a = p.apply_delta_artifact(spark, r["delta_path"], t, d.AUDIT)
    assert keys(t) == [(1, "a"), (3, "c")] and a["last_applied_watermark"]["event_id"] == 3
    assert t.curated().first()["amount"] == decimal.Decimal("1.10")
    again = p.apply_delta_artifact(spark, r["delta_path"], t, d.AUDIT)
    assert again["unchanged_count"] == 2 and again["version"] == a["version"]
    w = a["last_applied_watermark"]
    nothing = p.land_audit_delta(log(spark, rows[:3]), C, shared_dir(spark, "delta"), start=w)
    assert nothing["source_event_count"] == 0 and spark.read.schema("op string").json(nothing["delta_path"]).count() == 0
    empty = p.land_audit_delta(log(spark, []), C, shared_dir(spark, "delta"))
    assert empty["window_end"] is None and p.apply_delta_artifact(spark, empty["delta_path"], t, d.AUDIT)["effective_event_count"] == 0
    rows.append((9, "D", '{"order_id":1}', None, None))
    more = p.land_audit_delta(log(spark, rows), C, shared_dir(spark, "delta"), start=w)
    assert p.apply_delta_artifact(spark, more["delta_path"], t, d.AUDIT)["delete_count"] == 1 and keys(t) == [(3, "c")]


def test_cdc_quarantine_by_transaction(spark):
    s = "op string, commit_lsn string, end_lsn string, change_index long, xid long, commit_ts timestamp, old_key string, row_after string"
    ev = spark.createDataFrame([("I", "0/A", "0/B", 0, 101, T0, None, row(1, "a")), ("I", "0/A", "0/B", 1, 101, T0, None, '{"order_id":null}'), ("I", "0/C", "0/D", 0, 102, T0, None, row(2, "b"))], s)
    r = p.land_cdc_delta(ev, C, shared_dir(spark, "delta"))
    assert (r["source_event_count"], r["normalized_event_count"], r["invalid_event_count"], r["quarantined_event_count"], r["quarantined_transaction_count"]) == (3, 1, 1, 2, 1)
    assert r["last_decoded_lsn"] == "0/D"
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C)
    a = p.apply_delta_artifact(spark, r["delta_path"], t, d.CDC)
    assert keys(t) == [(2, "b")] and a["last_applied_lsn"] == "0/D"
    later = p.land_cdc_delta(ev, C, shared_dir(spark, "delta"), start_lsn="0/A", end_lsn="0/B")
    assert later["source_event_count"] == 0 and d.resolve_checkpoint_lsn("0/A", later, None) == "0/B"


def test_store_objects(spark):
    root = shared_dir(spark, "objects")
    assert store.normalize_key("/a/b/", "p/") == "p/a/b" and store.normalize_key("p/a", "p") == "p/a" and store.normalize_key("a") == "a"
    with pytest.raises(ValueError):
        store.normalize_key(" / ")
    path = store.put_json(spark, f"{root}/x.json", {"b": 1, "a": "é"})
    assert store.read_bytes(spark, path) == b'{"a": "\\u00e9", "b": 1}' and store.object_size(spark, path) == 23
    store.copy_object(spark, path, f"{root}/y.json")
    assert store.get_json(spark, f"{root}/y.json")["b"] == 1
    store.write_bytes(spark, f"{root}/z.json", b"[1]")
    with pytest.raises(ValueError):
        store.get_json(spark, f"{root}/z.json")


def test_target_without_a_column_is_refused(spark):
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C)
    p.run_hash_diff(source(spark, FIRST), t)
    wider = store.VersionedTable(spark, t.root, Contract(**(C.__dict__ | {"fields": (*C.fields, "more")})))
    with pytest.raises(ValueError, match="more"):
        wider.stored()


@pytest.mark.parametrize("bad", [None, "", "x"])
def test_a_row_that_cannot_be_normalized_never_deletes(spark, bad):
    c = Contract(**(C.__dict__ | {"required_fields": ("order_id", "status")}))
    t = store.VersionedTable(spark, shared_dir(spark, "t"), c)
    assert counts(p.run_hash_diff(source(spark, FIRST), t, hash_input="normalized")) == (3, 0, 0, 0)
    second = source(spark, [(1, "1.00", "a"), (2, "2.00", bad), (3, "3.00", "c")])
    if bad == "x":
        assert counts(p.run_hash_diff(second, t, hash_input="normalized")) == (0, 1, 2, 0)
        return
    with pytest.raises(ContractValidationError) as e:
        p.run_hash_diff(second, t, hash_input="normalized")
    assert e.value.invalid_count == 1 and keys(t) == [(1, "a"), (2, "b"), (3, "c")] and t.version() == 1


@pytest.mark.parametrize("hash_input", ["raw", "normalized"])
def test_a_snapshot_with_a_key_twice_is_refused(spark, hash_input):
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C)
    with pytest.raises(ContractValidationError, match='"order_id":1'):
        p.run_hash_diff(source(spark, [*FIRST, (1, "9.00", "z")]), t, hash_input=hash_input)
    assert t.version() == 0


def test_a_landed_snapshot_with_a_key_twice_is_refused(spark):
    out = shared_dir(spark, "land")
    r = p.validate_and_land_snapshot(source(spark, FIRST), C, out)
    twice = spark.read.text(r["accepted_path"])
    twice.unionByName(twice).write.text(f"{out}/twice")
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C)
    with pytest.raises(ContractValidationError):
        p.merge_snapshot(spark, f"{out}/twice", t)
    assert t.version() == 0


def test_writes_follow_the_change_not_the_table(spark):
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C, rows_per_bucket=50, keep=2)
    many = [(i, "1.00", "a") for i in range(1, 1201)]
    p.run_hash_diff(source(spark, many), t)
    m = t.manifest()
    assert m["n_buckets"] == 24 and m["rows"] == 1200 and t.stored().count() == 1200
    whole = store.object_size(spark, f"{t.root}/data/v=1")
    p.run_hash_diff(source(spark, [*many[:5], (6, "1.00", "changed"), *many[6:]]), t)
    assert store.object_size(spark, f"{t.root}/data/v=2") * 8 < whole
    ev = spark.createDataFrame([(7, "DELETE", T0, 1, None, None)], "order_id long, op string, event_ts timestamp, event_id long, status string, row_hash string")
    ev = ev.withColumns({"customer_id": F.lit(None).cast("long"), "amount": F.lit(None).cast("decimal(12,2)"), "updated_at": F.lit(None).cast("timestamp")})
    assert p.apply_delta(ev, t, d.AUDIT)["delete_count"] == 1
    assert store.object_size(spark, f"{t.root}/data/v=3") * 8 < whole and t.manifest()["rows"] == 1199
    rows = {r["order_id"]: r["status"] for r in t.curated().collect()}
    assert len(rows) == 1199 and rows[6] == "changed" and 7 not in rows
    p.apply_delta(ev.limit(0), t, d.AUDIT, {"stream_batches": {"q": 4}})
    assert t.version() == 4 and not path_exists(spark, f"{t.root}/data/v=4") and t.stored().count() == 1199
    # Only the last two versions are kept, with what they name.
    assert not path_exists(spark, f"{t.root}/manifests/v=1.json") and t.stored(3).count() == 1199
    p.run_hash_diff(source(spark, many[:3]), t)
    assert t.last_info()["stream_batches"] == {"q": 4} and keys(t) == [(1, "a"), (2, "a"), (3, "a")]


def test_a_table_that_outgrows_its_buckets_gets_more(spark):
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C, rows_per_bucket=10)
    p.run_hash_diff(source(spark, [(i, "1.00", "a") for i in range(5)]), t)
    assert t.manifest()["n_buckets"] == 1
    p.run_hash_diff(source(spark, [(i, "1.00", "a") for i in range(95)]), t)
    assert t.manifest()["n_buckets"] == 10 and t.stored().count() == 95
    assert counts(p.run_hash_diff(source(spark, [(i, "1.00", "a") for i in range(95)]), t)) == (0, 0, 95, 0)
