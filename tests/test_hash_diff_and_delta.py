import random

import pytest
from pyspark.sql import functions as F

from tidemark.contract.model import Contract
from tidemark.operators import delta as d
from tidemark.operators.hash_diff import change_counts, changed_columns, checked_hashes, classify, delete_missing, merged

ROWS = "k long, v string, row_hash string, change_type string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ROWS).drop("change_type")


def test_classification(spark):
    got = classify(frame(spark, [(1, "a", "h1"), (2, "b", "h2"), (3, "c", "h3"), (None, "n", "hn")]), frame(spark, [(1, "", "h1"), (2, "", "old"), (9, "", "h"), (None, "", "hn")]), ["k"])
    assert sorted(((r["k"], r["change_type"]) for r in got.collect()), key=str) == [(1, "UNCHANGED"), (2, "UPDATE"), (3, "INSERT"), (9, "DELETE"), (None, "UNCHANGED")]
    assert change_counts(got).first().asDict() == {"insert_count": 1, "update_count": 1, "unchanged_count": 2, "delete_count": 1}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides(spark):
    some, none = frame(spark, [(1, "a", "h")]), frame(spark, [])
    assert change_counts(classify(none, some, ["k"])).first()["delete_count"] == 1
    assert change_counts(classify(some, none, ["k"])).first()["insert_count"] == 1
    assert classify(none, none, ["k"]).count() == 0
    assert classify(none, some, ["k"], partial=True).count() == 0


def test_merge_keeps_unchanged_rows_of_the_target(spark):
    target = frame(spark, [(1, "drifted", "h1"), (2, "b", "old"), (9, "z", "h9")])
    now = frame(spark, [(1, "a", "h1"), (2, "B", "h2"), (3, "c", "h3")])
    out = merged(classify(now, target, ["k"]), target, ["k"])
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(1, "drifted"), (2, "B"), (3, "c")]


def test_blank_hashes_are_refused(spark):
    assert checked_hashes(frame(spark, [(1, "a", "h")])).count() == 1
    for bad in (None, " "):
        with pytest.raises(Exception, match="row_hash"):
            checked_hashes(frame(spark, [(1, "a", bad)])).collect()


def test_delete_missing_is_null_safe(spark):
    t = frame(spark, [(1, "a", "h"), (None, "n", "h"), (2, "b", "h")])
    assert {r["k"] for r in delete_missing(t, frame(spark, [(None, "", ""), (2, "", ""), (2, "", "")]), ["k"]).collect()} == {None, 2}
    assert delete_missing(t, t.limit(0), ["k"]).count() == 0


def test_changed_columns(spark):
    df = spark.createDataFrame([(1, None, 1, None), (1, "x", 2, None), (1, "x", 1, "x")], "a int, b string, a2 int, b2 string")
    c = changed_columns({"b": F.col("b"), "a": F.col("a")}, {"b": F.col("b2"), "a": F.col("a2")})
    assert [r["c"] for r in df.select(c.alias("c")).collect()] == [[], ["a", "b"], []]


C = Contract("o", "1", ("id", "status"), {"id": "integer", "status": "string"}, ("id",), ("id",), hash_keys=("status",))
EVENTS = "event_id long, event_ts long, op string, row_before string, key_json string, row_after string, errors string"


def audit(spark, rows):
    return spark.createDataFrame([(i, i, *r, "clash") for i, r in enumerate(rows)], EVENTS)


def norm(spark, rows, dialect=d.AUDIT, **more):
    old = d.audit_old_key(F.col("row_before"), F.col("key_json")) if dialect is d.AUDIT else F.col("key_json")
    e = audit(spark, rows)
    if dialect is d.CDC:
        e = e.withColumns({"commit_lsn": F.lit("0/1"), "end_lsn": F.lit("0/2"), "change_index": F.col("event_id"), "xid": F.lit(1), "commit_ts": F.lit(None).cast("timestamp")})
    return d.normalize_events(e, C, dialect, old_key=old)


def made(n):
    out = []
    for r in n.orderBy("event_id").collect():
        out.append([(e["op"], e["key"]["id"]) for e in r["events"]] if r["events"] is not None else [(e["code"], e["event_role"]) for e in r["errors"]])
    return out


def test_audit_events(spark):
    row = lambda i, s="x": f'{{"id":{i},"status":"{s}"}}'
    got = made(norm(spark, [
        ("I", None, '{"id":1}', row(1)), ("D", row(2), '{"id":2}', None), ("D", "{}", '{"id":"3"}', None), ("U", row(4), '{"id":4}', row(4, "y")), ("U", row(4), '{"id":5}', row(5)),
        ("I", None, '{"id":1}', None), ("U", None, '{"id":null}', None), ("X", None, '{"id":1}', row(1)), (None, None, None, None), ("D", None, "{}", None), ("U", None, '{"id":7}', '{"status":"x"}'),
    ]))
    assert got == [
        [("UPSERT", 1)], [("DELETE", 2)], [("DELETE", 3)], [("UPSERT", 4)], [("DELETE", 4), ("UPSERT", 5)],
        [("missing_row_after", "UPSERT")], [("missing_row_after", "UPSERT"), ("null_key", "DELETE")], [("unsupported_op", "AUDIT")], [("unsupported_op", "AUDIT")], [("missing_field", "DELETE")], [("missing_field", "UPSERT")],
    ]


def test_change_capture_events(spark):
    row = lambda i: f'{{"id":"{i}","status":"x"}}'
    got = made(norm(spark, [("U", None, None, row(4)), ("U", None, '{"id":"3","status":null}', row(4)), ("D", None, None, None), ("U", None, '{"id":null}', row(4)), ("U", None, '{"id":null}', None)], d.CDC))
    assert got == [[("UPSERT", 4)], [("DELETE", 3), ("UPSERT", 4)], [("missing_field", "DELETE")], [("null_key", "DELETE")], [("missing_row_after", "UPSERT")]]


def test_counts_and_event_frames(spark):
    n = norm(spark, [("I", None, '{"id":1}', '{"id":1,"status":"x"}'), ("U", '{"id":1}', '{"id":2}', '{"id":2,"status":"x"}'), ("I", None, None, None)])
    assert d.extract_counts(n).first().asDict() == {"source_event_count": 3, "normalized_event_count": 3, "upsert_event_count": 2, "delete_event_count": 1, "invalid_event_count": 1}
    assert d.delta_events(n, d.AUDIT).where("op = 'DELETE' and row is null and row_hash is null").count() == 1
    assert d.event_errors(n, ["event_id"]).first()["code"] == "missing_row_after"
    assert d.extract_counts(n.limit(0)).first()["normalized_event_count"] == 0


def test_transactions_are_quarantined_whole(spark):
    e = spark.createDataFrame([(101, 1, ["e"]), (101, 2, []), (102, 3, []), (None, 4, ["e"]), (None, 5, [])], "xid long, id long, errors array<string>")
    got = {r["id"]: r["quarantined"] for r in d.quarantine_transactions(e, ["xid"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_latest_effective_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(20)]), rng.choice([None, *range(9)]), rng.randrange(9), rng.choice(["UPSERT", "DELETE"]), f"h{rng.randrange(9)}") for _ in range(500)]
    df = spark.createDataFrame(rows, "k long, p long, q long, op string, row_hash string")
    best = {}
    rank = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] == "UPSERT", r[4])
    for r in rows:
        if r[0] not in best or rank(r) > rank(best[r[0]]):
            best[r[0]] = r
    assert sorted(map(tuple, d.latest_effective(df, ["k"], ["p", "q"]).collect()), key=str) == sorted(best.values(), key=str)


def test_apply(spark):
    target = frame(spark, [(1, "one", "h1"), (2, "two", "h2"), (3, "three", "h3"), (4, "four", "h4")])
    e = spark.createDataFrame([(1, "ONE", "UPSERT", "new"), (2, None, "DELETE", None), (3, "three!", "UPSERT", "h3"), (5, "five", "UPSERT", "h5"), (6, None, "DELETE", None)], "k long, v string, op string, row_hash string")
    c = d.classify_effective(e, target, ["k"])
    assert {r["k"]: r["change_type"] for r in c.collect()} == {1: "UPDATE", 2: "DELETE", 3: "UNCHANGED", 5: "INSERT", 6: "ABSENT"}
    assert d.apply_counts(c).first().asDict() == {"effective_event_count": 5, "insert_count": 1, "update_count": 1, "delete_count": 1, "unchanged_count": 1}
    assert sorted((r["k"], r["v"]) for r in d.applied(c, target, ["k"]).collect()) == [(1, "ONE"), (3, "three"), (4, "four"), (5, "five")]
    assert d.applied(c.limit(0), target, ["k"]).count() == 4 and d.applied(c, target.limit(0), ["k"]).count() == 3


def test_windows_and_positions(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (None, 5)], "a long, b long")
    got = lambda s, e: sorted((r["a"], r["b"]) for r in d.window(df, ("a", "b"), s, e).collect())
    assert got((1, 1), (2, 1)) == [(1, 2), (2, 1)] and got(None, (1, 2)) == [(1, 1), (1, 2)] and got((3, 1), (3, 1)) == []
    assert tuple(d.latest_position(df, ("a", "b")).first()) == (3, 1)
    assert tuple(d.latest_position(df.limit(0), ("a", "b")).first()) == (None, None)


def test_scalar_window_bounds_reach_the_scan(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b")).write.parquet(p)
    plan = d.window(spark.read.parquet(p), ("a", "b"), (2, 2), (5, 5))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(a,5)" in plan and "GreaterThanOrEqual(a" in plan


def test_checkpoints(spark):
    w = {"ordering_ts": "t", "event_id": 1}
    assert d.checkpoint_watermark(None) is None and d.checkpoint_watermark({"window_end": w}) == w and d.checkpoint_watermark({"last_applied_watermark": w, "window_end": {}}) == w
    assert d.checkpoint_lsn({"last_applied_lsn": " 0/1 ", "last_flushed_lsn": ""}) == {"last_applied_lsn": "0/1", "last_flushed_lsn": None}
    r = d.resolve_checkpoint_lsn
    assert r("0/1", None, None) == "0/1" and r("0/1", {"last_decoded_lsn": "0/5"}, {}) == "0/5" and r("0/1", {"last_decoded_lsn": "0/5"}, {"last_applied_lsn": "0/4"}) == "0/4"
    assert r("0/1", {"window_end_lsn": "0/9", "reached_window_end": True}, None) == "0/9" and r("0/1", {"window_end_lsn": "0/9", "reached_window_end": False}, None) == "0/1"
    with pytest.raises(ValueError):
        d.ordering_ts("x", F.lit(1), F.lit(2))
