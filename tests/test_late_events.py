import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.late_events import LateEventCounts, in_groups, lateness
from tidemark.session import shared_dir

T0 = dt.datetime(2025, 3, 1, 10, 0)
SCHEMA = "id long, tab string, at timestamp, seen timestamp, part string, batch string, lateness string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, T0 + dt.timedelta(minutes=a) if a is not None else None, T0 + dt.timedelta(minutes=s) if s is not None else None, "p", "b", "l") for i, t, a, s in rows], SCHEMA)


def op(spark):
    return LateEventCounts(spark, shared_dir(spark, "test-late"), ["id"], ["tab"], "at", "seen")


def counts(o):
    return {(r["tab"], r["period_start"].hour): (r["n_events"], r["n_late"], r["n_too_late"]) for r in o.counts().collect()}


def test_borders_of_lateness(spark):
    df = frame(spark, [(1, "a", 0, 59), (2, "a", 0, 60), (3, "a", 0, 419), (4, "a", 0, 420), (5, "a", 30, -5), (6, "a", 0, None), (7, "a", None, 5)])
    got = {r["id"]: r["x"] for r in df.select("id", lateness(F.col("at"), F.col("seen"), "hour", "6 hours").alias("x")).collect()}
    assert got == {1: "on_time", 2: "late", 3: "late", 4: "too_late", 5: "on_time", 6: "on_time", 7: None}


def test_late_batches_correct_their_periods(spark):
    o = op(spark)
    day = 24 * 60
    o.add_batch(frame(spark, [(1, "a", 0, 1), (2, "a", 5, 6), (3, "b", day, day + 1)]), 1)
    assert counts(o) == {("a", 10): (2, 0, 0), ("b", 10): (1, 0, 0)}
    touched = o.add_batch(frame(spark, [(4, "a", 10, 90), (1, "a", 0, 1), (5, "a", 20, 20 + day)]), 2)
    assert touched == ["20250301"]
    assert counts(o) == {("a", 10): (3, 1, 1), ("b", 10): (1, 0, 0)}
    before = counts(o)
    o.add_batch(frame(spark, [(4, "a", 10, 90), (1, "a", 0, 1), (5, "a", 20, 20 + day)]), 2)  # the run is repeated
    assert counts(o) == before
    assert {r["id"] for r in o.events().where("lateness <> 'on_time'").collect()} == {4, 5}
    o.drop()


def test_nulls_and_empty_batches(spark):
    o = op(spark)
    o.add_batch(frame(spark, [(1, None, 0, 1), (None, "a", 0, 1), (2, "a", None, 1)]), 1)
    assert counts(o) == {(None, 10): (1, 0, 0), ("a", 10): (1, 0, 0)}
    assert o.add_batch(frame(spark, []), 2) == []
    assert counts(o) == {(None, 10): (1, 0, 0), ("a", 10): (1, 0, 0)}


def test_only_empty_batches_and_an_earlier_store(spark):
    o = op(spark)
    assert o.add_batch(frame(spark, []), 1) == []
    assert counts(o) == {} and o.events().count() == 0
    o.add_batch(frame(spark, [(1, "a", 0, 1)]), 2)
    again = LateEventCounts(spark, o.root, ["id"], ["tab"], "at", "seen")
    assert counts(again) == counts(o) == {("a", 10): (1, 0, 0)} and again.events().count() == 1


def test_the_same_batch_again_with_other_days_replaces_the_first(spark):
    o = op(spark)
    day = 24 * 60
    o.add_batch(frame(spark, [(1, "a", 0, 1)]), 1)
    assert o.add_batch(frame(spark, [(2, "a", day, day + 1)]), 1) == ["20250301", "20250302"]
    assert {(r["part"], r["n_events"]) for r in o.counts().collect()} == {("20250302", 1)} and [r["id"] for r in o.events().collect()] == [2]
    o.add_batch(frame(spark, []), 1)
    assert counts(o) == {} and o.events().count() == 0


def test_closed_periods_and_repeated_deliveries_are_not_recomputed(spark):
    o = op(spark)
    day = 24 * 60
    o.add_batch(frame(spark, [(1, "a", 0, 1), (2, "a", 5, 6), (3, "b", day, day + 1)]), 1)
    assert o.add_batch(frame(spark, [(1, "a", 0, 1), (9, "a", 10, day), (9, "a", 10, day)]), 2) == []
    assert counts(o) == {("a", 10): (2, 0, 1), ("b", 10): (1, 0, 0)}
    assert {r["part"]: r["as_of"] for r in o.counts().collect()} == {"20250301": 1, "20250302": 1}
    assert o.add_batch(frame(spark, [(9, "a", 10, day)]), 3) == []  # past the cut-off, and known
    assert {(r["id"], r["lateness"]) for r in o.events().where("lateness <> 'on_time'").collect()} == {(9, "too_late")} and o.events().count() == 4
    assert o.add_batch(frame(spark, [(4, "a", 30, 100)]), 4) == ["20250301"]
    assert counts(o) == {("a", 10): (3, 1, 1), ("b", 10): (1, 0, 0)} and o.events().count() == 5
    assert o.add_batch(frame(spark, [(9, "a", 10, 20)]), 5) == ["20250301"]  # a copy that was visible in time
    assert counts(o)[("a", 10)] == (4, 1, 0)
    o.add_batch(frame(spark, [(4, "a", 30, 100), (8, "b", day, 3 * day)]), 2)  # batch 2 once more, with other rows
    assert counts(o) == {("a", 10): (4, 1, 0), ("b", 10): (1, 0, 1)}


def test_groups_of_batches(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate([None, 1, 1, 1, 2, 3, 5, 5])], "id long, batch int")
    got = [sorted(r["id"] for r in g.collect()) for g in in_groups(df, "batch", 3)]
    assert got == [[0, 1, 2, 3], [4, 5], [6, 7]]
    assert len(in_groups(df.limit(0), "batch", 3)) == 1
