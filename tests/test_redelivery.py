from pyspark.sql import functions as F

from tidemark.operators.redelivery import accept_batch, first_copies, repeated_identifiers

SCHEMA = "id long, part long, at long, body string, copy_rank int"
ID = ["id", "part"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA)


def test_first_copy_by_arrival_with_ties(spark):
    rows = [(1, 0, 5, "late"), (1, 0, 3, "first"), (1, 0, 3, "first"), (2, 0, 1, "a"), (2, 0, 1, "b"), (3, 0, None, "n"), (3, 0, 9, "known"), (3, 1, None, None)]
    got = {(r["id"], r["part"]): r["body"] for r in first_copies(frame(spark, rows), ID, [F.col("at")]).collect()}
    again = {(r["id"], r["part"]): r["body"] for r in first_copies(frame(spark, rows[::-1]), ID, [F.col("at")]).collect()}
    assert got == again
    assert got[1, 0] == "first" and got[3, 0] == "known" and got[3, 1] is None and len(got) == 4


def test_repeated_identifiers_once_each_and_nulls_together(spark):
    rows = [(1, 0, i, "x") for i in range(50)] + [(2, 0, 1, "y"), (None, 0, 1, "y"), (None, 0, 2, "z")]
    assert {(r["id"], r["part"]) for r in repeated_identifiers(frame(spark, rows), ID, [F.col("at")]).collect()} == {(1, 0), (None, 0)}


def test_hot_identifier_is_cut_before_the_shuffle(spark):
    plan = repeated_identifiers(frame(spark, [(1, 0, 1, "x")]), ID, [F.col("at")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_new_batches_against_stored(spark):
    stored = frame(spark, [(1, 0, 1, "x"), (None, 0, 1, "n")])
    batch = frame(spark, [(1, 0, 9, "x"), (2, 0, 9, "a"), (2, 0, 8, "b"), (None, 0, 9, "n"), (None, 1, 9, "m")])
    got = accept_batch(batch, stored, ID, [F.col("at")])
    assert sorted((r["id"] or 0, r["part"], r["body"]) for r in got.collect()) == [(0, 1, "m"), (2, 0, "b")]
    assert accept_batch(batch.limit(0), stored, ID, [F.col("at")]).count() == 0
    assert accept_batch(batch, stored.limit(0), ID, [F.col("at")]).count() == 4


def test_seen_messages_by_batches(spark):
    from tidemark.operators.redelivery import SeenMessages
    from tidemark.session import shared_dir

    def batch(*rows):
        return spark.createDataFrame([(*r, "clash") for r in rows], "feed string, id long, at long, batch string")

    m = SeenMessages(spark, shared_dir(spark, "test-seen"), ["feed", "id"], [F.col("at")], buckets=4)
    ids = lambda df: sorted(((r["feed"], r["id"], r["at"]) for r in df.collect()), key=str)
    assert ids(m.accept(batch(("a", 1, 5), ("a", 1, 4), ("b", 1, 1), (None, None, 2), (None, None, 3)), 1)) == [("a", 1, 4), ("b", 1, 1), (None, None, 2)]
    assert ids(m.accept(batch(("a", 1, 1), ("a", 2, 9), (None, None, 1), ("", 2, 1)), 2)) == [("", 2, 1), ("a", 2, 9)]
    assert ids(m.accept(batch(("a", 2, 9), ("a", 3, 1)), 2)) == [("a", 2, 9), ("a", 3, 1)]  # again, with other rows
    assert ids(m.accept(batch(), 3)) == [] and ids(m.accept(batch(("a", 3, 7), ("", 2, 1)), 4)) == [("", 2, 1)]
