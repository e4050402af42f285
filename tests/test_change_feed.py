import random

from pyspark.sql import functions as F

from tidemark.operators.change_feed import current_state, is_delete, json_key, optional_key

SCHEMA = "t string, k long, p0 long, p1 long, op string, row string, image string, __range int"


def state(spark, rows, base=None, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    got = current_state(df, ["t", "k"], ("p0", "p1"), is_delete(F.col("op")), image=F.col("row"), base=base, **more)
    return sorted(((r["t"], r["k"], r["pos_major"], r["pos_minor"], r["image"]) for r in got.collect()), key=str)


def brute(rows):
    best = {}
    for t, k, p0, p1, op, row, *_ in rows:
        o = (op or "").strip().upper()
        if None in (t, k, p0, p1) or o not in ("UPSERT", "DELETE", "I", "U", "D"):
            continue
        live = o not in ("DELETE", "D")
        best[t, k] = max(best.get((t, k), (p0, p1, False, "")), (p0, p1, live, row or ""))
    return sorted(((t, k, p0, p1, row or None) for (t, k), (p0, p1, live, row) in best.items() if live), key=str)


def test_random_feeds_against_brute_force(spark):
    rng = random.Random(7)
    for n_keys, n in ((3, 400), (60, 400)):
        rows = []
        for i in range(n):
            op = rng.choice(["UPSERT", "upsert", "I", "U", "DELETE", "D", "delete "])
            rows.append(("a", rng.randrange(n_keys), rng.randrange(10**6), i, op, f"r{i}", None, None))
        rows += rng.sample(rows, n // 4)  # delivered again, out of order
        rng.shuffle(rows)
        assert state(spark, rows) == brute(rows)


def test_one_key_holds_most_of_the_feed(spark):
    rows = [("a", 1, p, 0, "U", f"r{p}", None, None) for p in range(3000)] + [("a", 2, 5, 0, "I", "x", None, None)]
    assert state(spark, rows, slices=8) == [("a", 1, 2999, 0, "r2999"), ("a", 2, 5, 0, "x")]


def test_nulls_ties_unknown_ops_and_repeats(spark):
    rows = [
        ("a", None, 1, 1, "I", "x", None, None), ("a", 1, None, 1, "I", "x", None, None), ("a", 1, 1, 1, "??", "x", None, None), ("a", 1, 1, 1, None, "x", None, None),
        ("a", 2, 9, 1, "D", None, None, None), ("a", 2, 9, 1, "U", "kept", None, None),
        ("a", 3, 1, 1, "I", "x", None, None), ("a", 3, 1, 1, "I", "x", None, None), ("a", 3, 2, 1, "D", None, None, None),
    ]
    assert state(spark, rows) == [("a", 2, 9, 1, "kept")]


def test_empty_feed_and_base(spark):
    assert state(spark, []) == []
    base = spark.createDataFrame([("a", 1, "old1"), ("a", 2, "old2"), ("a", 2, "old2"), ("a", 3, "old3")], "t string, k long, image string")
    assert state(spark, [], base) == [("a", 1, None, None, "old1"), ("a", 2, None, None, "old2"), ("a", 3, None, None, "old3")]
    rows = [("a", 2, 5, 0, "U", "new2", None, None), ("a", 3, 5, 0, "D", None, None, None), ("a", 4, 5, 0, "I", "new4", None, None)]
    assert state(spark, rows, base) == [("a", 1, None, None, "old1"), ("a", 2, 5, 0, "new2"), ("a", 4, 5, 0, "new4")]


def test_keys_written_as_text(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "2"}',), ('{"b":" 3 "}',), ("{}",), (None,), ("broken",)], "j string")
    got = df.select(*[c.alias(n) for c, n in zip(json_key(F.col("j"), "a", "b"), "ab")]).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2), (None, 3), (None, None), (None, None), (None, None)]


def test_feeds_with_other_scales(spark):
    rows = [("audit", 1, 10**15, 1, "I", "x", None, None), ("audit", 1, 10**15 + 5, 1, "U", "y", None, None), ("cdc", 1, 7, 1, "I", "z", None, None)]
    assert state(spark, rows) == [("audit", 1, 10**15 + 5, 1, "y"), ("cdc", 1, 7, 1, "z")]


def test_stray_positions_and_one_transaction_leave_the_hot_key_split(spark):
    rows = [("a", 1, 7, i, "U", f"r{i}", None, None) for i in range(2000)] + [("a", 2, 10**15, 0, "I", "far", None, None)]
    assert state(spark, rows, slices=16) == [("a", 1, 7, 1999, "r1999"), ("a", 2, 10**15, 0, "far")]


def test_an_unreadable_line_number_is_not_line_0(spark):
    df = spark.createDataFrame([('{"order_id":1}',), ('{"line_no":null}',), ('{"line_no":"2"}',), ('{"line_no":"x"}',), ('{"line_no":""}',), (None,)], "j string")
    got = [r["n"] for r in df.select(optional_key(F.col("j"), "line_no").alias("n")).collect()]
    assert got == [0, 0, 2, None, None, None]
