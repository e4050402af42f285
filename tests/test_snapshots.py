import random

from pyspark.sql import functions as F

from tidemark.functions.hashes import row_hash64
from tidemark.operators.snapshots import differing_rows, snapshot_changes

SCHEMA = "g string, s int, n long, k1 long, k2 int, v string, w long, change string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a clash") for r in rows], SCHEMA)


def diff(spark, rows, **more):
    df = frame(spark, rows)
    got = snapshot_changes(df, "g", "s", [F.col("k1"), F.col("k2")], row_hash64([F.col("v"), F.col("w")]), [F.col("n")], ["k1", "k2"], **more)
    return sorted(((r["g"], r["snapshot_no"], r["k1"], r["k2"], r["change"]) for r in got.collect()), key=str)


def brute(rows):
    snaps = {}
    for g, s, n, k1, k2, v, w in sorted(rows, key=lambda r: str((r[0], r[1]))):
        if g is None or s is None or (k1 is None and k2 is None):
            continue
        here = snaps.setdefault(g, {}).setdefault(s, {})
        if (k1, k2) not in here or n < here[k1, k2][0]:
            here[k1, k2] = (n, (v, w))
    out = []
    for g, by in snaps.items():
        numbers = sorted(by)
        for a, b in zip(numbers, numbers[1:]):
            for k in set(by[a]) | set(by[b]):
                if k not in by[a] or k not in by[b] or by[a][k][1] != by[b][k][1]:
                    out.append((g, b, *k, "added" if k not in by[a] else "removed" if k not in by[b] else "changed"))
    return sorted(out, key=str)


def test_random_snapshots_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in "ab":
        for s in (1, 2, 5, 6):
            for n in range(120):
                rows.append((g, s, n, rng.choice([None, *range(60)]), rng.choice([None, 1, 2]), rng.choice(["x", "y", None]), rng.choice([None, 1])))
    assert diff(spark, rows) == brute(rows)
    assert diff(spark, rows, rows_per_bucket=40) == brute(rows)  # buckets that lack a snapshot


def test_nulls_change_places(spark):
    rows = [("a", 1, 1, 7, None, None, 1), ("a", 2, 1, 7, None, "1", None), ("a", 1, 2, None, 7, "x", 1), ("a", 2, 2, 7, 7, "x", 1)]
    assert diff(spark, rows) == brute(rows)


def test_a_key_that_fills_a_snapshot(spark):
    rows = [("a", 1, n, 1, 1, f"v{n}", 0) for n in range(500)] + [("a", 2, 1, 1, 1, "v0", 0)]
    assert diff(spark, rows) == []


def test_empty_and_single_snapshots(spark):
    assert diff(spark, []) == []
    assert diff(spark, [("a", 1, 1, 1, 1, "x", 1)]) == []
    assert diff(spark, [(None, 1, 1, 1, 1, "x", 1), ("a", None, 1, 1, 1, "x", 1)]) == []


def test_full_values_of_differing_keys(spark):
    df = frame(spark, [("a", 1, 1, 1, 1, "x", 1), ("a", 2, 3, 1, 1, "z", 1), ("a", 2, 2, 1, 1, "y", 1), ("a", 2, 1, 2, 1, "n", 1), ("a", 1, 9, 3, 1, "gone", 1)]).drop("change")
    key, first = [F.col("k1"), F.col("k2")], [F.col("n")]
    d = snapshot_changes(df, "g", "s", key, row_hash64([F.col("v")]), first, ["k1"])
    got = differing_rows(d, df, "g", "s", key, first)
    assert sorted((r["k1"], r["v"], r["change"]) for r in got.collect()) == [(1, "y", "changed"), (2, "n", "added")]
