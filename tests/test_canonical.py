import datetime as dt
import decimal
import hashlib
import json
import math
import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canonical import canonical_row, canonical_text, hardened_hash, plain_number, python_double, row_hash
from tidemark.functions.lsn import int_to_lsn, lsn_col, lsn_text, lsn_to_int, max_lsn


def texts(spark, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType().add("i", "long").add("v", kind))
    return [r["t"] for r in df.select("i", canonical_text(F.col("v"), df.schema["v"].dataType).alias("t")).orderBy("i").collect()]


def test_scalars(spark):
    assert texts(spark, [None, 42, -1], T.LongType()) == ["<NULL>", "42", "-1"]
    assert texts(spark, [True, False, None], T.BooleanType()) == ["True", "False", "<NULL>"]
    assert texts(spark, [decimal.Decimal("10.50"), decimal.Decimal("0.01")], T.DecimalType(10, 2)) == ["10.50", "0.01"]
    assert texts(spark, [dt.date(2025, 1, 1)], T.DateType()) == ["2025-01-01"]
    assert texts(spark, ["", "a|b", "<NULL>", "é"], T.StringType()) == ["", "a|b", "<NULL>", "é"]
    assert texts(spark, [b"\0\1\2" * 40], T.BinaryType()) == ["AAEC" * 40]


def test_times(spark):
    t = [dt.datetime(2025, 1, 1, 12, 0, 5), dt.datetime(2025, 1, 1, 12, 0, 5, 120000)]
    assert texts(spark, t, T.TimestampNTZType()) == ["2025-01-01T12:00:05", "2025-01-01T12:00:05.120000"]
    aware = [x.replace(tzinfo=dt.timezone.utc) for x in t]
    assert texts(spark, aware, T.TimestampType()) == ["2025-01-01T12:00:05+00:00", "2025-01-01T12:00:05.120000+00:00"]


def test_nested_values_are_sorted_ascii_json(spark):
    inner = T.StructType().add("b", T.DecimalType(5, 2)).add("a", T.ArrayType(T.StringType()))
    got = texts(spark, [(decimal.Decimal("1.10"), ["é", None]), None], inner)
    assert got == ['{"a":["\\u00e9",null],"b":"1.10"}', "<NULL>"]


def test_doubles_like_python(spark):
    rng = random.Random(11)
    values = [0.0, -0.0, 1e7, 9e-4, 1e16, 1e-4, 9.999e-5, 5.050393598878626e16, 2.0**-44, 1e23, 2e23, 1.5e300, 5e-324, 123456.789, -1e22]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)] + [round(rng.uniform(-1e6, 1e6), rng.randrange(6)) for _ in range(1000)]
    values = [v for v in values if math.isfinite(v)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = [(r["v"], r["p"], r["d"]) for r in df.select("v", python_double(F.col("v")).alias("p"), plain_number(F.col("v")).alias("d")).collect() if r["p"] != repr(r["v"]) or "e" in r["d"].lower() or float(r["d"]) != r["v"]]
    assert wrong == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1))
def test_lsn_round_trip(n):
    assert lsn_to_int(int_to_lsn(n)) == n


def test_row_hash_vectors(spark):
    df = spark.createDataFrame([(1, "NEW", "10.00"), (1, None, "10")], "id int, status string, amount string")
    got = df.select(row_hash(df, ["id", "status", "amount"]).alias("h"), canonical_row(df, ["id", "amount", "status"]).alias("t")).collect()
    assert got[0]["h"] == hashlib.sha256(b"1|NEW|10.00").hexdigest() and got[1]["t"] == "1|10|<NULL>"


def test_hardened_hash_has_no_border_collisions(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("<NULL>", "c"), (None, "c")], "x string, y string")
    assert df.select(row_hash(df, ["x", "y"])).distinct().count() == 2
    assert df.select(hardened_hash(df, ["x", "y"])).distinct().count() == 4


def test_lsn(spark):
    assert lsn_to_int("0/16B6C80") == 23817344 and int_to_lsn(23817344) == "0/16B6C80"
    assert max_lsn(None, "0/F", "1/0", None) == "1/0" and max_lsn(None) is None
    df = spark.createDataFrame([(x,) for x in ("0/16B6C80", " 00000001/00000002 ", "a/ff", "7", "x/1", "", None, "FFFFFFFF/0")], "l string")
    got = df.select(lsn_col(F.col("l")).alias("i")).withColumn("t", lsn_text(F.col("i"))).collect()
    assert [r["i"] for r in got] == [23817344, 2**32 + 2, 10 * 2**32 + 255, None, None, None, None, None]
    assert [r["t"] for r in got][:3] == ["0/16B6C80", "1/2", "A/FF"]


def test_canonical_json_round_trip(spark):
    df = spark.createDataFrame([('{"b":[1,{"z":null}],"a":"ü"}',)], "j string").select(F.parse_json("j").alias("v"))
    t = df.select(canonical_text(F.col("v"), T.VariantType()).alias("t")).first()["t"]
    assert t == '{"a":"\\u00fc","b":[1,{"z":null}]}' and json.loads(t)["b"][0] == 1
