from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.mixing import fill_to_shares, mix, splitting_tree, write_mix
from tidemark.llm.tokens import PATTERN, TOKENIZERS, encoding, with_token_counts
from tidemark.session import shared_dir

TARGETS = "mix_name string, source string, target_share double, max_repeats int, total_tokens long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, source string, block string, shard int")


def many(n, source, start, size=30):
    return [(start + i, "alpha beta gamma " * (size + i % 7), source) for i in range(n)]


def test_shares_within_capacities():
    assert fill_to_shares(100, {"a": 1, "b": 1}, {"a": 1000, "b": 1000}) == {"a": 50, "b": 50}
    assert fill_to_shares(100, {"a": 30, "b": 70}, {"a": 1000, "b": 20}) == {"a": 80, "b": 20}
    assert fill_to_shares(100, {"a": 1, "b": 1, "c": 0}, {"a": 10, "c": 50}) == {"a": 10, "b": 0, "c": 0}
    assert sum(fill_to_shares(90, {"a": 1, "b": 2, "c": 3}, {"a": 5, "b": float("inf"), "c": 20}).values()) == pytest.approx(90)
    assert fill_to_shares(0, {"a": 1}, {"a": 5}) == {"a": 0} and fill_to_shares(10, {}, {}) == {}


def test_splitting_tree_hands_out_exactly_the_quotas():
    rng = np.random.default_rng(1)
    for shards in (1, 2, 7, 16):
        leaves = splitting_tree({"a": 1000, "b": 13, "c": 0}, shards, rng)
        assert len(leaves) == shards
        assert [sum(x[s] for x in leaves) for s in "abc"] == [1000, 13, 0]
        assert max(sum(x.values()) for x in leaves) - min(sum(x.values()) for x in leaves) <= 4
    assert splitting_tree({"a": 0}, 3, rng) == [{"a": 0}] * 3


def test_drawn_documents_and_shares(spark):
    d = docs(spark, [*many(300, "Big ", 0), *many(20, " small", 1000), *many(40, "mid", 2000), (5000, None, "mid"), (5001, "", "mid"), (5002, "x y", None)])
    sizes = {r["s"]: r["n"] for r in with_token_counts(d.where("text is not null"), "text", ["source"]).groupBy(F.lower(F.trim("source")).alias("s")).agg(F.sum("n_tokens").alias("n")).collect()}
    total = sizes["small"] * 8
    t = spark.createDataFrame([("m", "big", 50.0, None, total), ("m", "SMALL", 40.0, 2, total), ("m", "mid", 10.0, 5, total), ("m", "gone", 5.0, None, total)], TARGETS)
    drawn, shares = mix(d, t, shards=4)
    rows = drawn.collect()
    s = {r["source"]: r for r in shares.collect()}
    assert s["gone"]["actual_tokens"] == 0 and s["small"]["actual_tokens"] == 2 * sizes["small"] and s["small"]["most_repeats"] == 2
    largest = max(r["n_tokens"] for r in rows)
    assert total - 3 * largest <= sum(r["n_tokens"] for r in rows) <= total
    assert sum(r["actual_share"] for r in s.values()) == pytest.approx(1)
    left = total - 2 * sizes["small"]
    assert abs(s["big"]["actual_tokens"] - left * 50 / 60) <= largest and abs(s["mid"]["actual_tokens"] - left * 10 / 60) <= largest
    copies = Counter((r["doc_id"], r["repeat"]) for r in rows)
    assert max(copies.values()) == 1 and {r["shard"] for r in rows} <= set(range(4))
    again = mix(d, t, shards=4)[0].collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, mix(d, t, shards=4, seed=1)[0].collect()))
    path = shared_dir(spark, "mix-out")
    write_mix(drawn, path)
    assert spark.read.parquet(path).count() == len(rows)


def test_a_document_is_never_repeated_too_often(spark):
    d = docs(spark, many(10, "a", 0))
    t = spark.createDataFrame([("m", "a", 1.0, 3, 10**9), ("z", "a", 1.0, 0, 100), ("n", "a", 0.0, None, 100)], TARGETS)
    drawn, shares = mix(d, t)
    assert Counter(r["doc_id"] for r in drawn.where("mix_name = 'm'").collect()) == {i: 3 for i in range(10)}
    assert {r["mix_name"]: r["actual_tokens"] > 0 for r in shares.collect()} == {"m": True, "z": False, "n": False}


def test_empty_tables(spark):
    t = spark.createDataFrame([("m", "a", 1.0, None, 100)], TARGETS)
    drawn, shares = mix(docs(spark, []), t)
    assert drawn.count() == 0 and shares.first()["actual_tokens"] == 0
    drawn, shares = mix(docs(spark, many(3, "a", 0)), t.limit(0))
    assert drawn.count() == 0 and shares.count() == 0


def test_token_counts_are_of_whole_texts(spark):
    texts = [None, "", "hello world", "<|endoftext|>", "é" * 1000, "x = 1\n" * 20000]
    d = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["n_tokens"] for r in with_token_counts(d, "text", ["doc_id"]).collect()}
    enc = encoding()
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
    assert PATTERN and TOKENIZERS


def test_many_passes_stay_numbers_and_shards_share_them(spark):
    d = docs(spark, many(6, "a", 0, 1))
    total = sum(r["n_tokens"] for r in with_token_counts(d, "text", ["doc_id"]).collect()) * 400
    drawn, shares = mix(d, spark.createDataFrame([("m", "a", 1.0, None, total + 5)], TARGETS), shards=5)
    rows = drawn.collect()
    copies = Counter((r["doc_id"], r["repeat"]) for r in rows)
    assert max(copies.values()) == 1 and 2400 <= len(rows) <= 2401
    by_shard = Counter(r["shard"] for r in rows)
    assert set(by_shard) == set(range(5)) and max(by_shard.values()) - min(by_shard.values()) <= 4 and shares.first()["most_repeats"] in (400, 401)


def test_quota_that_ends_within_a_part(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 2)
    d = docs(spark, many(200, "a", 0, 5))
    for total in (40, 777, 2000):
        drawn, _ = mix(d, spark.createDataFrame([("m", "a", 1.0, 1, total)], TARGETS), shards=3)
        got = drawn.agg(F.sum("n_tokens"), F.max("n_tokens")).first()
        longest = max(r["n_tokens"] for r in with_token_counts(d, "text", ["doc_id"]).collect())
        assert total - longest <= got[0] <= total


def test_trees_of_more_blocks_than_can_be_drawn(monkeypatch):
    leaves = splitting_tree({"a": 3 * 10**12 + 5, "b": 7}, 7, np.random.default_rng(1))
    assert sum(x["a"] for x in leaves) == 3 * 10**12 + 5 and sum(x["b"] for x in leaves) == 7
