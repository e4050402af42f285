"""The registered queries on the smallest tables: columns, and brute force where it is quick."""

import duckdb
import pytest

from tidemark.llm import leakage, queries

FOUND = {"p7_found": "item_id bigint, doc_id bigint", "p9_found": "doc_id bigint"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    assert got.count() > 0
    if name in FOUND:
        assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == FOUND[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "eval_items", "mix_targets"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE[name]).df()
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    plain = lambda df: sorted(map(repr, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_leaks_against_brute_force(spark, sf_dir):
    runs, want, n = {}, set(), leakage.MIN_WORDS
    for r in spark.read.parquet(f"{sf_dir}/eval_items.parquet").collect():
        w = leakage.words(r["text"])
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(r["item_id"])
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        w = leakage.words(r["text"])
        for k in range(len(w) - n + 1):
            want |= {(i, r["doc_id"]) for i in runs.get(tuple(w[k : k + n]), ())}
    assert {tuple(r) for r in queries.p7_found(spark, sf_dir).collect()} == want


def test_queries_on_empty_tables(spark, sf_dir, tmp_path):
    d = str(tmp_path)
    for t in ("documents", "eval_items", "mix_targets"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    assert {n: q(spark, d).count() for n, q in queries.QUERIES.items()} == dict.fromkeys(queries.QUERIES, 0)
