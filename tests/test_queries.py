"""Every registered query of the core against its SQL, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tidemark.plans import change_queries, contract_queries, pipeline_queries

QUERIES = change_queries.QUERIES | contract_queries.QUERIES | pipeline_queries.QUERIES
ORACLE = change_queries.ORACLE | contract_queries.ORACLE | pipeline_queries.ORACLE


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(sf_dir + "/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df, names):
    plain = df[names].astype(object).where(df[names].notna(), None)
    return Counter(tuple(repr(v.item() if hasattr(v, "item") else v) for v in r) for r in plain.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE:
        assert len(got.columns) and not got.columns.duplicated().any()
        return
    want = db.sql(ORACLE[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got, names) == rows(want, names)


FOUND = {
    "p1_found": "feed string, source_table string, key_id bigint, line_no bigint, pos_major bigint, pos_minor bigint",
    "p2_found": "contract_id string, snapshot_no bigint, order_id bigint, line_no bigint, change string",
    "p3_found": "feed string, source_table string, id_major bigint, id_minor bigint, op string",
    "p4_found": "audit_event_id bigint, lateness string",
    "p5_found": "feed string, source_table string, id_major bigint, id_minor bigint",
    "p6_found": "contract_id string, version string, file_id bigint, change string, field string, old_field string",
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_columns(spark, sf_dir, name):
    assert ", ".join(f"{n} {t}" for n, t in QUERIES[name](spark, sf_dir).dtypes) == FOUND[name]


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for p in glob.glob(sf_dir + "/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{d}/{os.path.basename(p)}")
    return d


@pytest.mark.parametrize("name", sorted(change_queries.QUERIES))
def test_query_on_empty_tables(spark, empty_dir, name):
    assert change_queries.QUERIES[name](spark, empty_dir).count() == 0


def test_positions_do_not_depend_on_the_session_zone(spark, sf_dir, db):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        for name in ("p1_found", "p5_found", "p5_marks", "p4_found"):
            got, want = QUERIES[name](spark, sf_dir).toPandas(), db.sql(ORACLE[name]).df()
            assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns)), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
