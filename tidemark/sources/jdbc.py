"""Tables of a database as partitioned scans, and upserts into one."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contract.model import parse_table_name, validate_identifier


def read_table(spark: SparkSession, url: str, table: str, fields: Sequence[str], partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, fetch_size: int = 10_000, properties: dict[str, str] | None = None) -> DataFrame:
    """The named columns of a table; with a numeric column and bounds, in parallel."""
    if partitions <= 0 or fetch_size <= 0:
        raise ValueError("partitions and fetch_size must be greater than zero")
    schema, name = parse_table_name(table)
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f'"{schema}"."{name}"').option("fetchsize", fetch_size)
    if partition_column:
        if not bounds:
            raise ValueError("a partition column needs bounds")
        r = r.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load().select(*fields)


def upsert_sql(table: str, fields: Sequence[str], keys: Sequence[str]) -> str:
    """INSERT … ON CONFLICT with the non-key fields updated, or nothing if there are none."""
    schema, name = parse_table_name(table)
    q = lambda names: ", ".join(f'"{n}"' for n in names)
    rest = [f for f in fields if f not in keys]
    action = "UPDATE SET " + ", ".join(f'"{f}" = EXCLUDED."{f}"' for f in rest) if rest else "NOTHING"
    return f'INSERT INTO "{schema}"."{name}" ({q(fields)}) VALUES ({", ".join(["%s"] * len(fields))}) ON CONFLICT ({q(keys)}) DO {action}'


def delete_sql(table: str, keys: Sequence[str]) -> str:
    schema, name = parse_table_name(table)
    return f'DELETE FROM "{schema}"."{name}" WHERE ' + " AND ".join(f'"{k}" IS NOT DISTINCT FROM %s' for k in keys)


def staged_sql(table: str, stage: str, fields: Sequence[str], keys: Sequence[str]) -> dict[str, str]:
    """Statements that stage changes beside a table and apply them to it."""
    schema, name = parse_table_name(table)
    target, beside = f'"{schema}"."{name}"', f'"{schema}"."{validate_identifier(stage)}"'
    q = lambda names: ", ".join(f'"{n}"' for n in names)
    same = " AND ".join(f's."{k}" IS NOT DISTINCT FROM {target}."{k}"' for k in keys)
    conflict = upsert_sql(table, fields, keys).split(" ON CONFLICT ", 1)[1]
    return {
        "create": f"CREATE TABLE {beside} AS SELECT 0 AS part_no, CAST('' AS text) AS change_type, {q(fields)} FROM {target} WHERE 1 = 0",
        "clear": f"DELETE FROM {beside} WHERE part_no = %s",
        "stage": f'INSERT INTO {beside} (part_no, change_type, {q(fields)}) VALUES ({", ".join(["%s"] * (len(fields) + 2))})',
        "delete": f"DELETE FROM {target} WHERE EXISTS (SELECT 1 FROM {beside} s WHERE s.change_type = 'DELETE' AND {same})",
        "upsert": f"INSERT INTO {target} ({q(fields)}) SELECT DISTINCT {q(fields)} FROM {beside} WHERE change_type IN ('INSERT', 'UPDATE') ON CONFLICT {conflict}",
        "drop": f"DROP TABLE {beside}",
    }


def write_changes(classified: DataFrame, connect, table: str, fields: Sequence[str], keys: Sequence[str], batch: int = 1000) -> None:
    """Sends a classified frame to a database: all of its changes are seen there, or none.

    Tasks fill a table of this call beside the target, each replacing what an earlier
    attempt of it left; one transaction then deletes and upserts.  ``connect`` opens a
    DB-API connection, on executors and on the driver.  Of deletes only keys are sent.
    """
    if batch <= 0:
        raise ValueError("batch must be greater than zero")
    sql = staged_sql(table, f"_staged_{uuid.uuid4().hex}", fields, keys)

    def run(*statements: str) -> None:
        conn = connect()
        try:
            cur = conn.cursor()
            for s in statements:
                cur.execute(s)
            conn.commit()
        finally:
            conn.close()

    def send(rows) -> None:
        conn, part = connect(), TaskContext.get().partitionId()
        try:
            cur, pending = conn.cursor(), []
            cur.execute(sql["clear"], (part,))
            for r in rows:
                gone = r["change_type"] == "DELETE"
                pending.append((part, r["change_type"], *[None if gone and f not in keys else r[f] for f in fields]))
                if len(pending) >= batch:
                    cur.executemany(sql["stage"], pending)
                    pending = []
            if pending:
                cur.executemany(sql["stage"], pending)
            conn.commit()
        finally:
            conn.close()

    run(sql["create"])
    try:
        classified.where("change_type in ('INSERT', 'UPDATE', 'DELETE')").select("change_type", *[F.col(f"`{f}`") for f in fields]).foreachPartition(send)
        run(sql["delete"], sql["upsert"])
    finally:
        run(sql["drop"])
