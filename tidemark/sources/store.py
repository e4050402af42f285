"""Versioned tables of curated rows and row hashes, artifacts and manifests.

Rows are spread over buckets by a hash of their key.  A version writes the buckets it
touches below ``data/v=N`` and a manifest that names, for each bucket, the version whose
folder holds it; then the pointer file ``CURRENT`` is replaced by an atomic rename and
readers resolve it once.  So what a version writes follows the change, not the table.
Curated rows and hash state are one version, so they can't disagree.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contract.model import Contract
from tidemark.contract.types import DEFAULT_DECIMAL, contract_schema, family
from tidemark.functions.canonical import canonical_text
from tidemark.functions.hashes import row_hash64
from tidemark.session import children, delete_path, hadoop_path, path_exists


def normalize_key(key: str, prefix: str = "") -> str:
    """An object key without outer slashes below ``prefix``, which is added once."""
    k, p = key.strip().strip("/"), prefix.strip().strip("/")
    if not k:
        raise ValueError("an object key must not be empty")
    return k if not p or k == p or k.startswith(p + "/") else f"{p}/{k}"


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written aside and renamed over the old one."""
    fs, tmp = hadoop_path(spark, path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(data))
    out.close()
    jvm = spark.sparkContext._jvm
    _, final = hadoop_path(spark, path)
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, final, options)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def put_json(spark: SparkSession, path: str, payload: dict[str, Any]) -> str:
    """A JSON object with sorted keys, in ASCII."""
    write_bytes(spark, path, json.dumps(payload, sort_keys=True, ensure_ascii=True, default=str).encode("ascii"))
    return path


def get_json(spark: SparkSession, path: str) -> dict[str, Any]:
    value = json.loads(read_bytes(spark, path))
    if not isinstance(value, dict):
        raise ValueError(f"{path} doesn't hold a JSON object")
    return value


def object_size(spark: SparkSession, path: str) -> int:
    fs, p = hadoop_path(spark, path)
    return int(fs.getContentSummary(p).getLength())


def copy_object(spark: SparkSession, source: str, target: str) -> str:
    fs, a = hadoop_path(spark, source)
    other, b = hadoop_path(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    return target


def write_ndjson(df: DataFrame, path: str) -> str:
    """Gzipped lines of JSON, one folder of part files; nulls are written out."""
    df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    return path


def read_ndjson(spark: SparkSession, path: str, schema) -> DataFrame:
    """Lines of JSON under a schema; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Rows of a bucket, and by which factor a table may outgrow its buckets before it gets more.
ROWS_PER_BUCKET, GROWTH = 2_000_000, 4
#: Up to how many buckets are named in a filter; more are joined.
NAMED_BUCKETS = 512


def bucket_text(c: Column, kind: T.DataType, contract_type: str | None) -> Column:
    """A key part as text that doesn't depend on the type that holds it."""
    if family(contract_type) == "decimal" or isinstance(kind, T.DecimalType):
        return F.coalesce(c.try_cast(DEFAULT_DECIMAL).cast("string"), c.cast("string"))
    return F.regexp_replace(canonical_text(c, kind, null_text=False), r"\+00:00$", "")


class VersionedTable:
    """Curated rows with their hash, in versions below ``root``.

    The last ``keep`` versions can be read; what only older ones name is removed as new
    ones come.  The number of buckets follows the number of rows: a table that outgrows
    them is written whole once, with more.
    """

    def __init__(self, spark: SparkSession, root: str, contract: Contract, rows_per_bucket: int = ROWS_PER_BUCKET, keep: int = 10):
        if rows_per_bucket <= 0 or keep <= 0:
            raise ValueError("rows_per_bucket and keep must be greater than zero")
        self.spark, self.root, self.contract = spark, root.rstrip("/"), contract
        self.keys = list(contract.key_fields)
        self.rows_per_bucket, self.keep = rows_per_bucket, keep

    def version(self) -> int:
        pointer = f"{self.root}/CURRENT"
        return int(read_bytes(self.spark, pointer)) if path_exists(self.spark, pointer) else 0

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """What a version consists of; of a table without versions, an empty one."""
        v = self.version() if version is None else version
        return get_json(self.spark, f"{self.root}/manifests/v={v}.json") if v else {"version": 0, "buckets": {}, "n_buckets": 1, "rows": 0, "schema": None}

    def last_info(self) -> dict[str, Any]:
        return self.manifest() if self.version() else {}

    def bucket(self, df: DataFrame, n_buckets: int, prefix: str = "") -> Column:
        """The bucket of a row of ``df``, by its key columns."""
        parts = [bucket_text(F.col(f"`{prefix}{k}`"), df.schema[f"{prefix}{k}"].dataType, self.contract.field_types.get(k)) for k in self.keys]
        return F.pmod(row_hash64(parts, "bucket"), F.lit(n_buckets)).cast("int")

    def stored(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Contract fields and ``row_hash``; without a version, an empty frame.

        ``buckets`` leaves out the others; the table must be read whole for its columns.
        """
        m = self.manifest(version)
        if m["schema"] is None:
            return self.spark.createDataFrame([], contract_schema(self.contract).add("row_hash", "string"))
        schema = T.StructType.fromJson(m["schema"])
        if missing := [f for f in self.contract.fields if f not in schema.names]:
            raise ValueError(f"the target lacks columns: {', '.join(missing)}")
        paths = [f"{self.root}/data/v={v}/__bucket={b}" for b, v in m["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def curated(self, version: int | None = None) -> DataFrame:
        return self.stored(version).drop("row_hash")

    def hash_state(self, version: int | None = None) -> DataFrame:
        return self.stored(version).select(*self.keys, "row_hash")

    def in_buckets(self, df: DataFrame, buckets: set[int], n_buckets: int) -> DataFrame:
        """The rows of ``df`` that lie in some buckets."""
        if len(buckets) == n_buckets:
            return df
        if len(buckets) <= NAMED_BUCKETS:
            return df.where(self.bucket(df, n_buckets).isin(sorted(buckets)) if buckets else F.lit(False))
        wanted = self.spark.createDataFrame([(b,) for b in sorted(buckets)], "__wanted int")
        return df.join(wanted, self.bucket(df, n_buckets) == F.col("__wanted"), "left_semi")

    def commit(self, rows: DataFrame, info: dict[str, Any] | None = None, n_rows: int | None = None) -> int:
        """Writes a whole table as the next version and makes it the current one."""
        n = rows.count() if n_rows is None else n_rows
        return self._commit(rows, {}, max(1, -(-n // self.rows_per_bucket)), n, info)

    def commit_buckets(self, rows_of: Callable[[DataFrame, set[int] | None], DataFrame], touched: set[int], n_rows: int, info: dict[str, Any] | None = None) -> int:
        """The next version, of which only ``touched`` buckets are written.

        ``rows_of`` gives the new rows from the stored rows of some buckets, or of all when
        it gets None.  With nothing touched only a manifest is written.  A table that has
        outgrown its buckets, or whose columns get other types, is written whole.
        """
        m = self.manifest()
        kept = {b: v for b, v in m["buckets"].items() if int(b) not in touched}
        if not touched and m["version"]:
            return self._commit(None, kept, m["n_buckets"], n_rows, info)
        if n_rows <= GROWTH * self.rows_per_bucket * m["n_buckets"]:
            rows = rows_of(self.stored(buckets=touched), touched)
            if not kept or [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in T.StructType.fromJson(m["schema"])]:
                return self._commit(rows, kept, m["n_buckets"], n_rows, info)
        return self.commit(rows_of(self.stored(), None), info, n_rows)

    def _commit(self, rows: DataFrame | None, kept: dict[str, int], n_buckets: int, n_rows: int, info: dict[str, Any] | None) -> int:
        before = self.manifest()
        v = before["version"] + 1
        target = f"{self.root}/data/v={v}"
        buckets, schema = dict(kept), before["schema"]
        if rows is not None:
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]).jsonValue()
            rows.withColumn("__bucket", self.bucket(rows, n_buckets)).hint("rebalance", "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(target)
            buckets |= {name.split("=", 1)[1]: v for name in children(self.spark, target) if name.startswith("__bucket=")}
        carried = {"stream_batches": before["stream_batches"]} if "stream_batches" in before else {}
        put_json(self.spark, f"{self.root}/manifests/v={v}.json", {"contract_id": self.contract.contract_id, "contract_version": self.contract.version, "written_at": time.time(), **carried, **(info or {}), "version": v, "buckets": buckets, "n_buckets": n_buckets, "rows": n_rows, "schema": schema})
        write_bytes(self.spark, f"{self.root}/CURRENT", str(v).encode())
        self.vacuum(self.keep)
        return v

    def vacuum(self, keep: int = 2) -> None:
        """Forgets versions older than the last ``keep`` and the folders only they name."""
        names = {int(n[2:-5]) for n in children(self.spark, f"{self.root}/manifests") if n.startswith("v=") and n.endswith(".json")}
        for old in sorted(n for n in names if n <= self.version() - keep):
            now = self.manifest(old + 1)["buckets"]
            for b, v in self.manifest(old)["buckets"].items():
                # A bucket's folder only gets younger, so one that was replaced is gone for good.
                if now.get(b) != v:
                    delete_path(self.spark, f"{self.root}/data/v={v}/__bucket={b}")
            delete_path(self.spark, f"{self.root}/manifests/v={old}.json")


def rows_for(df: DataFrame, table: VersionedTable) -> DataFrame:
    """The columns a version holds, from a classified frame."""
    return df.select(*[F.col(f"`{c}`") for c in table.contract.fields], "row_hash")
