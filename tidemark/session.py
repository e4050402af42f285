"""Settings the engine reads from, or gives to, the Spark session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
#: What a driver may take in, and a broadcast hold, of metadata.
MAX_BYTES = 32 << 20


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only where driver and executors are one process (tests, a laptop) may that setting be
    absent; a folder of this machine is then made and set as the checkpoint folder.  What
    one application keeps here is removed when it ends, or before that by ``delete_path``.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _FALLBACK:
            _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.setCheckpointDir(_FALLBACK[app])
        root = _FALLBACK[app]
    mine = f"{root.rstrip('/')}/tidemark-{app}"
    fs, p = hadoop_path(spark, mine)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{mine}/{purpose}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of a location."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if it isn't there."""
    fs, p = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def partition_folder(spark: SparkSession, column: str, value: object) -> str:
    """``column=value`` as Spark spells it in a path, with escapes and the name of null."""
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    escaped = "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else utils.escapePathName(str(value))
    return f"{utils.escapePathName(column)}={escaped}"


def bounded_rows(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> list[Row] | None:
    """The rows of a small frame, or None when they are more than the driver should hold.

    Rows are counted and measured (as JSON) before any is sent.  Used for metadata only
    (contracts, catalogues, touched periods); every caller has a join to fall back on.
    """
    held = df.storageLevel.useMemory or df.storageLevel.useDisk
    kept = df if held else df.persist()
    try:
        size = kept.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in df.columns])))).alias("b")).first()
        if size["n"] > max_rows or (size["b"] or 0) > max_bytes:
            return None
        return kept.collect()
    finally:
        if not held:
            kept.unpersist()


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The frame as a broadcast of its rows where those are few, else as it is."""
    rows = bounded_rows(df, max_rows, max_bytes)
    return df if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def kept(df: DataFrame, max_rows: int = 200_000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A frame that several plans read, worked out once: as rows, or stored if they are many."""
    rows = bounded_rows(df, max_rows, max_bytes)
    if rows is not None:
        return df.sparkSession.createDataFrame(rows, df.schema)
    path = shared_dir(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
