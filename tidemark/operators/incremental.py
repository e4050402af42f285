"""Processing only what was added or changed since the last successful run.

A partition's fingerprint is its number of rows and the sum of its row hashes: free of
order, additive over files and tasks, and cheap to compare.  Partitions whose
fingerprint differs from the stored one are recomputed and replaced as a whole by
dynamic partition overwrite; the new fingerprints are stored last.  A run that fails
before that leaves the old ones, so the next run does the same partitions again and
replaces them with the same rows: nothing is skipped and nothing is there twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashes import additive_halves, row_hash64
from tidemark.session import broadcast_if_small, delete_path, partition_folder, path_exists, shared_dir
from tidemark.sources.store import get_json, put_json, read_bytes, write_bytes


def fingerprints(df: DataFrame, partition: Sequence[str], hashed: Sequence[str], within: Column | None = None) -> DataFrame:
    """``n``, ``h_hi``, ``h_lo`` per partition, of the rows for which ``within`` holds.

    Partial sums are made before the shuffle, so a partition with a third of all rows
    costs one row per task.  Rows that repeat count as often as they are there; a null
    partition value is a partition of its own.
    """
    row = df.select(*partition, row_hash64([F.col(c) for c in hashed]).alias("__h"), (F.lit(True) if within is None else within).alias("__in"))
    hi, lo = additive_halves(F.when(F.col("__in"), F.col("__h")))
    return row.groupBy(*partition).agg(F.count_if("__in").alias("n"), F.coalesce(hi, F.lit(0)).alias("h_hi"), F.coalesce(lo, F.lit(0)).alias("h_lo"))


def changed_partitions(now: DataFrame, before: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Partitions that are new, gone (``gone`` true) or have another fingerprint."""
    b = before.select(*[F.col(c).alias(f"__b_{c}") for c in partition], *[F.col(c).alias(f"__b_{c}") for c in ("n", "h_hi", "h_lo")])
    a = now.select(*partition, "n", "h_hi", "h_lo")
    match = F.lit(True)
    for c in partition:
        match = match & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    j = a.join(b, match, "full_outer")
    differs = ~(F.col("n").eqNullSafe(F.col("__b_n")) & F.col("h_hi").eqNullSafe(F.col("__b_h_hi")) & F.col("h_lo").eqNullSafe(F.col("__b_h_lo")))
    return j.where(differs).select(*[F.coalesce(F.col(c), F.col(f"__b_{c}")).alias(c) for c in partition], F.col("n").isNull().alias("gone"))


class IncrementalTable:
    """A derived table whose partitions follow the partitions of its source.

    ``transform`` gets the source rows of the changed partitions and must keep the
    partition columns; ``merge``, if given, then gets its result, the rows the table holds
    of those partitions and the number of the run.  State below ``root``: ``table/``,
    ``fingerprints/v=N``, the columns and the pointer file ``CURRENT`` that names the
    committed N.  An empty text in a partition column counts as null, as paths have it.
    """

    def __init__(self, spark: SparkSession, root: str, partition: Sequence[str], hashed: Sequence[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df, merge: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None):
        self.spark, self.root, self.partition, self.hashed, self.transform, self.merge = spark, root, list(partition), list(hashed), transform, merge
        self.table_path = f"{root}/table"

    def version(self) -> int:
        """The last committed version; 0 before the first run."""
        pointer = f"{self.root}/CURRENT"
        return int(read_bytes(self.spark, pointer)) if path_exists(self.spark, pointer) else 0

    def _same(self, prefix: str) -> Column:
        match = F.lit(True)
        for c in self.partition:
            match = match & F.col(f"`{c}`").eqNullSafe(F.col(f"`{prefix}{c}`"))
        return match

    def run(self, source: DataFrame, before_commit: Callable[[], None] = lambda: None) -> int:
        """Brings the table up to date; returns the number of partitions recomputed.

        A partition that has vanished from the source, or of which nothing is left, is
        removed.  ``before_commit`` is called between the data and the fingerprints (tests
        let it fail).  A run after one that failed finds the old fingerprints, takes the
        same partitions, with the same number, and leaves the same rows.
        """
        for c in self.partition:
            if source.schema[c].dataType.typeName() == "string":
                source = source.withColumn(c, F.nullif(F.col(f"`{c}`"), F.lit("")))
        v = self.version()
        now_path = f"{self.root}/fingerprints/v={v + 1}"
        fingerprints(source, self.partition, self.hashed).write.mode("overwrite").parquet(now_path)
        now = self.spark.read.parquet(now_path)
        before = self.spark.read.parquet(f"{self.root}/fingerprints/v={v}") if v else now.limit(0)
        changed = changed_partitions(now, before, self.partition).persist()
        try:
            n = changed.count()
            todo = broadcast_if_small(changed.select(*[F.col(f"`{c}`").alias(f"__c_{c}") for c in self.partition]))
            rows = self.transform(source.join(todo, self._same("__c_"), "left_semi"))
            if self.merge:
                stored = self.read()
                rows = self.merge(rows, stored.join(todo, self._same("__c_"), "left_semi") if len(stored.columns) else stored, v + 1)
            put_json(self.spark, f"{self.root}/columns.json", T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]).jsonValue())
            if n:
                # The partitions written are told by the write itself; the table may be read
                # while it runs, as files are exchanged only when all of it is done.
                written = Observation()
                told = rows.hint("rebalance", *self.partition).observe(written, F.collect_set(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in self.partition])).alias("parts"))
                told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.partition).parquet(self.table_path)
                left = {tuple(r) for r in written.get.get("parts") or ()}
                # A partition left without rows has nothing that could overwrite it.
                for r in changed.select(*[F.col(f"`{c}`").cast("string") for c in self.partition]).toLocalIterator():
                    if tuple(r) not in left:
                        delete_path(self.spark, "/".join([self.table_path, *[partition_folder(self.spark, c, x) for c, x in zip(self.partition, r)]]))
            before_commit()
            write_bytes(self.spark, f"{self.root}/CURRENT", str(v + 1).encode())
            delete_path(self.spark, f"{self.root}/fingerprints/v={v - 1}")
            return n
        finally:
            changed.unpersist()

    def read(self) -> DataFrame:
        """The table; without any run, a frame without columns."""
        if not path_exists(self.spark, f"{self.root}/columns.json"):
            return self.spark.createDataFrame([], T.StructType())
        schema = T.StructType.fromJson(get_json(self.spark, f"{self.root}/columns.json"))
        return self.spark.read.schema(schema).parquet(self.table_path) if path_exists(self.spark, self.table_path) else self.spark.createDataFrame([], schema)


def first_seen(partition: Sequence[str], identity: Sequence[str]) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """A ``merge`` that gives each row ``first_run``, the run that processed it first."""

    def merge(rows: DataFrame, stored: DataFrame, run: int) -> DataFrame:
        if not len(stored.columns):
            return rows.withColumn("first_run", F.lit(run).cast("bigint"))
        s = stored.select(*[F.col(f"`{c}`").alias(f"__s_{c}") for c in [*partition, *identity]], "first_run")
        match = F.lit(True)
        for c in [*partition, *identity]:
            match = match & F.col(f"`{c}`").eqNullSafe(F.col(f"`__s_{c}`"))
        return rows.join(s, match, "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("first_run", F.lit(run)).cast("bigint").alias("first_run"))

    return merge


def covered_by(events: DataFrame, marks: DataFrame, feed: Sequence[str], position: tuple[str, str]) -> DataFrame:
    """The events at or before the mark of their feed: what succeeded runs have processed.

    ``marks`` holds one row per feed with ``m0, m1``.  An event without a position isn't
    known to be covered; a feed without a mark has nothing covered.
    """
    p0, p1 = position
    m = broadcast_if_small(marks.select(*[F.col(c).alias(f"__m_{c}") for c in feed], "m0", "m1"))
    match = F.lit(True)
    for c in feed:
        match = match & F.col(c).eqNullSafe(F.col(f"__m_{c}"))
    covered = (F.col(p0) < F.col("m0")) | ((F.col(p0) == F.col("m0")) & (F.col(p1) <= F.col("m1")))
    return events.join(m, match).where(covered).select(*events.columns)


def next_run(events: DataFrame, marks: DataFrame, feed: Sequence[str], identity: Sequence[str], position: tuple[str, str], segment: str, root: str) -> IncrementalTable:
    """The table of processed events after the run that follows the marks.

    The state that the succeeded runs left (partitions of feed and segment, with their
    fingerprints) is what lies at or before the marks.  The next run compares the
    fingerprints of all events with it, recomputes and replaces the partitions that differ
    and no others, and what it processes is what those partitions didn't hold:
    ``first_run`` of a row equals the table's version.  Copies of an event with one
    position count once.
    """
    spark, partition = events.sparkSession, [*feed, segment]
    names = [*partition, *identity, *position]
    events.select(*names).distinct().write.parquet(f"{root}/source")
    once = spark.read.parquet(f"{root}/source")
    rest = [*identity, *position]
    table = IncrementalTable(spark, f"{root}/processed", partition, rest, merge=first_seen(partition, rest))
    table.run(covered_by(once, marks, feed, position))
    table.run(once)
    delete_path(spark, f"{root}/source")
    return table


def uncovered_events(events: DataFrame, marks: DataFrame, feed: Sequence[str], identity: Sequence[str], position: tuple[str, str], segment: str, root: str | None = None) -> DataFrame:
    """Events beyond the furthest position a succeeded run noted for their feed.

    They are read from the table that the next run leaves (``next_run``).  Copies of an
    event count once.  A feed without any mark comes out whole; an event without a
    position isn't known to be covered and comes out too.
    """
    t = next_run(events, marks, feed, identity, position, segment, root or shared_dir(events.sparkSession, "incremental"))
    return t.read().where(F.col("first_run") == t.version()).select(*feed, *identity).distinct()
