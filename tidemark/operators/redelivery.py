"""Exactly one copy of every message that was delivered at least once.

Copies of an identifier are ranked by arrival with a full tie-break and the first is
kept.  Ranks beyond two are never needed (the second proves that there was another
copy), so Catalyst plans a group limit on both sides of the shuffle: each map task
sends at most two rows per identifier, however many copies it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.hashes import row_hash64
from tidemark.session import children, delete_path


def ranked_copies(df: DataFrame, identity: Sequence[str], arrival: Sequence[Column], keep: int = 2) -> DataFrame:
    """The first ``keep`` copies of each identifier with their ``copy_rank``.

    ``arrival`` orders the copies; nulls come last.  Rows equal in all of it are told
    apart by a hash over all columns, and rows equal in everything are one another's
    copies, so the kept row is the same in every run.  A row whose identifier has a
    null part can't be recognised again; such rows share one identifier per value of
    the other parts, as in SQL's PARTITION BY.
    """
    everything = row_hash64([F.col(f"`{c}`") for c in df.columns if not df.schema[c].dataType.typeName() in ("map", "variant")])
    order = [c.asc_nulls_last() for c in arrival] + [everything.asc()]
    rank = F.row_number().over(Window.partitionBy(*identity).orderBy(*order))
    return df.withColumn("copy_rank", rank).where(F.col("copy_rank") <= keep)


def first_copies(df: DataFrame, identity: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """One row per identifier: the copy that arrived first."""
    return ranked_copies(df, identity, arrival, keep=1).drop("copy_rank")


def repeated_identifiers(df: DataFrame, identity: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """Identifiers delivered more than once."""
    return ranked_copies(df, identity, arrival, keep=2).where("copy_rank = 2").select(*identity)


def accept_batch(batch: DataFrame, stored: DataFrame, identity: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """The rows of a new batch that no earlier batch has delivered, each once.

    The batch is made unique first, so a hot identifier meets the stored identifiers
    as one row; nulls in an identifier match nulls.
    """
    new = first_copies(batch, identity, arrival)
    seen = stored.select(*[F.col(c).alias(f"__seen_{c}") for c in identity])
    match = F.lit(True)
    for c in identity:
        match = match & F.col(c).eqNullSafe(F.col(f"__seen_{c}"))
    return new.join(seen, match, "left_anti")


class SeenMessages:
    """Identifiers accepted so far, in buckets by their hash, and the batches they came in.

    A batch meets the identifiers of the buckets it falls in and of no others, and adds one
    small file to each of them; what is stored is never shuffled to be made unique, since
    only identifiers that weren't there are added.  Below ``root``: ``messages/batch=N``
    (accepted rows) and ``seen/`` (identifiers by bucket and batch).
    """

    def __init__(self, spark: SparkSession, root: str, identity: Sequence[str], arrival: Sequence[Column], buckets: int = 64):
        self.spark, self.root, self.identity, self.arrival, self.buckets = spark, root.rstrip("/"), list(identity), list(arrival), buckets

    def accept(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of a batch that no other batch has delivered, each once, as stored.

        A batch that is given again under its number, after a failure or with other rows,
        replaces what it left; identifiers of later batches count as seen too.
        """
        n, target, seen_path = int(batch_id), f"{self.root}/messages/batch={int(batch_id)}", f"{self.root}/seen"
        bucket = F.pmod(row_hash64([F.col(c) for c in self.identity], "seen"), F.lit(self.buckets)).cast("int")
        new = batch.withColumn("__bucket", bucket)
        for b in children(self.spark, seen_path):
            delete_path(self.spark, f"{seen_path}/{b}/__batch={n}")
        kinds = ", ".join(f"`{c}` {batch.schema[c].dataType.simpleString()}" for c in self.identity)
        if children(self.spark, seen_path):
            stored = self.spark.read.schema(f"{kinds}, `__bucket` int, `__batch` bigint").parquet(seen_path)
            touched = [r[0] for r in new.select("__bucket").distinct().collect()]
            rows = accept_batch(new, stored.where(F.col("__bucket").isin(touched)) if touched else stored.limit(0), self.identity, self.arrival)
        else:
            rows = first_copies(new, self.identity, self.arrival)
        rows.write.mode("overwrite").parquet(target)
        accepted = self.spark.read.schema(rows.schema).parquet(target)
        ids = accepted.select(*self.identity, "__bucket", F.lit(n).cast("bigint").alias("__batch"))
        ids.hint("rebalance", "__bucket").write.mode("append").partitionBy("__bucket", "__batch").parquet(seen_path)
        return accepted.drop("__bucket")
