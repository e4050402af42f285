"""Classifying a snapshot against the stored row hashes in one full outer join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE_TYPES = ("INSERT", "UPDATE", "UNCHANGED", "DELETE")


def same_key(keys: Sequence[str], left: str = "", right: str = "__s_") -> Column:
    """Null-safe equality of all key parts; an equi-join for Catalyst."""
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"`{left}{k}`").eqNullSafe(F.col(f"`{right}{k}`"))
    return match


def checked_hashes(rows: DataFrame, column: str = "row_hash") -> DataFrame:
    """``rows`` with a supplied hash column; the job fails on a null or blank hash."""
    h = F.col(column)
    return rows.withColumn(column, F.when(h.isNull() | (F.trim(h) == ""), F.raise_error(F.lit(f"{column} must not be blank"))).otherwise(h))


def classify(current: DataFrame, state: DataFrame, keys: Sequence[str], partial: bool = False) -> DataFrame:
    """Rows of ``current`` (keys, payload, ``row_hash``) and vanished keys, with ``change_type``.

    A key without stored hash is INSERT, with another hash UPDATE, with the same hash
    UNCHANGED.  A stored key that ``current`` lacks is DELETE (payload null), unless
    ``partial``: then the input is a set of upserts and absence says nothing.  Keys match
    null-safely; an empty snapshot deletes everything.  ``current`` must be unique by
    key.  Columns of ``state`` other than the keys and ``row_hash`` aren't looked at.
    """
    s = state.select(*[F.col(f"`{k}`").alias(f"__s_{k}") for k in keys], F.col("row_hash").alias("__s_hash"), F.lit(True).alias("__in_state"))
    c = current.withColumn("__in_current", F.lit(True))
    j = c.join(s, same_key(keys), "left" if partial else "full_outer")
    change = (
        F.when(F.col("__in_current").isNull(), "DELETE")
        .when(F.col("__in_state").isNull(), "INSERT")
        .when(~F.col("row_hash").eqNullSafe(F.col("__s_hash")), "UPDATE")
        .otherwise("UNCHANGED")
    )
    out = []
    for x in current.columns:
        out.append(F.when(F.col("__in_current"), F.col(f"`{x}`")).otherwise(F.col(f"`__s_{x}`")).alias(x) if x in keys else F.col(f"`{x}`"))
    return j.select(*out, change.alias("change_type"))


def change_counts(classified: DataFrame) -> DataFrame:
    """One row: insert, update, unchanged and delete counts."""
    n = lambda t: F.count_if(F.col("change_type") == t)
    return classified.agg(n("INSERT").alias("insert_count"), n("UPDATE").alias("update_count"), n("UNCHANGED").alias("unchanged_count"), n("DELETE").alias("delete_count"))


def merged(classified: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The curated table after a snapshot: every row of it, minus the vanished keys.

    Rows whose hash is unchanged keep what the target has, so drift of the target itself
    goes unseen, as the comparison is with the hash state.
    """
    t = target.select(*[F.col(f"`{c}`").alias(f"__s_{c}") for c in target.columns], F.lit(True).alias("__in_target"))
    c = classified.where("change_type <> 'DELETE'")
    j = c.join(t, same_key(keys), "left")
    keep = (F.col("change_type") == "UNCHANGED") & F.col("__in_target")
    return j.select(*[F.when(keep, F.col(f"`__s_{x}`")).otherwise(F.col(f"`{x}`")).alias(x) for x in target.columns])


def delete_missing(target: DataFrame, source_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the target whose key the source still has (null-safe)."""
    s = source_keys.select(*[F.col(f"`{k}`").alias(f"__s_{k}") for k in keys])
    return target.join(s, same_key(keys), "left_semi")


def changed_columns(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Sorted names of the columns whose values differ (null-safe)."""
    return F.array_sort(F.filter(F.array(*[F.when(~before[c].eqNullSafe(after[c]), F.lit(c)) for c in after]), lambda x: x.isNotNull()))
