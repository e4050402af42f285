"""What changed between consecutive full snapshots.

Rows are reduced to compact arrays before they are shuffled: a 128-bit hash of the key
and a 64-bit hash of the compared values.  They are spread by key hash, so every
snapshot of a key meets in one bucket of bounded size; a bucket is sorted in numpy and
consecutive snapshots are compared by searchsorted.  Full values are fetched for the
differing keys only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashes import row_hash64
from tidemark.session import bounded_rows

ROWS_PER_BUCKET = 250_000
MAX_CATALOGUE = 200_000
NONE = -(1 << 62)


def _packed(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Two 64-bit halves as one sortable 16-byte value."""
    out = np.empty((len(h1), 2), dtype=">u8")
    out[:, 0] = h1.view(np.uint64)
    out[:, 1] = h2.view(np.uint64)
    return out.view("S16").reshape(-1)


def _absent(these: np.ndarray, those: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of ``these`` (any order) missing in sorted ``those``, and where each would be."""
    if not len(those):
        return np.ones(len(these), bool), np.zeros(len(these), np.int64)
    at = np.searchsorted(those, these)
    near = np.minimum(at, len(those) - 1)
    return those[near] != these, near


def diff_bucket(table: pa.Table) -> pa.Table:
    """Differences of one bucket: the input's carried columns, snapshot and change."""
    col = lambda name: table.column(name).to_numpy(zero_copy_only=False)
    snap, prev, nxt, value = col("__snap"), col("__prev"), col("__next"), col("__v")
    key = _packed(np.ascontiguousarray(col("__h1")), np.ascontiguousarray(col("__h2")))
    order = np.lexsort((np.arange(len(key)), key, snap)) if len(key) else np.array([], np.int64)
    starts = {}
    ordered_snap = snap[order]
    numbers, begin = np.unique(ordered_snap, return_index=True)
    ends = [*begin[1:], len(order)]
    for s, b, e in zip(numbers, begin, ends):
        starts[int(s)] = order[b:e]
    nothing = np.array([], np.int64)
    rows, at_snapshot, change = [], [], []

    def report(which: np.ndarray, snapshot: int, what: str) -> None:
        rows.append(which)
        at_snapshot.append(np.full(len(which), snapshot, np.int64))
        change.extend([what] * len(which))

    for s, here in starts.items():
        if (before := int(prev[here[0]])) != NONE:
            there = starts.get(before, nothing)
            missing, near = _absent(key[here], key[there])
            report(here[missing], s, "added")
            if len(there):
                same = ~missing
                report(here[same][value[here][same] != value[there[near]][same]], s, "changed")
        if (after := int(nxt[here[0]])) != NONE:
            missing, _ = _absent(key[here], key[starts.get(after, nothing)])
            report(here[missing], after, "removed")
    picked = table.take(pa.array(np.concatenate(rows) if rows else nothing))
    picked = picked.drop_columns([c for c in picked.column_names if c.startswith("__") and c not in ("__h1", "__h2")])
    return picked.append_column("snapshot_no", pa.array(np.concatenate(at_snapshot) if at_snapshot else nothing, pa.int64())).append_column("change", pa.array(change, pa.string()))


def snapshot_changes(
    rows: DataFrame,
    group: str,
    snapshot: str,
    key: Sequence[Column],
    value_hash: Column,
    first: Sequence[Column],
    carry: Sequence[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Keys added, removed or changed between a snapshot and the one before it by number.

    Result: ``group``, the ``carry`` columns (parts of the key), ``__h1``, ``__h2`` (the
    key's hash, for ``differing_rows``), ``snapshot_no`` of the later snapshot and
    ``change``.  Of several rows of a key in one snapshot the one smallest in ``first``
    counts; rows with a null in ``group`` or ``snapshot``, or whose key expressions are
    all null, are left out.  A snapshot of which no row was delivered doesn't exist.
    The first snapshot of a group has nothing to be compared with.
    """
    usable = rows.where(F.col(group).isNotNull() & F.col(snapshot).isNotNull() & F.coalesce(*[k.cast("string") for k in key]).isNotNull())
    compact = usable.select(
        F.col(group).alias(group),
        F.col(snapshot).cast("bigint").alias("__snap"),
        row_hash64(key, "key-a").alias("__h1"),
        row_hash64(key, "key-b").alias("__h2"),
        *[F.col(c).alias(c) for c in carry],
        value_hash.alias("__v"),
        F.struct(*[f.alias(f"f{i}") for i, f in enumerate(first)]).alias("__first"),
    )
    # Pre-aggregated on the map side: a key that fills a snapshot leaves a task as one row.
    once = compact.groupBy(group, "__snap", "__h1", "__h2").agg(
        *[F.min_by(c, "__first").alias(c) for c in carry], F.min_by("__v", "__first").alias("__v")
    )
    numbers = compact.select(group, "__snap").distinct()
    w = Window.partitionBy(group).orderBy("__snap")
    numbers = numbers.select(
        group, "__snap",
        F.coalesce(F.lag("__snap").over(w), F.lit(NONE)).alias("__prev"),
        F.coalesce(F.lead("__snap").over(w), F.lit(NONE)).alias("__next"),
    )
    if (known := bounded_rows(numbers, MAX_CATALOGUE)) is not None:
        numbers = F.broadcast(rows.sparkSession.createDataFrame(known, numbers.schema))
    buckets = max(1, -(-usable.count() // rows_per_bucket))
    bucketed = once.join(numbers, [group, "__snap"]).withColumn("__bucket", F.pmod(F.col("__h1"), F.lit(buckets)))
    kinds = {f.name: f.dataType.simpleString() for f in once.schema}
    schema = ", ".join([f"`{group}` {kinds[group]}", "__h1 bigint", "__h2 bigint", *[f"`{c}` {kinds[c]}" for c in carry], "snapshot_no bigint", "change string"])
    names = [group, "__h1", "__h2", *carry, "snapshot_no", "change"]

    def run(table: pa.Table) -> pa.Table:
        return diff_bucket(table).select(names)

    return bucketed.groupBy(group, "__bucket").applyInArrow(run, schema)


def differing_rows(changes: DataFrame, rows: DataFrame, group: str, snapshot: str, key: Sequence[Column], first: Sequence[Column]) -> DataFrame:
    """Full rows of the differing keys at the later snapshot (removed keys have none)."""
    wanted = changes.where("change <> 'removed'").select(F.col(group).alias("__g"), F.col("snapshot_no").alias("__s"), F.col("__h1").alias("__a"), F.col("__h2").alias("__b"), "change")
    hashed = rows.withColumns({"__h1": row_hash64(key, "key-a"), "__h2": row_hash64(key, "key-b")})
    joined = hashed.join(
        wanted,
        (F.col(group) == F.col("__g")) & (F.col(snapshot).cast("bigint") == F.col("__s")) & (F.col("__h1") == F.col("__a")) & (F.col("__h2") == F.col("__b")),
    )
    rank = F.row_number().over(Window.partitionBy("__g", "__s", "__a", "__b").orderBy(*first))
    return joined.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__g", "__s", "__a", "__b", "__h1", "__h2")
