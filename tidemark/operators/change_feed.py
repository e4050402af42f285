"""Rebuilding a table's current state from a feed of changes.

The feed is a signed multiset: after removal of repeated deliveries every change
adds one copy of its after-image and takes away one copy of its before-image (the
image the key had until then, found by position).  The multiplicities are summed
together with those of the base table, and the images with a positive sum are the
current state.

A key's history is first summed within slices (by a hash of the position), where all
images but the slice's last cancel out, and then over the slices.  So a key that holds a
third of all changes is spread over as many tasks as there are slices, wherever its
positions lie, and only one image per key and slice reaches the second step.  An image is
named by its position until the end: rows are fetched for surviving positions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lsn import lsn_col
from tidemark.functions.times import utc_micros

SLICES = 1024


def is_delete(op: Column) -> Column:
    """Whether an op, in any of its spellings, deletes; null for unknown text."""
    o = F.upper(F.trim(op))
    return F.when(o.isin("DELETE", "D"), True).when(o.isin("UPSERT", "I", "U", "INSERT", "UPDATE"), False)


def json_key(key_json: Column, *names: str) -> list[Column]:
    """Integer members of a JSON key object; a number may be written as text."""
    parsed = F.from_json(key_json, ", ".join(f"`{n}` string" for n in names))
    return [F.trim(parsed[n]).try_cast("bigint") for n in names]


def optional_key(key_json: Column, name: str) -> Column:
    """A member as ``json_key`` reads it, 0 where it is absent or null; unreadable text is null."""
    text = F.from_json(key_json, f"`{name}` string")[name]
    return F.when(key_json.isNotNull() & text.isNull(), F.lit(0).cast("bigint")).otherwise(F.trim(text).try_cast("bigint"))


def _sum_images(changes: DataFrame, group: Sequence[str]) -> DataFrame:
    """One step of the sum: the images of each group that remain.

    ``changes`` holds one row per change: ``__p0, __p1`` (position) and ``__live`` (false
    for a delete, whose after-image is the absence of the row), which name its image.
    The result has the same columns.
    """
    image = F.struct("__p0", "__p1", "__live")
    before = F.lag(image).over(Window.partitionBy(*group).orderBy("__p0", "__p1", "__live"))
    signed = F.array(
        F.struct(F.lit(1).alias("n"), image.alias("of")),
        F.struct(F.lit(-1).alias("n"), F.col("__before").alias("of")),
    )
    return (
        changes.withColumn("__before", before)
        .select(*group, F.explode(F.filter(signed, lambda s: s["of"].isNotNull())).alias("__s"))
        .select(*group, F.col("__s.n").alias("__n"), "__s.of.*")
        .groupBy(*group, "__p0", "__p1", "__live")
        .agg(F.sum("__n").alias("__n"))
        .where("__n > 0")
        .drop("__n")
    )


def current_state(
    changes: DataFrame,
    key: Sequence[str],
    position: tuple[str, str],
    delete_flag: Column,
    image: Column | None = None,
    base: DataFrame | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Rows that exist after all changes: key, ``pos_major``, ``pos_minor``, ``image``.

    ``position`` names two bigint columns, compared in that order.  ``image`` is any
    orderable column to be fetched for the rows that remain (null by default).
    ``base`` has the key columns and ``image``; its rows count as older than every
    change and come out with null positions where no change touches them.

    Defined results: a change with a null key part, position part or unknown op is
    left out (it can't be placed); repeated deliveries count once, and of copies that
    differ in their image the greatest image is taken; if a delete and an upsert of
    one key share a position, the upsert counts as the later (a row moved onto
    itself); a base row given twice counts once.  Empty input gives an empty result.
    """
    p0, p1 = position
    usable = changes.select(
        *[F.col(k) for k in key],
        F.col(p0).cast("bigint").alias("__p0"),
        F.col(p1).cast("bigint").alias("__p1"),
        (~delete_flag).alias("__live"),
        (F.lit(None).cast("string") if image is None else image).alias("__image"),
    )
    usable = usable.where(" and ".join(f"`{c}` is not null" for c in [*key, "__p0", "__p1", "__live"]))
    slice_of = F.pmod(F.xxhash64("__p0", "__p1"), F.lit(slices)).cast("int")
    once = usable.select(*key, slice_of.alias("__slice"), "__p0", "__p1", "__live").distinct()
    if base is not None:
        none = F.lit(None).cast("bigint")
        once = once.unionByName(base.select(*key, F.lit(-1).alias("__slice"), none.alias("__p0"), none.alias("__p1"), F.lit(True).alias("__live")).distinct())
    within = _sum_images(once, [*key, "__slice"])
    state = _sum_images(within.drop("__slice"), [*key]).where("__live").select(*key, "__p0", "__p1")
    places = [F.col("__p0").alias("pos_major"), F.col("__p1").alias("pos_minor")]
    if image is None and base is None:
        return state.select(*key, *places, F.lit(None).cast("string").alias("image"))
    at = [*key, "__p0", "__p1"]
    out = state.where("__p0 is not null").join(usable.where("__live").groupBy(*at).agg(F.max("__image").alias("image")), at).select(*key, *places, "image")
    if base is not None:
        match = F.lit(True)
        for k in key:
            match = match & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
        images = base.select(*[F.col(k).alias(f"__b_{k}") for k in key], F.col("image").alias("__image")).groupBy(*[f"__b_{k}" for k in key]).agg(F.max("__image").alias("image"))
        out = out.unionByName(state.where("__p0 is null").join(images, match).select(*key, *places, "image"))
    return out


def normalise_audit(delta: DataFrame) -> DataFrame:
    """audit_delta as feed, source_table, key_id, line_no, positions, op, row."""
    (order_id,) = json_key(F.col("key_json"), "order_id")
    return delta.select(
        F.lit("audit").alias("feed"),
        "source_table",
        order_id.alias("key_id"),
        optional_key(F.col("key_json"), "line_no").alias("line_no"),
        utc_micros(F.col("event_ts")).alias("p_major"),
        F.col("event_id").alias("p_minor"),
        F.col("op").alias("op"),
        F.col("row_json").alias("row_json"),
    )


def normalise_cdc(delta: DataFrame) -> DataFrame:
    """cdc_delta in the same form; the position is the commit and the change's index."""
    (shipment_id,) = json_key(F.col("key_json"), "shipment_id")
    return delta.select(
        F.lit("cdc").alias("feed"),
        "source_table",
        shipment_id.alias("key_id"),
        optional_key(F.col("key_json"), "line_no").alias("line_no"),
        lsn_col(F.col("commit_lsn")).alias("p_major"),
        F.col("change_index").alias("p_minor"),
        F.col("op").alias("op"),
        F.col("row_json").alias("row_json"),
    )
