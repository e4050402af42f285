"""Change events: windows over their positions, normalisation, quarantine, latest-wins apply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contract.model import Contract
from tidemark.functions.canonical import row_hash
from tidemark.functions.lsn import lsn_col
from tidemark.operators.hash_diff import classify, same_key
from tidemark.operators.validate import NO_ERRORS, error, json_members, judged_json, judged_keys


@dataclass(frozen=True)
class Dialect:
    """What tells the event strategies apart: position columns and how errors name an event."""

    name: str
    position: tuple[str, str]
    event_columns: tuple[str, ...]
    row_missing: str
    unsupported: str


AUDIT = Dialect("incremental_audit", ("event_ts", "event_id"), ("event_id", "event_ts"), "Audit event does not include row_after", "AUDIT")
CDC = Dialect("logical_cdc", ("__lsn", "change_index"), ("commit_lsn", "end_lsn", "change_index", "xid", "commit_ts"), "WAL event does not include row_after", "WAL")


# Positions and windows


def ordering_ts(mode: str, commit_ts: Column, recorded_at: Column) -> Column:
    """When an event counts as having happened, by watermark mode."""
    if mode == "commit_timestamp":
        return F.coalesce(commit_ts, recorded_at)
    if mode == "recorded_at":
        return recorded_at
    raise ValueError(f"unsupported watermark mode: {mode}")


def xid_of(txid: Column) -> Column:
    """The 32-bit xid of an epoch-qualified transaction id."""
    return F.pmod(txid, F.lit(4294967296))


def latest_position(events: DataFrame, position: tuple[str, str]) -> DataFrame:
    """One row with the greatest position, or nulls for an empty feed."""
    p = F.max(F.struct(*position))
    return events.where(" and ".join(f"`{c}` is not null" for c in position)).agg(p.alias("p")).select(*[F.col(f"p.{c}").alias(c) for c in position])


def window(events: DataFrame, position: tuple[str, str], start: tuple | None, end: tuple) -> DataFrame:
    """Events after ``start`` and up to ``end``, both compared as (major, minor).

    The comparison of pairs isn't pushed into a scan, so the bound on the first part is
    said once more by itself.
    """
    a, b = (F.col(c) for c in position)
    out = events.where((a <= end[0]) & ((a < end[0]) | (b <= end[1])))
    if start is not None:
        out = out.where((a >= start[0]) & ((a > start[0]) | (b > start[1])))
    return out


# Normalisation


def normalize_events(events: DataFrame, contract: Contract, dialect: Dialect, op: str = "op", old_key: Column | None = None, row_after: str = "row_after", strict_optional: bool = True) -> DataFrame:
    """``events`` plus ``events`` (array of op, key, row, row_hash) and ``errors``.

    I gives an upsert, D a delete, U an upsert and, if the key changed, a delete before
    it.  ``old_key`` is JSON text; a null or empty object stands for none: then a U keeps
    its key (change capture) or, for the audit dialect, the caller passes
    ``coalesce(row_before, key_json)``.  A D without a usable key, an I or U without a
    row, and unknown ops are errors; an event with errors gives no events.
    """
    after = F.col(row_after)
    nothing = F.create_map().cast("map<string,variant>")
    # Each step's columns are used several times by the next, so Catalyst computes them once.
    parsed = events.withColumns({"__m_after": json_members(after), "__m_old": json_members(old_key if old_key is not None else F.lit(None).cast("string"))})
    judged = parsed.withColumns({"__new": judged_json(F.coalesce("__m_after", nothing), contract, strict_optional), "__was": judged_keys(F.coalesce("__m_old", nothing), contract)})
    judged = judged.withColumns({"__after": F.col("__m_after").isNotNull(), "__old": F.col("__m_old").isNotNull() & (F.size("__m_old") > 0)})
    staged = judged.withColumns({"__row": F.col("__new.row"), "__row_errors": F.col("__new.errors"), "__key": F.col("__was.row"), "__key_errors": F.col("__was.errors")}).drop("__new", "__was", "__m_after", "__m_old")
    # The hash is taken over the coerced fields as columns of their own.
    flat = staged.select("*", *[F.col("__row").getField(f).alias(f"__f_{f}") for f in contract.fields])
    hashed = flat.withColumn("__hash", row_hash(flat, [f"__f_{f}" for f in contract.effective_hash_fields])).drop(*[f"__f_{f}" for f in contract.fields])
    new_key = F.struct(*[F.col("__row").getField(k).alias(k) for k in contract.key_fields])
    role = lambda errors, name: F.transform(errors, lambda e: F.struct(*[e.getField(f).alias(f) for f in ("field", "code", "message", "constraint", "actual_value", "contract_title", "contract_description")], F.lit(name).alias("event_role")))
    none = role(F.array().cast(NO_ERRORS), "")
    missing = role(F.array(error("$", "missing_row_after", dialect.row_missing)), "UPSERT")
    unsupported = role(F.array(error("$", "unsupported_op", "Unsupported operation")), dialect.unsupported)
    upsert_errors = F.when(~F.col("__after"), missing).otherwise(role(F.col("__row_errors"), "UPSERT"))
    delete_errors = role(F.col("__key_errors"), "DELETE")
    o = F.col(op)
    audit = dialect.name == AUDIT.name
    old_counts = F.lit(True) if audit else F.col("__old")
    # Change capture reports the old key only once the new row is right.
    update_errors = F.concat(F.when(~F.col("__after"), missing).otherwise(none), delete_errors, F.when(F.col("__after"), role(F.col("__row_errors"), "UPSERT")).otherwise(none)) if audit else F.when(F.size(upsert_errors) > 0, upsert_errors).when(old_counts, delete_errors).otherwise(none)
    errors = F.when(o == "I", upsert_errors).when(o == "D", delete_errors).when(o == "U", update_errors).otherwise(unsupported)
    event = lambda kind, k, r, h: F.struct(F.lit(kind).alias("op"), k.alias("key"), r.alias("row"), h.alias("row_hash"))
    no_row = F.when(F.lit(False), F.col("__row"))
    upsert = event("UPSERT", new_key, F.col("__row"), F.col("__hash"))
    delete = event("DELETE", F.col("__key"), no_row, F.lit(None).cast("string"))
    moved = old_counts & ~F.col("__key").eqNullSafe(new_key)
    made = F.when(o == "I", F.array(upsert)).when(o == "D", F.array(delete)).when(o == "U", F.when(moved, F.array(delete, upsert)).otherwise(F.array(upsert)))
    out = hashed.withColumn("errors", errors)
    return out.withColumn("events", F.when(F.size("errors") == 0, made)).drop("__after", "__old", "__row", "__row_errors", "__key", "__key_errors", "__hash")


def audit_old_key(row_before: Column, key_json: Column) -> Column:
    """The old image, or the key where it is absent or empty (triggers note the new key for U)."""
    empty = row_before.isNull() | (F.coalesce(F.json_object_keys(row_before).isNull() | (F.size(F.json_object_keys(row_before)) == 0), F.lit(True)))
    return F.when(empty, key_json).otherwise(row_before)


def quarantine_transactions(normalized: DataFrame, transaction: Sequence[str], feed: Sequence[str] = ()) -> DataFrame:
    """Adds ``quarantined``: true for every event of a transaction that has any error.

    The transactions with errors are found by an aggregate and marked by a join, so one
    huge transaction isn't brought into one task.
    """
    by = [*feed, *transaction]
    bad = normalized.where(F.size("errors") > 0).select(*[F.col(c).alias(f"__s_{c}") for c in by]).distinct().withColumn("__bad", F.lit(True))
    return normalized.join(bad, same_key(by), "left").withColumn("quarantined", F.coalesce("__bad", F.lit(False))).drop("__bad", *[f"__s_{c}" for c in by])


def extract_counts(normalized: DataFrame, transaction: Sequence[str] = ()) -> DataFrame:
    """The counters of an extract; with ``transaction``, those of quarantine too."""
    bad = F.size("errors") > 0
    out = F.col("quarantined") if "quarantined" in normalized.columns else bad
    made = lambda kind: F.coalesce(F.sum(F.when(~out, F.size(F.filter("events", lambda e: F.lit(True) if kind is None else e["op"] == kind)))), F.lit(0))
    counts = [
        F.count("*").alias("source_event_count"), made(None).alias("normalized_event_count"), made("UPSERT").alias("upsert_event_count"), made("DELETE").alias("delete_event_count"), F.count_if(bad).alias("invalid_event_count"),
    ]
    if transaction:
        counts += [F.count_if(out).alias("quarantined_event_count"), F.count_distinct(F.when(out, F.struct(*transaction))).alias("quarantined_transaction_count")]
    return normalized.agg(*counts)


def delta_events(normalized: DataFrame, dialect: Dialect) -> DataFrame:
    """One row per normalised event: the dialect's columns, op, key, row, row_hash."""
    good = normalized.where(~F.col("quarantined")) if "quarantined" in normalized.columns else normalized
    # Filtered after the outer explode: a filter on the array would be pushed below the
    # projection that makes it and have it made twice.
    each = good.select(*dialect.event_columns, F.explode_outer("events").alias("e")).where("e is not null")
    return each.select(*dialect.event_columns, "e.op", "e.key", "e.row", "e.row_hash")


def event_errors(normalized: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row per error of the events, with the event's own columns."""
    return normalized.select(*carry, F.posexplode_outer("errors").alias("error_index", "e")).where("e is not null").select(*carry, "error_index", "e.*")


# Latest-wins apply


def with_lsn(events: DataFrame) -> DataFrame:
    """Adds the position column of the change-capture dialect."""
    return events.withColumn("__lsn", lsn_col(F.col("commit_lsn")))


def latest_effective(events: DataFrame, keys: Sequence[str], position: Sequence[str], op: str = "op") -> DataFrame:
    """The last event of each key by position.

    A group limit before the shuffle leaves a task at most one row per key, so hot keys
    cost little.  At equal positions an upsert beats a delete (a key moved onto itself);
    rows equal in that too are told apart by their row hash, if they have one.
    """
    order = [F.col(f"`{p}`").desc_nulls_last() for p in position] + [(F.upper(F.col(op)) == "DELETE").asc()]
    if "row_hash" in events.columns:
        order.append(F.col("row_hash").desc_nulls_last())
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order))
    return events.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def classify_effective(effective: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Effective events with ``change_type``: INSERT, UPDATE, UNCHANGED, DELETE, or ABSENT.

    ABSENT is a delete of a key the state doesn't have.  ``effective`` has the keys, the
    payload, ``op`` and ``row_hash``.
    """
    j = classify(effective, state, keys, partial=True)
    return j.withColumn("change_type", F.when(F.col("op") == "DELETE", F.when(F.col("change_type") == "INSERT", "ABSENT").otherwise("DELETE")).otherwise(F.col("change_type")))


def applied(classified: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after the events: untouched rows, and the rows that were upserted.

    One full outer join by key; non-key columns of deletes aren't looked at.
    """
    e = classified.select(*[F.col(f"`{c}`").alias(f"__s_{c}") for c in target.columns], F.col("change_type").alias("__change"), F.lit(True).alias("__in_events"))
    t = target.withColumn("__in_target", F.lit(True))
    j = t.join(e, same_key(keys), "full_outer").where("__change is null or __change not in ('DELETE', 'ABSENT')")
    keep = F.col("__in_events").isNull() | ((F.col("__change") == "UNCHANGED") & F.col("__in_target"))
    return j.select(*[F.when(keep, F.col(f"`{c}`")).otherwise(F.col(f"`__s_{c}`")).alias(c) for c in target.columns])


def apply_counts(classified: DataFrame) -> DataFrame:
    n = lambda t: F.count_if(F.col("change_type") == t)
    return classified.agg(F.count("*").alias("effective_event_count"), n("INSERT").alias("insert_count"), n("UPDATE").alias("update_count"), n("DELETE").alias("delete_count"), n("UNCHANGED").alias("unchanged_count"))


# Checkpoints


def checkpoint_watermark(payload: Mapping[str, Any] | None) -> dict[str, Any] | None:
    """Where an audit run resumes: the last applied watermark, else the window's end."""
    if not payload:
        return None
    return payload.get("last_applied_watermark") or payload.get("window_end") or None


def checkpoint_lsn(payload: Mapping[str, Any] | None) -> dict[str, str | None]:
    """Both positions of a change-capture checkpoint; blanks are none."""
    clean = lambda k: (str((payload or {}).get(k) or "").strip() or None)
    return {"last_applied_lsn": clean("last_applied_lsn"), "last_flushed_lsn": clean("last_flushed_lsn")}


def resolve_checkpoint_lsn(start: str | None, delta: Mapping[str, Any] | None, apply: Mapping[str, Any] | None) -> str | None:
    """Applied, else decoded, else the window's end if it was reached, else the start.

    When all transactions of a window were quarantined the decoded position wins and
    they are passed over; when only the last was, the next run reads it again.
    """
    clean = lambda m, k: str((m or {}).get(k) or "").strip() or None
    return clean(apply, "last_applied_lsn") or clean(delta, "last_decoded_lsn") or (clean(delta, "window_end_lsn") if (delta or {}).get("reached_window_end") else None) or start
