"""The stages of the three strategies, from source frames to versioned tables.

Snapshots are accepted or rejected whole; audit events are quarantined one by one, change
capture by transaction.  Every stage can be repeated: artifacts are overwritten, and a
merge or apply of the same artifact changes nothing.
"""

from __future__ import annotations

from time import perf_counter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contract.model import Contract, ContractValidationError
from tidemark.contract.types import check_source, family
from tidemark.functions.canonical import canonical_text, row_hash
from tidemark.functions.coerce import coerce
from tidemark.functions.lsn import lsn_col
from tidemark.operators import delta as d
from tidemark.operators import hash_diff as hd
from tidemark.operators import validate as v
from tidemark.sources.store import VersionedTable, normalize_key, put_json, read_ndjson, rows_for, write_ndjson

PREVIEW = 5


def jsonable(row: Column, contract: Contract, fields: tuple[str, ...], kinds: T.StructType) -> Column:
    """A struct as JSON holds it: decimals, times and bytes as text, JSON text as JSON."""
    out = []
    for f in fields:
        c, kind = row.getField(f), kinds[f].dataType
        if isinstance(kind, (T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BinaryType)):
            c = canonical_text(c, kind, null_text=False)
        elif isinstance(kind, T.StringType) and family(contract.field_types.get(f)) in ("json", "array"):
            c = F.try_parse_json(c)
        out.append(c.alias(f))
    return F.when(row.isNotNull(), F.struct(*out))


def from_artifact(df: DataFrame, contract: Contract, fields: tuple[str, ...], prefix: str = "") -> list[Column]:
    """Typed columns of fields that an artifact holds as text."""
    return [coerce(F.col(f"{prefix}`{f}`"), T.StringType(), contract.field_types.get(f), json_text=True)[0].alias(f) for f in fields]


# Snapshots


def refuse_repeated_keys(rows: DataFrame, keys: list[str]) -> None:
    """Raises ContractValidationError if a key (nulls included) is held by several rows."""
    several = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("__n")).where("__n > 1")
    found = several.agg(F.count("*").alias("n"), F.sum("__n").alias("rows"), F.min(F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]))).alias("one")).first()
    if found["n"]:
        raise ContractValidationError(f"{found['n']} keys are held by {found['rows']} rows of the snapshot, one of them {found['one']}", invalid_count=found["rows"])


def run_hash_diff(source: DataFrame, table: VersionedTable, use_row_hash: bool = False, hash_input: str = "raw") -> dict[str, Any]:
    """Brings a table in line with a source snapshot; returns the run's counters.

    ``use_row_hash`` trusts a ``row_hash`` column of the source (never blank); else the
    source's values are hashed as they are (``raw``) or coerced (``normalized``).  A
    snapshot is taken whole or not at all: one that holds a key twice, or whose values
    can't be normalized, raises ContractValidationError and the table stays as it is (its
    absence would otherwise delete a rejected row).  Only the buckets of rows that changed
    are written, and nothing when nothing changed.
    """
    started, contract = perf_counter(), table.contract.check()
    check_source(source.schema, contract)
    if use_row_hash:
        current = hd.checked_hashes(source.select(*[F.col(f"`{f}`") for f in contract.fields], "row_hash"))
    elif hash_input == "normalized":
        judged = v.validated_rows(source, contract)
        invalid = judged.where(F.size("errors") > 0).count()
        if invalid:
            raise ContractValidationError(f"{invalid} rows of the snapshot break the contract", invalid_count=invalid)
        current = v.accepted_rows(judged, contract)
    else:
        current = source.select(*[F.col(f"`{f}`") for f in contract.fields]).withColumn("row_hash", row_hash(source, list(contract.effective_hash_fields), "raw"))
    keys = list(contract.key_fields)
    refuse_repeated_keys(current, keys)
    manifest = table.manifest()
    classified = hd.classify(current, table.stored().select(*keys, "row_hash"), keys).persist()
    try:
        counts = hd.change_counts(classified).first().asDict()
        diff_seconds = perf_counter() - started
        read = counts["insert_count"] + counts["update_count"] + counts["unchanged_count"]
        if counts["insert_count"] + counts["update_count"] + counts["delete_count"] or not manifest["version"]:

            def rows_of(stored: DataFrame, buckets: set[int] | None) -> DataFrame:
                mine = classified if buckets is None else table.in_buckets(classified, buckets, manifest["n_buckets"])
                return rows_for(hd.merged(mine, stored, keys), table)

            table.commit_buckets(rows_of, _touched(classified, table, manifest), read, {"counts": counts})
        return {**counts, "read_count": read, "version": table.version(), "diff_seconds": diff_seconds, "total_seconds": perf_counter() - started}
    finally:
        classified.unpersist()


def _touched(classified: DataFrame, table: VersionedTable, manifest: dict[str, Any]) -> set[int]:
    """Buckets in which a row is inserted, updated or deleted."""
    changed = classified.where("change_type in ('INSERT', 'UPDATE', 'DELETE')")
    return {r[0] for r in changed.select(table.bucket(classified, manifest["n_buckets"])).distinct().collect()}


def validate_and_land_snapshot(source: DataFrame, contract: Contract, out: str, strict_optional: bool = True) -> dict[str, Any]:
    """Validates a snapshot and lands ``errors``, ``accepted`` and ``manifest.json`` below ``out``.

    If any row is invalid only the errors and the manifest are landed and
    ContractValidationError is raised.  Row numbers follow the keys' order.
    """
    spark, started = source.sparkSession, perf_counter()
    contract.check()
    check_source(source.schema, contract)
    rows = v.numbered(source.select(*[F.col(f"`{f}`") for f in contract.fields]), list(contract.key_fields))
    judged = v.with_duplicates(v.validated_rows(rows, contract, strict_optional), contract, [F.col("row_number")]).persist()
    try:
        n = judged.agg(F.count("*").alias("source_row_count"), F.count_if(F.size("errors") > 0).alias("invalid_row_count")).first().asDict()
        n["valid_row_count"] = n["source_row_count"] - n["invalid_row_count"]
        errors = v.error_rows(judged)
        error_path = write_ndjson(errors, f"{out}/{normalize_key('errors')}")
        accepted = None
        if not n["invalid_row_count"]:
            good = v.accepted_rows(judged, contract)
            kinds = good.schema
            whole = good.select(F.struct(*[F.col(f"`{f}`") for f in contract.fields]).alias("r"), "row_hash")
            accepted = write_ndjson(whole.select(jsonable(F.col("r"), contract, contract.fields, kinds).alias("r"), "row_hash").select("r.*", "row_hash"), f"{out}/accepted")
        preview = [r.asDict() for r in v.error_preview(errors, PREVIEW)]
        manifest = put_json(spark, f"{out}/manifest.json", {**n, "stage": "validate_and_land_snapshot", "contract_id": contract.contract_id, "contract_version": contract.version, "accepted_path": accepted, "error_path": error_path, "sample_errors": preview, "seconds": perf_counter() - started})
        if accepted is None:
            raise ContractValidationError(f"{n['invalid_row_count']} of {n['source_row_count']} rows break the contract: {v.summarize(preview)}", error_path, manifest, None, n["invalid_row_count"])
        return {**n, "accepted_path": accepted, "error_path": error_path, "manifest_path": manifest}
    finally:
        judged.unpersist()


def read_accepted(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """A landed snapshot as typed rows with ``row_hash``."""
    text = T.StructType([T.StructField(f, T.StringType()) for f in [*contract.fields, "row_hash"]])
    raw = read_ndjson(spark, path, text)
    return raw.select(*from_artifact(raw, contract, contract.fields), "row_hash")


def merge_snapshot(spark: SparkSession, accepted_path: str, table: VersionedTable) -> dict[str, Any]:
    """Merges a landed snapshot; the artifact alone is enough to do it again."""
    return run_hash_diff(read_accepted(spark, accepted_path, table.contract), table, use_row_hash=True)


# Audit and change-capture deltas


def _land(normalized: DataFrame, contract: Contract, dialect: d.Dialect, out: str, carry: list[str], transaction: list[str], extra: dict[str, Any]) -> dict[str, Any]:
    spark = normalized.sparkSession
    kept = normalized.persist()
    try:
        counts = d.extract_counts(kept, transaction).first().asDict()
        events = d.delta_events(kept, dialect)
        kinds = {name: events.schema[name].dataType for name in ("key", "row")}
        times = [c for c in dialect.event_columns if isinstance(events.schema[c].dataType, (T.TimestampType, T.TimestampNTZType))]
        shown = events.withColumns({c: canonical_text(F.col(c), events.schema[c].dataType, null_text=False) for c in times})
        shown = shown.withColumn("key", jsonable(F.col("key"), contract, contract.key_fields, kinds["key"])).withColumn("row", jsonable(F.col("row"), contract, contract.fields, kinds["row"]))
        delta_path = write_ndjson(shown, f"{out}/delta")
        errors = d.event_errors(kept, carry)
        error_path = write_ndjson(errors, f"{out}/errors")
        preview = [r.asDict() for r in errors.orderBy(*carry, "error_index").limit(PREVIEW).collect()] if counts["invalid_event_count"] else []
        result = {**counts, **extra, "delta_path": delta_path, "error_path": error_path, "contract_id": contract.contract_id, "contract_version": contract.version}
        result["manifest_path"] = put_json(spark, f"{out}/manifest.json", {**result, "strategy": dialect.name, "sample_errors": preview})
        return result
    finally:
        kept.unpersist()


def land_audit_delta(audit: DataFrame, contract: Contract, out: str, start: dict[str, Any] | None = None, mode: str = "recorded_at") -> dict[str, Any]:
    """Lands the events of (``start``, newest] as a delta; bad events are quarantined.

    ``audit`` has the audit table's columns and, for mode ``commit_timestamp``,
    ``commit_ts``.  The window's end is fixed before the scan; an empty log, or one with
    nothing new, gives an empty delta.
    """
    contract.check()
    commit_ts = F.col("commit_ts") if "commit_ts" in audit.columns else F.lit(None).cast(audit.schema["recorded_at"].dataType)
    events = audit.withColumns({"event_ts": d.ordering_ts(mode, commit_ts, F.col("recorded_at")), "event_id": F.col("audit_event_id")})
    last = d.latest_position(events, ("event_ts", "event_id")).first()
    begin = (start["ordering_ts"], start["event_id"]) if start else None
    if last["event_ts"] is None:
        part = events.limit(0)
    else:
        part = d.window(events, ("event_ts", "event_id"), begin, (last["event_ts"], last["event_id"]))
    normalized = d.normalize_events(part, contract, d.AUDIT, old_key=d.audit_old_key(F.col("row_before"), F.col("key_json")))
    end = {"ordering_ts": last["event_ts"], "event_id": last["event_id"], "mode": mode} if last["event_ts"] is not None else None
    return _land(normalized, contract, d.AUDIT, out, ["event_id", "op", "event_ts"], [], {"window_start": start, "window_end": end, "watermark_mode": mode})


def land_cdc_delta(events: DataFrame, contract: Contract, out: str, start_lsn: str | None = None, end_lsn: str | None = None, reached_window_end: bool | None = None) -> dict[str, Any]:
    """Lands decoded changes of a window; a transaction with any error is quarantined whole.

    ``events``: op, commit_lsn, end_lsn, change_index, xid, commit_ts, old_key and
    row_after (JSON text), as ``sources.pgoutput.decode_messages`` gives them.
    ``reached_window_end`` is what the reader says (``sources.replication.land_messages``).
    Left out, the end counts as reached only if ``events`` has a commit at it or beyond,
    which come in order; else the checkpoint would pass over what wasn't read.
    """
    contract.check()
    lsn = lsn_col(F.col("commit_lsn"))
    if reached_window_end is None:
        reached_window_end = bool(end_lsn) and not events.where(lsn >= lsn_col(F.lit(end_lsn))).isEmpty()
    part = events
    if start_lsn:
        part = part.where(lsn > lsn_col(F.lit(start_lsn)))
    if end_lsn:
        part = part.where(lsn <= lsn_col(F.lit(end_lsn)))
    decoded = part.agg(F.max_by("end_lsn", F.struct(lsn, "change_index")).alias("last")).first()["last"]
    normalized = d.quarantine_transactions(d.normalize_events(part, contract, d.CDC, old_key=F.col("old_key")), ["commit_lsn", "xid"])
    return _land(normalized, contract, d.CDC, out, ["commit_lsn", "change_index", "op"], ["commit_lsn", "xid"], {"window_start_lsn": start_lsn, "window_end_lsn": end_lsn, "last_decoded_lsn": decoded, "reached_window_end": reached_window_end})


def read_delta(spark: SparkSession, path: str, contract: Contract, dialect: d.Dialect) -> DataFrame:
    """A landed delta as typed columns: keys, fields, op, row_hash and the position."""
    s = T.StringType()
    text = lambda names: T.StructType([T.StructField(n, s) for n in names])
    schema = T.StructType([*[T.StructField(c, s) for c in dialect.event_columns], T.StructField("op", s), T.StructField("key", text(contract.key_fields)), T.StructField("row", text(contract.fields)), T.StructField("row_hash", s)])
    return typed_delta(read_ndjson(spark, path, schema), contract, dialect)


def typed_delta(raw: DataFrame, contract: Contract, dialect: d.Dialect) -> DataFrame:
    """Key and row members, as text, to typed columns; of a delete only the key counts."""
    types = {"event_id": "bigint", "change_index": "bigint", "xid": "bigint", "event_ts": "timestamp", "commit_ts": "timestamp"}
    meta = [F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in dialect.event_columns]
    values = [coerce(F.coalesce(F.when(F.upper("op") == "UPSERT", F.col(f"row.`{f}`")), F.col(f"key.`{f}`")) if f in contract.key_fields else F.when(F.upper("op") == "UPSERT", F.col(f"row.`{f}`")), T.StringType(), contract.field_types.get(f), json_text=True)[0].alias(f) for f in contract.fields]
    out = raw.select(*meta, F.upper(F.trim("op")).alias("op"), "row_hash", *values)
    # A writer may leave the hash out; then it is computed from the row.
    hashed = row_hash(out, list(contract.effective_hash_fields))
    out = out.withColumn("row_hash", F.when(F.col("op") == "UPSERT", F.coalesce(F.when(F.trim("row_hash") != "", F.lower(F.trim("row_hash"))), hashed)))
    return d.with_lsn(out) if dialect.name == d.CDC.name else out


def apply_delta(events: DataFrame, table: VersionedTable, dialect: d.Dialect, info: dict[str, Any] | None = None) -> dict[str, Any]:
    """Applies typed delta events latest-wins; returns counts and the last position.

    The watermark is the greatest position of the events given, so quarantined events at
    the end don't move it.  Only buckets in which a row changes are written; when none
    does, nothing is, or a manifest alone if there is ``info`` to note.
    """
    started, contract = perf_counter(), table.contract
    keys, manifest = list(contract.key_fields), table.manifest()
    effective = d.latest_effective(events, keys, dialect.position).persist()
    # Only the buckets that the events' keys lie in are read, and only those that change written.
    seen = {r[0] for r in effective.select(table.bucket(effective, manifest["n_buckets"])).distinct().collect()}
    classified = d.classify_effective(effective, table.stored(buckets=seen).select(*keys, "row_hash"), keys).persist()
    try:
        counts = d.apply_counts(classified).first().asDict()
        position = F.struct(*dialect.position)
        last = events.agg(F.count("*").alias("n"), F.max(position).alias("p"), (F.max_by("end_lsn", position) if "end_lsn" in events.columns else F.lit(None).cast("string")).alias("e")).first()
        if counts["insert_count"] + counts["update_count"] + counts["delete_count"] or not manifest["version"] or info:

            def rows_of(stored: DataFrame, buckets: set[int] | None) -> DataFrame:
                mine = classified if buckets is None else table.in_buckets(classified, buckets, manifest["n_buckets"])
                return rows_for(d.applied(mine, stored, keys), table)

            n_rows = manifest["rows"] + counts["insert_count"] - counts["delete_count"]
            table.commit_buckets(rows_of, _touched(classified, table, manifest), n_rows, {"counts": counts, **(info or {})})
        result: dict[str, Any] = {**counts, "read_count": last["n"], "version": table.version(), "total_seconds": perf_counter() - started}
        if dialect.name == d.AUDIT.name:
            result["last_applied_watermark"] = None if last["p"] is None else {"ordering_ts": last["p"]["event_ts"], "event_id": last["p"]["event_id"], "mode": "event_ts"}
        else:
            result["last_applied_lsn"] = last["e"]
        return result
    finally:
        classified.unpersist()
        effective.unpersist()


def apply_delta_artifact(spark: SparkSession, path: str, table: VersionedTable, dialect: d.Dialect) -> dict[str, Any]:
    """Applies a landed delta; the artifact alone is enough to do it again."""
    return apply_delta(read_delta(spark, path, table.contract, dialect), table, dialect)
