"""Audit capture: a log table, a trigger function and a trigger at the source."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from typing import Any

from tidemark.admin import Connection, first_value, quoted
from tidemark.contract.model import Contract, parse_table_name, validate_identifier

MODES = ("auto", "commit_timestamp", "recorded_at")
#: Columns of the audit log as the events are read from it (fixed format).
LOG_COLUMNS = (
    "audit_event_id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY",
    "source_table TEXT NOT NULL",
    "op TEXT NOT NULL CHECK (op IN ('I', 'U', 'D'))",
    "source_txid BIGINT NOT NULL",
    "recorded_at TIMESTAMPTZ NOT NULL DEFAULT clock_timestamp()",
    "key_json JSONB NOT NULL",
    "row_before JSONB",
    "row_after JSONB",
    "changed_columns TEXT[]",
)


@dataclass
class AuditSetup:
    """What a setup really changed."""

    watermark_mode: str
    schema_created: bool = False
    table_created: bool = False
    function_created: bool = False
    trigger_created: bool = False
    indexes_created: int = 0

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def _named(prefix: str, table: str) -> str:
    """A name with a suffix that survives the cut at 63 characters where it can."""
    digest = hashlib.sha1(table.encode()).hexdigest()[:10]
    return validate_identifier(f"{prefix}{table}_{digest}"[:63])


def function_name(table: str) -> str:
    return _named("_ia_fn_", table)


def trigger_name(table: str) -> str:
    return _named("_ia_trg_", table)


def table_sql(schema: str, table: str) -> str:
    return f"CREATE TABLE IF NOT EXISTS {quoted(schema, table)} ({', '.join(LOG_COLUMNS)})"


def key_sql(keys: Sequence[str], record: str) -> str:
    """The key of NEW or OLD as a JSONB object."""
    if not keys:
        raise ValueError("a key needs fields")
    return "jsonb_build_object(" + ", ".join(f"'{validate_identifier(k)}', {record}.{quoted(k)}" for k in keys) + ")"


def function_sql(schema: str, table: str, function: str, keys: Sequence[str]) -> str:
    """A trigger function that logs an operation in the transaction that makes it.

    One INSERT serves all three operations: images that an operation lacks are null, and
    the names of changed columns are gathered for updates only.
    """
    return f"""CREATE OR REPLACE FUNCTION {quoted(schema, function)}() RETURNS trigger LANGUAGE plpgsql AS $body$
DECLARE
    before_image jsonb := CASE WHEN TG_OP <> 'INSERT' THEN to_jsonb(OLD) END;
    after_image jsonb := CASE WHEN TG_OP <> 'DELETE' THEN to_jsonb(NEW) END;
    event_key jsonb;
    changed text[];
BEGIN
    IF TG_OP = 'DELETE' THEN
        event_key := {key_sql(keys, "OLD")};
    ELSE
        event_key := {key_sql(keys, "NEW")};
    END IF;
    IF TG_OP = 'UPDATE' THEN
        changed := ARRAY(SELECT a.key FROM jsonb_each(after_image) a WHERE before_image -> a.key IS DISTINCT FROM a.value ORDER BY a.key);
    END IF;
    INSERT INTO {quoted(schema, table)} (source_table, op, source_txid, key_json, row_before, row_after, changed_columns)
    VALUES (TG_TABLE_SCHEMA || '.' || TG_TABLE_NAME, left(TG_OP, 1), txid_current(), event_key, before_image, after_image, changed);
    RETURN COALESCE(NEW, OLD);
END
$body$"""


def trigger_sql(source: tuple[str, str], trigger: str, schema: str, function: str) -> str:
    return f"CREATE TRIGGER {quoted(trigger)} AFTER INSERT OR UPDATE OR DELETE ON {quoted(*source)} FOR EACH ROW EXECUTE FUNCTION {quoted(schema, function)}()"


def drop_trigger_sql(source: tuple[str, str], trigger: str) -> str:
    return f"DROP TRIGGER IF EXISTS {quoted(trigger)} ON {quoted(*source)}"


def index_sql(schema: str, table: str) -> dict[str, str]:
    """Indexes by name: on the recording time and on the transaction, each with the id."""
    out = {}
    for kind, column in (("recorded", "recorded_at"), ("txid", "source_txid")):
        name = f"idx_{table}_{kind}_event"[:63]
        out[name] = f"CREATE INDEX IF NOT EXISTS {quoted(name)} ON {quoted(schema, table)} ({column}, audit_event_id)"
    return out


def ordering_sql(mode: str) -> str:
    """When an event counts as having happened, as SQL at the source."""
    if mode == "recorded_at":
        return "recorded_at"
    if mode == "commit_timestamp":
        # The log keeps 64-bit transaction ids; their commit time is asked for by the lower 32 bits.
        return "COALESCE(pg_xact_commit_timestamp(mod(source_txid, 4294967296)::text::xid), recorded_at)"
    raise ValueError(f"unsupported watermark mode: {mode}")


def latest_sql(schema: str, table: str, mode: str) -> str:
    return f"SELECT {ordering_sql(mode)} AS ordering_ts, audit_event_id FROM {quoted(schema, table)} ORDER BY 1 DESC, 2 DESC LIMIT 1"


def window_sql(schema: str, table: str, mode: str, lower: bool) -> str:
    """The events of a half-open window; parameters start_ts, start_id, end_ts, end_id."""
    position = f"({ordering_sql(mode)}, audit_event_id)"
    bounds = [f"{position} <= (%(end_ts)s, %(end_id)s)"] + ([f"{position} > (%(start_ts)s, %(start_id)s)"] if lower else [])
    return f"SELECT audit_event_id, op, source_txid, recorded_at, {ordering_sql(mode)} AS ordering_ts, key_json, row_before, row_after, changed_columns FROM {quoted(schema, table)} WHERE {' AND '.join(bounds)} ORDER BY ordering_ts, audit_event_id"


def resolve_mode(conn: Connection, requested: str = "auto") -> str:
    """The watermark mode to use: commit timestamps where the source keeps them."""
    if requested not in MODES:
        raise ValueError(f"unsupported watermark mode: {requested}")
    if requested == "recorded_at":
        return requested
    kept = str(first_value(conn, "SELECT current_setting('track_commit_timestamp', true) AS v") or "").strip().lower() in ("on", "true", "1")
    if requested == "commit_timestamp" and not kept:
        raise ValueError("watermark mode commit_timestamp needs track_commit_timestamp=on at the source")
    return "commit_timestamp" if kept else "recorded_at"


def ensure_audit_capture(conn: Connection, source_table: str, audit_table: str, contract: Contract, mode: str = "auto", replace_trigger: bool = False) -> AuditSetup:
    """Creates what is missing of schema, log, function, trigger and indexes.

    Running it again changes nothing but the function's body, which follows the
    contract's keys.
    """
    source, (schema, log) = parse_table_name(source_table), parse_table_name(audit_table)
    out = AuditSetup(resolve_mode(conn, mode))
    token = "_".join(source)
    fn, trigger = function_name(token), trigger_name(token)
    there = lambda sql, **p: bool(first_value(conn, f"SELECT EXISTS ({sql}) AS v", p))
    if not there("SELECT 1 FROM information_schema.schemata WHERE schema_name = %(s)s", s=schema):
        conn.execute(f"CREATE SCHEMA IF NOT EXISTS {quoted(schema)}")
        out.schema_created = True
    if not there("SELECT 1 FROM information_schema.tables WHERE table_schema = %(s)s AND table_name = %(t)s", s=schema, t=log):
        conn.execute(table_sql(schema, log))
        out.table_created = True
    out.function_created = not there("SELECT 1 FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace WHERE n.nspname = %(s)s AND p.proname = %(f)s", s=schema, f=fn)
    conn.execute(function_sql(schema, log, fn, contract.key_fields))
    has_trigger = there("SELECT 1 FROM pg_trigger t JOIN pg_class c ON c.oid = t.tgrelid JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = %(s)s AND c.relname = %(t)s AND t.tgname = %(g)s AND NOT t.tgisinternal", s=source[0], t=source[1], g=trigger)
    if has_trigger and replace_trigger:
        conn.execute(drop_trigger_sql(source, trigger))
        has_trigger = False
    if not has_trigger:
        conn.execute(trigger_sql(source, trigger, schema, fn))
        out.trigger_created = True
    for name, sql in index_sql(schema, log).items():
        if not there("SELECT 1 FROM pg_indexes WHERE schemaname = %(s)s AND tablename = %(t)s AND indexname = %(i)s", s=schema, t=log, i=name):
            conn.execute(sql)
            out.indexes_created += 1
    return out
