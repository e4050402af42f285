"""Logical replication at the source: settings, publication, replica identity, slot."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from tidemark.admin import Connection, first_value, quoted
from tidemark.contract.model import parse_table_name, validate_identifier

PLUGIN = "pgoutput"
IDENTITIES = ("default", "full")
#: Settings that may be written, and whether a value is good enough.
SETTINGS = {
    "wal_level": lambda v: v == "logical",
    "max_replication_slots": lambda v: int(v) > 0,
    "max_wal_senders": lambda v: int(v) > 0,
}


@dataclass
class CdcSetup:
    wal_level: str
    max_replication_slots: int
    max_wal_senders: int
    publication_created: bool = False
    table_added: bool = False
    slot_created: bool = False
    replica_identity_set: bool = False
    output_plugin: str = PLUGIN

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def settings_sql() -> str:
    return "SELECT " + ", ".join(f"current_setting('{s}') AS {s}" for s in SETTINGS)


def set_setting_sql(name: str, value: Any) -> str:
    if name not in SETTINGS:
        raise ValueError(f"not a setting that may be written: {name}")
    text = str(value).replace("'", "''")
    return f"ALTER SYSTEM SET {name} = '{text}'"


def publication_sql(publication: str, source: tuple[str, str]) -> str:
    return f"CREATE PUBLICATION {quoted(publication)} FOR TABLE {quoted(*source)} WITH (publish = 'insert, update, delete')"


def add_table_sql(publication: str, source: tuple[str, str]) -> str:
    return f"ALTER PUBLICATION {quoted(publication)} ADD TABLE {quoted(*source)}"


def drop_publication_sql(publication: str) -> str:
    return f"DROP PUBLICATION IF EXISTS {quoted(publication)}"


def identity_sql(source: tuple[str, str], mode: str) -> str:
    return f"ALTER TABLE {quoted(*source)} REPLICA IDENTITY {'FULL' if mode.strip().lower() == 'full' else 'DEFAULT'}"


def slot_info_sql() -> str:
    return "SELECT slot_name, plugin, slot_type, active, restart_lsn::text AS restart_lsn, confirmed_flush_lsn::text AS confirmed_flush_lsn FROM pg_replication_slots WHERE slot_name = %(slot)s"


def slot_lag_sql() -> str:
    """How much log a slot holds back."""
    return "SELECT slot_name, active, restart_lsn::text AS restart_lsn, confirmed_flush_lsn::text AS confirmed_flush_lsn, pg_wal_lsn_diff(pg_current_wal_lsn(), restart_lsn)::bigint AS retained_wal_bytes FROM pg_replication_slots WHERE slot_name = %(slot)s"


def create_slot_sql(slot: str, plugin: str = PLUGIN) -> str:
    return f"SELECT slot_name, lsn::text AS lsn FROM pg_create_logical_replication_slot('{validate_identifier(slot)}', '{validate_identifier(plugin)}')"


def current_lsn_sql() -> str:
    return "SELECT pg_current_wal_lsn()::text AS lsn"


def peek_sql(messages: bool = False) -> str:
    """Messages of a slot without taking them."""
    return "SELECT lsn::text AS lsn, xid::text AS xid, data FROM pg_logical_slot_peek_binary_changes(%(slot)s, NULL, %(n)s, 'proto_version', '1', 'publication_names', %(publication)s" + (", 'messages', 'true')" if messages else ")")


def slot_info(conn: Connection, slot: str) -> dict[str, Any] | None:
    rows = conn.query(slot_info_sql(), {"slot": slot})
    return dict(rows[0]) if rows else None


def slot_lag(conn: Connection, slot: str) -> dict[str, Any] | None:
    rows = conn.query(slot_lag_sql(), {"slot": slot})
    return dict(rows[0]) if rows else None


def _settings(conn: Connection, write: bool, wanted: dict[str, Any]) -> dict[str, Any]:
    now = dict(conn.query(settings_sql())[0])
    wrong = {s: wanted[s] for s, good in SETTINGS.items() if not good(str(now[s]))}
    if not wrong:
        return now
    listed = lambda m: ", ".join(f"{k}={v}" for k, v in m.items())
    if not write:
        raise ValueError(f"change capture needs other settings at the source: {listed(wrong)} (now {listed({s: now[s] for s in SETTINGS})})")
    try:
        for s, v in wrong.items():
            conn.execute(set_setting_sql(s, v), autocommit=True)
        conn.execute("SELECT pg_reload_conf()", autocommit=True)
    except Exception as e:
        raise ValueError(f"the settings {listed(wrong)} couldn't be written; use a connection that may: {e}") from e
    raise ValueError(f"the settings {listed(wrong)} were written; restart the source before change capture can go on")


def ensure_cdc_capture(conn: Connection, source_table: str, publication: str, slot: str, plugin: str = PLUGIN, replace_publication: bool = False, create_slot: bool = True, replica_identity: str = "default", write_settings: bool = False, slots: int = 10, senders: int = 10) -> CdcSetup:
    """Creates what is missing of settings, publication and slot.

    The slot is made last and outside of a transaction, so that it begins after the
    publication exists.  Settings that had to be written need a restart: then a
    ValueError says so, and the next call goes on.
    """
    if plugin != PLUGIN:
        raise ValueError(f"only {PLUGIN} is supported")
    if replica_identity not in IDENTITIES:
        raise ValueError("replica_identity must be 'default' or 'full'")
    if slots <= 0 or senders <= 0:
        raise ValueError("slots and senders must be greater than zero")
    source = parse_table_name(source_table)
    validate_identifier(publication)
    validate_identifier(slot)
    now = _settings(conn, write_settings, {"wal_level": "logical", "max_replication_slots": slots, "max_wal_senders": senders})
    out = CdcSetup(str(now["wal_level"]), int(now["max_replication_slots"]), int(now["max_wal_senders"]))
    exists = bool(first_value(conn, "SELECT EXISTS (SELECT 1 FROM pg_publication WHERE pubname = %(p)s) AS v", {"p": publication}))
    if exists and replace_publication:
        conn.execute(drop_publication_sql(publication))
        exists = False
    if not exists:
        conn.execute(publication_sql(publication, source))
        out.publication_created = out.table_added = True
    elif not first_value(conn, "SELECT EXISTS (SELECT 1 FROM pg_publication_tables WHERE pubname = %(p)s AND schemaname = %(s)s AND tablename = %(t)s) AS v", {"p": publication, "s": source[0], "t": source[1]}):
        conn.execute(add_table_sql(publication, source))
        out.table_added = True
    conn.execute(identity_sql(source, replica_identity))
    out.replica_identity_set = True
    info = slot_info(conn, slot)
    if info is None:
        if not create_slot:
            raise ValueError(f"the slot {slot!r} doesn't exist")
        conn.execute(create_slot_sql(slot, plugin), autocommit=True)
        out.slot_created = True
    elif info["plugin"] != plugin:
        raise ValueError(f"the slot {slot!r} uses the plugin {info['plugin']!r}, not {plugin!r}")
    return out


def peek_messages(conn: Connection, slot: str, publication: str, limit: int = 100, messages: bool = False) -> list[bytes]:
    """The next messages of an idle logical slot, left where they are."""
    if limit <= 0:
        raise ValueError("limit must be greater than zero")
    info = slot_info(conn, slot)
    if info is None:
        raise ValueError(f"the slot {slot!r} doesn't exist")
    if info["plugin"] != PLUGIN or info["slot_type"] != "logical":
        raise ValueError(f"the slot {slot!r} isn't a logical slot of {PLUGIN}")
    if info["active"]:
        raise ValueError(f"the slot {slot!r} is in use")
    return [bytes(r["data"]) for r in conn.query(peek_sql(messages), {"slot": slot, "publication": publication, "n": limit})]
