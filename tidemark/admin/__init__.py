"""Setting up change capture at a PostgreSQL source.

Everything here takes a ``Connection``: an object with ``query(sql, params)`` giving rows
as mappings, and ``execute(sql, params, autocommit)``.  ``psycopg2_connection`` makes one
where that driver is installed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, Protocol


class Connection(Protocol):
    def query(self, sql: str, params: Mapping[str, Any] | None = None) -> Sequence[Mapping[str, Any]]: ...

    def execute(self, sql: str, params: Mapping[str, Any] | None = None, autocommit: bool = False) -> None: ...


def psycopg2_connection(dsn: str, connect_timeout: int | None = None, statement_timeout_ms: int | None = None) -> Connection:
    """A connection that runs a statement per transaction (or in autocommit).

    Limits are in seconds for connecting and in milliseconds for each statement.
    """
    try:
        import psycopg2
        from psycopg2.extras import RealDictCursor
    except ImportError as e:
        raise RuntimeError("a PostgreSQL connection needs psycopg2") from e

    limits: dict[str, Any] = {}
    if connect_timeout:
        limits["connect_timeout"] = connect_timeout
    if statement_timeout_ms:
        limits["options"] = f"-c statement_timeout={int(statement_timeout_ms)}"

    class _Connection:
        def query(self, sql, params=None):
            with psycopg2.connect(dsn, **limits) as conn, conn.cursor(cursor_factory=RealDictCursor) as cur:
                cur.execute(sql, params)
                return cur.fetchall()

        def execute(self, sql, params=None, autocommit=False):
            conn = psycopg2.connect(dsn, **limits)
            try:
                conn.autocommit = autocommit
                with conn.cursor() as cur:
                    cur.execute(sql, params)
                if not autocommit:
                    conn.commit()
            finally:
                conn.close()

    return _Connection()


def first_value(conn: Connection, sql: str, params: Mapping[str, Any] | None = None) -> Any:
    """The first column of the first row, or None."""
    rows = conn.query(sql, params)
    return next(iter(rows[0].values())) if rows else None


def quoted(*names: str) -> str:
    """A qualified name of checked identifiers in double quotes."""
    from tidemark.contract.model import validate_identifier

    return ".".join(f'"{validate_identifier(n)}"' for n in names)
