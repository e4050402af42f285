import argparse
import datetime as dt
import json
import struct

import pytest

from tidemark.admin import audit, cdc
from tidemark.admin.cdc import peek_sql
from tidemark.cli import add_connection_options, add_contract_options, connection_of, ensure_audit, ensure_cdc, peek
from tidemark.contract.model import Contract
from tidemark.sources import credentials as cred
from tidemark.sources import jdbc
from tidemark.sources.credentials import ClientCredentials, access_token

C = Contract("c", "1", ("id", "line"), primary_keys=("id", "line"))


class Fake:
    """Answers queries by the first pattern they hold; keeps what was executed."""

    def __init__(self, **answers):
        self.answers, self.done = answers, []

    def query(self, sql, params=None):
        return next((v for k, v in self.answers.items() if k in sql), [{"v": False}])

    def execute(self, sql, params=None, autocommit=False):
        self.done.append((sql, autocommit))


def test_audit_setup_creates_what_is_missing():
    conn = Fake(track_commit_timestamp=[{"v": "on"}])
    out = audit.ensure_audit_capture(conn, "orders", "audit.log", C)
    assert out.to_dict() == {"watermark_mode": "commit_timestamp", "schema_created": True, "table_created": True, "function_created": True, "trigger_created": True, "indexes_created": 2}
    sql = "\n".join(s for s, _ in conn.done)
    assert 'CREATE TABLE IF NOT EXISTS "audit"."log"' in sql and "jsonb_build_object('id', NEW.\"id\", 'line', NEW.\"line\")" in sql and 'ON "public"."orders"' in sql
    again = Fake(EXISTS=[{"v": True}], track_commit_timestamp=[{"v": ""}])
    out = audit.ensure_audit_capture(again, "orders", "audit.log", C, replace_trigger=True)
    assert out.watermark_mode == "recorded_at" and not out.table_created and out.trigger_created and out.indexes_created == 0
    assert any(s.startswith("DROP TRIGGER") for s, _ in again.done)


def test_watermark_modes():
    assert audit.resolve_mode(Fake(), "recorded_at") == "recorded_at"
    with pytest.raises(ValueError):
        audit.resolve_mode(Fake(track_commit_timestamp=[{"v": "off"}]), "commit_timestamp")
    with pytest.raises(ValueError):
        audit.resolve_mode(Fake(), "other")


def test_audit_sql():
    assert len(audit.function_name("t" * 90)) <= 63 and audit.trigger_name("a") != audit.trigger_name("b")
    assert "%(start_ts)s" in audit.window_sql("a", "l", "recorded_at", True) and "%(start_ts)s" not in audit.window_sql("a", "l", "recorded_at", False)
    assert "4294967296" in audit.latest_sql("a", "l", "commit_timestamp")
    for bad in (lambda: audit.key_sql([], "NEW"), lambda: audit.ordering_sql("x"), lambda: audit.table_sql("a", "b; drop")):
        with pytest.raises(ValueError):
            bad()


GOOD = [{"wal_level": "logical", "max_replication_slots": "10", "max_wal_senders": "5"}]
LOW = [{"wal_level": "replica", "max_replication_slots": "0", "max_wal_senders": "5"}]


def test_cdc_setup():
    conn = Fake(wal_level=GOOD, pg_replication_slots=[])
    out = cdc.ensure_cdc_capture(conn, "s.orders", "pub", "slot", replica_identity="full")
    assert out.publication_created and out.slot_created and out.max_wal_senders == 5
    assert conn.done[-1][1] and "pg_create_logical_replication_slot" in conn.done[-1][0] and "REPLICA IDENTITY FULL" in conn.done[-2][0]
    there = Fake(wal_level=GOOD, **{"pubname = %(p)s)": [{"v": True}]}, pg_replication_slots=[{"plugin": "pgoutput"}])
    out = cdc.ensure_cdc_capture(there, "s.orders", "pub", "slot")
    assert not out.publication_created and out.table_added and not out.slot_created
    assert cdc.ensure_cdc_capture(there, "s.orders", "pub", "slot", replace_publication=True).publication_created


def test_cdc_settings_and_refusals():
    with pytest.raises(ValueError, match="wal_level=logical"):
        cdc.ensure_cdc_capture(Fake(wal_level=LOW), "t", "p", "s")
    conn = Fake(wal_level=LOW)
    with pytest.raises(ValueError, match="restart"):
        cdc.ensure_cdc_capture(conn, "t", "p", "s", write_settings=True)
    assert [a for _, a in conn.done] == [True] * 3
    for more in ({"plugin": "wal2json"}, {"replica_identity": "index"}, {"slots": 0}, {"publication": 'p"'}):
        with pytest.raises(ValueError):
            cdc.ensure_cdc_capture(Fake(wal_level=GOOD), **({"source_table": "t", "publication": "p", "slot": "s"} | more))
    with pytest.raises(ValueError, match="exist"):
        cdc.ensure_cdc_capture(Fake(wal_level=GOOD, pg_replication_slots=[]), "t", "p", "s", create_slot=False)
    with pytest.raises(ValueError, match="plugin"):
        cdc.ensure_cdc_capture(Fake(wal_level=GOOD, pg_replication_slots=[{"plugin": "x"}]), "t", "p", "s")
    with pytest.raises(ValueError):
        cdc.set_setting_sql("shared_buffers", 1)


def peek_connection(active=False):
    rel = b"R" + struct.pack("!I", 1) + b"public\0t\0d" + struct.pack("!H", 1) + b"\1id\0" + struct.pack("!Ii", 20, -1)
    msgs = [rel, b"B" + struct.pack("!QqI", 1, 0, 9), b"I" + struct.pack("!I", 1) + b"N\0\1t\0\0\0\1" + b"5", b"C\0" + struct.pack("!QQq", 2, 3, 0)]
    return Fake(peek_binary=[{"data": m} for m in msgs], pg_replication_slots=[{"plugin": "pgoutput", "slot_type": "logical", "active": active, "slot_name": "s"}])


def test_peek_command(monkeypatch, capsys):
    monkeypatch.setattr(peek, "connect", lambda dsn, *limits: peek_connection())
    base = ["--dsn", "x", "--slot", "s", "--publication", "p"]
    assert peek.main(base) == 0
    event = json.loads(capsys.readouterr().out)
    assert event["new"] == {"id": "5"} and event["commit_lsn"] == "0/2"
    assert peek.main([*base, "--info"]) == 0 and json.loads(capsys.readouterr().out)["slot_name"] == "s"
    monkeypatch.setattr(peek, "connect", lambda dsn, *limits: peek_connection(True))
    assert peek.main(base) == 1 and capsys.readouterr().err.startswith("ERROR: ")
    assert peek.main([*base, "--limit", "0"]) == 1
    with pytest.raises(SystemExit) as e:
        peek.main([])
    assert e.value.code == 2


def test_setup_commands(monkeypatch, capsys, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"contract_id": "c", "fields": ["id"], "primary_keys": ["id"]}))
    monkeypatch.setattr(ensure_audit, "connect", lambda dsn, *limits: Fake(track_commit_timestamp=[{"v": "on"}]))
    base = ["--dsn", "x", "--source-table", "t", "--audit-table", "a.l"]
    assert ensure_audit.main([*base, "--contract-file", str(f), "--pretty"]) == 0 and json.loads(capsys.readouterr().out)["trigger_created"]
    for bad in ([], ["--contract-file", str(f), "--registry-url", "http://r"], ["--registry-url", "http://r", "--namespace", "a", "--name", "b", "--token", "t", "--oidc-client-id", "i"], ["--registry-url", "http://r", "--namespace", "a", "--name", "b", "--oidc-client-id", "i"]):
        assert ensure_audit.main([*base, *bad]) == 1
    monkeypatch.setattr(ensure_cdc, "connect", lambda dsn, *limits: Fake(wal_level=GOOD, pg_replication_slots=[]))
    monkeypatch.setenv("SOURCE_DSN", "x")
    assert ensure_cdc.main(["--source-table", "t", "--publication", "p", "--slot", "s"]) == 0
    monkeypatch.delenv("SOURCE_DSN")
    assert ensure_cdc.main(["--source-table", "t", "--publication", "p", "--slot", "s"]) == 1


STS = b"""<R xmlns="urn:x"><A><Credentials><AccessKeyId>k</AccessKeyId><SecretAccessKey>s</SecretAccessKey><SessionToken>t</SessionToken><Expiration>2025-01-01T00:00:00Z</Expiration></Credentials></A></R>"""


def test_credentials():
    seen = []

    def post(url, form, timeout):
        seen.append((url, form))
        return (200, b'{"access_token":"tok"}') if "token" in url else (200, STS)

    got = cred.exchange(cred.ClientCredentials("http://token", "i", "x", scope="a"), cred.WebIdentity("http://sts", role_arn="r"), post)
    assert got == cred.TemporaryCredentials("k", "s", "t", dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc))
    assert seen[0][1]["scope"] == "a" and seen[1][1]["WebIdentityToken"] == "tok" and seen[1][1]["DurationSeconds"] == "3600"
    for answer in ((500, b"no"), (200, b"{}"), (200, b"<")):
        with pytest.raises(cred.ExchangeError):
            cred.access_token(cred.ClientCredentials("http://token", "i", "x"), lambda *_: answer)
    for answer in ((403, b"no"), (200, b"<R/>"), (200, b"x")):
        with pytest.raises(cred.ExchangeError):
            cred.assume_role(cred.WebIdentity("http://sts"), "t", lambda *_: answer)

    def down(*_):
        raise TimeoutError("t")

    with pytest.raises(cred.ExchangeError):
        cred.access_token(cred.ClientCredentials("http://token", "i", "x"), down)


def test_database_statements(spark):
    assert jdbc.upsert_sql("t", ["a", "b"], ["a"]) == 'INSERT INTO "public"."t" ("a", "b") VALUES (%s, %s) ON CONFLICT ("a") DO UPDATE SET "b" = EXCLUDED."b"'
    assert jdbc.upsert_sql("t", ["a"], ["a"]).endswith("DO NOTHING") and "IS NOT DISTINCT FROM" in jdbc.delete_sql("t", ["a", "b"])
    with pytest.raises(ValueError):
        jdbc.read_table(spark, "jdbc:x", "t", ["a"], fetch_size=0)
    with pytest.raises(ValueError):
        jdbc.read_table(spark, "jdbc:x", "t", ["a"], partition_column="a")


@pytest.mark.parametrize("fails", [False, True])
def test_changes_reach_a_database_whole_or_not_at_all(spark, tmp_path, fails):
    import sqlite3

    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as c:
        c.execute("create table t (k integer primary key, v text)")
        c.executemany("insert into t values (?, ?)", [(2, "old"), (3, "gone"), (4, "d")])

    def connect():
        import sqlite3 as s

        class Cursor:
            def __init__(self, c):
                self.c = c

            def execute(self, sql, args=()):
                if fails and "ON CONFLICT" in sql:
                    raise RuntimeError("lost")
                self.c.execute(sql.replace("%s", "?"), args)

            def executemany(self, sql, rows):
                self.c.executemany(sql.replace("%s", "?"), rows)

        class Conn:
            def __init__(self):
                self.c = s.connect(":memory:", timeout=30)
                self.c.execute("attach database ? as public", (db,))

            def cursor(self):
                return Cursor(self.c)

            def commit(self):
                self.c.commit()

            def close(self):
                self.c.close()

        return Conn()

    rows = [(1, "a", "INSERT"), (2, "b", "UPDATE"), (3, "x", "DELETE"), (4, "e", "UNCHANGED"), (5, None, "DELETE")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k long, v string, change_type string, part_no int").repartition(2)
    if fails:
        with pytest.raises(RuntimeError):
            jdbc.write_changes(df, connect, "t", ["k", "v"], ["k"], batch=1)
    else:
        jdbc.write_changes(df, connect, "t", ["k", "v"], ["k"], batch=1)
    with sqlite3.connect(db) as c:
        assert sorted(c.execute("select * from t").fetchall()) == ([(2, "old"), (3, "gone"), (4, "d")] if fails else [(1, "a"), (2, "b"), (4, "d")])
        assert [r[0] for r in c.execute("select name from sqlite_master where type = 'table'").fetchall()] == ["t"]


def test_connections_within_limits():
    p = argparse.ArgumentParser()
    add_connection_options(p)
    seen = []
    args = p.parse_args(["--dsn", "x", "--statement-timeout-ms", "500"])
    connection_of(args, lambda *a: seen.append(a))
    assert seen == [("x", 5, 500)]
    with pytest.raises(ValueError):
        connection_of(p.parse_args(["--dsn", "x", "--connect-timeout", "0"]), print)


def test_registry_options_and_certificates():
    p = argparse.ArgumentParser()
    add_contract_options(p)
    args = p.parse_args(["--contracts-service-url", "http://r", "--namespace", "n", "--name", "c", "--contracts-access-token", "t", "--contracts-oidc-no-verify-ssl"])
    assert args.registry_url == "http://r" and args.token == "t" and args.oidc_no_verify_tls
    seen = []
    c = ClientCredentials("https://o/token", "i", "s", verify_tls=False)

    def post(url, form, timeout, verify_tls=True):
        seen.append(verify_tls)
        return 200, b'{"access_token": "abc"}'

    import tidemark.sources.credentials as credentials

    original, credentials.http_post = credentials.http_post, post
    try:
        assert access_token(c) == "abc" and access_token(ClientCredentials("https://o/token", "i", "s")) == "abc"
    finally:
        credentials.http_post = original
    assert seen == [False, True]
    assert "'messages', 'true'" in peek_sql(True) and "'messages'" not in peek_sql()


def test_lag_of_a_slot():
    found = [{"slot_name": "s", "active": True, "restart_lsn": "0/1", "confirmed_flush_lsn": "0/2", "retained_wal_bytes": 5}]
    assert cdc.slot_lag(Fake(retained_wal_bytes=found), "s") == found[0] and cdc.slot_lag(Fake(retained_wal_bytes=[]), "s") is None
