import itertools
import json
import os
import struct
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.contract.model import Contract
from tidemark.operators import delta as d
from tidemark.operators.late_events import LateEventCounts
from tidemark.operators.pipelines import land_cdc_delta, typed_delta
from tidemark.session import shared_dir
from tidemark.sources import pgoutput as pg
from tidemark.sources import replication, store
from tidemark.streaming.apply import apply_stream, batch_applier, count_stream


def tup(*values):
    out = struct.pack("!H", len(values))
    for v in values:
        out += b"n" if v is None else b"u" if v is ... else b"t" + struct.pack("!I", len(v.encode())) + v.encode()
    return out


def relation(table="orders", columns=("id", "status"), rid=10):
    return b"R" + struct.pack("!I", rid) + b"public\0" + table.encode() + b"\0d" + struct.pack("!H", len(columns)) + b"".join(b"\1" + c.encode() + b"\0" + struct.pack("!Ii", 25, -1) for c in columns)


def begin(xid, lsn=1):
    return b"B" + struct.pack("!QqI", lsn, 0, xid)


def commit(lsn, end=None, ts=1_000_000):
    return b"C\0" + struct.pack("!QQq", lsn, end or lsn + 1, ts)


def change(kind, *parts, rid=10):
    return kind.encode() + struct.pack("!I", rid) + b"".join(parts)


STREAM = [
    relation(), relation("other", ("x",), 11),
    begin(7), change("I", b"N", tup("1", "é")), change("I", b"N", tup("z"), rid=11), change("U", b"N", tup("1", ...)), change("U", b"K", tup("1", None), b"N", tup("2", "b")), change("D", b"O", tup("2", "b")), commit(2**32 + 5),
    b"Y" + b"\0" * 8,
    relation(columns=("id", "status", "more")), begin(8), change("I", b"N", tup("3", "c", None)), commit(2**32 + 9),
    begin(9), change("I", b"N", tup("4", "never", None)),
]
EXPECTED = [
    ("I", "1/5", 0, 7, None, {"id": "1", "status": "é"}), ("U", "1/5", 1, 7, None, {"id": "1", "status": None}), ("U", "1/5", 2, 7, {"id": "1", "status": None}, {"id": "2", "status": "b"}), ("D", "1/5", 3, 7, {"id": "2", "status": "b"}, None),
    ("I", "1/9", 0, 8, None, {"id": "3", "status": "c", "more": None}),
]


def messages(spark, stream, capture="a"):
    return spark.createDataFrame([(capture, i, bytearray(m) if m is not None else None) for i, m in enumerate(stream)], "capture string, seq long, data binary")


def test_both_decoders_agree(spark):
    got = [(e["op"], e["commit_lsn"], e["change_index"], e["xid"], e["old"], e["new"]) for e in pg.decode_all(STREAM, "public.orders")]
    assert got == EXPECTED
    rows = pg.decode_messages(messages(spark, [*STREAM, None, b""]), "public.orders").orderBy("xid", "change_index").collect()
    load = lambda t: None if t is None else json.loads(t)
    assert [(r["op"], r["commit_lsn"], r["change_index"], r["xid"], load(r["old_key"]), load(r["row_after"])) for r in rows] == EXPECTED
    assert rows[1]["unchanged"] == ["status"] and rows[0]["end_lsn"] == "1/6" and rows[0]["commit_ts"].year == 2000
    assert pg.decode_messages(messages(spark, STREAM)).count() == 6 and pg.decode_messages(messages(spark, [])).count() == 0


@pytest.mark.parametrize("stretch", [1, 2, 5])
def test_captures_and_transactions_longer_than_a_stretch(spark, monkeypatch, stretch):
    monkeypatch.setattr(pg, "STRETCH", stretch)
    both = messages(spark, STREAM).unionByName(messages(spark, STREAM[:9], "b"))
    rows = pg.decode_messages(both, "public.orders").groupBy("xid", "change_index", "op").count().orderBy("xid", "change_index").collect()
    assert [tuple(r) for r in rows] == [(7, 0, "I", 2), (7, 1, "U", 2), (7, 2, "U", 2), (7, 3, "D", 2), (8, 0, "I", 1)]


@pytest.mark.parametrize("bad", [[begin(1), b"T\0"], [begin(1), change("I", b"N", tup("1"), rid=99), commit(1)], [relation(), begin(1), change("I", b"N", tup("1")), commit(1)], [relation(), begin(1), change("I", b"K", tup("1", "2")), commit(1)], [relation(), begin(1), change("I", b"N", b"\0\2t\0\0"), commit(1)]])
def test_broken_streams_fail(spark, bad):
    with pytest.raises(pg.PgOutputError):
        list(pg.decode_all(bad))
    with pytest.raises(Exception):
        pg.decode_messages(messages(spark, bad)).collect()


def test_unchanged_values_can_be_kept(spark):
    ev = pg.decode_messages(messages(spark, STREAM), "public.orders").where("xid = 7 and change_index = 1")
    state = spark.createDataFrame([(1, "stored")], "id long, status string")
    assert json.loads(pg.keep_unchanged(ev, state, ["id"]).first()["row_after"]) == {"id": "1", "status": "stored"}
    assert json.loads(pg.keep_unchanged(ev, state.limit(0), ["id"]).first()["row_after"]) == {"id": "1", "status": None}


C = Contract("o", "1", ("id", "status"), {"id": "integer", "status": "string"}, ("id",), ("id",))


def shaped(df):
    text = "struct<id:string,status:string>"
    return typed_delta(df.select("commit_lsn", "end_lsn", "change_index", "xid", "commit_ts", F.when(F.col("op") == "D", "DELETE").otherwise("UPSERT").alias("op"), F.from_json(F.coalesce("old_key", "row_after"), text).alias("key"), F.from_json("row_after", text).alias("row"), F.lit(None).cast("string").alias("row_hash")), C, d.CDC)


def test_slot_source_streams_and_acknowledges(spark, tmp_path):
    plain = [relation(), begin(7), change("I", b"N", tup("1", "a")), change("I", b"N", tup("2", "b")), commit(50), begin(8), change("D", b"K", tup("1", None)), commit(60)]
    lsns = ["0/10", "0/32", "0/32", "0/32", "0/32", "0/3C", "0/3C", "0/3C"]
    (tmp_path / "cap.jsonl").write_text("".join(json.dumps({"lsn": x, "data": m.hex()}) + "\n" for x, m in zip(lsns, plain)))
    replication.register(spark)
    options = {"client": "tidemark.sources.replication:FolderClient", "path": str(tmp_path)}
    peek = spark.read.format("pgoutput").options(**options).load()
    assert pg.decode_messages(peek, "public.orders").count() == 3 and not (tmp_path / "ACK").exists()
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C)
    q = apply_stream(spark.readStream.format("pgoutput").options(**options).load(), t, d.CDC, shared_dir(spark, "ckpt"), prepare=lambda b: shaped(pg.decode_messages(b, "public.orders")), available_now=False)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r["id"], r["status"]) for r in t.curated().collect()] == [(2, "b")]


def events(spark, rows):
    return spark.createDataFrame([(i, i, op, k, s, f"h{s}") for i, op, k, s in rows], "event_ts long, event_id long, op string, id long, status string, row_hash string")


def test_a_repeated_batch_is_applied_once(spark):
    t = store.VersionedTable(spark, shared_dir(spark, "t"), C)
    run = batch_applier(t, d.AUDIT)
    assert run(events(spark, [(1, "UPSERT", 1, "a")]), 0)["insert_count"] == 1
    assert run(events(spark, [(1, "UPSERT", 1, "a")]), 0) is None
    assert run(events(spark, [(2, "DELETE", 1, None)]), 1)["delete_count"] == 1 and t.curated().count() == 0
    assert run(events(spark, [(1, "UPSERT", 1, "a")]), 1) is None and t.curated().count() == 0


def test_counts_follow_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    make = lambda rows: spark.createDataFrame(rows, "id long, tab string, at string, seen string").select("id", "tab", F.col("at").cast("timestamp").alias("at"), F.col("seen").cast("timestamp").alias("seen"))
    make([(1, "a", "2025-01-01 10:00:00", None)]).write.parquet(src)
    o = LateEventCounts(spark, shared_dir(spark, "late"), ["id"], ["tab"], "at", "seen")
    ckpt = shared_dir(spark, "ckpt")
    for late in (None, [(2, "a", "2025-01-01 10:30:00", "2025-01-01 12:00:00"), (1, "a", "2025-01-01 10:00:00", None)]):
        if late:
            make(late).write.mode("append").parquet(src)
        count_stream(spark.readStream.schema(make([]).schema).parquet(src), o, ckpt).awaitTermination(120)
    assert [(r["n_events"], r["n_late"]) for r in o.counts().collect()] == [(2, 1)]


class FakeSlot:
    """Stands for psycopg2's connection and cursor; one message, or None, per read."""

    def __init__(self, reads, wal_end=0):
        self.reads, self.wal_end = list(reads), wal_end

    def cursor(self):
        return self

    def close(self):
        pass

    def start_replication(self, **options):
        pass

    def read_message(self):
        if not self.reads:
            return None
        step = self.reads.pop(0)
        if isinstance(step, int):  # a keepalive
            self.wal_end = step
            return None
        self.wal_end = step[0]
        return SimpleNamespace(data_start=step[0], payload=step[1])


class SlotOf(replication.SlotClient):
    def __init__(self, reads, **options):
        super().__init__({"dsn": "", "slot": "s", "publication": "p", **options})
        self.reads = reads

    def _connect(self, replication):
        return FakeSlot(self.reads)


TRANSACTION = [(10, begin(7)), (12, change("I", b"N", tup("1", "a"))), (20, commit(15, 20))]


@pytest.fixture
def clock(monkeypatch):
    """Every look at the clock takes a second; waiting takes none."""
    now = itertools.count()
    monkeypatch.setattr(replication, "time", SimpleNamespace(monotonic=lambda: float(next(now))))
    monkeypatch.setattr(replication.select, "select", lambda *a: None)


@pytest.mark.parametrize("options", [{"max_seconds": "4"}, {"max_seconds": "1000", "idle_seconds": "5"}])
@pytest.mark.parametrize("reads", [TRANSACTION, TRANSACTION[:2], []])
def test_a_slot_read_that_stops_early_fails(clock, reads, options):
    with pytest.raises(replication.WindowNotReached):
        list(SlotOf(reads, **options).messages("0/0", "0/40"))


@pytest.mark.parametrize("reads, n", [([*TRANSACTION, 0x40], 3), ([0x40], 0), ([*TRANSACTION, (0x50, begin(8)), (0x51, b"I")], 3)])
def test_a_slot_read_ends_at_the_windows_end(clock, reads, n):
    assert len(list(SlotOf(reads, max_seconds="100").messages("0/0", "0/40"))) == n
    assert len(list(SlotOf(TRANSACTION, max_seconds="8").messages("0/0", "0/14"))) == 3


def stopping_client(options):
    """A folder whose reading stops before the window's end while ``STOP`` is there."""
    client = replication.FolderClient(options)
    whole, stop_at = client.messages, int(options.get("stop_at", 5))

    def messages(start, end):
        for i, m in enumerate(whole(start, end)):
            if i == stop_at and os.path.exists(os.path.join(client.folder, "STOP")):
                raise replication.WindowNotReached("time is over")
            yield m

    client.messages = messages
    return client


def stopping_source():
    """Local classes, so that workers needn't import this file; fails while ``STOP`` is there."""

    class Reader(replication.SlotStreamReader):
        def read(self, partition):
            for i, row in enumerate(replication.SlotStreamReader.read(self, partition)):
                if i == 5 and os.path.exists(os.path.join(self.options["path"], "STOP")):
                    raise replication.WindowNotReached("time is over")
                yield row

    class Source(replication.PgOutputSource):
        @classmethod
        def name(cls):
            return "stopping"

        def streamReader(self, schema):
            return Reader(self.options)

    return Source


def test_a_window_read_in_part_is_not_acknowledged_and_read_again(spark, tmp_path):
    plain = [relation(), begin(7), change("I", b"N", tup("1", "a")), commit(50), begin(8), change("I", b"N", tup("2", "b")), commit(60)]
    lsns = ["0/10", *["0/32"] * 3, *["0/3C"] * 3]
    (tmp_path / "cap.jsonl").write_text("".join(json.dumps({"lsn": x, "data": m.hex()}) + "\n" for x, m in zip(lsns, plain)))
    (tmp_path / "STOP").write_text("")
    spark.dataSource.register(stopping_source())
    options = {"client": "tidemark.sources.replication:FolderClient", "path": str(tmp_path)}
    t, ckpt = store.VersionedTable(spark, shared_dir(spark, "t"), C), shared_dir(spark, "ckpt")

    def run():
        q = apply_stream(spark.readStream.format("stopping").options(**options).load(), t, d.CDC, ckpt, prepare=lambda b: shaped(pg.decode_messages(b, "public.orders")), available_now=False)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="time is over"):
        run()
    assert not (tmp_path / "ACK").exists() and not t.version()
    (tmp_path / "STOP").unlink()
    run()
    assert sorted((r["id"], r["status"]) for r in t.curated().collect()) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("stop_at, checkpoint", [(2, "0/1"), (5, "0/33"), (7, "0/3D")])
def test_a_checkpoint_does_not_pass_what_was_not_read(spark, tmp_path, stop_at, checkpoint):
    plain = [relation(), begin(7), change("I", b"N", tup("1", "a")), commit(50), begin(8), change("I", b"N", tup("2", "b")), commit(60)]
    lsns = ["0/10", *["0/32"] * 3, *["0/3C"] * 3]
    (tmp_path / "cap.jsonl").write_text("".join(json.dumps({"lsn": x, "data": m.hex()}) + "\n" for x, m in zip(lsns, plain)))
    (tmp_path / "STOP").write_text("")
    spark.sparkContext.addPyFile(__file__)
    read = replication.land_messages(spark, {"client": f"{__name__}:stopping_client", "path": str(tmp_path), "stop_at": str(stop_at)}, shared_dir(spark, "messages"))
    assert read["reached_window_end"] is (stop_at == 7) and read["messages"].where("data is not null").count() == stop_at
    r = land_cdc_delta(pg.decode_messages(read["messages"], "public.orders"), C, shared_dir(spark, "delta"), None, read["end_lsn"], read["reached_window_end"])
    assert r["reached_window_end"] is (stop_at == 7) and d.resolve_checkpoint_lsn("0/1", r, None) == checkpoint


def test_a_window_end_counts_as_reached_only_if_known(spark):
    ev = pg.decode_messages(messages(spark, STREAM), "public.orders")
    land = lambda end, **known: land_cdc_delta(ev, C, shared_dir(spark, "delta"), "1/9", end, **known)
    unknown = land("1/F")
    assert unknown["source_event_count"] == 0 and d.resolve_checkpoint_lsn("1/9", unknown, None) == "1/9"
    assert d.resolve_checkpoint_lsn("1/9", land("1/F", reached_window_end=True), None) == "1/F"
    assert land("1/9")["reached_window_end"] is True and land("1/9", reached_window_end=False)["reached_window_end"] is False
