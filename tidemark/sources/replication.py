"""A replication slot as a streaming source (``spark.readStream.format("pgoutput")``).

The source asks a client for messages; which one is named by the option ``client`` as
``module:factory``.  Offsets are log positions; the slot is acknowledged only when Spark
has committed a batch, so a batch that fails is read again.  A read that stops before its
window's end fails: what Spark commits and the slot is told is always the whole window.
"""

from __future__ import annotations

import glob
import importlib
import json
import os
import select
import time
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.functions.lsn import int_to_lsn, lsn_to_int

SCHEMA = "capture string, seq long, wal_end string, data binary"


class WindowNotReached(RuntimeError):
    """Reading stopped before the window's end; messages may be missing."""


class ReplicationClient(Protocol):
    """What the source needs of a connection."""

    def current_lsn(self) -> str: ...

    def messages(self, start: str, end: str) -> Iterator[tuple[str, bytes]]:
        """(position, message) after ``start``, up to the first COMMIT beyond ``end``.

        Ends only when ``end`` was reached, else raises WindowNotReached.
        """

    def acknowledge(self, lsn: str) -> None: ...


class FolderClient:
    """Messages captured in files of ``{"lsn": …, "data": hex}`` lines; acknowledged positions in ``ACK``."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def _lines(self) -> Iterator[dict]:
        for name in sorted(glob.glob(os.path.join(self.folder, "*.jsonl"))):
            with open(name, encoding="utf-8") as f:
                yield from (json.loads(x) for x in f if x.strip())

    def current_lsn(self) -> str:
        return int_to_lsn(max((lsn_to_int(x["lsn"]) for x in self._lines()), default=0))

    def messages(self, start: str, end: str) -> Iterator[tuple[str, bytes]]:
        lo, hi = lsn_to_int(start), lsn_to_int(end)
        for x in self._lines():
            if lo < lsn_to_int(x["lsn"]) <= hi:
                yield x["lsn"], bytes.fromhex(x["data"])

    def acknowledge(self, lsn: str) -> None:
        with open(os.path.join(self.folder, "ACK"), "w", encoding="utf-8") as f:
            f.write(lsn)


class SlotClient:
    """A live slot through psycopg2, where that is installed.

    A window that isn't read within ``max_seconds``, or a server that is silent for
    ``idle_seconds`` before its end, fails the read; nothing is acknowledged then.
    """

    def __init__(self, options: dict[str, str]):
        self.dsn, self.slot, self.publication = options["dsn"], options["slot"], options["publication"]
        self.max_seconds = float(options.get("max_seconds", 30))
        self.idle_seconds = float(options["idle_seconds"]) if options.get("idle_seconds") else None
        if self.max_seconds <= 0 or (self.idle_seconds is not None and self.idle_seconds <= 0):
            raise ValueError("time limits must be greater than zero")

    def _connect(self, replication: bool):
        try:
            import psycopg2
            from psycopg2 import extras
        except ImportError as e:
            raise RuntimeError("reading a live slot needs psycopg2") from e
        return psycopg2.connect(self.dsn, connection_factory=extras.LogicalReplicationConnection) if replication else psycopg2.connect(self.dsn)

    def _start(self, cur, start: str) -> None:
        cur.start_replication(slot_name=self.slot, start_lsn=start, decode=False, options={"proto_version": "1", "publication_names": self.publication, "messages": "false"})

    def current_lsn(self) -> str:
        conn = self._connect(False)
        try:
            with conn.cursor() as cur:
                cur.execute("SELECT pg_current_wal_lsn()::text")
                return cur.fetchone()[0]
        finally:
            conn.close()

    def messages(self, start: str, end: str) -> Iterator[tuple[str, bytes]]:
        hi, began, heard = lsn_to_int(end), time.monotonic(), time.monotonic()
        conn = self._connect(True)
        try:
            cur = conn.cursor()
            self._start(cur, start)
            while time.monotonic() - began < self.max_seconds:
                msg = cur.read_message()
                if msg is None:
                    if cur.wal_end >= hi:
                        return
                    if self.idle_seconds and time.monotonic() - heard >= self.idle_seconds:
                        raise WindowNotReached(f"slot {self.slot}: nothing came for {self.idle_seconds:g} s (idle_seconds) at {int_to_lsn(cur.wal_end)}, before the window's end {end}")
                    select.select([cur], [], [], 0.2)
                    continue
                heard = time.monotonic()
                if msg.data_start > hi and msg.payload[:1] == b"B":
                    return
                yield int_to_lsn(msg.data_start), bytes(msg.payload)
            # Transactions come in the order of their COMMITs: a position at the end or
            # beyond belongs to the window's last transaction, read whole, or to a later one.
            if cur.wal_end < hi:
                raise WindowNotReached(f"slot {self.slot}: {self.max_seconds:g} s (max_seconds) were over at {int_to_lsn(cur.wal_end)}, before the window's end {end}; give a greater max_seconds")
        finally:
            conn.close()

    def acknowledge(self, lsn: str) -> None:
        conn = self._connect(True)
        try:
            cur = conn.cursor()
            self._start(cur, lsn)
            cur.send_feedback(flush_lsn=lsn_to_int(lsn), reply=True)
        finally:
            conn.close()


def open_client(options: dict[str, str]) -> ReplicationClient:
    module, _, factory = options.get("client", "tidemark.sources.replication:SlotClient").partition(":")
    return getattr(importlib.import_module(module), factory)(dict(options))


class _Window(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


class _Reader:
    options: dict[str, str]

    #: Whether a read that stops early gives what it has, without the mark, or fails.
    partial = False

    def read(self, partition: _Window):
        """The messages, and at last a mark without data that the window's end was reached."""
        capture, seq = f"{partition.start}-{partition.end}", 0
        try:
            for lsn, data in open_client(self.options).messages(partition.start, partition.end):
                yield capture, seq, lsn, data
                seq += 1
        except WindowNotReached:
            if not self.partial:
                raise
        else:
            yield capture, seq, partition.end, None


class SlotStreamReader(_Reader, DataSourceStreamReader):
    """A slot is one serial stream, so a batch has one partition."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"lsn": self.options.get("start_lsn", "0/0")}

    def latestOffset(self) -> dict:
        return {"lsn": open_client(self.options).current_lsn()}

    def partitions(self, start: dict, end: dict):
        return [_Window(start["lsn"], end["lsn"])]

    def commit(self, end: dict) -> None:
        open_client(self.options).acknowledge(end["lsn"])


class SlotPeekReader(_Reader, DataSourceReader):
    """The same messages as a batch; nothing is acknowledged.

    With the option ``partial`` set to true a read that stops early gives what it has.
    """

    def __init__(self, options):
        self.options = dict(options)
        self.partial = str(self.options.get("partial", "")).lower() == "true"

    def partitions(self):
        return [_Window(self.options.get("start_lsn", "0/0"), self.options.get("end_lsn") or open_client(self.options).current_lsn())]


class PgOutputSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgoutput"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SlotPeekReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SlotStreamReader(self.options)


def land_messages(spark: SparkSession, options: dict[str, str], out: str) -> dict[str, Any]:
    """Reads a window once and lands its messages as Parquet.

    Gives ``messages`` (the landed frame), ``start_lsn``, ``end_lsn`` and
    ``reached_window_end``, as ``operators.pipelines.land_cdc_delta`` takes them.  The
    flag is taken from the landed rows: a second read could get further than the first.
    """
    register(spark)
    start, end = options.get("start_lsn", "0/0"), options.get("end_lsn") or open_client(options).current_lsn()
    spark.read.format("pgoutput").options(**{"partial": "true", **options, "start_lsn": start, "end_lsn": end}).load().write.parquet(out)
    messages = spark.read.parquet(out)
    return {"messages": messages, "start_lsn": start, "end_lsn": end, "reached_window_end": not messages.where("data is null").isEmpty()}


def register(spark) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(PgOutputSource)
