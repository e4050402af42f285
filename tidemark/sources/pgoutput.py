"""Decoding PostgreSQL's pgoutput messages into change events.

Captured messages come as a frame of ``capture`` (a file or micro-batch), ``seq`` (order
within it) and ``data``.  Message headers are read by built-in functions; only relations
(once each) and tuples go through an Arrow-batched function.  A capture is cut into
stretches of ``seq``: the last BEGIN and the changes counted before a stretch are carried
into it, so neither a capture nor a transaction is brought into one task.  A transaction
without its COMMIT in the capture gives nothing.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.lsn import int_to_lsn
from tidemark.session import broadcast_if_small

#: Microseconds from 1970 to 2000, where the protocol's clock begins (fixed value).
EPOCH_MICROS = 946_684_800_000_000
CHANGES = ("I", "U", "D")
#: Values of ``seq`` that one task frames together.
STRETCH = 65_536


class PgOutputError(ValueError):
    """A message that can't be read."""


class Cursor:
    """Reads network-order values from a message."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise PgOutputError(f"the message ends after {len(self.data)} bytes, {self.at + n} are needed")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack("!" + form, self.take(struct.calcsize("!" + form)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise PgOutputError("a name isn't terminated")
        s = self.take(end - self.at).decode()
        self.at += 1
        return s


def read_relation(data: bytes) -> dict:
    """An R message: id, qualified name, replica identity and columns."""
    c = Cursor(data, 1)
    rel = {"id": c.number("I"), "schema": c.text(), "table": c.text(), "identity": chr(c.number("B"))}
    rel["columns"] = [{"flags": c.number("B"), "name": c.text(), "oid": c.number("I"), "typmod": c.number("i")} for _ in range(c.number("H"))]
    rel["name"] = f"{rel['schema']}.{rel['table']}"
    return rel


def read_tuple(c: Cursor, names: list[str]) -> tuple[dict[str, str | None], list[str]]:
    """(values, columns whose unchanged TOASTed value wasn't sent); nulls for both kinds."""
    n = c.number("H")
    if n != len(names):
        raise PgOutputError(f"a tuple has {n} columns, its relation {len(names)}")
    values: dict[str, str | None] = {}
    unchanged = []
    for name in names:
        kind = chr(c.number("B"))
        if kind == "t":
            values[name] = c.take(c.number("I")).decode()
        elif kind in ("n", "u"):
            values[name] = None
            if kind == "u":
                unchanged.append(name)
        else:
            raise PgOutputError(f"unknown kind of column value: {kind!r}")
    return values, unchanged


def read_change(data: bytes, names: list[str]) -> dict:
    """An I, U or D message: old (key or row before), new, unchanged."""
    c, out = Cursor(data, 5), {"old": None, "new": None, "unchanged": []}
    kind = chr(data[0])
    mark = chr(c.number("B"))
    if mark in "KO" and kind in "UD":
        out["old"], _ = read_tuple(c, names)
        if kind == "D":
            return out
        mark = chr(c.number("B"))
    if mark != "N" or kind == "D":
        raise PgOutputError(f"unexpected tuple mark {mark!r} in a message {kind!r}")
    out["new"], out["unchanged"] = read_tuple(c, names)
    return out


class Decoder:
    """Decodes a stream of messages in order, for one reader in one process."""

    def __init__(self, table: str | None = None):
        self.table, self.relations = table, {}
        self.xid: int | None = None
        self.pending: list[dict] = []

    def feed(self, data: bytes) -> list[dict]:
        """Events that this message completes: all of a transaction at its COMMIT."""
        kind = chr(data[0]) if data else ""
        if kind == "B":
            c = Cursor(data, 1)
            c.take(16)
            self.xid, self.pending = c.number("I"), []
        elif kind == "R":
            rel = read_relation(data)
            self.relations[rel["id"]] = rel
        elif kind in CHANGES:
            rel = self.relations.get(Cursor(data, 1).number("I"))
            if rel is None:
                raise PgOutputError("a change of a relation that wasn't announced")
            if self.table in (None, rel["name"]):
                self.pending.append({"op": kind, "relation": rel["name"], "change_index": len(self.pending), **read_change(data, [x["name"] for x in rel["columns"]])})
        elif kind == "T":
            raise PgOutputError("TRUNCATE can't be replicated")
        elif kind == "C":
            c = Cursor(data, 2)
            commit, end, ts = c.number("Q"), c.number("Q"), c.number("q")
            head = {"commit_lsn": int_to_lsn(commit), "end_lsn": int_to_lsn(end), "xid": self.xid, "commit_ts": dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=ts + EPOCH_MICROS)}
            done, self.pending = [x | head for x in self.pending], []
            return done
        return []


def decode_all(messages: Iterable[bytes], table: str | None = None) -> Iterator[dict]:
    d = Decoder(table)
    for m in messages:
        yield from d.feed(m)


@F.pandas_udf(T.StructType().add("name", T.StringType()).add("columns", T.ArrayType(T.StringType())))
def _relation(data: pd.Series) -> pd.DataFrame:
    rels = [read_relation(bytes(x)) if x is not None else None for x in data]
    return pd.DataFrame({"name": [r and r["name"] for r in rels], "columns": [r and [c["name"] for c in r["columns"]] for r in rels]})


@F.pandas_udf(T.StructType().add("old_key", T.StringType()).add("row_after", T.StringType()).add("unchanged", T.ArrayType(T.StringType())))
def _change(data: pd.Series, columns: pd.Series) -> pd.DataFrame:
    names: dict[str, list[str]] = {}
    out = [read_change(bytes(x), names[n] if n in names else names.setdefault(n, n.split("\0") if n else [])) for x, n in zip(data, columns)]
    text = lambda v: None if v is None else json.dumps(v, ensure_ascii=False)
    return pd.DataFrame({"old_key": [text(o["old"]) for o in out], "row_after": [text(o["new"]) for o in out], "unchanged": [o["unchanged"] for o in out]})


def _u32(c: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("bigint")


def _lsn(c: Column, at: int) -> Column:
    return F.concat_ws("/", F.hex(_u32(c, at)), F.hex(_u32(c, at + 4)))


def decode_messages(messages: DataFrame, table: str | None = None) -> DataFrame:
    """op, commit_lsn, end_lsn, change_index, xid, commit_ts, relation, old_key, row_after, unchanged.

    ``old_key`` and ``row_after`` are JSON objects of text values.  ``change_index`` counts
    the changes of the selected table within a transaction.  A TRUNCATE or a change of a
    relation that wasn't announced fails the job; messages of other kinds, null and empty
    ones are passed over.
    """
    m = messages.select("capture", "seq", "data").where("data is not null and length(data) > 0")
    m = m.withColumn("kind", F.char(F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int")))
    m = m.where(F.col("kind").isin("B", "C", "R", "T", *CHANGES))
    m = m.withColumn("kind", F.when(F.col("kind") == "T", F.raise_error(F.lit("TRUNCATE can't be replicated"))).otherwise(F.col("kind")))
    m = m.withColumn("stretch", F.floor(F.col("seq") / F.lit(STRETCH)))

    # The BEGIN that each message comes after, within its stretch or carried into it.
    begins = m.groupBy("capture", "stretch").agg(F.max(F.when(F.col("kind") == "B", F.col("seq"))).alias("last"))
    earlier = Window.partitionBy("capture").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = begins.select("capture", "stretch", F.max("last").over(earlier).alias("carried"))
    in_order = Window.partitionBy("capture", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    framed = m.where("kind <> 'R'").withColumn("begun", F.last(F.when(F.col("kind") == "B", F.col("seq")), ignorenulls=True).over(in_order))
    framed = framed.join(carried, ["capture", "stretch"]).withColumn("begin_seq", F.coalesce("begun", "carried")).drop("begun", "carried")

    begin = m.where("kind = 'B'").select("capture", F.col("seq").alias("begin_seq"), _u32(F.col("data"), 18).alias("xid"))
    commit = framed.where("kind = 'C'").select("capture", "begin_seq", F.col("seq").alias("commit_seq"), _lsn(F.col("data"), 3).alias("commit_lsn"), _lsn(F.col("data"), 11).alias("end_lsn"), F.timestamp_micros(F.conv(F.hex(F.substring("data", 19, 8)), 16, -10).cast("bigint") + EPOCH_MICROS).alias("commit_ts"))
    # The first COMMIT after a BEGIN ends it; what follows belongs to nothing.
    commit = commit.groupBy("capture", "begin_seq").agg(*[F.min_by(c, "commit_seq").alias(c) for c in ("commit_lsn", "end_lsn", "commit_ts")], F.min("commit_seq").alias("commit_seq"))
    transactions = begin.join(commit, ["capture", "begin_seq"])

    # A relation is announced once, and again when it changes: few messages, all of them
    # looked up by capture and number, and the last before the change taken.
    announced = m.where("kind = 'R'").select("capture", "seq", _u32(F.col("data"), 2).alias("rel_id"), _relation("data").alias("rel"))
    announced = announced.select("capture", "rel_id", F.struct("seq", F.col("rel.name").alias("name"), F.array_join("rel.columns", "\0").alias("columns")).alias("r"))
    relations = broadcast_if_small(announced.groupBy("capture", "rel_id").agg(F.array_sort(F.collect_list("r")).alias("rels")))
    changes = framed.where(F.col("kind").isin(*CHANGES)).withColumn("rel_id", _u32(F.col("data"), 2)).join(relations, ["capture", "rel_id"], "left")
    as_of = F.try_element_at(F.filter("rels", lambda r: r["seq"] < F.col("seq")), F.lit(-1))
    changes = changes.withColumn("as_of", as_of).withColumn("rel", F.when(F.col("as_of").isNotNull(), F.col("as_of")).otherwise(F.raise_error(F.lit("a change of a relation that wasn't announced")))).drop("rels", "as_of")
    if table is not None:
        changes = changes.where(F.col("rel.name") == table)

    # Changes are counted within stretches, and those of a transaction's earlier stretches added.
    own = ["capture", "begin_seq", "stretch"]
    before = Window.partitionBy("capture", "begin_seq").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = changes.groupBy(*own).agg(F.count("*").alias("n")).select(*own, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    index = F.row_number().over(Window.partitionBy("capture", "stretch", "begin_seq").orderBy("seq")) - 1
    done = changes.withColumn("index", index).join(parts.join(transactions, ["capture", "begin_seq"]), own).where("seq < commit_seq")
    done = done.withColumn("c", _change("data", F.col("rel.columns")))
    return done.select(F.col("kind").alias("op"), "commit_lsn", "end_lsn", (F.col("index") + F.col("offset")).cast("bigint").alias("change_index"), "xid", "commit_ts", F.col("rel.name").alias("relation"), "c.old_key", "c.row_after", "c.unchanged")


def keep_unchanged(events: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Fills columns whose unchanged TOASTed value wasn't sent from ``state`` (text columns).

    Without this they count as null, as the plain decoding has it.
    """
    row = F.from_json("row_after", "map<string,string>")
    s = state.select(*[F.col(k).cast("string").alias(f"__s_{k}") for k in keys], F.map_from_arrays(F.array(*[F.lit(c) for c in state.columns]), F.array(*[F.col(c).cast("string") for c in state.columns])).alias("__stored"))
    match = F.lit(True)
    e = events.withColumn("__row", row)
    for k in keys:
        match = match & F.col("__row")[k].eqNullSafe(F.col(f"__s_{k}"))
    j = e.join(s, match, "left")
    filled = F.transform_values("__row", lambda k, v: F.when(F.array_contains("unchanged", k) & F.col("__stored").isNotNull(), F.col("__stored")[k]).otherwise(v))
    return j.withColumn("row_after", F.when(F.col("row_after").isNotNull(), F.to_json(filled, {"ignoreNullFields": "false"}))).drop("__row", "__stored", *[f"__s_{k}" for k in keys])
