"""Counts per event-time period that late events correct until a cut-off.

Every batch is added to the retained raw events.  The partitions (days of event time) in
which it brings something new before the cut-off are recomputed from all their retained
events and replaced as a whole (dynamic partition overwrite): the events once each with
their lateness, and the counts.  A repeated delivery changes nothing, so it makes no
partition be recomputed; nor does an event past the cut-off, which no longer counts: it is
kept beside a partition that is closed, and reported.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import children, delete_path, path_exists
from tidemark.sources.store import get_json, put_json

#: Up to how many partitions are named in a filter; more are joined.
NAMED_PARTS = 1000


def lateness(event_time: Column, visible: Column, period: str, grace: str) -> Column:
    """``on_time``, ``late`` or ``too_late``; null when the event has no event time.

    ``period`` is a unit of date_trunc, ``grace`` an interval.  An event is on time if
    it became visible before the end of its period (also if seemingly before it
    happened) and late for less than ``grace`` after that end.
    """
    end = F.date_trunc(period, event_time) + F.expr(f"interval 1 {period}")
    seen = F.coalesce(visible, event_time)
    return F.when(event_time.isNull(), None).when(seen < end, "on_time").when(seen < end + F.expr(f"interval {grace}"), "late").otherwise("too_late")


class LateEventCounts:
    """Per-period counts kept right by batches of late events.

    Below ``root``, by partition: ``raw/`` (every delivery, by batch), ``events/`` (each
    event once, with its lateness), ``counts/`` (by ``group`` and period, with the batch
    that recomputed them), ``beyond/`` (events past the cut-off since then) and
    ``batches/`` (which partitions a batch touched).  Partitions are days of the calendar,
    which bounds how many of them the driver can ever be told of.

    Defined results: an event without event time has no period and isn't retained; copies
    of one identifier count once, the one visible first; nulls in identifiers and groups
    match nulls.
    """

    def __init__(self, spark: SparkSession, root: str, identity: Sequence[str], group: Sequence[str], event_time: str, visible: str, period: str = "hour", grace: str = "6 hours"):
        self.spark, self.root = spark, root
        self.identity, self.group = list(identity), list(group)
        self.event_time, self.visible, self.period, self.grace = event_time, visible, period, grace
        self.raw_path, self.events_path, self.counts_path, self.beyond_path = (f"{root}/{x}" for x in ("raw", "events", "counts", "beyond"))
        self._columns: dict[str, str] = {}

    def _classified(self, events: DataFrame) -> DataFrame:
        when = F.col(self.event_time).cast("timestamp")
        seen = F.col(self.visible).cast("timestamp")
        return events.select(
            *self.identity,
            *[c for c in self.group if c not in self.identity],
            when.alias("event_time"),
            F.coalesce(seen, when).alias("visible_time"),
            F.date_trunc(self.period, when).alias("period_start"),
            lateness(when, seen, self.period, self.grace).alias("lateness"),
            F.date_format(when, "yyyyMMdd").alias("part"),
        ).where("event_time is not null")

    def add_batch(self, batch: DataFrame, batch_id: int) -> list[str]:
        """Retains a batch, recomputes the partitions it changes, returns those.

        Calling it again with the same id, also with other rows, replaces what the first
        call left behind: the partitions that call touched are recomputed too.  A call that
        failed half-way is repeated as a whole; until then a partition may have been
        replaced without the others.  An empty batch touches nothing.
        """
        n, noted = int(batch_id), f"{self.root}/batches/{int(batch_id)}.json"
        target = f"{self.raw_path}/batch={n}"
        classified = self._classified(batch)
        self._columns = {f.name: f.dataType.simpleString() for f in classified.schema}
        before = get_json(self.spark, noted) if path_exists(self.spark, noted) else {"touched": [], "beyond": []}
        for p in before["beyond"]:
            delete_path(self.spark, f"{self.beyond_path}/part={p}/batch={n}")
        classified.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(target)
        mine = self._once(self.spark.read.schema(self._ddl(self._columns)).parquet(target))
        seen = {c.split("=", 1)[1] for c in children(self.spark, target) if c.startswith("part=")}
        new = self._news(mine, seen).persist()
        try:
            found = {r["part"]: r["open"] for r in new.groupBy("part").agg(F.bool_or(F.col("lateness") != "too_late").alias("open")).collect()}
            again = {p for p, o in found.items() if o} | set(before["touched"])
            closed = set(found) - again
            # Noted before anything is replaced: a repeated call has to undo this one.
            put_json(self.spark, noted, {"touched": sorted(again), "beyond": sorted(closed)})
            if closed:
                late = self._of(new, closed).withColumn("batch", F.lit(n).cast("bigint"))
                late.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(self.beyond_path)
            if again:
                self.recompute(again, n)
        finally:
            new.unpersist()
        return sorted(again)

    def _news(self, mine: DataFrame, parts: Iterable[str]) -> DataFrame:
        """Events that no retained delivery had, or that are visible earlier than it was."""
        if not path_exists(self.spark, self.events_path) and not path_exists(self.spark, self.beyond_path):
            return mine
        known = self.events(parts).select(*[F.col(c).alias(f"__k_{c}") for c in ("part", *self.identity)], F.col("visible_time").alias("__k_visible"))
        match = F.lit(True)
        for c in ("part", *self.identity):
            match = match & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        return mine.join(known, match, "left").where("__k_part is null or visible_time < __k_visible").select(*mine.columns)

    @staticmethod
    def _ddl(columns: dict[str, str]) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in columns.items())

    def _known(self) -> dict[str, str]:
        """Columns of the raw events; of a store that an earlier process filled, as stored."""
        if not self._columns:
            stored = self.spark.read.option("basePath", self.raw_path).parquet(self.raw_path).schema
            self._columns = {f.name: f.dataType.simpleString() for f in stored if f.name != "batch"} | {"part": "string"}
        return self._columns

    def _of(self, df: DataFrame, parts: Iterable[str] | None) -> DataFrame:
        if parts is None:
            return df
        named = sorted(parts)
        if len(named) <= NAMED_PARTS:
            return df.where(F.col("part").isin(named) if named else F.lit(False))
        return df.join(F.broadcast(self.spark.createDataFrame([(p,) for p in named], "part string")), "part", "left_semi")

    def _stored(self, path: str, columns: dict[str, str]) -> DataFrame:
        return self.spark.read.schema(self._ddl(columns)).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], self._ddl(columns))

    def raw(self) -> DataFrame:
        """Every retained delivery of every event."""
        return self.spark.read.option("basePath", self.raw_path).schema(self._ddl(self._known() | {"batch": "bigint"})).parquet(self.raw_path)

    def _once(self, raw: DataFrame) -> DataFrame:
        """Each event of a frame with the raw columns once: the earliest visibility counts."""
        others = [c for c in self._known() if c not in [*self.identity, "part"]]
        first = raw.groupBy("part", *self.identity).agg(F.min(F.struct("visible_time", "event_time", *[c for c in others if c not in ("visible_time", "event_time")])).alias("__e"))
        return first.select(*[F.col(c) if c in ("part", *self.identity) else F.col(f"__e.{c}").alias(c) for c in self._known()])

    def events(self, parts: Iterable[str] | None = None) -> DataFrame:
        """The retained events of some partitions (all by default), each once, as last computed."""
        parts = None if parts is None else set(parts)
        computed = self._of(self._stored(self.events_path, self._known()), parts)
        if not path_exists(self.spark, self.beyond_path):
            return computed
        return computed.unionByName(self._once(self._of(self._stored(self.beyond_path, self._known() | {"batch": "bigint"}), parts)))

    def recompute(self, parts: Iterable[str], batch_id: int) -> None:
        """Replaces partitions by what their retained events give; without any, removes them."""
        parts = set(parts)
        once = self._once(self._of(self.raw(), parts))
        once.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.events_path)
        left = {r[0] for r in self._of(self.raw(), parts).select("part").distinct().collect()}
        for p in parts - left:
            delete_path(self.spark, f"{self.events_path}/part={p}")
            delete_path(self.spark, f"{self.counts_path}/part={p}")
        counts = (
            self._of(self._stored(self.events_path, self._known()), parts)
            .groupBy("part", *self.group, "period_start")
            .agg(*self._counted(), F.lit(int(batch_id)).cast("bigint").alias("as_of"))
        )
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.counts_path)
        for p in parts:  # they are among the events now
            delete_path(self.spark, f"{self.beyond_path}/part={p}")

    @staticmethod
    def _counted() -> list[Column]:
        return [
            F.count_if(F.col("lateness") != "too_late").alias("n_events"),
            F.count_if(F.col("lateness") == "late").alias("n_late"),
            F.count_if(F.col("lateness") == "too_late").alias("n_too_late"),
        ]

    def counts(self) -> DataFrame:
        """Counts per group and period, ``as_of`` the batch that last recomputed them.

        No rows while no batch has had any event.
        """
        known = self._known()
        columns = {c: known[c] for c in self.group} | {"period_start": known["period_start"], "n_events": "bigint", "n_late": "bigint", "n_too_late": "bigint", "as_of": "bigint", "part": "string"}
        computed = self._stored(self.counts_path, columns)
        if not path_exists(self.spark, self.beyond_path):
            return computed
        by = ["part", *self.group, "period_start"]
        beyond = self._once(self._stored(self.beyond_path, known | {"batch": "bigint"})).groupBy(*by).agg(*self._counted(), F.lit(None).cast("bigint").alias("as_of"))
        both = computed.unionByName(beyond).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_events", "n_late", "n_too_late")], F.max("as_of").alias("as_of"))
        return both.select(*columns)

    def drop(self) -> None:
        delete_path(self.spark, self.root)


def in_groups(df: DataFrame, batch: str, groups: int) -> list[DataFrame]:
    """A log cut into at most ``groups`` parts of consecutive batches and about equal size.

    Rows without a batch number belong to the first part.
    """
    sizes = sorted((r[0], r[1]) for r in df.groupBy(batch).count().where(F.col(batch).isNotNull()).collect())
    total, done, last = sum(n for _, n in sizes), 0, {}
    for b, n in sizes:
        done += n
        last[min(groups - 1, (done - 1) * groups // total)] = b
    cuts = [last[g] for g in sorted(last)]
    if not cuts:
        return [df]
    lows = [None, *cuts[:-1]]
    c = F.col(batch)
    return [df.where(c.isNull() | (c <= hi) if lo is None else (c > lo) & (c <= hi)) for lo, hi in zip(lows, cuts)]
