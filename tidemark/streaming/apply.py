"""Applying change streams to versioned tables, each micro-batch exactly once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.delta import Dialect
from tidemark.operators.late_events import LateEventCounts
from tidemark.operators.pipelines import apply_delta
from tidemark.sources.store import VersionedTable


def batch_applier(table: VersionedTable, dialect: Dialect, prepare: Callable[[DataFrame], DataFrame] | None = None, query: str = "default") -> Callable[[DataFrame, int], dict[str, Any] | None]:
    """A function for ``foreachBatch``.

    The batch's id is stored in the same version as its rows; a batch that Spark runs
    again after a failure finds its id there and does nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> dict[str, Any] | None:
        done = table.last_info().get("stream_batches", {})
        if int(done.get(query, -1)) >= batch_id:
            return None
        # A source such as a slot is read once for a batch, not once for every pass over it.
        kept = batch.persist()
        try:
            return apply_delta(prepare(kept) if prepare else kept, table, dialect, {"stream_batches": {**done, query: batch_id}})
        finally:
            kept.unpersist()

    return run


def apply_stream(stream: DataFrame, table: VersionedTable, dialect: Dialect, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True, query: str = "default") -> StreamingQuery:
    """Starts a query that applies typed delta events as they come."""
    run = batch_applier(table, dialect, prepare, query)
    writer = stream.writeStream.foreachBatch(lambda b, i: (run(b, i), None)[1]).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def count_stream(stream: DataFrame, counts: LateEventCounts, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps per-period counts right while events arrive; batches are idempotent by id."""
    writer = stream.writeStream.foreachBatch(lambda b, i: (counts.add_batch(b, i), None)[1]).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
