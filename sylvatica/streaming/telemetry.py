"""Telemetry as a stream: the last events of each session in keyed state, and results that a restart does not repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sylvatica.operators.trials import remaining
from sylvatica.sources import readers, sinks

KEEP = 200
#: The state store that keyed state needs; a session or a cluster sets it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _LastEvents(StatefulProcessor):
    """The last ``keep`` events of a session: a list in the state store, which a session without events for ``idle_ms`` loses."""

    def __init__(self, session: str, order: str, columns: list[str], schema: str, keep: int, idle_ms: int | None) -> None:
        self.session, self.order, self.columns, self.schema, self.keep, self.idle_ms = session, order, columns, schema, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema, self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        at = self.columns.index(self.order)
        for row in rows:
            last.append(tuple(row[c] for c in self.columns))
            if len(last) >= 2 * self.keep + 64:  # bounded, however many events a batch has
                last = self._newest(last, at)
        last = self._newest(last, at)
        self.kept.put(last)
        for event in last:
            yield Row(**{self.session: key[0], **dict(zip(self.columns, event, strict=True))})

    def _newest(self, events: list[tuple], at: int) -> list[tuple]:
        """By their order alone, which may repeat or be null (null is the oldest); equal ones stay as they came."""
        return sorted(events, key=lambda e: (e[at] is not None, e[at] if e[at] is not None else 0))[-self.keep :]

    def close(self) -> None:
        pass


def last_events(events: DataFrame, session: str = "session", order: str = "event_id", payload: str | list[str] = "payload", keep: int = KEEP, idle_ms: int | None = None) -> DataFrame:
    """Per session, after every micro-batch with new events, its last ``keep`` events in order, with all columns of ``payload``.

    State lies in the state store, is as large as the kept events, and outlives the loss of any executor.
    """
    columns = [order, *([payload] if isinstance(payload, str) else payload)]
    chosen = events.select(session, *columns)
    schema = chosen.select(*columns).schema
    told = chosen.select(session, *columns).schema
    processor = _LastEvents(session, order, columns, schema, keep, idle_ms)
    return chosen.groupBy(session).transformWithState(processor, told, "Update", "None" if idle_ms is None else "ProcessingTime")


def started(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """A query started with the state store that keyed state needs; the session's own choice is put back."""
    key, wanted = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, wanted)
    try:
        return start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def newest_states(updates: DataFrame, session: str = "session") -> DataFrame:
    """Of updates written batch by batch (with their number in ``batch``), each session's last."""
    numbered = updates.withColumn("batch", F.col("batch").cast("long"))
    last = numbered.groupBy(session).agg(F.max("batch").alias("batch"))
    return numbered.join(last, [session, "batch"]).drop("batch")


def resume_stream(
    tasks: DataFrame, path: str, schema: str, work: Callable[[DataFrame], DataFrame], key: list[str], checkpoint: str, partition: str = "trial_id",
) -> StreamingQuery:
    """Work off a stream of tasks into the results table at ``path``, once each, also after a restart.

    A micro-batch writes its own folder, named by the query (which its checkpoint knows) and its number, and a repeated
    micro-batch replaces it; a task is passed over if another batch has its result.  For that the keys of the batch's
    own trials are read, not all results.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(key)
        own = f"{rows.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        others = readers.read_results(rows.sparkSession, path, schema).where(F.col("batch") != own)
        sinks.append_results(work(remaining(rows, readers.results_of(others, rows, partition), key)), path, own, partition)

    return tasks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
