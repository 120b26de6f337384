"""Event-time windows and deduplication of event streams."""

import threading

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ordermill.operators.silver import bronze_from_inbox, insert_absent
from ordermill.sources.inbox import as_inbox_rows
from ordermill.sources.store import read_or_empty

WINDOW = "5 minutes"
DELAY = "10 minutes"


def window_counts(events, time_column, by=(), measures=None, width=WINDOW, delay=DELAY):
    """Counts per tumbling window and `by`.

    On a stream, windows are final once the watermark passes their end, and later events
    are dropped. A table has no watermark: every row counts.
    """
    if events.isStreaming:
        events = events.withWatermark(time_column, delay)
    columns = measures or {"count": F.count("*")}
    return (
        events.groupBy(F.window(time_column, width), *by)
        .agg(*[c.alias(name) for name, c in columns.items()])
        .select("window.start", "window.end", *by, *columns)
    )


def event_type_windows(events, width=WINDOW, delay=DELAY):
    """Events and late events per window and event type."""
    measures = {"events": F.count("*"), "late_events": F.count_if("is_late_event")}
    return window_counts(events, "event_time_utc", ["event_type"], measures, width, delay)


def distinct_events(events, time_column="event_time_utc", delay=DELAY):
    """A stream with repeats of an event dropped while they arrive within the delay.

    Repeats that arrive later are stopped where rows are stored, by `insert_absent`.
    """
    return events.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["event_id"])


def message_windows(messages, cluster, topic, topic_id, width=WINDOW, delay=DELAY):
    """Windows by event type over the messages of the pipeline, decoded as for Silver."""
    events = bronze_from_inbox(as_inbox_rows(messages, cluster, topic_id), cluster, topic)
    return event_type_windows(events, width, delay)


def start_distinct_store(events, path, checkpoint, time_column, delay=DELAY, **trigger):
    """Append each event once to the table at `path`.

    The state store drops the copies that arrive within the delay, so most never reach the table.
    A copy that comes when its state is gone is left out by its id, looked up in the table, as is
    every row of a batch that is run again. With the time of arrival as time column no row is late.
    """
    schema = events.schema

    def add(batch, batch_id):
        known = read_or_empty(batch.sparkSession, path, schema)
        insert_absent(known, batch, small_source=True).write.mode("append").parquet(path)

    return (
        distinct_events(events, time_column, delay)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


class LateRows(StreamingQueryListener):
    """Keeps, for each trigger of the query of the given name, the rows read and those dropped as late.

    `rows` has one entry (batch, read, dropped) per trigger; `wait` returns once the query's end was reported.
    """

    def __init__(self, name):
        self.name, self.rows, self._run, self._ended = name, [], None, threading.Event()

    def onQueryStarted(self, event):
        if event.name == self.name:
            self._run = event.runId

    def onQueryProgress(self, event):
        progress = event.progress
        if progress.runId == self._run:
            dropped = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
            self.rows.append((progress.batchId, progress.numInputRows, dropped))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.runId == self._run:
            self._ended.set()

    def wait(self, seconds=60):
        if not self._ended.wait(seconds):
            raise TimeoutError(f"no end of {self.name} was reported")


def start_memory_sink(frame, name, checkpoint=None):
    """An in-memory table of finished rows, for tests."""
    writer = frame.writeStream.format("memory").queryName(name).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
