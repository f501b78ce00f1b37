"""Durations: each agent's completions paired with its starts, by state that lasts across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillet.sources import shared

_OUT = "agent long, start_id long, end_id long, seconds double, status string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Pairs(StatefulProcessor):
    """The open start of an agent: its time in microseconds, its id, and whether a completion has used it."""

    def __init__(self, timeout: int) -> None:
        self.timeout = timeout  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at long, id long, used boolean")

    def _timer(self, at: int) -> int:
        return -(-(at + self.timeout) // 1000)  # whole milliseconds, not before the time-out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State and timer are read before an agent's events of the batch and written after them, not at each event."""
        out = []
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        before = state = self.open.get() if self.open.exists() else None
        for at, name, kind in zip(events["at"].tolist(), events["event_id"].tolist(), events["kind"].tolist()):
            over = state is not None and at - state[0] > self.timeout
            if state is not None and (kind == "start" or over):
                if not state[2]:
                    out.append((key[0], state[1], None, None, "timed out" if over else "restarted"))
                state = None
            if kind == "start":
                state = (at, name, False)
            elif state is None:
                out.append((key[0], None, name, 0.0, "no start"))
            else:
                state = (state[0], state[1], True)
                out.append((key[0], state[1], name, (at - state[0]) / 1e6, "done"))
        timers = [None if s is None else self._timer(s[0]) for s in (before, state)]
        if timers[0] != timers[1]:
            if before is not None:
                self.handle.deleteTimer(timers[0])
            if state is not None:
                self.handle.registerTimer(timers[1])
        if state is not None:
            self.open.update(state)
        elif before is not None:
            self.open.clear()
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.open.get() if self.open.exists() else None
        if state is not None and self._timer(state[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            if not state[2]:
                yield _frame([(key[0], state[1], None, None, "timed out")])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["agent", "start_id", "end_id", "seconds", "status"])
    return out.astype({"agent": "int64", "start_id": "Int64", "end_id": "Int64", "seconds": "Float64", "status": "object"})


def durations(spark: SparkSession, folder: str, name: str, schema, start: str, end: str, timeout_hours: int = 48, late: str = "1 day", agent: str = "user_id", files: int | None = None) -> DataFrame:
    """agent, start_id, end_id, seconds and status, of the events (event_id, ts, event_type and agent) in the files of
    that name, read as a stream.

    A completion (type ``end``) takes the time since the agent's last start (type ``start``), by time and then
    id; a second one counts from the same start. Without a start, or with one that is longer ago than the
    time-out, it has 0 seconds, no start_id and status "no start". A start that no completion has used when another follows
    is "restarted", or "timed out" if that is later than the time-out or the watermark passes it; a start that
    is still within its time at the end stays in the state and gives no row. Events later than ``late`` behind the
    newest are left out, as are those without an agent or a time. An agent's events of one batch are sorted in memory,
    so batches should be of a bounded size (``files`` in a batch).

    The stream runs in a session of its own, whose state store is RocksDB, so this session's settings stay.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    source = own.readStream.schema(schema).option("pathGlobFilter", f"{name}*").option("recursiveFileLookup", "true")
    rows = (source.option("maxFilesPerTrigger", files) if files else source).parquet(folder)
    kind = F.when(F.col("event_type") == start, "start").otherwise("end")
    rows = rows.where(F.col("event_type").isin(start, end) & F.col(agent).isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL")
    rows = rows.withWatermark("ts", late).select(F.col(agent).cast("long").alias("agent"), "ts", F.unix_micros("ts").alias("at"), "event_id", kind.alias("kind"))
    paired = rows.groupBy("agent").transformWithStateInPandas(_Pairs(timeout_hours * 3_600_000_000), _OUT, "append", "EventTime")
    out, mark = shared.folder(spark, "durations"), shared.folder(spark, "progress")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/n={number}")

    paired.writeStream.outputMode("append").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.schema(_OUT).option("recursiveFileLookup", "true").parquet(out)
