"""Sessions as keyed state: a thread's events drive its stage, exactly once and in one sequence.

Events (thread_id, event_id, ts, decision) are a stream. The state of a thread is its stage, the number
of its last step and the ids of events it has seen: an event that arrives again, in the same batch or
after a restart, is no step; two clients' events of one thread are put in order by the one task that
holds the thread's state, so no number is given twice. Within a batch, events are taken in the order of
(ts, event_id). A thread that waits for longer than `idle` in event time is ended by a timer.

Events older than the watermark are dropped by Spark's operator; ids of seen events are kept for as long
as such an event could still arrive. A thread's new events of one batch are sorted in one task: they are
one session's decisions, and few.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandgraph.operators.workflow import stage_after

#: The stage in which a session waits after each step of the workflow.
WAITS_IN = {"parse": "interpret", "expand": "approve", "gate": "extract_confirm", "extract": "report"}
EXPIRED = "expired"
_STEP = Row("thread_id", "seq", "at", "event_id", "decision", "stage")


def next_stage(stage: str | None, decision: str) -> str:
    """The stage a thread waits in after a decision; without a stage, or after its report, it begins."""
    if stage in (None, "report"):
        return "interpret"
    step = stage_after(stage, decision)
    return WAITS_IN.get(step, step)


class _Steps(StatefulProcessor):
    """A thread's state is one value: read once and written once a batch, however many events the thread has in it.
    Ids that are too old to come again go whenever it is written."""

    def __init__(self, idle: timedelta, kept: timedelta):
        self.idle_ms, self.kept_ms = (int(x.total_seconds() * 1000) for x in (idle, kept))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "seq long, stage string, due long, ids array<string>, at array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = sorted(((r.at, r.event_id, r.decision) for r in rows), key=lambda r: r[:2])
        now = self.now.get()
        seq, stage, due, ids, ats = now if now is not None else (0, None, None, [], [])
        seen, out, armed = dict(zip(ids, ats)), [], due
        for at, event_id, decision in new:
            if event_id in seen:
                continue
            seen[event_id] = at // 1000
            if due is not None and at // 1000 >= due and stage != "report":  # the timer's time came within this batch
                seq, stage = seq + 1, "report"
                out.append(_STEP(key[0], seq, due * 1000, None, EXPIRED, stage))
            seq, stage = seq + 1, next_stage(stage, decision)
            out.append(_STEP(key[0], seq, at, event_id, decision, stage))
            due = at // 1000 + self.idle_ms
        if out:
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(due)
            self._keep(seq, stage, due, seen, timerValues.getCurrentWatermarkInMs())
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seq, stage, due, ids, ats = self.now.get()
        out = []
        if stage != "report":
            seq, stage = seq + 1, "report"
            out.append(_STEP(key[0], seq, due * 1000, None, EXPIRED, stage))
        self._keep(seq, stage, None, dict(zip(ids, ats)), expiredTimerInfo.getExpiryTimeInMs())
        return iter(out)

    def _keep(self, seq: int, stage: str, due: int | None, seen: dict[str, int], now: int) -> None:
        seen = {k: v for k, v in seen.items() if v >= now - self.kept_ms}
        self.now.update((seq, stage, due, list(seen), list(seen.values())))

    def close(self) -> None:
        pass


def steps(events: DataFrame, late: str = "1 hour", idle: timedelta = timedelta(days=1), kept: timedelta = timedelta(hours=2)) -> DataFrame:
    """A stream of events as a stream of steps: thread_id, seq, ts, event_id, decision, stage.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). kept is at least late.
    """
    key = events.schema["thread_id"].dataType.simpleString()
    ts = F.col("ts").cast("timestamp")
    picked = events.select("thread_id", F.col("event_id").cast("string").alias("event_id"), ts.alias("ts"), F.unix_micros(ts).alias("at"), "decision")
    keyed = picked.withWatermark("ts", late).groupBy("thread_id")
    schema = f"thread_id {key}, seq long, at long, event_id string, decision string, stage string"
    out = keyed.transformWithState(statefulProcessor=_Steps(idle, kept), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select("thread_id", "seq", F.timestamp_micros("at").alias("ts"), "event_id", "decision", "stage")


def run(events: DataFrame, out: str, checkpoint: str, **how: object) -> None:
    """Take all events that are there now through `steps` into Parquet files under out."""
    spark = events.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        steps(events, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
