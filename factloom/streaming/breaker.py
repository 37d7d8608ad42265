"""Cooldowns on a stream: the machine of operators/machines.py with state by key and timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.operators.machines import step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Milliseconds to which timers are rounded up, so that a burst of events has few.
TICK = 1000


class Breaker(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, so that they are walked in order of time however they are batched."""

    def __init__(self, fails: int, span: int):
        self.fails, self.span = fails, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, tie long, failed boolean")
        self.machine = handle.getValueState("machine", "count long, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ticks = set()
        for r in rows:
            self.waiting.appendValue((r["at"], r["tie"], r["failed"]))
            ticks.add((r["at"] // 1000 // TICK + 1) * TICK)
        for t in ticks:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        state = tuple(self.machine.get()) if self.machine.exists() else (0, 0)
        for at, tie, failed in sorted(r for r in held if r[0] < due):
            state, outcome = step(state, at, bool(failed), self.fails, self.span)
            yield Row(key=key[0], tie=tie, outcome=outcome, until=state[1] if state[1] > at else None)
        later = [r for r in held if r[0] >= due]
        self.waiting.put(later) if later else self.waiting.clear()
        if state[0] == 0 and state[1] <= due:  # as new: nothing to remember
            self.machine.clear()
        else:
            self.machine.update(state)

    def close(self) -> None:
        pass


def cooldowns(events: DataFrame, key: str, time: str, tie: str, failed: Column, *, fails: int = 2, seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """(key, tie, outcome, until) of each event that the watermark has passed, as operators/machines.py has it; events later than `late` are dropped.

    key is text and tie a whole number. The state of a key goes once it is open,
    has no failure to remember and no event waiting.
    """
    rows = events.withWatermark(time, late).select(F.col(time), F.col(key).cast("string").alias("key"), F.unix_micros(time).alias("at"), F.col(tie).cast("long").alias("tie"), F.coalesce(failed, F.lit(False)).alias("failed"))
    out = rows.groupBy("key").transformWithState(Breaker(fails, seconds * 1_000_000), "key string, tie long, outcome string, until long", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.col("tie").alias(tie), "outcome", F.timestamp_micros("until").alias("until"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what is there, append it to path, and stop. The state store is RocksDB, which timers need."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(PROVIDER, before)
