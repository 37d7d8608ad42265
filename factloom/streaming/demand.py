"""Streams: demand in event-time windows, claims once a key, and alerts that fire once a day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.sources.versions import VersionedTable


def demand(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by topic in tumbling windows; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def claims(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; the state of a key goes when it is past it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def alerts(events: DataFrame, budget: float, shares: tuple[float, ...] = (0.75, 0.9, 1.0), late: str = "1 hour") -> DataFrame:
    """(day, alert, spent): shares of a day's budget, each told once, however the day's events are batched; a day's state goes a day after its end."""

    def spend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent, told = state.get if state.exists else (0.0, 0)
        for b in batches:
            spent += float(b["value"].sum())
        now = sum(spent >= s * budget for s in shares)
        state.update((spent, max(told, now)))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(key[0]).timestamp() * 1000) + 2 * 86_400_000, state.getCurrentWatermarkMs() + 1))
        if now > told:
            yield pd.DataFrame({"day": [key[0]] * (now - told), "alert": list(shares[told:now]), "spent": [spent] * (now - told)})

    days = events.withWatermark("ts", late).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "value").groupBy("day")
    return days.applyInPandasWithState(spend, "day string, alert double, spent double", "spent double, told int", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, write it to path, and stop; a rerun goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_windows(windows: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what is there, and merge the windows that have changed into the versioned table at path.

    A batch that is replayed after a stop does nothing more, and readers see the
    table as it was before a batch or after it.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.select(F.concat_ws("|", F.col("start").cast("string"), "event_type").alias("key"), "*")
        into = VersionedTable(batch.sparkSession, path, "key")
        into.create(keyed.schema)
        into.merge(keyed, "replace", batch=("windows", number))

    windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def windows_of(spark: SparkSession, path: str) -> DataFrame:
    """The windows that run_windows has merged so far."""
    return VersionedTable(spark, path, "key").read().drop("key")
