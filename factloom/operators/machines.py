"""Cooldowns and leases: state machines over ordered events, for keys of any size.

A key that has failed some times in a row is closed for a while; what comes
meanwhile is skipped and counts for nothing. Whether an event counts depends on
what became of all before it, so that no window function tells. A lease is the
same machine: each claim that is let through closes its key at once.

A key's events are cut into runs. A run is a transfer function: for each state
in which it may be entered (how many failures in a row, or closed until when)
it says in which state it is left. Those of a key are put together in the order
of time, which gives each run the state it is entered in; then every run is
walked by itself. So a hot key is walked in as many tasks as it has runs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.tables import saved

#: Events of a run, and microseconds below which a key isn't cut.
RUN_ROWS, CELL = 20_000, 60_000_000

State = tuple[int, int]  # failures in a row, closed until (microseconds; 0: open)


def step(state: State, at: int, failed: bool, fails: int, span: int) -> tuple[State, str]:
    """The state after an event, and what became of it: skipped, ok, failed, or closed (it closed the key)."""
    count, until = state
    if at < until:
        return state, "skipped"
    if not failed:
        return (0, 0), "ok"
    return ((0, at + span), "closed") if count + 1 >= fails else ((count + 1, until), "failed")


def transfer(times: list[int], failed: list[bool], fails: int, span: int) -> list[tuple[int, int, int, int]]:
    """(count, until, count after, until after): how a run is left if it is entered with `count` failures and closed until before or at `until`.

    Open entries have one row for each count; for closed ones, all times of
    return with the same outcome share a row, and times after the last one of
    a row belong to the next. A return beyond the last event leaves the entry
    as it is, and has no row.
    """
    n = len(times)
    left: list[list[State]] = [[(c, 0) for c in range(fails)]]  # from the end backwards: left[-1][c] is how it ends from here with c failures
    after = lambda i: left[n - i]  # noqa: E731  the list is n - i + 1 long when place i is known
    for i in range(n - 1, -1, -1):
        here: list[State] = []
        for c in range(fails):
            if not failed[i]:
                here.append(after(i + 1)[0])
            elif c + 1 < fails:
                here.append(after(i + 1)[c + 1])
            else:
                back = bisect_left(times, times[i] + span, i + 1)
                here.append((0, times[i] + span) if back == n else after(back)[0])
        left.append(here)
    out = [(c, 0, *after(0)[c]) for c in range(fails)]
    for i in range(1, n):  # closed until after the event before and not after this one
        if times[i] == times[i - 1]:
            continue
        end = after(i)[0]
        if len(out) > fails and out[-1][2:] == end:
            out[-1] = (0, times[i], *end)
        else:
            out.append((0, times[i], *end))
    return out


def entered(first: int, rows: list[tuple[int, int, int, int]], state: State) -> State:
    """How a run with this transfer function, whose first event is at `first`, is left if entered in a state."""
    count, until = state
    if until <= first:
        return next(r[2:] for r in rows if r[:2] == (count, 0))
    closed = [r for r in rows if r[1]]
    at = bisect_left([r[1] for r in closed], until)
    return closed[at][2:] if at < len(closed) else state


def runs_of(events: DataFrame, key: str, time: str, tie: str, failed: Column) -> DataFrame:
    """(key, run, events): the events of each key in runs of about RUN_ROWS, cut between minutes."""
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(tie).alias("tie"), F.coalesce(failed, F.lit(False)).alias("failed")).withColumn("cell", F.floor(F.col("at") / CELL))
    cells = rows.groupBy("key", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = cells.select(F.col("key").alias("of"), F.col("cell").alias("at_cell"), F.floor(before / RUN_ROWS).alias("run"))
    return rows.join(numbered, F.col("key").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at_cell"))).groupBy("key", "run").agg(F.sort_array(F.collect_list(F.struct("at", "tie", "failed"))).alias("events"))


_TRANSFER = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("count", "until", "count_after", "until_after")]))


def cooldowns(events: DataFrame, key: str, time: str, tie: str, failed: Column, *, fails: int = 2, seconds: int = 1800) -> DataFrame:
    """(key, tie, outcome, until) of every event: skipped, ok, failed or closed, and until when its key is closed then.

    After `fails` failures in a row a key is closed for `seconds`; an ok ends
    the row, and so does closing. Events of one time go by `tie`. Null keys are
    one key; a null `failed` is no failure; an empty table gives no rows.
    """
    if fails < 1 or seconds < 0:
        raise ValueError("fails must be 1 or more, seconds 0 or more")
    span = seconds * 1_000_000
    runs = saved(runs_of(events, key, time, tie, failed))
    kind, tie_kind = runs.schema["key"].dataType, events.schema[tie].dataType

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a run at a time: a batch may hold very many events
                own = batch.column("events")[i].values
                times = own.field("at").to_pylist()
                rows = transfer(times, own.field("failed").to_pylist(), fails, span)
                fields = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.StructArray.from_arrays(fields, ["count", "until", "count_after", "until_after"]))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), batch.column("run").slice(i, 1), pa.array(times[:1], pa.int64()), whole], names=["key", "run", "first", "rows"])

    made = runs.mapInArrow(functions, T.StructType([T.StructField("key", kind), T.StructField("run", T.LongType()), T.StructField("first", T.LongType()), T.StructField("rows", _TRANSFER)]))
    lines = made.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("run", "first", "rows"))).alias("line"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, counts, untils = [], [], [], []
            for i in range(batch.num_rows):
                state: State = (0, 0)
                for r in batch.column("line")[i].values or ():  # one run's table in Python at a time
                    keys.append(i)
                    numbers.append(r["run"].as_py())
                    counts.append(state[0])
                    untils.append(state[1])
                    rows = r["rows"].values
                    state = entered(r["first"].as_py(), list(zip(*(rows.field(n).to_pylist() for n in ("count", "until", "count_after", "until_after")), strict=True)), state)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), *(pa.array(x, pa.int64()) for x in (numbers, counts, untils))], names=["key", "run", "count", "until"])

    states = lines.mapInArrow(put_together, T.StructType([T.StructField("key", kind), *(T.StructField(n, T.LongType()) for n in ("run", "count", "until"))]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                state, outcomes, untils = (batch.column("count")[i].as_py(), batch.column("until")[i].as_py()), [], []
                own = batch.column("events")[i].values
                for at, bad in zip(own.field("at").to_pylist(), own.field("failed").to_pylist(), strict=True):
                    state, outcome = step(state, at, bad, fails, span)
                    outcomes.append(outcome)
                    untils.append(state[1] if state[1] > at else None)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own)).cast(pa.int64()), own.field("tie"), pa.array(outcomes, pa.string()), pa.array(untils, pa.int64())], names=["row", "tie", "outcome", "until"]).set_column(0, "key", batch.column("key").take(pa.array([i] * len(own), pa.int64())))

    walked = runs.join(states.withColumnRenamed("key", "of").withColumnRenamed("run", "at_run"), F.col("key").eqNullSafe(F.col("of")) & (F.col("run") == F.col("at_run"))).select("key", "events", "count", "until")
    out = walked.mapInArrow(walk, T.StructType([T.StructField("key", kind), T.StructField("tie", tie_kind), T.StructField("outcome", T.StringType()), T.StructField("until", T.LongType())]))
    return out.select(F.col("key").alias(key), F.col("tie").alias(tie), "outcome", F.timestamp_micros("until").alias("until"))


def leases(claims: DataFrame, key: str, time: str, tie: str, *, seconds: int) -> DataFrame:
    """(key, tie, until) of the claims that got their key, each until its lease ends; all others came while it was held."""
    held = cooldowns(claims, key, time, tie, F.lit(True), fails=1, seconds=seconds)
    return held.where("outcome = 'closed'").drop("outcome")
