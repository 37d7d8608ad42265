"""Queries with state: ledgers, claims, settlements, phases and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import machines as M
from factloom.operators import stateful as S
from factloom.plans.catalog import query
from factloom.sources.tables import records, shared_root, table


@query("""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, ts, sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS spent FROM events), x AS (SELECT day, unnest([0.75, 0.9, 1.0]) AS alert, event_id, ts, spent FROM r)
  SELECT day, alert::DOUBLE AS alert, arg_min(event_id, [epoch_us(ts), event_id]) AS at FROM x WHERE spent >= alert * 100000 GROUP BY day, alert""")
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each day's spending, in cents, reached three quarters, nine tenths and all of its budget."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "value").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", F.floor(F.col("value") * 100).alias("cents"))
    return S.budget_ledger(e, "day", "ts", "event_id", "cents", 100_000)


@query("SELECT user_id, arg_min(event_type, event_id) AS owner, min(event_id) AS claimed, count(*) - 1 AS lost FROM events GROUP BY user_id")
def claims_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim of each user."""
    return S.first_claims(table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS versions FROM events GROUP BY user_id")
def cycle_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of each user."""
    return S.latest(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value"), "user_id", "event_id", ["event_type", "value"])


@query("""WITH m AS (SELECT custkey AS project, CAST(id % 4 AS INT) AS phase, count(*) AS milestones, count(*) FILTER (result_status IN ('successful', 'partial')) AS done FROM records GROUP BY 1, 2), o AS (SELECT *, coalesce(max(CASE WHEN done < milestones THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ob FROM m)
  SELECT project, phase, milestones, done, CASE WHEN done = milestones THEN 'complete' WHEN ob = 0 THEN 'in_progress' ELSE 'not_started' END AS status FROM o""")
def phase_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of each customer's projects."""
    m = records(spark, sf_dir).select(F.col("custkey").alias("project"), (F.col("id") % 4).cast("int").alias("phase"), "result_status")
    return S.phases(m, "project", "phase", F.col("result_status").isin("successful", "partial"))


#: A plain walk over each source's events, one step of the recursion each.
_WALK = """WITH RECURSIVE e AS (SELECT {key} AS source, event_id, ts, {bad} AS bad, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS k FROM events),
  walk AS (SELECT source, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0 AS fails, NULL::TIMESTAMP AS until, '' AS outcome FROM e WHERE k = 1 UNION ALL
    SELECT e.source, e.k, e.event_id, CASE WHEN ts < until THEN w.fails WHEN NOT bad THEN 0 WHEN w.fails + 1 >= {n} THEN 0 ELSE w.fails + 1 END, CASE WHEN ts < until THEN until WHEN NOT bad THEN NULL WHEN w.fails + 1 >= {n} THEN ts + INTERVAL {seconds} SECOND ELSE until END,
      CASE WHEN ts < until THEN 'skipped' WHEN NOT bad THEN 'ok' WHEN w.fails + 1 >= {n} THEN 'closed' ELSE 'failed' END FROM walk w JOIN e ON e.source = w.source AND e.k = w.k + 1)"""


@query(_WALK.format(key="user_id % 10", bad="event_type = 'error'", n=2, seconds=1800) + " SELECT source, event_id, outcome, CASE WHEN outcome IN ('closed', 'skipped') THEN until END AS until FROM walk WHERE k > 0")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each source's events if two failures in a row close it for half an hour."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").withColumn("source", F.col("user_id") % 10)
    return M.cooldowns(e, "source", "ts", "event_id", F.col("event_type") == "error", fails=2, seconds=1800)


@query(_WALK.format(key="user_id % 25", bad="true", n=1, seconds=7200) + " SELECT source AS candidate, event_id, until FROM walk WHERE outcome = 'closed'")
def claim_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims that get their candidate, if each holds it for two hours."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id").withColumn("candidate", F.col("user_id") % 25)
    return M.leases(e, "candidate", "ts", "event_id", seconds=7200)


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def tumbling_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand by day and topic."""
    w = F.window("ts", "1 day")
    e = table(spark, sf_dir, "events", "ts", "event_type", "value").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("cents"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n", "cents")


@query("SELECT event_type, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS cents FROM events GROUP BY 1")
def tumbling_demand_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the table's file, summed over all its windows."""
    from factloom.streaming.demand import demand, run_windows, windows_of

    folder = f"{shared_root(spark)}/demand-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    run_windows(demand(stream), f"{folder}/windows", f"{folder}/state")
    return windows_of(spark, f"{folder}/windows").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


@query("""WITH s AS (SELECT event_type AS strategy, user_id % 10 AS library, count(*) AS runs, count(*) FILTER (value > 60) AS accepted, CAST(sum(floor(value * 100)) AS BIGINT) AS cents FROM events GROUP BY 1, 2)
  SELECT * FROM s""")
def strategy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, acceptances and cost by library and strategy."""
    e = table(spark, sf_dir, "events", "event_type", "user_id", "value")
    return e.groupBy(F.col("event_type").alias("strategy"), (F.col("user_id") % 10).alias("library")).agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 60).alias("accepted"), F.sum(F.floor(F.col("value") * 100)).alias("cents"))
