"""Ledgers, claims and state machines over ordered rows, as window expressions on batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_ledger(spends: DataFrame, day: str, order: str, tie: str, amount: str, budget: int, alerts: tuple[float, ...] = (0.75, 0.9, 1.0)) -> DataFrame:
    """(day, alert, at): the row at which a day's running sum of a whole-number amount first reaches each share of the budget.

    Sums by minute tell in which minutes that is; only their rows are put in
    order, so a day of very many rows is in no one task.
    """
    rows = spends.select(day, tie, order, amount, F.floor(F.unix_timestamp(order) / 60).alias("minute"))
    minutes = rows.groupBy(day, "minute").agg(F.sum(amount).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(day).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0))
    steps = minutes.withColumn("upto", upto).withColumn("base", F.col("upto") - F.col("n")).withColumn("alert", F.explode(F.array(*map(F.lit, alerts))))
    due = steps.where((F.col("upto") >= F.col("alert") * budget) & (F.col("base") < F.col("alert") * budget)).groupBy(day, "alert").agg(F.min_by(F.struct("minute", "base"), "minute").alias("m")).select(day, "alert", "m.*")
    w = Window.partitionBy(day, "alert").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.join(due, [day, "minute"]).withColumn("spent", F.col("base") + F.sum(amount).over(w))
    return running.where(F.col("spent") >= F.col("alert") * budget).groupBy(day, "alert").agg(F.min_by(tie, F.struct(order, tie)).alias("at"))


def first_claims(claims: DataFrame, key: str, order: str, owner: str) -> DataFrame:
    """One claim a key: the first; others lose. An aggregate, so it combines before the shuffle."""
    return claims.groupBy(key).agg(F.min_by(owner, order).alias("owner"), F.min(order).alias("claimed"), (F.count("*") - 1).alias("lost"))


def latest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__r"), F.count("*").alias("versions")).select(key, *(F.col(f"__r.{c}").alias(c) for c in columns), "versions")


def phases(milestones: DataFrame, project: str, phase: str, done: Column) -> DataFrame:
    """(project, phase, done, status): a phase is complete when all of its milestones are, and the first that isn't is in progress."""
    by = milestones.groupBy(project, phase).agg(F.count("*").alias("milestones"), F.count_if(done).alias("done"))
    w = Window.partitionBy(project).orderBy(phase).rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.max(F.when(F.col("done") < F.col("milestones"), 1).otherwise(0)).over(w), F.lit(0))
    status = F.when(F.col("done") == F.col("milestones"), "complete").when(open_before == 0, "in_progress").otherwise("not_started")
    return by.select(project, phase, "milestones", "done", status.alias("status"))
