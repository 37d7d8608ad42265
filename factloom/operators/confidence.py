"""Confidence in a body of evidence, strength of single records and how far their peers agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.rules import blank, half_up

# Weights of the parts of a confidence score.
CONFIDENCE_WEIGHTS = {"outcome_strength": 0.30, "evidence_quality": 0.25, "implementation_depth": 0.20, "consistency": 0.15, "diversity": 0.10}
LABELS = [(70, "strong"), (45, "moderate"), (20, "limited")]


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def package_inputs(records: DataFrame, group: str) -> DataFrame:
    """The counts that confidence rests on, by group; records have tier and metric summary."""
    c = F.col
    detail = sum((F.when(~blank(c(f)), 1).otherwise(0) for f in ("rollout_strategy", "success_criteria", "lessons_learned", "implementation_pattern")), F.lit(0))
    return records.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(c("tier") == "gold").alias("gold"), F.count_if(c("n_metrics") > 0).alias("outcomes"), F.count_if(c("with_baseline") & c("with_post")).alias("measured"),
        F.count_if("independently_verified").alias("independent"), F.count_if("vendor_reported").alias("vendor"), F.count_if(detail >= 2).alias("rich"),
        F.count_if(c("result_status").isin("failed", "abandoned")).alias("negative"), F.count_distinct(F.nullif("organization_name", F.lit(""))).alias("organizations"),
    )


def confidence() -> dict[str, Column]:
    """Parts, score and label from package_inputs."""
    c = F.col
    total, m = F.greatest(c("total"), F.lit(1)), c("measured")
    outcome = F.when(m >= 10, 90.0 + F.least(F.lit(10), m - 10)).when(m >= 5, 70.0 + (m - 5) * 4).when(m >= 3, 50.0 + (m - 3) * 10).when(m >= 1, 25 + (m - 1) * 12.5).when(c("outcomes") >= 3, 20.0).when(c("outcomes") >= 1, 10.0).otherwise(0.0)
    quality = clamp(F.least(F.lit(50.0), c("gold") / total * 80) + F.least(F.lit(30.0), c("independent") / total * 50) - F.least(F.lit(20.0), c("vendor") / total * 30))
    depth = F.when(c("rich") >= 5, 90.0).when(c("rich") >= 3, 70.0).when(c("rich") >= 1, 40.0).otherwise(0.0)
    bad = c("negative") / total
    steady = F.when(bad > 0.3, F.greatest(F.lit(0.0), 80 - bad * 80)).when(bad > 0.1, 85.0).otherwise(100.0)
    spread = F.least(F.lit(100.0), c("organizations") * 10.0)
    parts = {"outcome_strength": F.least(F.lit(100.0), outcome), "evidence_quality": quality, "implementation_depth": depth, "consistency": steady, "diversity": spread}
    raw = None
    for name, weight in CONFIDENCE_WEIGHTS.items():
        raw = parts[name] * weight if raw is None else raw + parts[name] * weight
    score = half_up(clamp(raw), 1)
    label = F.when(score >= LABELS[0][0], LABELS[0][1])
    for bound, name in LABELS[1:]:
        label = label.when(score >= bound, name)
    return {"score": score, "label": label.otherwise("insufficient")}


def candidate_score() -> Column:
    """Strength of a record from 0 to 100: a base of 50 with additions and deductions."""
    c = F.col
    status = F.when(c("result_status").isin("successful", "partial"), 10).when(c("result_status").isin("failed", "abandoned"), -10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 50 + F.when(c("independently_verified"), 15).otherwise(0) + F.when(F.coalesce("sample_size", F.lit(0)) > 1, 10).otherwise(0) + F.least(F.lit(15), c("n_numeric") * 5) - F.when(c("vendor_reported"), 10).otherwise(0) + status))


def peer_consistency(records: DataFrame, group: str) -> DataFrame:
    """(id, score): how many of a record's peers, the others of its group, went well. Counted from the group's totals."""
    good = F.col("result_status").isin("successful", "partial")
    totals = records.groupBy(group).agg(F.count("*").alias("n"), F.count_if(good).alias("g"))
    ratio = (F.col("g") - F.when(good, 1).otherwise(0)) / (F.col("n") - 1)
    score = F.when(F.col("n") == 1, 50).when(ratio >= 0.8, 90).when(ratio >= 0.5, 70).when(ratio >= 0.3, 50).otherwise(30)
    return records.join(totals, group).select("id", group, score.alias("score"))


def comparables(records: DataFrame, group: str, score: Column, most: int = 3) -> DataFrame:
    """The best `most` records of each group with one an organization; those without an organization don't count."""
    named = records.where(~blank(F.col("organization_name"))).withColumn("__s", score)
    best = named.groupBy(group, "organization_name").agg(F.max(F.struct(F.col("__s"), (-F.col("id")).alias("i"))).alias("b"))
    w = Window.partitionBy(group).orderBy(F.desc("b"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(group, "rank", "organization_name", (-F.col("b.i")).alias("id"), F.col("b.__s").alias("score"))


def provenance_tier() -> Column:
    """gold, silver or bronze by where a record (provenance, n_metrics, with_baseline, with_post, detail) comes from."""
    c = F.col
    sound, outcomes = c("provenance").isin("government_audited", "peer_reviewed", "financial_disclosure"), c("n_metrics") > 0
    customer = c("provenance").isin("customer_documented", "independently_validated")
    extras = ~blank(c("lessons_learned")) | ~blank(c("rollout_strategy"))
    return (
        F.when(sound & outcomes & c("with_baseline") & c("with_post"), "gold")
        .when(sound, F.when(outcomes, "silver").otherwise("bronze"))
        .when(customer, F.when(outcomes | (c("detail") >= 6), "silver").otherwise("bronze"))
        .when(c("provenance") == "vendor_documented", F.when((c("detail") >= 7) | ((c("detail") >= 5) & extras), "silver").otherwise("bronze"))
        .otherwise("bronze")
    )


def change_fields(metrics: DataFrame) -> DataFrame:
    """Metrics with the change in percent from baseline to post value where it isn't given, and its direction."""
    derived = half_up((F.col("post_value") - F.col("baseline_value")) / F.col("baseline_value") * 100, 4)
    pct = F.coalesce(F.col("percentage_change").cast("double"), F.when(F.col("baseline_value") != 0, derived))
    return metrics.withColumn("pct", pct).withColumn("direction", F.when(pct > 0, "up").when(pct < 0, "down").when(pct == 0, "flat"))
