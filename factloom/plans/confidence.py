"""Queries about confidence, strength and peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.rules import half_up
from factloom.operators import confidence as C
from factloom.plans.catalog import query
from factloom.plans.coverage import _R, _TIERED, tiered
from factloom.sources.tables import metrics, records, table

_INPUTS = """SELECT workflow, count(*) AS total, count(*) FILTER (tier = 'gold') AS gold, count(*) FILTER (n_metrics > 0) AS outcomes, count(*) FILTER (with_baseline AND with_post) AS measured, count(*) FILTER (independently_verified) AS independent, count(*) FILTER (vendor_reported) AS vendor,
  count(*) FILTER (CAST(rollout_strategy <> '' AS INT) + CAST(success_criteria <> '' AS INT) + CAST(lessons_learned <> '' AS INT) + CAST(implementation_pattern <> '' AS INT) >= 2) AS rich, count(*) FILTER (result_status IN ('failed', 'abandoned')) AS negative, count(DISTINCT nullif(organization_name, '')) AS organizations FROM tiered GROUP BY workflow"""
_D = "::DOUBLE"
_CONF = f"""least(100.0{_D}, CASE WHEN measured >= 10 THEN 90.0{_D} + least(10, measured - 10) WHEN measured >= 5 THEN 70.0{_D} + (measured - 5) * 4 WHEN measured >= 3 THEN 50.0{_D} + (measured - 3) * 10 WHEN measured >= 1 THEN 25{_D} + (measured - 1) * 12.5{_D} WHEN outcomes >= 3 THEN 20.0{_D} WHEN outcomes >= 1 THEN 10.0{_D} ELSE 0.0{_D} END) * 0.3{_D}
  + greatest(0.0{_D}, least(100.0{_D}, least(50.0{_D}, gold / total * 80) + least(30.0{_D}, independent / total * 50) - least(20.0{_D}, vendor / total * 30))) * 0.25{_D} + CASE WHEN rich >= 5 THEN 90.0{_D} WHEN rich >= 3 THEN 70.0{_D} WHEN rich >= 1 THEN 40.0{_D} ELSE 0.0{_D} END * 0.2{_D}
  + CASE WHEN negative / total > 0.3 THEN greatest(0.0{_D}, 80 - negative / total * 80) WHEN negative / total > 0.1 THEN 85.0{_D} ELSE 100.0{_D} END * 0.15{_D} + least(100.0{_D}, organizations * 10.0{_D}) * 0.1{_D}"""


@query(f"WITH {_TIERED}, i AS ({_INPUTS}), s AS (SELECT workflow, total, measured, {_R(f'greatest(0.0{_D}, least(100.0{_D}, {_CONF}))', 1)} AS score FROM i) SELECT *, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 45 THEN 'moderate' WHEN score >= 20 THEN 'limited' ELSE 'insufficient' END AS label FROM s")
def package_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in the evidence on each workflow."""
    i = C.package_inputs(tiered(spark, sf_dir), "workflow")
    return i.select("workflow", "total", "measured", *(c.alias(n) for n, c in C.confidence().items()))


@query(f"""WITH {_TIERED} SELECT id, greatest(0, least(100, 50 + CASE WHEN independently_verified THEN 15 ELSE 0 END + CASE WHEN coalesce(sample_size, 0) > 1 THEN 10 ELSE 0 END + least(15, n_numeric * 5) - CASE WHEN vendor_reported THEN 10 ELSE 0 END
  + CASE WHEN result_status IN ('successful', 'partial') THEN 10 WHEN result_status IN ('failed', 'abandoned') THEN -10 ELSE 0 END)) AS score FROM tiered""")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of each record as a candidate."""
    return tiered(spark, sf_dir).select("id", C.candidate_score().alias("score"))


@query("""WITH r AS (SELECT id, workflow, CAST(result_status IN ('successful', 'partial') AS INT) AS g FROM records), t AS (SELECT *, sum(g) OVER (PARTITION BY workflow) - g AS good, count(*) OVER (PARTITION BY workflow) - 1 AS n FROM r)
  SELECT id, workflow, CASE WHEN n = 0 THEN 50 WHEN good / n >= 0.8 THEN 90 WHEN good / n >= 0.5 THEN 70 WHEN good / n >= 0.3 THEN 50 ELSE 30 END AS score FROM t""")
def peer_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the other records of a workflow went."""
    return C.peer_consistency(records(spark, sf_dir).select("id", "workflow", "result_status"), "workflow")


@query(f"""WITH {_TIERED}, s AS (SELECT workflow, organization_name, id, points + CASE WHEN independently_verified THEN 2 ELSE 0 END AS score FROM tiered WHERE trim(organization_name) <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY workflow, organization_name ORDER BY score DESC, id) AS k FROM s),
  r AS (SELECT workflow, organization_name, id, score, row_number() OVER (PARTITION BY workflow ORDER BY score DESC, id) AS rank FROM o WHERE k = 1) SELECT * FROM r WHERE rank <= 3""")
def comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest records of each workflow, one an organization."""
    return C.comparables(tiered(spark, sf_dir), "workflow", F.col("points") + F.when(F.col("independently_verified"), 2).otherwise(0))


_PROV = "CASE id % 7 WHEN 0 THEN 'government_audited' WHEN 1 THEN 'peer_reviewed' WHEN 2 THEN 'customer_documented' WHEN 3 THEN 'independently_validated' WHEN 4 THEN 'vendor_documented' ELSE 'unknown' END"


@query(f"""WITH {_TIERED}, p AS (SELECT *, {_PROV} AS provenance, id % 11 AS detail FROM tiered), c AS (SELECT provenance, CASE WHEN provenance IN ('government_audited', 'peer_reviewed') THEN CASE WHEN n_metrics > 0 AND with_baseline AND with_post THEN 'gold' WHEN n_metrics > 0 THEN 'silver' ELSE 'bronze' END
  WHEN provenance IN ('customer_documented', 'independently_validated') THEN CASE WHEN n_metrics > 0 OR detail >= 6 THEN 'silver' ELSE 'bronze' END WHEN provenance = 'vendor_documented' THEN CASE WHEN detail >= 7 OR (detail >= 5 AND (lessons_learned <> '' OR rollout_strategy <> '')) THEN 'silver' ELSE 'bronze' END ELSE 'bronze' END AS tier FROM p)
  SELECT provenance, tier, count(*) AS n FROM c GROUP BY 1, 2""")
def provenance_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by where records come from."""
    p = tiered(spark, sf_dir).withColumn("provenance", F.expr(_PROV)).withColumn("detail", F.col("id") % 11)
    return p.groupBy("provenance", C.provenance_tier().alias("tier")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT *, coalesce(percentage_change::DOUBLE, CASE WHEN baseline_value <> 0 THEN {_R('(post_value - baseline_value) / baseline_value * 100', 4)} END) AS pct FROM metrics)
  SELECT metric_name, CASE WHEN pct > 0 THEN 'up' WHEN pct < 0 THEN 'down' WHEN pct = 0 THEN 'flat' END AS direction, count(*) AS n, min(pct) AS low, max(pct) AS high FROM p GROUP BY 1, 2""")
def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by direction, changes being worked out from baselines where they aren't given."""
    return C.change_fields(metrics(spark, sf_dir)).groupBy("metric_name", "direction").agg(F.count("*").alias("n"), F.min("pct").alias("low"), F.max("pct").alias("high"))


@query(f"""WITH {_TIERED}, f AS (SELECT unnest([CASE WHEN rollout_strategy <> '' THEN 'rollout' END, CASE WHEN success_criteria <> '' THEN 'criteria' END, CASE WHEN lessons_learned <> '' THEN 'lessons' END, CASE WHEN implementation_pattern <> '' THEN 'pattern' END]) AS family FROM tiered), v AS (SELECT family, count(*) AS votes FROM f WHERE family IS NOT NULL GROUP BY 1)
  SELECT family, votes, row_number() OVER (ORDER BY votes DESC, family) AS rank FROM v""")
def family_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of detail is there, ranked; the ranks are given over one row a kind."""
    from pyspark.sql import Window

    f = {"rollout_strategy": "rollout", "success_criteria": "criteria", "lessons_learned": "lessons", "implementation_pattern": "pattern"}
    one = records(spark, sf_dir).agg(*(F.count_if(F.col(c) != "").alias(n) for c, n in f.items()))
    v = one.unpivot([], list(f.values()), "family", "votes").where("votes > 0")
    return v.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("votes"), "family")))


@query(f"""WITH i AS (SELECT workflow, count(*) AS n, {', '.join(f"count(*) FILTER ({c}) AS {a}" for c, a in (("rollout_strategy <> ''", 'a'), ("success_criteria <> ''", 'b'), ("lessons_learned <> ''", 'c'), ("has_baseline", 'd'), ("measurement_period IS NOT NULL", 'e')))} FROM records WHERE workflow <> '' GROUP BY 1),
  r AS (SELECT workflow, n, (a + b + c + d + e) / (5 * n) AS richness, CAST(a >= n * 0.3 AS INT) + CAST(b >= n * 0.3 AS INT) + CAST(c >= n * 0.3 AS INT) + CAST(d >= n * 0.3 AS INT) + CAST(e >= n * 0.3 AS INT) AS flags FROM i) SELECT workflow, n, {_R('richness', 4)} AS richness, flags, flags >= 3 AND n >= 2 AND richness >= 0.15 AS production FROM r""")
def implementation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fully implementations of each workflow are described, and whether that is enough."""
    has = [F.col("rollout_strategy") != "", F.col("success_criteria") != "", F.col("lessons_learned") != "", F.col("has_baseline"), F.col("measurement_period").isNotNull()]
    i = records(spark, sf_dir).where("workflow <> ''").groupBy("workflow").agg(F.count("*").alias("n"), *(F.count_if(h).alias(f"h{k}") for k, h in enumerate(has)))
    total, flags = sum((F.col(f"h{k}") for k in range(5)), F.lit(0)), sum(((F.col(f"h{k}") >= F.col("n") * 0.3).cast("int") for k in range(5)), F.lit(0))
    richness = total / (5 * F.col("n"))
    return i.select("workflow", "n", half_up(richness, 4).alias("richness"), flags.alias("flags"), ((flags >= 3) & (F.col("n") >= 2) & (richness >= 0.15)).alias("production"))


@query("""WITH v AS (SELECT user_id AS plan, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events WHERE event_type IN ('click', 'purchase')) SELECT plan, version, event_id, event_type AS change, next IS NULL AS current FROM v""")
def plan_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of plans as versions, the last of which holds."""
    from pyspark.sql import Window

    w = Window.partitionBy("plan").orderBy("event_id")
    v = table(spark, sf_dir, "events", "user_id", "event_id", "event_type").where(F.col("event_type").isin("click", "purchase")).select(F.col("user_id").alias("plan"), "event_id", F.col("event_type").alias("change"))
    return v.select("plan", F.row_number().over(w).alias("version"), "event_id", "change", F.lead("event_id").over(w).isNull().alias("current"))


@query(f"""WITH s AS (SELECT id, workflow, CASE WHEN independently_verified THEN 20 ELSE 0 END + CASE WHEN source_url <> '' THEN 20 ELSE 0 END + CASE WHEN has_baseline THEN 20 ELSE 0 END + CASE WHEN sample_size > 1 THEN 20 ELSE 0 END + CASE WHEN measurement_period IS NOT NULL THEN 20 ELSE 0 END AS q FROM records)
  SELECT workflow, q >= 70 AS approved, count(*) AS n, {_R('avg(q)', 2)} AS quality FROM s GROUP BY 1, 2""")
def ingest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that would be let in by themselves."""
    c = F.col
    q = sum((F.when(F.coalesce(x, F.lit(False)), 20).otherwise(0) for x in (c("independently_verified"), c("source_url") != "", c("has_baseline"), c("sample_size") > 1, c("measurement_period").isNotNull())), F.lit(0))
    return records(spark, sf_dir).withColumn("q", q).groupBy("workflow", (c("q") >= 70).alias("approved")).agg(F.count("*").alias("n"), half_up(F.avg("q"), 2).alias("quality"))
