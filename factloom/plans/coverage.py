"""Queries about coverage, quality and gaps of the evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.rules import blank, half_up
from factloom.operators import coverage as C
from factloom.operators import spans as S
from factloom.operators.incremental import GapReport
from factloom.plans.catalog import query
from factloom.sources.tables import metrics, records, saved, shared_root, table

#: How much is asked about a workflow; others 0.4.
DEMAND = {"invoice_processing": 0.9, "customer_support": 1.0, "fraud_detection": 0.8, "recruiting": 0.5, "code_review": 0.7}

_R = lambda x, n: f"floor(({x}) * {10**n} + 0.5) / {10**n}"
_SUMMARY = """SELECT record_id, count(*) AS n_metrics, count(*) FILTER (percentage_change IS NOT NULL OR absolute_change IS NOT NULL) AS n_numeric, bool_or(percentage_change IS NOT NULL OR coalesce(absolute_change, 0) <> 0) AS quantified,
  bool_or(baseline_value IS NOT NULL) AS with_baseline, bool_or(post_value IS NOT NULL) AS with_post, bool_or(percentage_change IS NOT NULL) AS with_percent, bool_or(absolute_change IS NOT NULL) AS with_absolute,
  bool_or(coalesce(regexp_matches(lower(time_period), 'month|year|quarter'), false)) AS sustained, bool_or(coalesce(percentage_change, 0) <> 0 OR coalesce(absolute_change, 0) <> 0) AS positive FROM metrics GROUP BY record_id"""
_ALL = """SELECT r.*, coalesce(n_metrics, 0) AS n_metrics, coalesce(n_numeric, 0) AS n_numeric, coalesce(quantified, false) AS quantified, coalesce(with_baseline, false) AS with_baseline, coalesce(with_post, false) AS with_post,
  coalesce(with_percent, false) AS with_percent, coalesce(with_absolute, false) AS with_absolute, coalesce(sustained, false) AS sustained, coalesce(positive, false) AS positive FROM records r LEFT JOIN summary s ON r.id = s.record_id"""
_POINTS = """(CASE WHEN trim(organization_name) <> '' THEN 2 ELSE 0 END + CASE WHEN result_status NOT IN ('unknown', 'theoretical', 'proposed') THEN 2 ELSE 0 END + CASE WHEN quantified THEN 2 ELSE 0 END + CASE WHEN source_url <> '' THEN 1 ELSE 0 END
  + CASE WHEN has_baseline THEN 1 ELSE 0 END + CASE WHEN coalesce(measurement_period, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(sample_size, 0) > 1 THEN 1 ELSE 0 END + CASE WHEN independently_verified THEN 2 ELSE 0 END - CASE WHEN vendor_reported THEN 2 ELSE 0 END)"""
_ACADEMIC = " OR ".join(f"contains(lower(organization_name), '{w}')" for w in C.ACADEMIC)
_TIER = f"CASE WHEN trim(organization_name) = '' OR (({_ACADEMIC}) AND NOT independently_verified) THEN 'rejected' WHEN points >= 8 THEN 'gold' WHEN quantified AND richness = 'rich' THEN 'decision_grade' WHEN points >= 1 THEN 'supporting' ELSE 'rejected' END"
_TIERED = f"summary AS ({_SUMMARY}), full_ AS ({_ALL}), pointed AS (SELECT *, {_POINTS} AS points FROM full_), tiered AS (SELECT *, {_TIER} AS tier FROM pointed)"


def _label(none: str = "absent") -> str:
    return f"CASE WHEN high = 0 THEN '{none}' WHEN high >= 25 AND high / total >= 0.25 THEN 'excellent' WHEN high >= 10 OR high / total >= 0.5 THEN 'good' WHEN high >= 4 OR high / total >= 0.1 THEN 'developing' ELSE 'limited' END"


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with metric summary, points and tier."""
    return C.with_metrics(records(spark, sf_dir), metrics(spark, sf_dir)).withColumn("points", C.gold_points()).withColumn("tier", C.tier())


@query(f"WITH {_TIERED} SELECT id, points, tier FROM tiered")
def evidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and tier of each record."""
    return tiered(spark, sf_dir).select("id", "points", "tier")


@query("SELECT count(*) AS total, count(*) FILTER (publication_status = 'published') AS published, count(*) FILTER (publication_status = 'staging') AS staging, count(*) FILTER (publication_status = 'quarantined') AS quarantined, count(*) FILTER (publication_status = 'rejected') AS rejected, count(DISTINCT organization_name) FILTER (organization_name <> '') AS organizations FROM records")
def governance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by publication status, and organizations."""
    r = records(spark, sf_dir)
    return r.agg(F.count("*").alias("total"), *(F.count_if(F.col("publication_status") == s).alias(s) for s in ("published", "staging", "quarantined", "rejected")), F.count_distinct(F.nullif("organization_name", F.lit(""))).alias("organizations"))


@query(f"""WITH {_TIERED}, g AS (SELECT coalesce(nullif(business_function, ''), 'uncategorized') AS business_function, coalesce(nullif(workflow, ''), 'uncategorized') AS workflow, tier FROM tiered WHERE publication_status = 'published'),
  c AS (SELECT business_function, workflow, count(*) AS total, count(*) FILTER (tier IN ('gold', 'decision_grade')) AS high FROM g GROUP BY GROUPING SETS ((business_function), (workflow)))
  SELECT business_function, workflow, total, high, {_label('limited')} AS coverage FROM c""")
def decision_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by function and by workflow, both from one scan."""
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("uncategorized"))
    r = tiered(spark, sf_dir).where("publication_status = 'published'").select(named("business_function").alias("business_function"), named("workflow").alias("workflow"), "tier")
    g = r.groupingSets([["business_function"], ["workflow"]], "business_function", "workflow").agg(F.count("*").alias("total"), F.count_if(F.col("tier").isin(*C.HIGH_TIERS)).alias("high"))
    return g.withColumn("coverage", C.coverage_level(F.col("high"), F.col("high") / F.col("total"), "limited"))


_DEMAND_SQL = "CASE workflow " + " ".join(f"WHEN '{w}' THEN {d}" for w, d in DEMAND.items()) + " ELSE 0.4 END"
_COV = ", ".join(f"count(*) FILTER (trim({f}) <> '') / count(*) AS cov_{f}" for f in C.FIELDS)
_GAP_PARTS = ["least(1.0::DOUBLE, (5 - total) / 5.0::DOUBLE)", "least(1.0::DOUBLE, (1 - gold) / 1.0::DOUBLE)", "least(1.0::DOUBLE, (3 - decision_grade) / 3.0::DOUBLE)", *(f"greatest(0.0::DOUBLE, (0.5::DOUBLE - cov_{f}) / 0.5::DOUBLE)" for f in C.FIELDS)]
_GAPS = f"""{_TIERED}, by_ AS (SELECT workflow, business_function, count(*) AS total, count(*) FILTER (tier = 'gold') AS gold, count(*) FILTER (tier = 'decision_grade') AS decision_grade, {_COV} FROM tiered WHERE publication_status = 'published' AND workflow <> '' GROUP BY workflow, business_function),
  raw_ AS (SELECT *, gold + decision_grade AS high, ({' + '.join(_GAP_PARTS)}) / 7.0::DOUBLE AS raw, ({_DEMAND_SQL})::DOUBLE AS demand FROM by_),
  gaps AS (SELECT workflow, business_function, total, gold, decision_grade, greatest(0, 5 - total) + greatest(0, 1 - gold) + greatest(0, 3 - decision_grade) AS needed, {_label()} AS coverage,
  concat_ws(',', {', '.join(f"CASE WHEN cov_{f} < 0.5 THEN '{f}' END" for f in C.FIELDS)}) AS missing, demand, {_R('raw', 3)} AS gap, {_R('raw * demand', 3)} AS impact FROM raw_)"""


def _demand() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in DEMAND.items() for x in kv)), F.col("workflow")), F.lit(0.4))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gaps(tiered(spark, sf_dir).where("publication_status = 'published' AND workflow <> ''"), _demand())


@query(f"WITH {_GAPS} SELECT * FROM gaps")
def gap_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Need for evidence by workflow and function."""
    return _gaps(spark, sf_dir)


@query(f"WITH {_GAPS} SELECT * FROM gaps")
def gap_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, kept up to date from changes: a load with a third of the records out of date, their present state, and late old changes that no longer count."""
    columns = ["id", "workflow", "business_function", "publication_status", "tier", *C.FIELDS]
    now = saved(tiered(spark, sf_dir).select(*columns, F.lit(2).cast("long").alias("seq")))
    stale = lambda rows, seq: rows.withColumns({"tier": F.lit("gold"), "workflow": F.lit("code_review"), "lessons_learned": F.lit("early"), "seq": F.lit(seq).cast("long")})
    third = F.col("id") % 3 == 0
    report = GapReport(spark, f"{shared_root(spark)}/gaps-{uuid.uuid4().hex}")
    for number, changes in enumerate((now.where(~third).unionByName(stale(now.where(third), 1)), now.where(third), stale(now.where(F.col("id") % 6 == 0), 0), now.where(third))):
        report.apply(changes, number)
    return report.report(_demand())


@query(f"""WITH {_GAPS} SELECT business_function, count(*) AS categories, count(*) FILTER (coverage IN ('good', 'excellent')) AS good_plus, {_R("100 * coalesce(sum(greatest(CAST(floor(demand * 100 + 0.5) AS BIGINT), 1)) FILTER (coverage IN ('good', 'excellent')), 0) / sum(greatest(CAST(floor(demand * 100 + 0.5) AS BIGINT), 1))", 1)} AS coverage_pct FROM gaps GROUP BY business_function""")
def decision_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each function's demand that is well covered; demand is summed in whole hundredths."""
    good, weight = F.col("coverage").isin("good", "excellent"), F.greatest(F.floor(F.col("demand") * 100 + 0.5).cast("long"), F.lit(1))
    pct = half_up(100 * F.sum(F.when(good, weight).otherwise(0)) / F.sum(weight), 1)
    return _gaps(spark, sf_dir).groupBy("business_function").agg(F.count("*").alias("categories"), F.count_if(good).alias("good_plus"), pct.alias("coverage_pct"))


@query(f"""WITH p AS (SELECT n.n_name AS region_name, s.s_suppkey AS vendor, l.l_orderkey AS ord FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey),
  c AS (SELECT region_name, vendor, count(*) AS n, min(ord) AS first_ FROM p GROUP BY 1, 2), t AS (SELECT region_name, count(*) AS values, arg_max(vendor, n * 1000000000000 - first_) AS top, max(n) AS top_n, sum(n) AS total FROM c GROUP BY 1)
  SELECT region_name, values, top, {_R('top_n / total', 3)} AS share, total >= 5 AND {_R('top_n / total', 3)} > 0.6 AS concentrated FROM t""")
def diversity_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each nation's lines come from one supplier."""
    l, s, n = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey"), table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    pairs = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("region_name"), F.col("l_suppkey").alias("vendor"), F.col("l_orderkey").alias("ord"))
    return C.concentration(pairs, "region_name", "vendor", "ord")


@query("""WITH p AS (SELECT DISTINCT geography, workflow FROM records WHERE id % 37 < 3), n AS (SELECT workflow, count(*) AS n FROM records WHERE id % 37 < 3 GROUP BY 1 ORDER BY n DESC, workflow LIMIT 50),
  a AS (SELECT g.geography, n.workflow, row_number() OVER (PARTITION BY g.geography ORDER BY n.n DESC, n.workflow) AS k FROM (SELECT DISTINCT geography FROM p) g CROSS JOIN n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.geography = g.geography AND p.workflow = n.workflow))
  SELECT g.geography, coalesce(string_agg(a.workflow, ',' ORDER BY k) FILTER (k <= 3), '') AS absent FROM (SELECT DISTINCT geography FROM p) g LEFT JOIN a USING (geography) GROUP BY 1""".replace(" WHERE id % 37 < 3", ""))
def top_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest workflows that a geography lacks."""
    return C.top_absent(records(spark, sf_dir).select("geography", "workflow"), "geography", "workflow")


@query(f"""WITH v AS (SELECT p_type AS kind, l_quantity * (l_discount + 0.01) AS v FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM v),
  q AS (SELECT *, max(CASE WHEN k = n // 4 THEN v END) OVER (PARTITION BY kind) AS q1, max(CASE WHEN k = 3 * n // 4 THEN v END) OVER (PARTITION BY kind) AS q3 FROM r)
  SELECT kind, {_R('min(v)', 1)} AS low, {_R('median(v)', 1)} AS median, {_R('max(v)', 1)} AS high, max(n) AS sample_size, CASE WHEN max(n) >= 6 THEN 'median_iqr' WHEN max(n) = 1 THEN 'single_value' ELSE 'median_minmax' END AS method
  FROM q WHERE n < 6 OR v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY kind""")
def outcome_ranges_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of discounted quantity by kind of part, without outliers."""
    l, p = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_discount"), table(spark, sf_dir, "part", "p_partkey", "p_type")
    values = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("kind"), (F.col("l_quantity") * (F.col("l_discount") + 0.01)).alias("v"))
    return C.outcome_ranges(values, "kind", "v")


@query("SELECT metric_category, min(percentage_change) AS low, median(percentage_change) AS median, max(percentage_change) AS high, count(*) AS n FROM metrics WHERE percentage_change > 0 AND percentage_change <= 150 GROUP BY 1")
def improvement_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of improvements by category."""
    m = metrics(spark, sf_dir).where("percentage_change > 0 AND percentage_change <= 150")
    return m.groupBy("metric_category").agg(F.min("percentage_change").alias("low"), F.median("percentage_change").alias("median"), F.max("percentage_change").alias("high"), F.count("*").alias("n"))


@query(f"WITH c AS (SELECT event_type AS topic, count(*) AS n FROM events WHERE value >= 0.5 GROUP BY 1) SELECT topic, n, {_R('n / max(n) OVER ()', 3)} AS demand FROM c")
def demand_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand by topic, from 0 to 1. The maximum is taken over one row a topic."""
    c = table(spark, sf_dir, "events", "event_type", "value").where("value >= 0.5").groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("n"))
    return c.select("topic", "n", half_up(F.col("n") / c.agg(F.max("n")).scalar(), 3).alias("demand"))


@query(f"""WITH {_TIERED} SELECT business_function, count(*) AS records, count(*) FILTER (tier = 'gold') AS gold, count(*) FILTER (tier = 'decision_grade') AS decision_grade, count(*) FILTER (tier = 'supporting') AS supporting, count(*) FILTER (tier = 'rejected') AS rejected FROM tiered GROUP BY 1""")
def source_tier_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by business function."""
    t = tiered(spark, sf_dir).groupBy("business_function").pivot("tier", ["gold", "decision_grade", "supporting", "rejected"]).agg(F.count(F.lit(1))).fillna(0)
    return t.withColumn("records", F.col("gold") + F.col("decision_grade") + F.col("supporting") + F.col("rejected"))


@query(f"""WITH {_TIERED} SELECT count(*) AS records, count(*) FILTER (tier = 'gold') AS gold, count(DISTINCT nullif(organization_name, '')) AS organizations, count(DISTINCT industry) AS industries, count(DISTINCT nullif(workflow, '')) AS workflows,
  sum(n_metrics) AS metrics, {_R('100 * count(*) FILTER (has_baseline) / count(*)', 1)} AS baseline_pct, {_R('100 * count(*) FILTER (n_numeric > 0) / count(*)', 1)} AS measured_pct FROM tiered WHERE publication_status = 'published'""")
def quality_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures of the published library."""
    t = tiered(spark, sf_dir).where("publication_status = 'published'")
    pct = lambda c: half_up(100 * F.count_if(c) / F.count("*"), 1)
    return t.agg(
        F.count("*").alias("records"), F.count_if(F.col("tier") == "gold").alias("gold"), F.count_distinct(F.nullif("organization_name", F.lit(""))).alias("organizations"), F.count_distinct("industry").alias("industries"),
        F.count_distinct(F.nullif("workflow", F.lit(""))).alias("workflows"), F.sum("n_metrics").alias("metrics"), pct(F.col("has_baseline")).alias("baseline_pct"), pct(F.col("n_numeric") > 0).alias("measured_pct"),
    )


_FILLED = ["organization_name", "employee_count", "workflow", "business_function", "sample_size", "measurement_period", "source_url", *C.FIELDS]


@query(f"SELECT field, sum(CAST(filled AS INT)) AS n, {_R('100 * sum(CAST(filled AS INT)) / count(*)', 1)} AS pct FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce(CAST({f} AS VARCHAR), '') <> '' AS filled FROM records" for f in _FILLED) + ") GROUP BY field")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field is filled: one wide aggregate, turned on its side."""
    one = records(spark, sf_dir).agg(F.count("*").alias("all"), *(F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f) for f in _FILLED))
    return one.unpivot(["all"], _FILLED, "field", "n").select("field", "n", half_up(100 * F.col("n") / F.col("all"), 1).alias("pct"))


@query(f"""WITH {_TIERED}, d AS (SELECT *, (CASE WHEN trim(organization_name) <> '' THEN 1 ELSE 0 END + CASE WHEN employee_count IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN has_baseline THEN 1 ELSE 0 END + CASE WHEN measurement_period IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN sample_size IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN n_metrics > 0 THEN 1 ELSE 0 END) AS have FROM tiered) SELECT have, count(*) AS n, have / 6 >= 0.9 AS complete FROM d GROUP BY have""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by how many of six dimensions they have."""
    dims = [~blank(F.col("organization_name")), F.col("employee_count").isNotNull(), F.col("has_baseline"), F.col("measurement_period").isNotNull(), F.col("sample_size").isNotNull(), F.col("n_metrics") > 0]
    have = sum((F.when(d, 1).otherwise(0) for d in dims), F.lit(0))
    return tiered(spark, sf_dir).groupBy(have.alias("have")).agg(F.count("*").alias("n")).withColumn("complete", F.col("have") / 6 >= 0.9)


_REASON = "CASE WHEN trim(organization_name) = '' THEN 'no_organization' WHEN NOT quantified THEN 'no_quantified_outcome' WHEN NOT has_baseline THEN 'no_baseline' WHEN measurement_period IS NULL THEN 'no_timeframe' ELSE 'thin_implementation' END"


@query(f"WITH {_TIERED}, b AS (SELECT id, {_REASON} AS reason FROM tiered WHERE tier IN ('supporting', 'rejected')), k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY id) AS k FROM b) SELECT reason, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (k <= 5) AS examples FROM k GROUP BY reason")
def bronze_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why records fall short, with five examples each."""
    reason = F.when(blank(F.col("organization_name")), "no_organization").when(~F.col("quantified"), "no_quantified_outcome").when(~F.col("has_baseline"), "no_baseline").when(F.col("measurement_period").isNull(), "no_timeframe").otherwise("thin_implementation")
    b = tiered(spark, sf_dir).where(F.col("tier").isin("supporting", "rejected")).select("id", reason.alias("reason"))
    # The five smallest ids of each of at most 200 parts are enough, so no reason's ids meet in one row.
    part = b.groupBy("reason", F.pmod(F.xxhash64("id"), F.lit(200)).alias("part")).agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("id")), 1, 5).alias("ids"))
    return part.groupBy("reason").agg(F.sum("n").alias("n"), F.array_join(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, 5), ",").alias("examples"))


@query(f"""WITH {_TIERED} SELECT tier, count(*) AS n, count(*) FILTER (regexp_matches(source_url, '^https?://')) AS promotable, {_R("100 * count(*) FILTER (regexp_matches(source_url, '^https?://')) / count(*)", 1)} AS pct FROM tiered GROUP BY tier""")
def promotion_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by tier that have a source to go back to."""
    ok = F.rlike("source_url", F.lit("^https?://"))
    return tiered(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.count_if(ok).alias("promotable"), half_up(100 * F.count_if(ok) / F.count("*"), 1).alias("pct"))


@query(f"""WITH {_TIERED}, x AS (SELECT tier AS after_, CASE WHEN points >= 8 THEN 'gold' WHEN points >= 4 THEN 'decision_grade' WHEN points >= 1 THEN 'supporting' ELSE 'rejected' END AS before_ FROM tiered)
  SELECT before_ AS before, after_ AS after, count(*) AS n, bool_or(before_ <> after_) AS changed FROM x GROUP BY 1, 2""")
def tier_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by points alone against tiers by all rules."""
    before = F.when(F.col("points") >= 8, "gold").when(F.col("points") >= 4, "decision_grade").when(F.col("points") >= 1, "supporting").otherwise("rejected")
    t = tiered(spark, sf_dir).groupBy(before.alias("before"), F.col("tier").alias("after")).agg(F.count("*").alias("n"))
    return t.withColumn("changed", F.col("before") != F.col("after"))


@query(f"SELECT event_type AS source_type, count(*) AS attempts, count(*) FILTER (value >= 50) AS accepted, {_R('count(*) FILTER (value < 50) / count(*)', 4)} AS rejection_rate, {_R('count(*) * 0.78 / nullif(count(*) FILTER (value >= 50), 0)', 4)} AS cost_per_accepted FROM events GROUP BY 1")
def unit_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance and cost of attempts by source type."""
    ok = F.count_if(F.col("value") >= 50)
    return table(spark, sf_dir, "events", "event_type", "value").groupBy(F.col("event_type").alias("source_type")).agg(
        F.count("*").alias("attempts"), ok.alias("accepted"), half_up(F.count_if(F.col("value") < 50) / F.count("*"), 4).alias("rejection_rate"), half_up(F.try_divide(F.count("*") * F.lit(0.78), ok), 4).alias("cost_per_accepted"),
    )


@query("""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, max(value) FILTER (k = CAST(floor(n * 0.5::DOUBLE) AS BIGINT)) AS p50, max(value) FILTER (k = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95, max(value) FILTER (k = CAST(floor(n * 0.99::DOUBLE) AS BIGINT)) AS p99 FROM e GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at the positions n/2, 0.95 n and 0.99 n, by type."""
    e = C.positions(table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value")
    return e.groupBy("event_type").agg(*(C.at_position("value", F.floor(F.col("n") * p)).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)))


@query(f"""WITH m AS (SELECT d.doc_id, l.quality = 1 AS want, length(d.text) > 300 AS got FROM documents d JOIN labels l USING (doc_id)), s AS (SELECT count(*) FILTER (want AND got) AS tp, count(*) FILTER (got) AS p, count(*) FILTER (want) AS w FROM m)
  SELECT tp, {_R('coalesce(tp / nullif(p, 0), 1.0)', 4)} AS precision, {_R('coalesce(tp / nullif(w, 0), 1.0)', 4)} AS recall, {_R('coalesce(2 * tp / nullif(p + w, 0), 1.0)', 4)} AS f1 FROM s""")
def gold_set_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a length rule against the labels."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", (F.length("text") > 300).alias("got"))
    m = d.join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id").withColumn("want", F.col("quality") == 1)
    s = m.agg(F.count_if(F.col("want") & F.col("got")).alias("tp"), F.count_if("got").alias("p"), F.count_if("want").alias("w"))
    share = lambda a, b: half_up(F.coalesce(F.try_divide(a, b), F.lit(1.0)), 4)
    return s.select("tp", share(F.col("tp"), F.col("p")).alias("precision"), share(F.col("tp"), F.col("w")).alias("recall"), share(2 * F.col("tp"), F.col("p") + F.col("w")).alias("f1"))


@query(f"SELECT industry, {_R('100 * count(*) FILTER (result_status = ' + chr(39) + 'successful' + chr(39) + ') / count(*)', 1)} AS progress, count(*) AS n FROM records GROUP BY 1")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of successful records by industry."""
    return records(spark, sf_dir).groupBy("industry").agg(half_up(100 * F.count_if(F.col("result_status") == "successful") / F.count("*"), 1).alias("progress"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type, value FROM events), s AS (SELECT DISTINCT d AS last FROM e),
  j AS (SELECT last, event_type, value, row_number() OVER (PARTITION BY last, event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY last, event_type) AS n
    FROM s JOIN e ON e.d BETWEEN s.last - 6 AND s.last)
  SELECT CAST(last AS VARCHAR) AS week_to, event_type, n, max(value) FILTER (k = CAST(floor(n * 0.5::DOUBLE) AS BIGINT)) AS p50,
    max(value) FILTER (k = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95, max(value) FILTER (k = CAST(floor(n * 0.99::DOUBLE) AS BIGINT)) AS p99
  FROM j GROUP BY ALL""")
def span_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at the positions n/2, 0.95 n and 0.99 n of each week that ends on a day with events, by type."""
    e = table(spark, sf_dir, "events", "ts", "event_type", "value").withColumn("day", F.to_date("ts"))
    days = saved(S.by_day(e, "event_type", "day", "value"))
    ends = days.select("day").distinct()
    weeks = ends.select(F.col("day").cast("string").alias("span"), F.date_sub("day", 6).alias("first"), F.col("day").alias("last"))
    shares = (0.5, 0.95, 0.99)
    found = S.percentiles(e, days, weeks, list(shares), "event_type", "day", "value")
    values = [F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in shares]
    return found.groupBy(F.col("span").alias("week_to"), F.col("key").alias("event_type"), "n").agg(*values)
