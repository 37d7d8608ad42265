"""Queries on gaps, recovered values, plans in progress and campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.rules import half_up
from factloom.operators import promotion as P
from factloom.plans.catalog import query
from factloom.plans.coverage import DEMAND, _R
from factloom.sources.tables import metrics, notes, records, table

_LEVEL = "CASE id % 6 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END"
#: What a category of these tables should have.
TARGETS = {"total": 300, "gold": 40, "silver": 60}
_FIELDS = ["rollout_strategy", "success_criteria", "lessons_learned", "implementation_pattern"]
_SOURCE_SQL = {"rollout_strategy": "['case_study', 'implementation_guide']", "success_criteria": "['case_study', 'report']", "lessons_learned": "['postmortem', 'case_study']", "implementation_pattern": "['implementation_guide', 'whitepaper']"}
_G = f"""g AS (SELECT coalesce(nullif(workflow, ''), 'unknown_workflow') AS workflow, coalesce(nullif(business_function, ''), 'operations') AS business_function, count(*) AS total, count(*) FILTER ({_LEVEL} = 'gold') AS gold, count(*) FILTER ({_LEVEL} = 'silver') AS silver, {', '.join(f"avg(CAST(trim({f}) <> '' AS DOUBLE)) AS {f}" for f in _FIELDS)}
  FROM records WHERE (workflow <> '' OR business_function <> '') GROUP BY 1, 2), s AS (SELECT *, (least(1.0, ({TARGETS['total']} - total) / {TARGETS['total']}) + least(1.0, ({TARGETS['gold']} - gold) / {TARGETS['gold']}) + least(1.0, ({TARGETS['silver']} - silver) / {TARGETS['silver']}) + {' + '.join(f'greatest(0.0, (0.5 - {f}) / 0.5)' for f in _FIELDS)}) / 7 AS gap0,
  CASE workflow {' '.join(f"WHEN '{k}' THEN {v}" for k, v in DEMAND.items())} ELSE 0.4 END AS demand, list_filter([{', '.join(f"CASE WHEN {f} < 0.5 THEN '{f}' END" for f in _FIELDS)}], lambda x: x IS NOT NULL) AS missing FROM g),
  gaps AS (SELECT workflow, business_function, total, gold, silver, {_R('gap0', 4)} AS gap, demand, {_R('gap0 * demand', 4)} AS impact, greatest(0, {TARGETS['total']} - total) + greatest(0, {TARGETS['gold']} - gold) AS need, missing FROM s)"""


def _gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gaps(records(spark, sf_dir).withColumn("level", F.expr(_LEVEL)), DEMAND, TARGETS)


def _join_sources() -> str:
    every = "flatten([" + ", ".join(f"CASE WHEN list_contains(missing, '{f}') THEN {v} ELSE [] END" for f, v in _SOURCE_SQL.items()) + "])"
    return f"array_to_string(list_filter({every}, lambda x, i: list_position({every}, x) = i), ',')"


@query(f"WITH {_G} SELECT workflow, business_function, total, gold, silver, gap, demand, impact, need, array_to_string(missing, ',') AS missing, {_join_sources()} AS sources FROM gaps")
def category_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of categories by the older rule, and the kinds of sources that could fill them."""
    return _gap_rows(spark, sf_dir).withColumns({"missing": F.array_join("missing", ","), "sources": F.array_join("sources", ",")})


@query(f"""WITH {_G}, p AS (SELECT *, sum(need) OVER (ORDER BY impact DESC, workflow, business_function ROWS UNBOUNDED PRECEDING) AS spent FROM gaps WHERE need > 0) SELECT workflow, business_function, CAST(need AS BIGINT) AS need, CAST(spent AS BIGINT) AS spent, {_R('greatest(0.0, 1 - gap)', 3)} AS before FROM p WHERE spent <= 4000""")
def campaign_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a campaign of 4,000 records goes after, and where each category begins."""
    return P.campaigns(_gap_rows(spark, sf_dir), 4000)


@query(f"""WITH {_G} SELECT workflow, business_function, total AS total_records, gold, silver, total - gold - silver AS bronze, gap AS gap_score, need AS estimated_records_needed FROM gaps""")
def gap_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs in the form that planners of the older engine read."""
    c = F.col
    return _gap_rows(spark, sf_dir).select("workflow", "business_function", c("total").alias("total_records"), "gold", "silver", (c("total") - c("gold") - c("silver")).alias("bronze"), c("gap").alias("gap_score"), c("need").alias("estimated_records_needed"))


_TIME = "CASE id % 6 WHEN 0 THEN 'within 1,200 days' WHEN 1 THEN 'late in the quarter' WHEN 2 THEN '18' WHEN 3 THEN 'two years' WHEN 4 THEN '3.5 weeks after' ELSE 'soon' END"


@query(rf"""WITH t AS (SELECT id, {_TIME} AS s FROM records), n AS (SELECT id, TRY_CAST(replace(regexp_extract(s, '(\d[\d,]*\.?\d*)', 1), ',', '') AS DOUBLE) AS n, CASE WHEN contains(s, 'year') THEN 'year' WHEN contains(s, 'quarters') THEN 'quarters' WHEN contains(s, 'quarter') THEN 'quarter' WHEN contains(s, 'month') THEN 'month' WHEN contains(s, 'week') THEN 'week' WHEN contains(s, 'day') THEN 'day' ELSE '' END AS u FROM t)
  SELECT coalesce(n, CASE WHEN u <> '' THEN 1.0 END) AS value, CASE WHEN n IS NOT NULL THEN CASE WHEN u <> '' THEN u ELSE 'months' END WHEN u <> '' THEN u END AS unit, count(*) AS n FROM n GROUP BY ALL""")
def period_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods in words as numbers and units."""
    value, unit = P.timeframe(F.expr(_TIME))
    return records(spark, sf_dir).groupBy(value.alias("value"), unit.alias("unit")).agg(F.count("*").alias("n"))


_STATUS = "CASE id % 4 WHEN 0 THEN ' Deployed' WHEN 1 THEN 'theoretical' WHEN 2 THEN 'live' ELSE 'pilot' END"
_SAMPLE = "CASE id % 3 WHEN 0 THEN 'about 1,500 people' WHEN 1 THEN '1' ELSE '' END"


@query(rf"""WITH r AS (SELECT *, result_status IN ('', 'unknown', 'theoretical', 'proposed') AS no_status, coalesce(measurement_period, 0) = 0 AS no_period, coalesce(sample_size, 0) <= 1 AS no_sample, NOT has_baseline AS no_base, lower(trim({_STATUS})) AS s, TRY_CAST(replace(regexp_extract({_SAMPLE}, '(\d[\d,]*\.?\d*)', 1), ',', '') AS DOUBLE) AS n FROM records)
  SELECT id, CASE WHEN no_status THEN CASE WHEN s IN ('deployed', 'pilot') THEN s WHEN s = 'theoretical' THEN 'proposed' END END AS result_status, CASE WHEN no_period AND id % 5 > 0 THEN id % 5 END AS measurement_period, CASE WHEN no_sample AND n > 1 THEN CAST(n AS BIGINT) END AS sample_size, CASE WHEN no_base AND lessons_learned <> '' THEN true END AS has_baseline FROM r""")
def recovered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second look adds to each record: only what it lacked, and only values that hold."""
    from factloom.operators.records import missing_fields

    found = {"deployment_status": F.expr(_STATUS), "measurement_period": F.col("id") % 5, "sample_size": F.expr(_SAMPLE), "baseline": F.col("lessons_learned")}
    return records(spark, sf_dir).withColumn("missing", missing_fields()).select("id", *(c.alias(n) for n, c in P.recovered(F.col("missing"), found).items()))


@query("""SELECT DISTINCT record_id, metric_name, coalesce(CAST(percentage_change AS DOUBLE), CASE WHEN coalesce(baseline_value, 0) <> 0 AND post_value IS NOT NULL THEN floor(100.0 * (post_value - baseline_value) / baseline_value * 10000 + 0.5) / 10000 END) AS percentage, absolute_change FROM metrics
  WHERE coalesce(percentage_change, 0) <> 0 OR coalesce(absolute_change, 0) <> 0 OR coalesce(baseline_value, 0) <> 0 OR coalesce(post_value, 0) <> 0""")
def promotion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that have a value, once a record."""
    return P.metric_rows(metrics(spark, sf_dir))


def _kw(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(p_name), '{w}')" for w in words) + ")"


@query(f"SELECT CASE WHEN {_kw(['rpa', 'workflow automation', 'automation', 'robotic'])} THEN 'Workflow_Automation' WHEN {_kw(['ai', 'machine learning', 'ml', 'deep learning', 'llm', 'gen ai'])} THEN 'AI' WHEN {_kw(['software', 'platform', 'crm', 'erp', 'system', 'saas'])} THEN 'Software' WHEN {_kw(['process redesign', 'reengineering', 'lean', 'six sigma'])} THEN 'Process_Redesign' WHEN {_kw(['staffing', 'hiring', 'training', 'outsource'])} THEN 'Staffing' ELSE 'Workflow_Automation' END AS family, count(*) AS n FROM (SELECT substr(note, 1, 60) AS p_name FROM notes) GROUP BY 1")
def named_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes' titles by the family their name stands for."""
    return notes(spark, sf_dir).groupBy(P.named_family(F.substring("note", 1, 60)).alias("family")).agg(F.count("*").alias("n"))


_CAT = "CASE id % 6 WHEN 0 THEN ' RPA ' WHEN 1 THEN 'GenAI' WHEN 2 THEN 'lean' WHEN 3 THEN 'ERP' WHEN 4 THEN 'hiring' ELSE 'something else' END"


@query(f"""SELECT CASE id % 6 WHEN 0 THEN 'workflow_automation' WHEN 1 THEN 'ai' WHEN 2 THEN 'process_redesign' WHEN 3 THEN 'software' WHEN 4 THEN 'staffing' ELSE 'something else' END AS category, {_R("avg(CASE WHEN id % 7 > 3 THEN (id % 7) / 10 WHEN filled >= 2 THEN 0.5 WHEN filled = 1 THEN 0.3 WHEN lessons_learned <> '' THEN 0.2 ELSE 0.0 END)", 4)} AS depth, count(*) AS n
  FROM (SELECT *, CAST(rollout_strategy <> '' AS INT) + CAST(implementation_pattern <> '' AS INT) AS filled FROM records) GROUP BY 1""")
def category_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean depth of descriptions by category."""
    filled = (F.col("rollout_strategy") != "").cast("int") + (F.col("implementation_pattern") != "").cast("int")
    depth = P.detail(F.when(F.col("id") % 7 > 3, F.col("id") % 7), filled, F.col("lessons_learned") != "")
    return records(spark, sf_dir).groupBy(P.category(F.expr(_CAT)).alias("category")).agg(half_up(F.avg(depth), 4).alias("depth"), F.count("*").alias("n"))


_PLAN = "SELECT o_custkey AS plan, o_orderpriority AS phase, CAST(substr(o_orderpriority, 1, 1) AS INT) AS phase_order, CASE WHEN o_custkey % 3 = 0 AND substr(o_orderpriority, 1, 1) IN ('2', '4') THEN 'in_progress' ELSE 'planned' END AS phase_status, 'Order ' || o_orderkey AS title, o_orderkey AS item_order, CASE o_orderkey % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'not_started' ELSE 'completed' END AS status FROM orders"


@query(f"""WITH p AS ({_PLAN}), r AS (SELECT *, CASE status WHEN 'blocked' THEN 0 WHEN 'not_started' THEN 1 ELSE 2 END AS k FROM p WHERE phase_status = 'in_progress'), f AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY phase_order, k, item_order) AS n FROM r)
  SELECT a.plan, CASE WHEN f.plan IS NULL THEN 'Start the first phase' WHEN k = 0 THEN 'Resolve blockers in ''' || phase || ''': ' || title WHEN k = 1 THEN 'Begin milestone: ' || title ELSE 'Complete ''' || phase || ''' phase review' END AS action FROM (SELECT DISTINCT plan FROM p) a LEFT JOIN f ON f.plan = a.plan AND f.n = 1""")
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each plan (customer) does next: its orders are milestones, their priorities phases."""
    return P.next_action(spark.sql(_PLAN.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority")))


@query("""WITH b AS (SELECT l_orderkey AS id, bool_and(l_returnflag <> 'R') AS free FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag <> 'N' GROUP BY 1), m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'blocked' WHEN 'O' THEN 'not_started' ELSE 'completed' END AS status FROM orders)
  SELECT CASE WHEN free THEN CASE WHEN status = 'blocked' THEN 'in_progress' ELSE status END WHEN NOT free THEN 'blocked' ELSE status END AS status, count(*) AS n FROM m LEFT JOIN b USING (id) GROUP BY 1""")
def blocked_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestones (orders) by status after their blockers (returned lines) are opened and resolved."""
    status = F.when(F.col("o_orderstatus") == "F", "blocked").when(F.col("o_orderstatus") == "O", "not_started").otherwise("completed")
    m = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    b = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").where("l_linenumber <= 2 AND l_returnflag <> 'N'").select(F.col("l_orderkey").alias("milestone"), (F.col("l_returnflag") != "R").alias("resolved"))
    return P.with_blockers(m, b).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT CAST(custkey % 40 AS INT) AS library, regexp_replace(source_url, '/[0-9]+$', '/' || (id % 50)) AS url, id % 50 < 20 AS seen FROM records WHERE source_url <> ''), k AS (SELECT DISTINCT library, url FROM f WHERE seen) SELECT library, count(*) AS pending FROM (SELECT DISTINCT library, url FROM f) n ANTI JOIN k USING (library, url) GROUP BY library""")
def page_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages still to be read in each library: those found and not yet known, each once."""
    url = F.concat(F.regexp_replace("source_url", "/[0-9]+$", "/"), (F.col("id") % 50).cast("string"))
    f = records(spark, sf_dir).where("source_url <> ''").select((F.col("custkey") % 40).cast("int").alias("library"), url.alias("url"), (F.col("id") % 50 < 20).alias("seen"))
    return P.frontier(f, f.where("seen").distinct()).groupBy("library").agg(F.count("*").alias("pending"))


@query("SELECT id, organization_name, array_to_string(list_filter([nullif(rollout_strategy, ''), nullif(success_criteria, ''), nullif(lessons_learned, '')], lambda x: x IS NOT NULL), '; ') AS findings FROM records WHERE richness = 'rich' ORDER BY id LIMIT 20")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 rich records, for a person to look at."""
    found = F.array_compact(F.array(*(F.nullif(c, F.lit("")) for c in ("rollout_strategy", "success_criteria", "lessons_learned"))))
    return P.review_sample(records(spark, sf_dir).where("richness = 'rich'").select("id", "organization_name", found.alias("findings")), "id", 20, ["findings"])


@query("""WITH p AS (SELECT id, total_price / 600000 AS price, CAST(has_baseline AS INT) * 0.8 AS baseline, CASE WHEN sample_size > 700 THEN 0.8 ELSE 0.1 END AS sample_size FROM records) SELECT id, 'Strongest on ' || CASE WHEN price >= baseline AND price >= sample_size THEN 'price' WHEN baseline >= sample_size THEN 'baseline' ELSE 'sample size' END || ' (' || printf('%.2f', greatest(price, baseline, sample_size)) || ')' AS rationale FROM p""")
def rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence on what each record is strongest in."""
    p = records(spark, sf_dir).select("id", (F.col("total_price") / 600000).alias("price"), (F.col("has_baseline").cast("int") * 0.8).alias("baseline"), F.when(F.col("sample_size") > 700, 0.8).otherwise(0.1).alias("sample_size"))
    return P.rationale(p, ["price", "baseline", "sample_size"]).select("id", "rationale")


@query("SELECT business_function, string_agg(workflow, ',' ORDER BY workflow) AS workflows, count(*) AS n FROM (SELECT DISTINCT business_function, workflow FROM records WHERE workflow <> '' AND business_function <> '') GROUP BY 1")
def problems_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows of each function."""
    r = records(spark, sf_dir).where("workflow <> '' AND business_function <> ''").groupBy("business_function").agg(F.sort_array(F.collect_set("workflow")).alias("w"))
    return r.select("business_function", F.array_join("w", ",").alias("workflows"), F.size("w").cast("bigint").alias("n"))


@query("""WITH s AS (SELECT count(*) AS documents, count(*) FILTER (richness <> 'thin') AS relevant, count(*) FILTER (richness <> 'thin' AND organization_name <> '') AS extracted, count(*) FILTER (richness = 'rich' AND organization_name <> '' AND has_baseline) AS accepted FROM records)
  SELECT documents, relevant, extracted, accepted, floor(accepted / documents * 10000 + 0.5) / 10000 AS yield, floor(accepted / relevant * 10000 + 0.5) / 10000 AS acceptance FROM s""")
def extraction_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From documents to accepted records, with the rates between."""
    c = F.col
    n = records(spark, sf_dir).agg(F.count("*").alias("documents"), F.count_if(c("richness") != "thin").alias("relevant"), F.count_if((c("richness") != "thin") & (c("organization_name") != "")).alias("extracted"), F.count_if((c("richness") == "rich") & (c("organization_name") != "") & c("has_baseline")).alias("accepted"))
    return n.select("*", half_up(F.try_divide(c("accepted"), c("documents")), 4).alias("yield"), half_up(F.try_divide(c("accepted"), c("relevant")), 4).alias("acceptance"))
