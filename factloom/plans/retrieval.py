"""Queries that find records like a profile, and say what they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.rules import families, half_up
from factloom.operators import linking as L
from factloom.operators import ranking as K
from factloom.operators import retrieval as S
from factloom.plans.catalog import query
from factloom.plans.coverage import _R, _TIERED, tiered
from factloom.plans.extraction import _FAMILIES, _T
from factloom.sources.tables import metrics, notes, records, saved, spread, table

PROFILE = {"workflow": "claims processing new system", "employee_count": 800, "size_band": "200-1000", "industry": "building", "category": "software", "subcategory": "training", "outcome": "cost"}
CONTEXT = {"workflow": "invoice_processing", "problem": "manual invoice work with a new system", "business_function": "hr", "industry": "automobile", "subsector": "cars", "size_band": "200-1000", "geography": "united", "regulation": "high", "model": "public"}

_REC = f"""rec AS (SELECT r.id, r.organization_name, r.workflow, r.business_function, r.geography, r.employee_count, r.result_status, [r.industry] AS industries, n.note AS text, {_FAMILIES.replace('(t,', '(translate(lower(n.note), chr(45) || chr(8211), chr(32) || chr(32)),')} AS families, coalesce(m.outcomes, []) AS outcomes,
  CASE r.id % 4 WHEN 0 THEN 'software' WHEN 1 THEN 'ai' WHEN 2 THEN '' ELSE 'staffing' END AS category, CASE WHEN r.id % 3 = 0 THEN 'cars' WHEN r.id % 3 = 1 THEN '' ELSE 'trucks' END AS subsector, CASE WHEN r.industry IN ('automobile', 'household') THEN 'high' ELSE 'low' END AS regulation, CASE r.id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE '' END AS model
  FROM records r JOIN notes n ON n.id = r.id LEFT JOIN (SELECT record_id, list_distinct(list(metric_category)) AS outcomes FROM metrics GROUP BY 1) m ON m.record_id = r.id)"""


def _rec(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    m = metrics(spark, sf_dir).groupBy(F.col("record_id").alias("id")).agg(F.collect_set("metric_category").alias("outcomes"))
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (F.col("id") % n).cast("int"))
    r = records(spark, sf_dir).where(only).select("id", "organization_name", "workflow", "business_function", "geography", "employee_count", "result_status", "industry")
    r = spread(r, "id").join(notes(spark, sf_dir), "id").join(m, "id", "left")  # what meets by broadcast is in as many tasks
    return r.select(
        "id", "organization_name", "workflow", "business_function", "geography", "employee_count", "result_status", F.array("industry").alias("industries"), F.col("note").alias("text"), families(F.col("note")).alias("families"),
        F.coalesce("outcomes", F.array().cast("array<string>")).alias("outcomes"), pick(4, "software", "ai", "", "staffing").alias("category"), pick(3, "cars", "", "trucks").alias("subsector"),
        F.when(F.col("industry").isin("automobile", "household"), "high").otherwise("low").alias("regulation"), pick(3, "public", "private", "").alias("model"),
    )


_Q = PROFILE["workflow"]
_PW = "['claims', 'processing', 'new', 'system']"
_SIX = f"""six AS (SELECT *, len(list_intersect(tw, {_PW})) AS shared FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS tw, list_distinct(list_filter(regexp_split_to_array(translate(lower(workflow), '_-', '  '), '\\s+'), lambda w: w <> '')) AS ww,
  CASE WHEN employee_count IS NULL THEN NULL WHEN employee_count < 10 THEN 1 WHEN employee_count < 50 THEN 2 WHEN employee_count < 200 THEN 3 WHEN employee_count < 1000 THEN 4 WHEN employee_count < 10000 THEN 5 ELSE 6 END AS band FROM rec)),
  fit AS (SELECT *, least(1.0, shared / greatest(len(tw), 4) * 1.5 + least(0.3, 0.1 * ({' + '.join(f"CAST(contains(lower(text), '{p}') AS INT)" for p in ('claims processing', 'processing new', 'new system', 'claims processing new', 'processing new system'))}))) AS f_problem,
  CASE WHEN workflow = '' THEN 0.0 WHEN lower(workflow) = '{_Q}' THEN 1.0 WHEN contains(lower(workflow), '{_Q}') OR contains('{_Q}', lower(workflow)) THEN 0.7 ELSE len(list_intersect(ww, {_PW})) / (len(ww) + 4 - len(list_intersect(ww, {_PW}))) * 0.5 END AS f_workflow,
  (CASE WHEN coalesce(employee_count, 0) > 0 THEN least(employee_count, 800) / greatest(employee_count, 800) ELSE 0 END + coalesce(CASE abs(band - 4) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.2 END, 0)) / greatest(1, CAST(coalesce(employee_count, 0) > 0 AS INT) + CAST(coalesce(abs(band - 4) <= 2, false) AS INT)) AS f_size,
  CASE WHEN industries[1] = 'building' THEN 1.0 ELSE 0.0 END AS f_industry, CASE WHEN list_contains(outcomes, 'cost') THEN 1.0 ELSE 0.0 END AS f_outcome,
  (CASE WHEN category = '' THEN 0.0 WHEN category = 'software' THEN 1.0 WHEN len(list_intersect(families, ['new_software_implementation', 'existing_software_optimization', 'software'])) > 0 THEN 0.6 ELSE 0.0 END + CASE WHEN list_contains(families, 'training') THEN 1.0 ELSE 0.0 END) / CASE WHEN list_contains(families, 'training') THEN 2 ELSE 1 END AS f_intervention FROM six),
  scored AS (SELECT *, f_problem * 0.35 + f_workflow * 0.25 + f_intervention * 0.15 + f_industry * 0.1 + f_size * 0.1 + f_outcome * 0.05 AS total FROM fit)"""


def _scored(spark: SparkSession, sf_dir: str, profile: dict = PROFILE) -> DataFrame:
    factors = S.similarity(profile)
    r = _rec(spark, sf_dir).select("id", "organization_name", "result_status", "families", *(c.alias(f"f_{n}") for n, c in factors.items()))
    return r.withColumn("total", S.weighed({n: F.col(f"f_{n}") for n in factors}, S.WEIGHTS))


@query(f"WITH {_REC}, {_SIX} SELECT id, {_R('f_problem', 4)} AS problem, {_R('f_workflow', 4)} AS workflow, {_R('f_size', 4)} AS company_size, f_industry AS industry, {_R('f_intervention', 4)} AS intervention, f_outcome AS outcome, {_R('total', 3)} AS total FROM scored")
def similarity_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six factors and their weighted sum for every record and one profile."""
    s = _scored(spark, sf_dir)
    r = lambda n, d=4: half_up(F.col(f"f_{n}"), d).alias(n)
    return s.select("id", r("problem"), r("workflow"), r("company_size"), r("industry"), r("intervention"), r("outcome"), half_up(F.col("total"), 3).alias("total"))


@query(f"""WITH {_REC}, {_SIX}, g AS (SELECT id, organization_name, CAST(floor(total * 1000 + 0.5) AS BIGINT) AS score FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(lower(organization_name), ''), '#' || id) ORDER BY score DESC, id) AS k FROM g)
  SELECT id, organization_name, score FROM r WHERE k = 1 ORDER BY score DESC, id LIMIT 20""")
def comparable_implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 records most like the profile, one an organization."""
    s = _scored(spark, sf_dir).select("id", "organization_name", F.floor(F.col("total") * 1000 + 0.5).alias("score"))
    return K.best_per_entity(s, "organization_name", "score", "id", 20)


@query(f"WITH {_REC}, {_SIX} SELECT result_status AS status, count(*) AS n, {_R('avg(floor(total * 100 + 0.5))', 2)} AS mean_evidence, result_status IN ('failed', 'abandoned') AS negative FROM scored GROUP BY 1")
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scored records by status, with their mean score in hundredths."""
    return S.status_breakdown(_scored(spark, sf_dir).select(F.col("result_status").alias("status"), F.floor(F.col("total") * 100 + 0.5).alias("evidence")))


_ASKED = "['a', 'invoice', 'manual', 'new', 'system', 'with', 'work']"
_W = S.CONTEXT_WEIGHTS
_TEN = f"""ten AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), {_ASKED})) / 7 * 1.5 AS p, list_distinct(list_filter(regexp_split_to_array(translate(lower(workflow), '_-', '  '), '\\s+'), lambda w: w <> '')) AS ww,
  CASE WHEN employee_count IS NULL THEN NULL WHEN employee_count < 10 THEN 1 WHEN employee_count < 50 THEN 2 WHEN employee_count < 200 THEN 3 WHEN employee_count < 1000 THEN 4 WHEN employee_count < 10000 THEN 5 ELSE 6 END AS band FROM rec),
  flow AS (SELECT *, CASE WHEN workflow = '' THEN 0.0 WHEN workflow = 'invoice_processing' THEN 1.0 WHEN contains(workflow, 'invoice') OR contains(workflow, 'processing') THEN 0.9 ELSE len(list_intersect(ww, ['invoice', 'processing'])) / (len(ww) + 2 - len(list_intersect(ww, ['invoice', 'processing']))) * 0.5 END AS w FROM ten),
  context AS (SELECT *, {_R(f"least(1.0, p) * {_W['problem']}", 4)} AS c1, {_R(f"w * {_W['workflow']}", 4)} AS c2, {_R(f"CASE WHEN business_function = '' THEN 0.5 ELSE 0.0 END * {_W['operational_function']}", 4)} AS c3,
  {_R(f"CASE WHEN industries[1] <> 'automobile' THEN 0.0 WHEN subsector = 'cars' THEN 1.0 WHEN subsector <> '' THEN 0.5 ELSE 0.7 END * {_W['industry_subsector']}", 4)} AS c4, {_R(f"CASE WHEN industries[1] = 'automobile' THEN 1.0 ELSE 0.0 END * {_W['broader_industry']}", 4)} AS c5,
  {_R(f"CASE WHEN band IS NULL THEN 0.5 WHEN band = 4 THEN 1.0 WHEN abs(band - 4) = 1 THEN 0.6 WHEN abs(band - 4) = 2 THEN 0.3 ELSE 0.0 END * {_W['organization_size']}", 4)} AS c6, {_R(f"CASE WHEN model = '' THEN 0.5 WHEN model = 'public' THEN 1.0 ELSE 0.4 END * {_W['business_model']}", 4)} AS c7,
  {_R(f"CASE WHEN geography = '' THEN 0.5 WHEN contains(geography, 'united') OR contains('united', geography) THEN 1.0 ELSE 0.0 END * {_W['geography']}", 4)} AS c8, {_R(f"CASE WHEN regulation = 'high' THEN 1.0 ELSE 0.0 END * {_W['regulatory']}", 4)} AS c9, {_R(f"0.5 * {_W['technology_readiness']}", 4)} AS c10 FROM flow)"""
_SUM = " + ".join(f"c{i}" for i in range(1, 11))


def _in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rec(spark, sf_dir).select("id", "organization_name", S.weighed(S.context_similarity(CONTEXT), _W, 4).alias("total"))


@query(f"WITH {_REC}, {_TEN} SELECT id, {_R(_SUM, 3)} AS total FROM context")
def context_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten-factor fit of every record to a context."""
    return _in_context(spark, sf_dir).select("id", half_up(F.col("total"), 3).alias("total"))


@query(f"""WITH {_REC}, {_SIX}, {_TEN}, a AS (SELECT id, row_number() OVER (ORDER BY floor(total * 1000 + 0.5) DESC, id) AS rank FROM scored), b AS (SELECT id, row_number() OVER (ORDER BY floor(({_SUM}) * 1000 + 0.5) DESC, id) AS rank FROM context)
  SELECT a.rank AS rank, a.id AS by_factors, b.id AS by_context FROM a JOIN b ON a.rank = b.rank WHERE a.rank <= 5""")
def legacy_or_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best by either way of scoring, side by side."""
    best = lambda df, name: df.select(F.floor(F.col("total") * 1000 + 0.5).alias("s"), "id").orderBy(F.desc("s"), "id").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "id"))).alias("l")).select(F.posexplode("l").alias("p", "x")).select((F.col("p") + 1).cast("bigint").alias("rank"), F.col("x.id").alias(name))
    return best(_scored(spark, sf_dir), "by_factors").join(best(_in_context(spark, sf_dir), "by_context"), "rank")


_COMPARABLE = """CASE WHEN trim(organization_name) = '' OR contains(lower(organization_name), 'university') THEN 'rejected' WHEN p >= 8 THEN 'gold' WHEN n_metrics > 0 AND p >= 4 THEN 'decision_grade' ELSE 'supporting' END"""


@query(f"""WITH {_TIERED}, c AS (SELECT *, 2 + CASE WHEN result_status IN ('successful', 'partial') THEN 2 ELSE 0 END + CASE WHEN n_metrics > 0 THEN 2 ELSE 0 END + CASE WHEN NOT vendor_reported THEN 1 ELSE 0 END + CASE WHEN (id * 7) % 100 >= 60 THEN 1 ELSE 0 END + CASE WHEN independently_verified THEN 2 ELSE 0 END
  + CASE WHEN measurement_period IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(employee_count, 0) > 0 THEN 1 ELSE 0 END AS p FROM tiered), t AS (SELECT id, {_COMPARABLE} AS comparable, CASE WHEN contains(lower(organization_name), 'university') AND NOT independently_verified THEN 'rejected' WHEN points >= 8 THEN 'gold' WHEN points >= 4 THEN 'silver' WHEN points >= 1 THEN 'bronze' ELSE 'rejected' END AS legacy FROM c)
  SELECT comparable, legacy, count(*) AS n FROM t GROUP BY ALL""")
def comparable_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the tier they have as comparables and by the older score-card."""
    t = tiered(spark, sf_dir)
    return t.groupBy(S.comparable_tier((F.col("id") * 7) % 100, F.col("n_metrics")).alias("comparable"), S.legacy_tier(F.col("points")).alias("legacy")).agg(F.count("*").alias("n"))


_FAM = f"""f AS (SELECT t.*, unnest({_FAMILIES.replace('(t,', '(nt,')}) AS family FROM (SELECT t.*, translate(lower(n.note), '-–', '  ') AS nt FROM tiered t JOIN notes n ON n.id = t.id) t),
  g AS (SELECT family, count(*) AS family_count, count(*) FILTER (n_metrics > 0) AS measured, count(*) FILTER (with_percent) AS quantified, count(*) FILTER (measurement_period IS NOT NULL) AS with_baseline, count(*) FILTER (result_status = 'successful') AS successful, count(*) FILTER (result_status IN ('failed', 'abandoned')) AS failed,
  count(DISTINCT nullif(lower(organization_name), '')) AS organizations, count(*) FILTER (NOT vendor_reported) AS independent, avg(points * 10) AS evidence, count(*) FILTER (tier = 'gold') AS gold, count(*) FILTER (tier = 'decision_grade') AS dg, count(*) FILTER (tier = 'supporting') AS supporting FROM f GROUP BY family)"""


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir).join(notes(spark, sf_dir).select("id", families(F.col("note")).alias("families")), "id").withColumn("family", F.explode("families"))
    n = lambda cond: F.count_if(cond)
    c = F.col
    return t.groupBy("family").agg(
        F.count("*").alias("family_count"), n(c("n_metrics") > 0).alias("measured"), n(c("with_percent")).alias("quantified"), n(c("measurement_period").isNotNull()).alias("with_baseline"), n(c("result_status") == "successful").alias("successful"),
        n(c("result_status").isin("failed", "abandoned")).alias("failed"), F.count_distinct(F.nullif(F.lower("organization_name"), F.lit(""))).alias("organizations"), n(~c("vendor_reported")).alias("independent"), F.avg(c("points") * 10).alias("evidence"),
        n(c("tier") == "gold").alias("gold"), n(c("tier") == "decision_grade").alias("dg"), n(c("tier") == "supporting").alias("supporting"),
    )


@query(f"""WITH {_TIERED}, {_FAM} SELECT family, greatest(0, least(100, CASE WHEN family_count >= 50 THEN 20 WHEN family_count >= 20 THEN 15 WHEN family_count >= 10 THEN 10 WHEN family_count >= 5 THEN 5 ELSE 2 END + CASE WHEN family_count >= 10 THEN 10 WHEN family_count >= 5 THEN 8 WHEN family_count >= 3 THEN 5 ELSE 3 END
  + CASE WHEN measured >= 5 AND quantified >= 3 THEN 25 WHEN measured >= 3 AND quantified >= 1 THEN 15 WHEN measured >= 1 THEN 5 ELSE -10 END + CASE WHEN successful / family_count > 0.5 THEN 10 WHEN successful / family_count > 0.3 THEN 5 ELSE 0 END + CASE WHEN evidence >= 80 THEN 10 WHEN evidence >= 60 THEN 5 WHEN evidence >= 40 THEN 2 ELSE 0 END
  + CASE WHEN organizations >= 10 THEN 5 WHEN organizations >= 5 THEN 3 ELSE 0 END - CASE WHEN failed / family_count > 0.5 THEN 20 WHEN failed / family_count > 0.3 THEN 10 WHEN failed / family_count > 0.1 THEN 5 ELSE 0 END + CASE WHEN independent >= 3 THEN 8 WHEN independent >= 1 THEN 3 ELSE 0 END + CASE WHEN with_baseline >= 3 THEN 5 ELSE 0 END)) AS confidence,
  CASE WHEN gold >= 2 THEN 'gold' WHEN gold + dg >= 3 THEN 'decision_grade' WHEN gold + dg + supporting >= 1 THEN 'supporting' ELSE 'insufficient' END AS tier FROM g""")
def family_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in each intervention family, and the tier of its evidence."""
    g = _families(spark, sf_dir).withColumn("total", F.col("family_count"))
    return g.select("family", S.family_confidence().alias("confidence"), S.overall_tier(F.col("gold"), F.col("dg"), F.col("supporting")).alias("tier"))


def _like(*w: str) -> str:
    return "(" + " OR ".join(f"contains(family, '{x}')" for x in w) + ")"


@query(f"""WITH {_TIERED}, {_FAM}, k AS (SELECT family, row_number() OVER (ORDER BY family_count DESC, family) AS rank FROM g) SELECT family, rank, CASE WHEN {_like('ai', 'hybrid')} THEN 'High' WHEN {_like('software')} THEN 'Medium to High' WHEN {_like('process')} THEN 'Medium' WHEN {_like('automation')} THEN 'Low to Medium' WHEN {_like('staffing')} THEN 'Low' ELSE 'Medium' END AS difficulty,
  CASE WHEN {_like('ai')} THEN '8-24 weeks' WHEN {_like('software')} THEN '10-30 weeks' WHEN {_like('automation')} THEN '4-12 weeks' WHEN {_like('process')} THEN '6-20 weeks' WHEN {_like('staffing')} THEN '4-16 weeks' ELSE 'To be determined' END AS timeframe,
  CASE WHEN {_like('automation')} THEN 'Fast implementation' WHEN {_like('software')} THEN 'Purpose-built functionality' WHEN {_like('process')} THEN 'Addresses root causes' WHEN {_like('staffing')} THEN 'Flexible and reversible' ELSE 'Proven approach' END AS advantage,
  CASE WHEN {_like('automation')} THEN 'Requires structured processes' WHEN {_like('software')} THEN 'Vendor lock-in risk' WHEN {_like('process')} THEN 'Slower to implement' WHEN {_like('staffing')} THEN 'Hard to scale quickly' ELSE 'Requires careful implementation planning' END AS tradeoff, CASE rank WHEN 1 THEN 'recommended' ELSE 'alternative' END AS label FROM k""")
def recommendation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families by the number of their records, with what is said of them."""
    n = _families(spark, sf_dir).select("family", "family_count")
    ranks = n.agg(F.array_sort(F.collect_list(F.struct((-F.col("family_count")).alias("n"), "family"))).alias("l")).select(F.posexplode("l").alias("p", "x"))  # a row a family: a fixed list
    r = ranks.select(F.col("x.family").alias("family"), (F.col("p") + 1).cast("bigint").alias("rank"))
    return r.select("family", "rank", *(c.alias(k) for k, c in S.labels(F.array("family"), F.col("rank")).items()))


@query(f"""WITH i AS (SELECT record_id % 40 AS company, percentage_change / 100 AS x FROM metrics WHERE percentage_change > 0 AND percentage_change <= 150), s AS (SELECT company, min(x) AS lo, median(x) AS mid, max(x) AS hi FROM i GROUP BY 1), v AS (SELECT c_custkey % 40 AS company, CASE WHEN c_custkey % 40 % 9 = 0 THEN NULL ELSE sum(CAST(floor(c_acctbal) AS BIGINT)) END AS volume FROM customer GROUP BY 1)
  SELECT v.company, CASE WHEN volume > 0 AND mid IS NOT NULL THEN 'estimated' ELSE 'insufficient_input' END AS status, CASE WHEN volume > 0 THEN CAST(floor(volume * 0.25 * lo + 0.5) AS BIGINT) END AS hours_low, CASE WHEN volume > 0 THEN CAST(floor(volume * 0.25 * mid + 0.5) AS BIGINT) END AS hours, CASE WHEN volume > 0 THEN CAST(floor(volume * 0.25 * hi + 0.5) AS BIGINT) END AS hours_high,
  CASE WHEN volume > 0 THEN CAST(floor(volume * 0.25 * mid * 40 + 0.5) AS BIGINT) END AS savings FROM v LEFT JOIN s USING (company)""")
def impact_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comparable improvements would save in companies of so much work, at a quarter of an hour and 40 an hour."""
    x = metrics(spark, sf_dir).where("percentage_change > 0 AND percentage_change <= 150").groupBy((F.col("record_id") % 40).alias("company"))
    s = x.agg((F.min("percentage_change") / 100).alias("lo"), (F.median("percentage_change") / 100).alias("mid"), (F.max("percentage_change") / 100).alias("hi"))
    company = F.col("c_custkey") % 40
    v = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").groupBy(company.alias("company")).agg(F.sum(F.floor("c_acctbal")).alias("v")).select("company", F.when(F.col("company") % 9 != 0, F.col("v")).alias("volume"))
    e = S.impact(F.col("volume"), F.lit(0.25), F.lit(40), F.col("lo"), F.col("mid"), F.col("hi"))
    return v.join(s, "company", "left").select("company", e.alias("e")).select("company", "e.*")


#: Changes of the profile, one field each.
CHANGES = [{}, {"workflow": "claims handling"}, {"industry": "machinery"}, {"size_band": "10-50", "employee_count": 30}, {"outcome": "time"}]
_FIELDS = ["none", "workflow", "industry", "size", "outcome"]


@query()
def field_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the best 25 move if one field of the profile changes: all variants scored in one pass. Compared with scoring them one by one in a test."""
    kept = ["id", "text", "workflow", "employee_count", "industries", "category", "families", "outcomes"]
    rows = S.scored_variants(saved(spread(_rec(spark, sf_dir).select(*kept), "id")), [PROFILE | c for c in CHANGES])
    rows = rows.select("id", F.posexplode(F.transform("totals", lambda x: F.floor(x * 1000 + 0.5))).alias("query", "score"))
    ranks = saved(K.ranked(rows, 25))  # 25 rows a variant, met twice below
    base = ranks.where("query = 0").select("id", F.col("rank").alias("r0"))
    moved = ranks.where("query > 0").join(base, "id", "left").groupBy("query").agg(F.count("r0").alias("common"), F.sum(F.abs(F.col("rank") - F.col("r0"))).alias("d"))
    name = F.get(F.array(*map(F.lit, _FIELDS)), F.col("query"))
    return moved.select(name.alias("field"), "common", half_up(F.coalesce(F.try_divide(F.col("d"), F.col("common")) / 25, F.lit(1.0)), 4).alias("moved"))


_RISKS = f"""list_filter([CASE WHEN vendor_reported THEN 'Vendor-reported outcome' END, CASE WHEN result_status IN ('failed', 'abandoned') THEN 'Similar implementations have failed or been abandoned' END, CASE WHEN len(list_filter(f, lambda x: contains(x, 'automation'))) > 0 THEN 'Complex exceptions may still require manual review' END,
  CASE WHEN len(list_filter(f, lambda x: contains(x, 'software'))) > 0 THEN 'Integration with existing systems may take longer than expected' END], lambda x: x IS NOT NULL)"""


@query(f"""WITH r AS (SELECT r.*, {_FAMILIES} AS f FROM records r JOIN (SELECT id, {_T} AS t FROM notes) n ON n.id = r.id), k AS (SELECT {_RISKS} AS risks FROM r) SELECT unnest(CASE WHEN len(risks) = 0 THEN ['Implementation risk depends on organizational readiness'] ELSE risks[1:3] END) AS risk, count(*) AS n FROM k GROUP BY 1""")
def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the risks that are named for them, three each at most."""
    r = records(spark, sf_dir).join(notes(spark, sf_dir).select("id", families(F.col("note")).alias("families")), "id")
    return r.select(F.explode(S.risks()).alias("risk")).groupBy("risk").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT r.id, organization_name, result_status, unnest({_FAMILIES}) AS family FROM records r JOIN (SELECT id, {_T} AS t FROM notes) n ON n.id = r.id WHERE result_status IN ('failed', 'abandoned') AND publication_status = 'published'), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY id) AS k FROM r)
  SELECT family, k AS number, id, result_status FROM k WHERE k <= 3""")
def counter_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three published failures of each family."""
    r = records(spark, sf_dir).where("publication_status = 'published'").where(F.col("result_status").isin("failed", "abandoned")).select("id", "result_status")
    r = r.join(notes(spark, sf_dir).select("id", F.explode(families(F.col("note"))).alias("family")), "id")
    return r.withColumn("number", F.row_number().over(Window.partitionBy("family").orderBy("id"))).where("number <= 3").select("family", "number", "id", "result_status")


_DEMANDED = "CASE id % 6 WHEN 0 THEN 'Invoice and billing' WHEN 1 THEN 'CI CD deploy' WHEN 2 THEN 'HR documents' WHEN 3 THEN 'Support tickets' WHEN 4 THEN 'the close' ELSE workflow END"
_KEYED = "list_max([" + ", ".join(f"CASE WHEN contains(lower(w), '{k}') THEN {v} ELSE 0.0 END" for k, v in S.DEMAND_KEYWORDS) + "])"


@query(f"SELECT w AS workflow, {_KEYED} AS demand, count(*) AS n FROM (SELECT {_DEMANDED} AS w FROM records) GROUP BY ALL")
def keyword_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows by the greatest demand that a keyword of theirs has."""
    return records(spark, sf_dir).select(F.expr(_DEMANDED).alias("workflow")).groupBy("workflow", S.keyword_demand(F.col("workflow")).alias("demand")).agg(F.count("*").alias("n"))


@query(f"""WITH {_TIERED}, p AS (SELECT workflow, count(*) FILTER (business_function <> '') AS problem, count(*) FILTER (rollout_strategy <> '') AS intervention, count(DISTINCT nullif(lower(organization_name), '')) AS organizations, count(*) FILTER (richness = 'rich') AS implementation, count(DISTINCT nullif(implementation_pattern, '')) AS patterns,
  count(*) FILTER (n_metrics > 0) AS outcome, count(*) FILTER (quantified) AS metrics, count(*) FILTER (vendor_reported) AS risks, count(*) FILTER (result_status IN ('failed', 'abandoned')) AS failed, count(*) FILTER (tier = 'gold') AS gold, count(*) FILTER (tier = 'decision_grade') AS silver, {_R('avg(points) * 10', 2)} AS confidence FROM tiered GROUP BY workflow),
  a AS (SELECT *, CASE WHEN implementation >= 2 AND patterns > 0 THEN implementation ELSE 0 END AS told, CAST(gold = 0 AS INT) + CAST(silver = 0 AS INT) + CAST(implementation = 0 AS INT) + CAST(confidence < 40 AS INT) AS changes FROM p),
  l AS (SELECT *, [{{'question': 'Why this problem?', 'evidence': problem, 'level': CASE WHEN problem = 0 THEN 'unavailable' WHEN problem >= 5 THEN 'high' WHEN problem >= 2 THEN 'medium' ELSE 'low' END}}, {{'question': 'Why this intervention?', 'evidence': intervention, 'level': CASE WHEN intervention = 0 THEN 'unavailable' WHEN intervention >= 5 THEN 'high' WHEN intervention >= 3 THEN 'medium' ELSE 'low' END}},
  {{'question': 'Who else solved it?', 'evidence': organizations, 'level': CASE WHEN organizations >= 5 THEN 'high' WHEN organizations >= 1 THEN 'low' ELSE 'unavailable' END}}, {{'question': 'How did they implement it?', 'evidence': told, 'level': CASE WHEN told > 0 THEN 'high' ELSE 'unavailable' END}}, {{'question': 'What outcomes did they achieve?', 'evidence': outcome, 'level': CASE WHEN outcome = 0 THEN 'unavailable' WHEN outcome >= 3 THEN 'high' ELSE 'medium' END}},
  {{'question': 'What risks should we expect?', 'evidence': risks + failed, 'level': CASE WHEN risks > 0 THEN 'high' WHEN failed > 0 THEN 'medium' ELSE 'unavailable' END}}, {{'question': 'How should we measure success?', 'evidence': metrics, 'level': CASE WHEN metrics > 0 THEN 'medium' ELSE 'low' END}}, {{'question': 'What would change this recommendation?', 'evidence': changes, 'level': CASE WHEN changes = 0 THEN 'high' ELSE 'medium' END}}] AS answers FROM a),
  g AS (SELECT *, len(list_filter(answers, lambda x: x.level = 'unavailable')) + CAST(confidence < 40 AS INT) + CAST(gold = 0 AND silver = 0 AS INT) + CAST(implementation = 0 AS INT) AS gaps FROM l)
  SELECT workflow, unnest(answers, recursive := true), CAST(gaps AS INT) AS gaps, gaps <= 2 AND confidence >= 40 AS can_defend FROM g""")
def defensibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a recommendation for each workflow answers eight questions."""
    c, n = F.col, F.count_if
    t = tiered(spark, sf_dir)
    p = t.groupBy("workflow").agg(
        n(c("business_function") != "").alias("problem"), n(c("rollout_strategy") != "").alias("intervention"), F.count_distinct(F.nullif(F.lower("organization_name"), F.lit(""))).alias("organizations"), n(c("richness") == "rich").alias("implementation"),
        F.count_distinct(F.nullif("implementation_pattern", F.lit(""))).alias("patterns"), n(c("n_metrics") > 0).alias("outcome"), n(c("quantified")).alias("metrics"), n(c("vendor_reported")).alias("risks"), n(c("result_status").isin("failed", "abandoned")).alias("failed"),
        n(c("tier") == "gold").alias("gold"), n(c("tier") == "decision_grade").alias("silver"), half_up(F.avg("points") * 10, 2).alias("confidence"),
    )
    return S.defended(p, "workflow")


ASSESSMENT = {"workflow": "claims handling", "function": "finance", "industry": "building", "employees": 800, "geography": "nation_3", "goal": "cost", "budget": 150000, "weeks": 12}
_COST_WORDS = S.GOALS["cost_reduction"]
_MEETS = "(" + " OR ".join(f"contains(lower(m.name), '{w}') OR contains(lower(m.category), '{w}')" for w in _COST_WORDS) + ")"
_BAND_OF = "CASE WHEN {0} < 10 THEN 1 WHEN {0} < 50 THEN 2 WHEN {0} < 200 THEN 3 WHEN {0} < 1000 THEN 4 WHEN {0} < 10000 THEN 5 ELSE 6 END"


@query(f"""WITH {_TIERED}, f AS (SELECT r.id, result_status IN ('successful', 'partial') AS good, {_FAMILIES} AS f FROM records r JOIN (SELECT id, {_T} AS t FROM notes) n ON n.id = r.id), fc AS (SELECT list_sort(f) AS f, count(*) AS n, count(*) FILTER (good) AS g FROM f GROUP BY 1),
  ft AS (SELECT a.f, sum(b.n) AS n, sum(b.g) AS g FROM fc a JOIN fc b ON len(list_intersect(a.f, b.f)) > 0 GROUP BY a.f), peers AS (SELECT id, CASE WHEN coalesce(n - 1, 0) <= 0 THEN 50 WHEN (g - CAST(good AS INT)) / (n - 1) >= 0.8 THEN 90 WHEN (g - CAST(good AS INT)) / (n - 1) >= 0.5 THEN 70 WHEN (g - CAST(good AS INT)) / (n - 1) >= 0.3 THEN 50 ELSE 30 END AS oc FROM f LEFT JOIN ft ON ft.f = list_sort(f.f)),
  ml AS (SELECT record_id, list({{'name': metric_name, 'category': metric_category, 'q': percentage_change IS NOT NULL OR absolute_change IS NOT NULL}} ORDER BY seq, partkey, suppkey) AS ms FROM metrics GROUP BY 1),
  x AS (SELECT t.*, oc, ms, translate(lower(workflow), '_-', '  ') AS w, regexp_split_to_array(translate(lower(workflow), '_-', '  '), '\\s+') AS ww, list_filter(ms, lambda m: {_MEETS})[1] AS hit, least(floor(total_price), 150000) / greatest(floor(total_price), 150000) AS ratio FROM tiered t JOIN peers USING (id) LEFT JOIN ml ON ml.record_id = t.id),
  c AS (SELECT id, {_R("greatest(CASE WHEN workflow = '' THEN 0.0 WHEN w = 'claims handling' THEN 1.0 WHEN contains(w, 'claims handling') OR contains('claims handling', w) THEN 0.7 ELSE len(list_intersect(ww, ['claims', 'handling'])) / (len(list_distinct(ww)) + 2 - len(list_intersect(ww, ['claims', 'handling']))) END, CASE WHEN business_function = 'finance' THEN 1.0 ELSE 0.0 END) * 100", 1)} AS problem_alignment,
  {_R("(CASE WHEN industry = 'building' THEN 0.8 ELSE 0.3 END * 0.3 + CASE WHEN employee_count IS NULL THEN 0.0 WHEN abs(" + _BAND_OF.format('employee_count') + " - 4) = 0 THEN 1.0 WHEN abs(" + _BAND_OF.format('employee_count') + " - 4) = 1 THEN 0.5 WHEN abs(" + _BAND_OF.format('employee_count') + " - 4) = 2 THEN 0.2 ELSE 0.0 END * 0.3 + CASE WHEN geography = 'nation_3' THEN 0.5 ELSE 0.0 END * 0.15) * 100", 1)} AS organizational_similarity,
  CASE WHEN coalesce(len(ms), 0) = 0 THEN 0.0 WHEN hit IS NULL THEN 30.0 WHEN hit.q THEN 90.0 ELSE 60.0 END AS goal_alignment,
  CAST(greatest(0, least(100, 50 + CASE WHEN n_numeric > 0 THEN 15 ELSE 0 END + CASE WHEN independently_verified THEN 10 ELSE 0 END + CASE WHEN has_baseline OR with_baseline THEN 10 ELSE 0 END + CASE WHEN n_metrics >= 3 THEN 10 WHEN n_metrics >= 1 THEN 5 ELSE 0 END - CASE WHEN vendor_reported THEN 15 ELSE 0 END + CASE WHEN coalesce(sample_size, 0) >= 30 THEN 10 WHEN coalesce(sample_size, 0) >= 10 THEN 5 ELSE 0 END)) AS DOUBLE) AS evidence_strength,
  CAST(least(100, 50 + CASE WHEN floor(total_price) > 0 THEN CASE WHEN ratio >= 0.8 THEN 15 WHEN ratio >= 0.5 THEN 5 ELSE 0 END ELSE 0 END + CASE WHEN id % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN implementation_pattern <> '' THEN 10 ELSE 0 END + CASE WHEN coalesce(measurement_period, 0) > 0 AND measurement_period <= 12 THEN 10 ELSE 0 END + CASE WHEN id % 5 = 3 THEN 5 ELSE 0 END) AS DOUBLE) AS implementation_fit, oc AS outcome_consistency FROM x)
  SELECT *, {_R('problem_alignment * 0.3 + organizational_similarity * 0.2 + goal_alignment * 0.2 + evidence_strength * 0.15 + implementation_fit * 0.1 + outcome_consistency * 0.05', 1)} AS match FROM c""")
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six components of every record for an assessment, and their weighted sum."""
    quantified = F.col("percentage_change").isNotNull() | F.col("absolute_change").isNotNull()
    first = F.min(F.struct("seq", "partkey", "suppkey", quantified.alias("quantified")))["quantified"]  # of an order's lines, those that meet the goal
    m = metrics(spark, sf_dir).where(S.meets_goal(str(ASSESSMENT["goal"]), F.col("metric_name"), F.col("metric_category"))).groupBy(F.col("record_id").alias("id")).agg(first.alias("goal_quantified"))
    good = F.col("result_status").isin("successful", "partial")
    kin = L.kin_consistency(records(spark, sf_dir).select("id", good.alias("good")).join(notes(spark, sf_dir).select("id", families(F.col("note")).alias("families")), "id")).select("id", F.col("score").alias("outcome_consistency"))
    t = tiered(spark, sf_dir).withColumns({"cost": F.floor("total_price").cast("double"), "has_software": F.col("id") % 2 == 0, "pilot": F.col("implementation_pattern") != "", "weeks": F.col("measurement_period"), "human_review": F.col("id") % 5 != 3})
    parts = t.join(m, "id", "left").select("id", *(c.alias(n) for n, c in S.components(ASSESSMENT).items())).join(kin, "id")
    return parts.withColumn("match", half_up(S.weighed({n: F.col(n) for n in S.COMPONENT_WEIGHTS}, S.COMPONENT_WEIGHTS), 1))
