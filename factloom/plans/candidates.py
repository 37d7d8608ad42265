"""Queries of candidates, of effort, and of what a choice rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.rules import families
from factloom.operators import candidates as C
from factloom.operators import retrieval as S
from factloom.plans.catalog import query
from factloom.plans.coverage import _R, _TIERED, tiered
from factloom.plans.extraction import _FAMILIES
from factloom.plans.retrieval import _REC, _SIX, PROFILE, _rec, _scored
from factloom.sources.tables import metrics, notes, records, saved

_FACTORS = list(S.WEIGHTS)

_BAND = "CASE WHEN employee_count IS NULL THEN '' WHEN employee_count < 10 THEN '<10' WHEN employee_count < 50 THEN '10-50' WHEN employee_count < 200 THEN '50-200' WHEN employee_count < 1000 THEN '200-1000' WHEN employee_count < 10000 THEN '1000-10000' ELSE '10000+' END"
_SIGNED = "CASE WHEN {x} >= 0 THEN '+' ELSE '' END || {x}"
_CANDIDATES = f"""WITH {_REC}, {_SIX},
  own AS (SELECT record_id AS id, count(*) AS n_metrics, count(*) FILTER (percentage_change IS NOT NULL OR absolute_change IS NOT NULL) AS numbers,
    string_agg(CASE WHEN percentage_change IS NOT NULL THEN metric_name || ': ' || {_SIGNED.format(x='percentage_change')} || '%' ELSE metric_name || ': ' || {_SIGNED.format(x='absolute_change')} || ' units' END, ';' ORDER BY seq, metric_name, baseline_value NULLS FIRST, post_value NULLS FIRST, absolute_change NULLS FIRST, percentage_change NULLS FIRST)
      FILTER (percentage_change IS NOT NULL OR absolute_change IS NOT NULL) AS summaries FROM metrics GROUP BY 1)
  SELECT s.id, s.organization_name AS organization, coalesce({_BAND.replace('employee_count', 's.employee_count')}, '') AS band, s.industries[1] AS industry, length(substr(s.text, 1, 300)) AS problem_chars, array_to_string(s.families, ',') AS families,
    s.result_status, coalesce(n_metrics, 0) AS n_metrics, coalesce(summaries, '') AS outcomes,
    greatest(0, least(100, 50 + CASE WHEN independently_verified THEN 15 ELSE 0 END + CASE WHEN coalesce(sample_size, 0) > 1 THEN 10 ELSE 0 END + least(15, 5 * coalesce(numbers, 0)) - CASE WHEN vendor_reported THEN 10 ELSE 0 END
      + CASE WHEN s.result_status IN ('successful', 'partial') THEN 10 WHEN s.result_status IN ('failed', 'abandoned') THEN -10 ELSE 0 END)) AS evidence_score,
    CAST(floor(total * 100 + 0.5) AS INT) AS similarity_score, {_R('f_problem', 4)} AS problem_fit
  FROM scored s JOIN records r ON r.id = s.id LEFT JOIN own ON own.id = s.id WHERE r.publication_status = 'published'"""


@query(_CANDIDATES)
def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published records as whole candidates for one profile: fields, metrics, what they say, evidence and likeness."""
    factors = S.similarity(PROFILE)
    r = _rec(spark, sf_dir)
    known = records(spark, sf_dir).where("publication_status = 'published'").select("id", "has_baseline", "sample_size", "independently_verified", "vendor_reported")
    scored = r.select("id", "organization_name", "industries", "employee_count", "text", "families", "geography", "business_function", "workflow", "result_status", *(c.alias(f"_{n}") for n, c in factors.items()))
    scored = saved(scored.join(known, "id").withColumn("total", S.weighed({n: F.col(f"_{n}") for n in factors}, S.WEIGHTS)))  # fields and factors come from here
    listed = lambda n: F.array(n)
    fields = scored.select(
        "id", "organization_name", F.col("industries").alias("organization_industry"), listed("geography").alias("organization_geography"), F.col("employee_count").alias("organization_employee_count"), F.col("text").alias("problem_statement"),
        listed("business_function").alias("problem_business_function"), F.col("workflow").alias("intervention_title"), F.col("families").alias("intervention_families"), F.col("text").alias("intervention_description"),
        "result_status", "has_baseline", "sample_size", "independently_verified", "vendor_reported",
    )
    m = metrics(spark, sf_dir).withColumns({"id": F.col("seq"), "unit": F.lit("units")})
    out = C.candidates(fields, m, scored.select("id", "total", *(F.col(f"_{n}").alias(n) for n in factors)), list(factors))
    return out.select(
        "id", "organization", F.coalesce("organization_employee_band", F.lit("")).alias("band"), F.get("organization_industry", 0).alias("industry"), F.length("problem_statement").alias("problem_chars"),
        F.array_join("intervention_families", ",").alias("families"), "result_status", F.size("metrics").cast("long").alias("n_metrics"), F.array_join("outcome_summaries", ";").alias("outcomes"), "evidence_score", "similarity_score",
        (F.floor(F.col("similarity_breakdown.problem") * 10_000 + 0.5) / 10_000).alias("problem_fit"),
    )


_CATEGORIES = {"AI": "ai", "Software": "software", "Workflow_Automation": "workflow_automation", "Process_Redesign": "process_redesign", "Staffing": "staffing", "Hybrid": "hybrid"}
_EFFORT = ", ".join(f"({'NULL' if n is None else repr(n)}, {', '.join(map(str, e[:6]))}, '{', '.join(e[6])}')" for n, e in C.EFFORT.items())
_IN = " ".join(f"WHEN len(list_intersect(families, {S.CATEGORY_FAMILIES[c]!r})) > 0 THEN '{n}'" for n, c in _CATEGORIES.items())


@query(f"""WITH t AS (SELECT id, translate(lower(note), '-–', '  ') AS nt FROM notes), f AS (SELECT id, {_FAMILIES.replace('(t,', '(nt,')} AS families FROM t), c AS (SELECT id, CASE {_IN} END AS category FROM f),
  e(category, min_weeks, expected_weeks, max_weeks, min_people, expected_people, max_people, roles) AS (VALUES {_EFFORT}),
  g AS (SELECT industry, category, count(*) AS records FROM records JOIN c USING (id) GROUP BY 1, 2)
  SELECT industry, coalesce(g.category, '') AS category, records, min_weeks, expected_weeks, max_weeks, min_people, expected_people, max_people, roles, records * expected_people * expected_weeks AS person_weeks
  FROM g JOIN e ON e.category IS NOT DISTINCT FROM g.category""")
def project_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What work of each industry's categories takes in weeks, people and roles, and what all its records took by that."""
    own = families(F.col("note"))
    n = notes(spark, sf_dir).select("id", own.alias("families"))
    category = F.coalesce(*(F.when(F.arrays_overlap("families", F.array(*map(F.lit, S.CATEGORY_FAMILIES[c]))), name) for name, c in _CATEGORIES.items()), F.lit(""))
    g = records(spark, sf_dir).select("id", "industry").join(n, "id").groupBy("industry", category.alias("category")).agg(F.count("*").alias("records"))
    e = g.withColumn("e", C.effort(F.col("category"))).select("industry", "category", "records", "e.*").drop("basis")
    return e.withColumns({"roles": F.array_join("roles", ", "), "person_weeks": F.col("records") * F.col("expected_people") * F.col("expected_weeks")})


_COLS = ", ".join(f"{{'p': {i}, 'factor': '{n}', 'v': max(f_{'size' if n == 'company_size' else n}) FILTER (rank <= 5)}}" for i, n in enumerate(_FACTORS))


@query(f"""WITH {_TIERED}, {_REC}, {_SIX}, b AS (SELECT s.*, s.industries[1] AS sector, CAST(floor(total * 1000 + 0.5) AS BIGINT) AS score, coalesce(nullif(lower(s.organization_name), ''), '#' || s.id) AS o FROM scored s),
  d AS (SELECT *, row_number() OVER (PARTITION BY sector, o ORDER BY score DESC, id) AS own FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, id) AS rank FROM d WHERE own = 1),
  g AS (SELECT sector, [{_COLS}] AS f, count(*) FILTER (tier = 'gold') AS gold, count(*) FILTER (tier = 'decision_grade') AS decision_grade, count(*) AS total, count(*) FILTER (r.employee_count > 0) AS sized FROM r JOIN tiered t ON t.id = r.id WHERE rank <= 12 GROUP BY 1),
  x AS (SELECT sector, gold, decision_grade, total, sized, unnest(f) AS f FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY f.v DESC, f.p) AS place FROM x)
  SELECT sector, string_agg(f.factor || '=' || CAST(floor(f.v * 100 + 0.5) AS INT), ',' ORDER BY place) AS reasons, gold, decision_grade, total - gold - decision_grade AS mixed, total,
    CASE WHEN sized < 2 THEN 'Few comparable organizations at the customer''s employee scale' WHEN total > gold + decision_grade THEN (total - gold - decision_grade) || ' comparable implementation(s) reported mixed or negative outcomes' ELSE '' END AS uncertainty
  FROM k WHERE place <= 5 GROUP BY ALL""")
def recommendation_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each industry's dozen of records most like the profile: the factors that speak for them, their evidence, and the main doubt."""
    t = tiered(spark, sf_dir).select("id", F.col("industry").alias("sector"), "employee_count", "tier")
    s = _scored(spark, sf_dir).join(t, "id")
    factors = [F.col(f"f_{n}").alias(n) for n in _FACTORS]
    who = F.coalesce(F.nullif(F.lower("organization_name"), F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")))
    row = F.struct((-F.floor(F.col("total") * 1000 + 0.5)).alias("s"), "id", "tier", "employee_count", *factors)
    best = s.groupBy("sector", who.alias("who")).agg(F.min(row).alias("r")).select("sector", "r.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("sector").orderBy("s", "id"))).where("rank <= 12")
    out = C.trace(ranked, "sector", _FACTORS)
    said = F.transform("reasons", lambda r: F.concat(r["factor"], F.lit("="), F.round(r["raw"] * 100).cast("int").cast("string")))
    return out.withColumn("reasons", F.array_join(said, ","))
