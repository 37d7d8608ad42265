"""Queries of rules over whole records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.rules import half_up
from factloom.operators import entities as E
from factloom.operators import records as O
from factloom.plans.catalog import query
from factloom.plans.coverage import _GAPS, _R, _TIERED, _gaps, tiered
from factloom.sources.sinks import admitted
from factloom.sources.tables import metrics, notes, records, table


def _first(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{v}'" for p, v in pairs) + f" ELSE '{otherwise}' END"


@query(f"SELECT id, {_first([(p, w) for p, w, _ in O.PROBLEMS], 'process_automation')} AS workflow, {_first([(p, f) for p, _, f in O.PROBLEMS], 'operations')} AS business_function, {_first(O.OUTCOMES, 'efficiency')} AS wanted FROM (SELECT id, lower(trim(note)) AS t FROM notes)")
def problem_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each note is about."""
    return notes(spark, sf_dir).select("id", *(c.alias(n) for n, c in O.problem(F.col("note")).items()))


@query("""SELECT field, count(*) AS n FROM (SELECT unnest([CASE WHEN result_status IN ('', 'unknown', 'theoretical', 'proposed') THEN 'deployment_status' END, CASE WHEN coalesce(measurement_period, 0) = 0 THEN 'measurement_period' END,
  CASE WHEN coalesce(sample_size, 0) <= 1 THEN 'sample_size' END, CASE WHEN NOT has_baseline THEN 'baseline' END]) AS field FROM records) WHERE field IS NOT NULL GROUP BY field""")
def outcome_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of four fields is missing."""
    return records(spark, sf_dir).select(F.explode(O.missing_fields()).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query("""SELECT id, len(i) = 0 AS valid, array_to_string(i, '; ') AS issues FROM (SELECT id, list_filter([CASE WHEN trim(organization_name) = '' THEN 'missing required field: organization_name' END, CASE WHEN trim(workflow) = '' THEN 'missing required field: workflow' END,
  CASE WHEN richness NOT IN ('rich', 'usable') THEN 'invalid richness: ' || richness END, CASE WHEN employee_count < 0 THEN 'negative employee_count' END, CASE WHEN coalesce(employee_count, 1) = 0 THEN 'no employees' END], lambda x: x IS NOT NULL) AS i FROM records)""")
def enrichment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records could be added, and what is wrong with the others."""
    return records(spark, sf_dir).select("id", O.issues(["rich", "usable"]).alias("i")).select("id", (F.size("i") == 0).alias("valid"), F.array_join("i", "; ").alias("issues"))


@query("""WITH m AS (SELECT record_id, metric_name || ': ' || abs(percentage_change) || '% ' || CASE WHEN (percentage_change < 0 AND metric_category IN ('cost', 'time', 'risk', 'errors')) OR percentage_change > 0 THEN 'improvement' ELSE 'decline' END AS line,
  row_number() OVER (PARTITION BY record_id ORDER BY seq, partkey, suppkey) AS k FROM metrics WHERE percentage_change IS NOT NULL) SELECT record_id, string_agg(line, '; ' ORDER BY k) AS summary FROM m WHERE k <= 3 GROUP BY record_id""")
def outcome_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three measured changes of each record in words."""
    return O.summaries(metrics(spark, sf_dir))


_BAND = "CASE WHEN employee_count < 10 THEN 1 WHEN employee_count < 50 THEN 2 WHEN employee_count < 200 THEN 3 WHEN employee_count < 1000 THEN 4 WHEN employee_count < 10000 THEN 5 ELSE 6 END"


@query(f"""WITH f AS (SELECT id, (CASE WHEN business_function = '' THEN 0.5::DOUBLE WHEN business_function = 'finance' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.4::DOUBLE + (CASE WHEN industry = 'machinery' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.3::DOUBLE
  + (CASE WHEN employee_count IS NULL THEN 0.5::DOUBLE WHEN abs({_BAND} - 4) = 0 THEN 1.0::DOUBLE WHEN abs({_BAND} - 4) = 1 THEN 0.6::DOUBLE WHEN abs({_BAND} - 4) = 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) * 0.2::DOUBLE
  + (CASE WHEN contains(geography, '1') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.1::DOUBLE AS fit FROM records WHERE publication_status = 'published') SELECT id, {_R('fit', 4)} AS fit FROM f""")
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of published records to a profile, gaps counting as neutral."""
    return records(spark, sf_dir).where("publication_status = 'published'").select("id", half_up(O.context_fit("finance", "machinery", 500, "1"), 4).alias("fit"))


@query("""WITH c AS (SELECT c_name AS name, 'site' || (c_custkey % 40) || '.example' AS domain, c_custkey, c_mktsegment FROM customer), reg AS (SELECT lower(name) AS k, min(lower(c_mktsegment)) AS i FROM c WHERE c_custkey % 3 = 0 GROUP BY 1), dom AS (SELECT lower(domain) AS k, min('by domain ' || domain) AS i FROM c WHERE c_custkey % 40 < 10 GROUP BY 1),
  ev AS (SELECT lower(organization_name) AS k, min(industry) AS i FROM records WHERE organization_name <> '' GROUP BY 1)
  SELECT name, coalesce(reg.i, dom.i, ev.i) AS industry, CASE WHEN reg.i IS NOT NULL THEN 'registry' WHEN dom.i IS NOT NULL THEN 'domains' WHEN ev.i IS NOT NULL THEN 'evidence' ELSE 'none' END AS via FROM c LEFT JOIN reg ON lower(name) = reg.k LEFT JOIN dom ON lower(domain) = dom.k LEFT JOIN ev ON lower(name) = ev.k""")
def organization_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries of customers by name, domain or evidence."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(F.col("c_name").alias("name"), F.concat(F.lit("site"), (F.col("c_custkey") % 40).cast("string"), F.lit(".example")).alias("domain"), "c_custkey", F.lower("c_mktsegment").alias("industry"))
    reg = c.where("c_custkey % 3 = 0").select("name", "industry")
    dom = c.where("c_custkey % 40 < 10").select("domain", F.concat(F.lit("by domain "), "domain").alias("industry"))
    ev = records(spark, sf_dir).where("organization_name <> ''").select(F.col("organization_name").alias("name"), "industry")
    return O.resolve(c.select("name", "domain"), reg, dom, ev)


@query(f"""WITH {_GAPS}, t AS (SELECT workflow, business_function, replace(workflow, '_', ' ') AS wf, gold, decision_grade, missing FROM gaps) SELECT workflow, business_function, array_to_string(list_filter([concat_ws(' ', wf, business_function, 'implementation'), CASE WHEN gold = 0 THEN wf || ' automation quantified results' END,
  CASE WHEN decision_grade < 3 THEN concat_ws(' ', wf, business_function, 'case study outcomes') END, CASE WHEN missing <> '' THEN concat_ws(' ', wf, replace(string_split(missing, ',')[1], '_', ' ')) END], lambda x: x IS NOT NULL), '|') AS terms FROM t""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to search for to fill each gap."""
    return _gaps(spark, sf_dir).select("workflow", "business_function", F.array_join(O.search_terms(), "|").alias("terms"))


@query("SELECT id, organization_name, result_status, workflow FROM records WHERE publication_status = 'published' AND result_status IN ('failed', 'abandoned') ORDER BY id LIMIT 20")
def negative_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 published records of failure."""
    r = records(spark, sf_dir).where("publication_status = 'published'").where(F.col("result_status").isin("failed", "abandoned"))
    return r.select("id", "organization_name", "result_status", "workflow").orderBy("id").limit(20)


@query(f"""WITH {_TIERED}, n AS (SELECT DISTINCT lower(trim(organization_name)) AS o, lower(trim(workflow)) AS w FROM tiered WHERE id % 2 = 0), c AS (SELECT *, CASE WHEN trim(organization_name) = '' THEN 'missing organization_name' WHEN trim(workflow) = '' THEN 'missing workflow' WHEN tier NOT IN ('gold', 'decision_grade') THEN 'below the gate'
  WHEN EXISTS (SELECT 1 FROM n WHERE n.o = lower(trim(organization_name)) AND n.w = lower(trim(workflow))) THEN 'duplicate' END AS reason FROM tiered WHERE id % 2 = 1)
  SELECT coalesce(reason, 'added') AS result, CASE WHEN reason IS NULL THEN count(DISTINCT lower(organization_name) || '|' || lower(workflow)) ELSE count(*) END AS n FROM c GROUP BY reason""")
def gated_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of one half of the records could be added to the other, and why not the rest."""
    t = tiered(spark, sf_dir).select("id", "organization_name", "workflow", "tier")
    added, refused = admitted(t.where("id % 2 = 1"), t.where("id % 2 = 0"), ["organization_name", "workflow"], F.col("tier").isin("gold", "decision_grade"))
    return added.agg(F.lit("added").alias("result"), F.count("*").alias("n")).where("n > 0").unionAll(refused.groupBy(F.col("reason").alias("result")).agg(F.count("*").alias("n")))


@query("SELECT lower(organization_name) AS name, array_to_string(list_sort(list_distinct(list(industry))), ',') AS industries, count(*) AS n, min(id) AS first_id FROM records WHERE organization_name <> '' GROUP BY 1")
def organization_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizations of the evidence with their industries."""
    r = records(spark, sf_dir).where("organization_name <> ''").groupBy(F.lower("organization_name").alias("name"))
    return r.agg(F.array_join(F.sort_array(F.collect_set("industry")), ",").alias("industries"), F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH {_TIERED}, r AS (SELECT id, extracted_at, tier, row_number() OVER (ORDER BY extracted_at DESC, id) AS k FROM tiered WHERE tier = 'gold') SELECT id, tier, (SELECT count(*) FROM r) AS total FROM r WHERE k > 20 AND k <= 70""")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of gold records, the newest first, with their total."""
    t = tiered(spark, sf_dir).where("tier = 'gold'").select("id", "tier", "extracted_at")
    total = t.agg(F.count("*")).scalar()
    return t.orderBy(F.desc("extracted_at"), "id").offset(20).limit(50).select("id", "tier", total.alias("total"))


@query(f"""WITH {_TIERED}, s AS (SELECT w.shift, t.id, (0.5 + w.shift) * points + (0.5 - w.shift) * n_metrics AS score FROM tiered t, (SELECT unnest([-0.05, 0.0, 0.05])::DOUBLE AS shift) w WHERE publication_status = 'published'), r AS (SELECT *, row_number() OVER (PARTITION BY shift ORDER BY {_R('score', 6)} DESC, id) AS k FROM s),
  t AS (SELECT shift, id, k FROM r WHERE k <= 25) SELECT a.shift, count(b.id) AS common, {_R('coalesce(sum(abs(a.k - b.k)) / nullif(count(b.id), 0) / 25, 1.0)', 4)} AS moved FROM t a LEFT JOIN t b ON a.id = b.id AND b.shift = 0 WHERE a.shift <> 0 GROUP BY a.shift""")
def weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the best 25 move if weights shift; all shifts in one pass."""
    t = tiered(spark, sf_dir).where("publication_status = 'published'").select("id", "points", "n_metrics").withColumn("shift", F.explode(F.array(*map(F.lit, (-0.05, 0.0, 0.05)))))
    s = t.withColumn("score", half_up((0.5 + F.col("shift")) * F.col("points") + (0.5 - F.col("shift")) * F.col("n_metrics"), 6))
    r = s.withColumn("k", F.row_number().over(Window.partitionBy("shift").orderBy(F.desc("score"), "id"))).where("k <= 25").select("shift", "id", "k")
    base = r.where("shift = 0").select("id", F.col("k").alias("k0"))
    g = r.where("shift <> 0").join(base, "id", "left").groupBy("shift").agg(F.count("k0").alias("common"), F.sum(F.abs(F.col("k") - F.col("k0"))).alias("d"))
    return g.select("shift", "common", half_up(F.coalesce(F.try_divide(F.col("d"), "common") / 25, F.lit(1.0)), 4).alias("moved"))


_ENTITIES = r"""WITH RECURSIVE m AS (SELECT page_id AS id, trim(regexp_replace(lower(coalesce(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'i'), '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS name,
    coalesce(regexp_extract(lower(url), '^https?://(?:[^/:?#]*\.)?([^./:?#]+\.example\.[a-z]+)', 1), '') AS domain FROM pages),
  w AS (SELECT *, string_split(name, ' ') AS words FROM m),
  k AS (SELECT * FROM (SELECT id, 0 AS kind, name AS value FROM w UNION ALL SELECT id, 1, domain FROM w
    UNION ALL SELECT id, 2, array_to_string(words[1:4], ' ') FROM w WHERE len(words) > 4) WHERE value <> ''),
  e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b USING (kind, value)),
  r AS (SELECT id, id AS root FROM m UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a),
  c AS (SELECT id, min(root) AS entity FROM r GROUP BY 1),
  n AS (SELECT entity, name, count(*) AS c FROM c JOIN m USING (id) GROUP BY 1, 2),
  t AS (SELECT entity, name AS canonical, sum(c) OVER (PARTITION BY entity) AS size, row_number() OVER (PARTITION BY entity ORDER BY name = '', c DESC, length(name), name) AS place FROM n),
  b AS (SELECT DISTINCT k.kind, k.value FROM k JOIN m USING (id) JOIN c USING (id) JOIN t USING (entity) WHERE place = 1 AND name = canonical),
  v AS (SELECT k.id, min(kind) AS kind FROM k JOIN b USING (kind, value) GROUP BY 1)
  SELECT m.id, name, entity, canonical, CASE WHEN name = canonical THEN 'itself' ELSE coalesce(['name', 'domain', 'beginning'][v.kind + 1], 'chain') END AS via, CAST(size AS BIGINT) AS size
  FROM m JOIN c USING (id) JOIN t USING (entity) LEFT JOIN v ON m.id = v.id WHERE place = 1"""


@query(_ENTITIES)
def organization_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose pages are whose: by the same title, the same domain, or titles that begin alike, along chains."""
    title = F.regexp_extract("html", "(?i)<title[^>]*>([^<]*)</title>", 1)
    domain = F.regexp_extract(F.lower("url"), r"^https?://(?:[^/:?#]*\.)?([^./:?#]+\.example\.[a-z]+)", 1)
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), E.plain_name(title).alias("name"), domain.alias("domain"))
    return E.entities(p, {"name": F.col("name"), "domain": F.col("domain"), "beginning": E.beginning(F.col("name"), 4)})
