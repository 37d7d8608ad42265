"""Queries that rank and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.rules import half_up
from factloom.operators import ranking as K
from factloom.operators import scoring as S
from factloom.operators import topk as N
from factloom.plans.catalog import query
from factloom.plans.coverage import _R, _TIERED, _gaps, _GAPS, tiered
from factloom.sources.tables import metrics, records, saved, table


@query("""WITH s AS (SELECT id, organization_name, CAST(floor(total_price) AS BIGINT) AS score FROM records), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(lower(organization_name), ''), '#' || id) ORDER BY score DESC, id) AS k FROM s)
  SELECT id, organization_name, score FROM r WHERE k = 1 ORDER BY score DESC, id LIMIT 25""")
def topk_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best records, one an organization."""
    s = records(spark, sf_dir).select("id", "organization_name", F.floor("total_price").alias("score"))
    return K.best_per_entity(s, "organization_name", "score", "id", 25)


@query("""WITH s AS (SELECT id, organization_name, CAST(floor(total_price) AS BIGINT) AS score FROM records WHERE workflow = 'fraud_detection' AND geography IN ('nation_1', 'france', 'nation_2', 'china')), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(lower(organization_name), ''), '#' || id) ORDER BY score DESC, id) AS k FROM s),
  a AS (SELECT * FROM r WHERE k = 1 ORDER BY score DESC, id LIMIT 1000), b AS (SELECT * FROM r WHERE k > 1 ORDER BY score DESC, id LIMIT greatest(0, 900 - (SELECT count(*) FROM a))) SELECT id, organization_name, score FROM a UNION ALL SELECT id, organization_name, score FROM b""".replace(" AND geography IN ('nation_1', 'france', 'nation_2', 'china')", ""))
def backfill_to_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record an organization, filled up to 900 with their next best."""
    s = records(spark, sf_dir).where("workflow = 'fraud_detection'").select("id", "organization_name", F.floor("total_price").alias("score"))
    return K.best_per_entity(s, "organization_name", "score", "id", 1000, 900)


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER w AS rank, s_acctbal - lead(s_acctbal) OVER w AS gap FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey))
  SELECT s_nationkey, s_suppkey, rank, CASE rank WHEN 1 THEN 'recommended' ELSE 'alternative' END AS label, coalesce(gap < 500 AND rank < 3, false) AS close FROM r WHERE rank <= 3""")
def rank_close_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three richest suppliers of each nation, and close calls."""
    return K.close_calls(table(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey", "s_acctbal"), "s_nationkey", "s_acctbal", "s_suppkey", 3, 500)


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+'))"
_SCORES = f"""q AS (SELECT item_id AS query, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), qw AS (SELECT query, len(w) AS nq, unnest(w) AS word FROM q), dw AS (SELECT id, len(w) AS nd, unnest(w) AS word FROM d),
  scores AS (SELECT query, id, count(*) AS shared, count(*) / greatest(max(nq), max(nd)) AS score FROM qw JOIN dw USING (word) GROUP BY query, id), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scores)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark", "item_id", "text").select(F.col("item_id").alias("id"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {_SCORES} SELECT query, id, shared, {_R('score', 6)} AS score, rank FROM ranked WHERE rank <= 10")
def retrieval_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents nearest to each benchmark item by words."""
    best, _ = N.nearest(_asked(spark, sf_dir), _docs(spark, sf_dir), 10)
    return best.select("query", "id", "shared", half_up(F.col("score"), 6).alias("score"), "rank")


@query(f"""WITH {_SCORES}, l AS (SELECT query, id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS label FROM scores JOIN labels ON doc_id = id), t AS (SELECT query, count(*) AS relevant FROM l WHERE label = 'relevant' GROUP BY 1),
  h AS (SELECT query, k, count(*) FILTER (label = 'relevant') AS hit, count(*) FILTER (coalesce(label, 'irrelevant') = 'irrelevant') AS miss FROM ranked LEFT JOIN l USING (query, id) CROSS JOIN (SELECT unnest([10, 25, 50]) AS k) WHERE rank <= k GROUP BY 1, 2),
  s AS (SELECT k, floor(hit * 1000000 / k) AS p, floor(hit * 1000000 / relevant) AS r, floor(miss * 1000000 / k) AS i FROM h JOIN t USING (query)) SELECT k, {_R('sum(p) / count(*) / 1000000', 4)} AS precision, {_R('sum(r) / count(*) / 1000000', 4)} AS recall, {_R('sum(i) / count(*) / 1000000', 4)} AS irrelevant FROM s GROUP BY k""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and share of irrelevant at 10, 25 and 50; documents of good quality count as relevant."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("doc_id", "id")
    good = labels.where("quality = 1").select("id", F.lit(True).alias("good"))
    best, sharing = N.nearest(_asked(spark, sf_dir), _docs(spark, sf_dir).join(good, "id", "left"), 50, count_where=F.col("good"))
    best = saved(best)
    label = F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant")
    return K.at_k(best, best.join(labels, "id").select("query", "id", label.alias("label")), [10, 25, 50], sharing.withColumnRenamed("n", "relevant"))


@query(f"""WITH {_SCORES}, other AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY shared DESC, id) AS rank FROM scores), a AS (SELECT * FROM ranked WHERE rank <= 25), b AS (SELECT * FROM other WHERE rank <= 25),
  m AS (SELECT a.query, sum(abs(a.rank - b.rank)) AS d, count(*) AS n FROM a JOIN b ON a.query = b.query AND a.id = b.id GROUP BY 1) SELECT q.query, {_R('coalesce(d / n / 25, 1.0)', 4)} AS moved FROM (SELECT DISTINCT query FROM a) q LEFT JOIN m USING (query)""")
def rank_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far ranks move if shared words are counted and not weighed."""
    best = lambda by: N.nearest(_asked(spark, sf_dir), _docs(spark, sf_dir), 25, by=by)[0]
    return K.displacement(saved(best("share")), best("count"), 25)


def _steps(x: str, *pairs: tuple[float, float], otherwise: float) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b} THEN {v}::DOUBLE" for b, v in pairs) + f" ELSE {otherwise}::DOUBLE END"


_PARTS = {
    "source_credibility": "CASE WHEN vendor_reported THEN 0.3::DOUBLE WHEN independently_verified THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END",
    "measured_outcomes": f"CASE WHEN n_metrics = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, {_steps('n_metrics', (3, 1.0), (2, 0.8), (1, 0.5), otherwise=0.0)} + CASE WHEN with_baseline AND with_post THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN with_percent THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN with_absolute THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) END",
    "outcome_impact": "CASE WHEN n_metrics = 0 THEN 0.0::DOUBLE WHEN n_numeric = 0 THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN with_baseline THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN sustained THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN positive THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) END",
    "sample_size": f"CASE WHEN coalesce(sample_size, 0) = 0 THEN 0.3::DOUBLE ELSE {_steps('sample_size', (1000, 1.0), (100, 0.8), (10, 0.6), otherwise=0.4)} END",
    "independent_validation": "CASE WHEN independently_verified THEN 1.0::DOUBLE WHEN NOT vendor_reported THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END",
    "outcome_specificity": f"CASE WHEN n_metrics = 0 THEN 0.0::DOUBLE ELSE {_steps('n_numeric / n_metrics', (0.8, 1.0), (0.5, 0.7), (0.1, 0.4), otherwise=0.1)} END",
    "recency": "CASE WHEN days <= 30 THEN 1.0::DOUBLE WHEN days <= 90 THEN 0.9::DOUBLE WHEN days <= 365 THEN 0.7::DOUBLE WHEN days <= 730 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END",
    "comparables": _steps("n_same", (100, 1.0), (50, 0.8), (10, 0.6), (1, 0.4), otherwise=0.2),
}


@query(f"""WITH {_TIERED}, n AS (SELECT workflow, count(*) - 1 AS n_same FROM tiered GROUP BY 1), x AS (SELECT t.*, n_same, date_diff('day', CAST(extracted_at AS DATE), DATE '2001-01-01') AS days FROM tiered t JOIN n USING (workflow))
  SELECT id, CAST(floor(({' + '.join(f'({p}) * {S.EVIDENCE_WEIGHTS[n]}' for n, p in _PARTS.items())}) / 100.0::DOUBLE * 100 + 0.5) AS INTEGER) AS score FROM x""")
def evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence score of each record."""
    t = tiered(spark, sf_dir)
    n = t.groupBy("workflow").agg((F.count("*") - 1).alias("n_same"))
    return t.join(n, "workflow").select("id", S.evidence_score(S.evidence_parts(F.lit("2001-01-01").cast("date"), F.col("n_same"))).alias("score"))


_TERMS = "CASE WHEN q = '' OR t = '' THEN 0.0::DOUBLE WHEN q = t THEN 1.0::DOUBLE WHEN contains(t, q) OR contains(q, t) THEN 0.7::DOUBLE ELSE 0.5::DOUBLE * len(list_intersect(wq, wt)) / greatest(len(list_distinct(list_concat(wq, wt))), 1) END"


@query(f"""WITH p AS (SELECT * FROM (VALUES (1, 'customer_support', 'machinery', 500), (2, 'quality review', 'building', 90), (3, 'inventory_management', 'automobile', 12000)) v(profile, workflow, industry, size)),
  x AS (SELECT profile, r.id, p.workflow AS q, r.workflow AS t, p.industry = r.industry AS same, p.size, r.employee_count AS c FROM p CROSS JOIN records r WHERE r.publication_status = 'published'),
  y AS (SELECT *, list_distinct(list_filter(string_split(translate(q, '_-', '  '), ' '), lambda w: w <> '')) AS wq, list_distinct(list_filter(string_split(translate(t, '_-', '  '), ' '), lambda w: w <> '')) AS wt FROM x),
  s AS (SELECT profile, id, 0.25::DOUBLE * ({_TERMS}) + 0.1::DOUBLE * CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE * coalesce(CASE WHEN greatest(size, c) > 0 AND c IS NOT NULL THEN least(size, c)::DOUBLE / greatest(size, c) END, 0.0) AS s FROM y),
  r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY {_R('s', 6)} DESC, id) AS rank FROM s) SELECT profile, id, {_R('s', 6)} AS score, rank FROM r WHERE rank <= 20""")
def profile_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 published records most like each of three profiles, a literal query set sent to all tasks."""
    profiles = spark.createDataFrame([(1, "customer_support", "machinery", 500), (2, "quality review", "building", 90), (3, "inventory_management", "automobile", 12000)], "profile int, q string, qi string, size long")
    r = records(spark, sf_dir).where("publication_status = 'published'").select("id", "workflow", "industry", "employee_count")
    every = r.withColumn("p", F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in p.asDict().items())) for p in profiles.collect()))))
    score = S.SIMILARITY_WEIGHTS["workflow"] * S.term_similarity(F.col("p.q"), F.col("workflow")) + S.SIMILARITY_WEIGHTS["industry"] * F.when(F.col("p.qi") == F.col("industry"), 1.0).otherwise(0.0)
    size = F.when(F.col("employee_count").isNull(), 0.0).otherwise(S.size_similarity(F.col("p.size"), F.col("employee_count")))
    s = every.select("p.profile", "id", half_up(score + S.SIMILARITY_WEIGHTS["company_size"] * size, 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("score"), "id"))).where("rank <= 20")


@query(f"""WITH b AS (SELECT c_custkey, list_distinct(list(p_brand)) AS brands FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1), r AS (SELECT brands FROM b WHERE c_custkey = (SELECT min(c_custkey) FROM b))
  SELECT c_custkey, {_R('len(list_intersect(b.brands, r.brands)) / len(list_distinct(list_concat(b.brands, r.brands)))', 6)} AS jaccard FROM b, r""")
def dimension_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each customer's brands to the first customer's."""
    o, l, p = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey"), table(spark, sf_dir, "part", "p_partkey", "p_brand")
    b = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("p_brand").alias("brands"))
    first = b.agg(F.min_by("brands", "c_custkey")).scalar()
    return b.withColumn("ref", first).select("c_custkey", half_up(F.size(F.array_intersect("brands", "ref")) / F.size(F.array_union("brands", "ref")), 6).alias("jaccard"))


@query(f"""WITH {_TIERED}, r AS (SELECT id, tier, unnest([CASE WHEN n_numeric > 0 THEN 'outcome' END, CASE WHEN richness <> 'thin' THEN 'implementation' END, CASE WHEN result_status IN ('failed', 'abandoned') THEN 'counter' END, CASE WHEN independently_verified THEN 'validation' END, CASE WHEN workflow <> '' THEN 'context' END]) AS role FROM tiered),
  k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY id) AS k FROM r WHERE role IS NOT NULL) SELECT role, count(*) AS n, count(*) FILTER (tier = 'gold') AS gold, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (k <= 3) AS first_ids FROM k GROUP BY role""")
def evidence_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that records can play in a case, with the first three of each."""
    c = F.col
    role = F.array_compact(F.array(F.when(c("n_numeric") > 0, "outcome"), F.when(c("richness") != "thin", "implementation"), F.when(c("result_status").isin("failed", "abandoned"), "counter"), F.when(c("independently_verified"), "validation"), F.when(c("workflow") != "", "context")))
    r = tiered(spark, sf_dir).select("id", "tier", F.explode(role).alias("role"))
    part = r.groupBy("role", F.pmod(F.xxhash64("id"), F.lit(200)).alias("part")).agg(F.count("*").alias("n"), F.count_if(c("tier") == "gold").alias("gold"), F.slice(F.sort_array(F.collect_list("id")), 1, 3).alias("ids"))
    return part.groupBy("role").agg(F.sum("n").alias("n"), F.sum("gold").alias("gold"), F.array_join(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, 3), ",").alias("first_ids"))


@query(f"""WITH x AS (SELECT id, (id % 5000 + 100)::DOUBLE * (id % 30 + 1) / 60.0 * 40.0 AS labour, greatest(0.05::DOUBLE, least(0.7::DOUBLE, (id % 100) / 100.0::DOUBLE)) AS a, (id % 90 + 10) * 1000.0::DOUBLE AS build FROM records)
  SELECT id, {_R('labour', 2)} AS labour, {_R('labour * a', 2)} AS saving, {_R('build / (labour * a * 0.5) * 12', 2)} AS payback_months FROM x""")
def economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labour, savings and payback of automating each record's work."""
    i = F.col("id")
    e = S.economics((i % 5000 + 100).cast("double"), i % 30 + 1, F.lit(40.0), (i % 100) / 100.0, (i % 90 + 10) * 1000.0)
    return records(spark, sf_dir).select("id", *(half_up(c, 2).alias(n) for n, c in e.items()))


@query("""WITH x AS (SELECT record_id, seq, partkey, baseline_value::DOUBLE AS b, coalesce(post_value, 10)::DOUBLE AS c, (baseline_value - 20)::DOUBLE AS t FROM metrics WHERE baseline_value IS NOT NULL)
  SELECT CASE WHEN CASE WHEN t >= b THEN c >= t ELSE c <= t END THEN 'achieved' WHEN CASE WHEN t >= b THEN c >= b + (t - b) / 2 ELSE c <= b + (t - b) / 2 END THEN 'on_track' ELSE 'below_target' END AS status, count(*) AS n FROM x GROUP BY 1""")
def metric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by how near they are to a target 20 below the baseline."""
    m = metrics(spark, sf_dir).where("baseline_value IS NOT NULL")
    b = F.col("baseline_value").cast("double")
    return m.groupBy(S.metric_status(b, b - 20, F.coalesce("post_value", F.lit(10)).cast("double")).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {_GAPS} SELECT workflow, business_function, gap, impact FROM gaps ORDER BY impact DESC, workflow, business_function LIMIT 10")
def shopping_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten categories where more evidence would help most."""
    return _gaps(spark, sf_dir).select("workflow", "business_function", "gap", "impact").orderBy(F.desc("impact"), "workflow", "business_function").limit(10)


@query(f"""WITH {_TIERED}, v AS (SELECT result_status AS outcome, workflow, count(*) AS n, min(id) AS first_ FROM tiered WHERE workflow <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY n DESC, first_) AS k FROM v) SELECT workflow, outcome, n FROM r WHERE k <= 2""")
def outcome_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two commonest results of each workflow."""
    v = tiered(spark, sf_dir).where("workflow <> ''").groupBy("workflow", F.col("result_status").alias("outcome")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return v.withColumn("k", F.row_number().over(Window.partitionBy("workflow").orderBy(F.desc("n"), "first"))).where("k <= 2").select("workflow", "outcome", "n")
