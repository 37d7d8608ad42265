"""Queries about duplicates, relations, joins and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.rules import families
from factloom.operators import linking as L
from factloom.plans.catalog import query
from factloom.plans.extraction import _FAMILIES, _T
from factloom.sources.tables import metrics, notes, records, table

#: Aliases and keywords of kinds of parts.
ALIASES = {"standard anodized": "standard", "promo": "promotional", "economy plated": "economy"}
KEYWORDS = [("promo", "promotional"), ("econom", "economy"), ("standard", "standard"), ("small", "small"), ("medium", "medium"), ("large", "large")]


@query("WITH h AS (SELECT doc_id, sha256(text) AS k FROM documents), f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k HAVING count(*) > 1) SELECT first, doc_id AS other FROM h JOIN f USING (k) WHERE doc_id > first")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents by content hash."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    return L.first_with_others(d, "k", "doc_id")


@query("""WITH t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+'))) AS w FROM documents), c AS (SELECT *, min(doc_id) OVER (PARTITION BY w) AS class FROM t), s AS (SELECT doc_id, w, len(w) AS n FROM c WHERE doc_id = class AND len(w) > 0),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) WHERE 100 * len(list_intersect(a.w, b.w)) >= 85 * greatest(a.n, b.n)),
  l AS (SELECT a AS class, count(*) AS k FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1) SELECT doc_id, class, coalesce(k, 0) AS linked_classes FROM c LEFT JOIN l USING (class)""".replace("\\\\", "\\"))
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of equal word sets, and how many other classes share 85 % of the larger one's words with it."""
    found = L.near_classes(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 85)
    return found.select(F.col("id").alias("doc_id"), "class", F.col("links").alias("linked_classes"))


@query("WITH r AS (SELECT id, lower(organization_name) AS org FROM records WHERE organization_name <> ''), f AS (SELECT org, min(id) AS first FROM r GROUP BY org HAVING count(*) > 1) SELECT first, id AS other FROM r JOIN f USING (org) WHERE id > first")
def same_case_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further records of an organization, with its first."""
    return L.first_with_others(records(spark, sf_dir).where("organization_name <> ''").select("id", F.lower("organization_name").alias("org")), "org", "id")


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY record_id, seq) AS i, record_id % 500 AS subject, CASE WHEN percentage_change IS NULL THEN 'neutral' WHEN percentage_change >= 5 THEN 'up' ELSE 'down' END AS direction FROM metrics WHERE record_id <= 3000),
  p AS (SELECT a.subject, CASE WHEN a.direction = b.direction THEN 'supports' ELSE 'contradicts' END AS relation FROM c a JOIN c b ON a.subject = b.subject AND a.i < b.i WHERE a.direction <> 'neutral' AND b.direction <> 'neutral')
  SELECT 'case ' || subject AS subject, relation, count(*) AS n, CASE relation WHEN 'supports' THEN 0.7 ELSE 0.5 END AS confidence FROM p GROUP BY 1, 2""".replace(" WHERE record_id <= 3000", ""))
def claim_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often claims on a subject support and contradict each other."""
    direction = F.when(F.col("percentage_change").isNull(), "neutral").when(F.col("percentage_change") >= 5, "up").otherwise("down")
    return L.relations(metrics(spark, sf_dir).select(F.concat(F.lit("Case "), (F.col("record_id") % 500).cast("string")).alias("subject"), direction.alias("direction")))


@query("""WITH t AS (SELECT id, lower(organization_name) AS org, list_distinct([workflow, business_function, industry, geography]) AS w FROM records WHERE organization_name <> ''),
  s AS (SELECT id, org, list_filter(w, lambda x: x <> '') AS w FROM t) SELECT id FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.org = a.org AND b.id <> a.id AND len(list_intersect(a.w, b.w)) >= 2)""")
def sibling_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share two words with another of their organization."""
    words = F.filter(F.array("workflow", "business_function", "industry", "geography"), lambda x: x != "")
    return L.siblings(records(spark, sf_dir).select("id", F.col("organization_name").alias("organization"), words.alias("words")))


@query("SELECT id, count(m.record_id) AS n_metrics, coalesce(string_agg(m.seq || ':' || m.metric_name, ',' ORDER BY m.seq), '') AS metrics FROM records r LEFT JOIN metrics m ON r.id = m.record_id GROUP BY id")
def left_nest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with all their metrics."""
    n = L.nested(records(spark, sf_dir).select("id"), metrics(spark, sf_dir), "id", "record_id", "seq", "m", ["metric_name"])
    return n.select("id", F.size("m").cast("long").alias("n_metrics"), F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["metric_name"])), ",").alias("metrics"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS large FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a pending order, and whether they have a large one."""
    c, o = table(spark, sf_dir, "customer", "c_custkey"), table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus")
    large = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("large", F.lit(True))
    left = c.join(o.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return left.join(large, "c_custkey", "left").select("c_custkey", F.coalesce("large", F.lit(False)).alias("large"))


@query("SELECT r.id, m.metric_name AS first_metric, m.value_type FROM records r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY seq, partkey, suppkey) AS k FROM metrics) m ON r.id = m.record_id AND m.k = 1")
def first_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's first metric, by an aggregate in place of a sort."""
    first = metrics(spark, sf_dir).groupBy(F.col("record_id").alias("id")).agg(F.min_by(F.struct("metric_name", "value_type"), F.struct("seq", "partkey", "suppkey")).alias("m"))
    return records(spark, sf_dir).select("id").join(first, "id", "left").select("id", F.col("m.metric_name").alias("first_metric"), "m.value_type")


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(p_type || CASE p_partkey % 3 WHEN 0 THEN ' (new)' ELSE '' END), '\\([^)]*\\)', '', 'g'), '[_\\-/]', ' ', 'g'), '\\s+', ' ', 'g'))"
_ALIAS = "CASE k " + " ".join(f"WHEN '{a}' THEN '{v}'" for a, v in ALIASES.items()) + " END"
_WORD = "CASE " + " ".join(f"WHEN contains(k, '{w}') THEN '{v}'" for w, v in KEYWORDS) + " END"


@query(f"SELECT coalesce({_ALIAS}, {_WORD}, k) AS value, CASE WHEN {_ALIAS} IS NOT NULL THEN 1.0 WHEN {_WORD} IS NOT NULL THEN 0.7 ELSE 0.3 END AS confidence, CASE WHEN {_ALIAS} IS NOT NULL THEN 'alias' WHEN {_WORD} IS NOT NULL THEN 'keyword' ELSE 'raw' END AS method, count(*) AS n FROM (SELECT {_CLEAN} AS k FROM part) GROUP BY 1, 2, 3")
def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts on a vocabulary, with confidence and method."""
    raw = F.concat("p_type", F.when(F.col("p_partkey") % 3 == 0, " (new)").otherwise(""))
    return table(spark, sf_dir, "part", "p_partkey", "p_type").select(L.canonical(raw, ALIASES, KEYWORDS).alias("c")).groupBy("c.value", "c.confidence", "c.method").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN employee_count < 10 THEN '<10' WHEN employee_count < 50 THEN '10-50' WHEN employee_count < 200 THEN '50-200' WHEN employee_count < 1000 THEN '200-1000' WHEN employee_count < 10000 THEN '1000-10000' WHEN employee_count IS NOT NULL THEN '10000+' END AS band, count(*) AS n FROM records GROUP BY 1")
def employee_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by band of size."""
    from factloom.functions.rules import employee_band

    return records(spark, sf_dir).groupBy(employee_band(F.col("employee_count")).alias("band")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 100000, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 0), m AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE upper(c_mktsegment) END AS c_mktsegment FROM n)
  SELECT coalesce(c.c_custkey, m.c_custkey) AS c_custkey, coalesce(m.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(nullif(m.c_mktsegment, ''), c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN m ON c.c_custkey = m.c_custkey""")
def upsert_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that never blank a value, and new rows."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    n = c.where("c_custkey % 2 = 0").unionAll(c.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 100000))
    m = n.select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.upper("c_mktsegment")).alias("c_mktsegment"))
    return L.merged_non_empty(c, m, "c_custkey")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM orders JOIN customer c ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier s ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.1),
  w AS (SELECT 0 AS node, 0 AS depth UNION SELECT l.dst, w.depth + 1 FROM w JOIN l ON l.src = w.node WHERE w.depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def link_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations within three steps of nation 0 over large, cheap deliveries."""
    o, c = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_discount").where("l_quantity >= 50 AND l_discount >= 0.1")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    links = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()
    return L.reachable(links, spark.createDataFrame([(0,)], "node int"), 3)


_NAMES = "CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || ' Holdings' WHEN 2 THEN substr(c_name, 1, 11) ELSE 'Unheard of ' || c_custkey END"


@query(f"""WITH a AS (SELECT DISTINCT n AS name, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS a FROM (SELECT {_NAMES} AS n FROM customer)), r AS (SELECT DISTINCT c_name AS entry, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS r FROM customer WHERE c_custkey % 3 = 0)
  SELECT name, min(entry) AS entry FROM a JOIN r ON a = r OR (length(r) >= 4 AND starts_with(a, r)) OR (length(a) >= 4 AND starts_with(r, a)) GROUP BY name""")
def registry_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are registered, or begin as a registered one does."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return L.prefix_matches(c.select(F.expr(_NAMES).alias("name")), c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name")))


@query(f"""WITH f AS (SELECT r.id, result_status IN ('successful', 'partial') AS good, {_FAMILIES} AS f FROM records r JOIN (SELECT id, {_T} AS t FROM notes) n ON n.id = r.id), c AS (SELECT list_sort(f) AS f, count(*) AS n, count(*) FILTER (good) AS g FROM f GROUP BY 1),
  t AS (SELECT a.f, sum(b.n) AS n, sum(b.g) AS g FROM c a JOIN c b ON len(list_intersect(a.f, b.f)) > 0 GROUP BY a.f), x AS (SELECT id, good, coalesce(n - 1, 0) AS peers, g - CAST(good AS INT) AS pos FROM f LEFT JOIN t ON t.f = list_sort(f.f))
  SELECT id, CAST(peers AS BIGINT) AS peers, CASE WHEN peers <= 0 THEN 50 WHEN pos / peers >= 0.8 THEN 90 WHEN pos / peers >= 0.5 THEN 70 WHEN pos / peers >= 0.3 THEN 50 ELSE 30 END AS score FROM x""")
def family_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the other records with any family in common went."""
    good = F.col("result_status").isin("successful", "partial")
    r = records(spark, sf_dir).select("id", good.alias("good")).join(notes(spark, sf_dir).select("id", families(F.col("note")).alias("families")), "id")
    return L.kin_consistency(r)
