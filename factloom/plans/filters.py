"""Queries that pick, project and nest records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.operators import filters as P
from factloom.operators import linking as L
from factloom.plans.catalog import query
from factloom.plans.extraction import _FAMILIES, _T
from factloom.sources.tables import metrics, notes, records, table

_JSON = f"SELECT id, CASE WHEN len(f) = 0 THEN '[]' ELSE '[\"' || array_to_string(f, '\",\"') || '\"]' END AS families FROM (SELECT id, {_FAMILIES} AS f FROM (SELECT id, {_T} AS t FROM notes))"


@query(f"""WITH j AS ({_JSON}) SELECT count(*) FILTER (families IS NOT NULL AND families <> '[]') AS non_empty, count(*) FILTER (families ILIKE '%"training"%' OR families ILIKE '%"governance"%') AS member, count(*) FILTER (families ILIKE '%ai%') AS inside,
  count(*) FILTER (families ILIKE '%"ai"%') AS strict, (SELECT count(*) FROM records WHERE nullif(result_status, 'unknown') NOT IN ('failed', 'abandoned')) AS not_negative, (SELECT count(*) FROM records WHERE source_url LIKE 'http%') AS linked FROM j""")
def json_array_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass the filters over lists kept as JSON text: non-empty, with a member, with a part of a member; statuses that aren't negative (a null one drops); and links."""
    text = notes(spark, sf_dir).select("id", F.to_json(R.families(F.col("note"))).alias("families"))
    lists = P.json_list("families")
    found = text.agg(F.count_if(F.size(lists) > 0).alias("non_empty"), F.count_if(P.has_member(lists, "Training") | P.has_member(lists, "governance")).alias("member"), F.count_if(P.has_part(lists, "AI")).alias("inside"), F.count_if(P.has_member(lists, "ai")).alias("strict"))
    status = F.nullif("result_status", F.lit("unknown"))
    other = records(spark, sf_dir).agg(F.count_if(~status.isin("failed", "abandoned")).alias("not_negative"), F.count_if(F.startswith("source_url", F.lit("http"))).alias("linked"))
    return found.crossJoin(other)  # one row each


@query("""WITH c AS (SELECT r.id, r.extracted_at, n.note FROM records r LEFT JOIN notes n ON n.id = r.id WHERE (richness IN ('thin', 'usable') OR employee_count IS NULL OR geography = '') AND lessons_learned = '' AND implementation_pattern = '' AND r.id % 97 <> 0 ORDER BY extracted_at, r.id LIMIT 500)
  SELECT id, length(note) AS chars FROM c WHERE length(note) >= 120""")
def enrichment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 oldest unclaimed records that lack something, with their documents; too short texts go after the limit."""
    claimed = records(spark, sf_dir).where("id % 97 = 0").select("id")
    lacking = F.coalesce(F.col("richness").isin("thin", "usable"), F.lit(True)) | F.col("employee_count").isNull() | (F.col("geography") == "")
    open_ = records(spark, sf_dir).where(lacking & (F.col("lessons_learned") == "") & (F.col("implementation_pattern") == "")).join(claimed, "id", "left_anti").select("id", "extracted_at")
    oldest = open_.orderBy("extracted_at", "id").limit(500)
    return oldest.join(notes(spark, sf_dir), "id", "left").where(F.length("note") >= 120).select("id", F.length("note").alias("chars"))


@query("SELECT CASE WHEN fit >= 55 THEN 'direct' WHEN fit >= 35 THEN 'supporting' ELSE 'adjacent' END AS band, count(*) AS n FROM (SELECT (id * 7) % 100 AS fit FROM records) WHERE fit >= 0 GROUP BY 1")
def relevance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by band of their fit (0 to 99)."""
    return records(spark, sf_dir).groupBy(P.relevance_band((F.col("id") * 7) % 100).alias("band")).agg(F.count("*").alias("n"))


_NORMALIZED = "SELECT id, source_url, note, id % 3 = 0 AS has_document, CASE WHEN geography = '' OR id % 4 = 0 THEN NULL ELSE (id % 10) / 10 END AS geo, CASE WHEN employee_count IS NULL THEN NULL ELSE (id % 7) / 7 END AS size, id % 31 = 0 AS done FROM records JOIN notes USING (id)"


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their attributes as a map of (value, confidence)."""
    r = records(spark, sf_dir).join(notes(spark, sf_dir), "id")
    entry = lambda name, value, known, sure: F.when(known, F.create_map(F.lit(name), F.struct(value.cast("string").alias("value"), sure.alias("confidence")))).otherwise(F.create_map().cast("map<string,struct<value:string,confidence:double>>"))
    geo = entry("geography", F.col("geography"), (F.col("geography") != "") & (F.col("id") % 4 != 0), F.col("id") % 10 / 10)
    size = entry("employee_count", F.col("employee_count"), F.col("employee_count").isNotNull(), F.col("id") % 7 / 7)
    return r.select("id", "source_url", "note", (F.col("id") % 3 == 0).alias("has_document"), F.map_concat(geo, size).alias("normalized"), (F.col("id") % 31 == 0).alias("done"))


@query(f"""WITH n AS ({_NORMALIZED}) SELECT id, CASE WHEN has_document AND length(trim(note)) >= 80 THEN 2 WHEN regexp_matches(source_url, '^https?://') THEN 1 ELSE 0 END AS source_rank FROM n
  WHERE NOT done AND NOT (coalesce(geo >= 0.5, false) AND coalesce(size >= 0.5, false)) ORDER BY source_rank DESC, id LIMIT 300""")
def recovery_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose place or size is missing or doubtful, those with a document's text first, then those with a link."""
    open_ = _normalized(spark, sf_dir).where(~F.col("done") & ~(P.known("normalized", "geography") & P.known("normalized", "employee_count")))
    return open_.select("id", P.source_rank("note", "has_document", "source_url").alias("source_rank")).orderBy(F.desc("source_rank"), "id").limit(300)


@query(f"""WITH n AS ({_NORMALIZED}) SELECT n.id, array_to_string(list_filter([CASE WHEN geo >= 0.7 THEN geography END, CASE WHEN size >= 0.7 THEN CAST(employee_count AS VARCHAR) END], lambda x: x IS NOT NULL), ',') AS sure FROM n JOIN records r ON r.id = n.id""")
def confident_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of each record that are sure enough (0.7), joined by commas."""
    return _normalized(spark, sf_dir).select("id", F.array_join(P.confident("normalized", 0.7), ",").alias("sure"))


@query("SELECT r_regionkey AS region, r_name AS name, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS milestones, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def phase_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases (regions) with their milestones (nations) nested in their order."""
    nested = L.nested(table(spark, sf_dir, "region", "r_regionkey", "r_name"), table(spark, sf_dir, "nation"), "r_regionkey", "n_regionkey", "n_nationkey", "milestones", ["n_name"])
    line = F.transform("milestones", lambda m: F.concat_ws(":", m["n_nationkey"].cast("string"), m["n_name"]))
    return nested.select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"), F.nullif(F.array_join(line, ","), F.lit("")).alias("milestones"), F.size("milestones").cast("bigint").alias("n"))


@query("""SELECT r.id, substr(n.note, 1, 300) AS problem, length(substr(n.note, 1, 500)) AS description_chars, r.organization_name, coalesce(m.n, 0) AS n_metrics, coalesce(m.names, '') AS metrics FROM records r JOIN notes n ON n.id = r.id
  LEFT JOIN (SELECT record_id, count(*) AS n, string_agg(metric_name || '=' || coalesce(CAST(percentage_change AS VARCHAR), ''), ';' ORDER BY seq, partkey, suppkey) AS names FROM metrics GROUP BY 1) m ON m.record_id = r.id WHERE r.publication_status = 'published'""")
def candidate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published records as candidates: texts cut for display, metrics nested."""
    m = metrics(spark, sf_dir).select("record_id", "seq", "partkey", "suppkey", "metric_name", "percentage_change")
    r = records(spark, sf_dir).where("publication_status = 'published'").select("id", "organization_name").join(notes(spark, sf_dir), "id")
    own = m.groupBy(F.col("record_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", "partkey", "suppkey", "metric_name", "percentage_change"))).alias("own"))
    line = F.transform("own", lambda x: F.concat(x["metric_name"], F.lit("="), F.coalesce(x["percentage_change"].cast("string"), F.lit(""))))
    return r.join(own, "id", "left").select("id", F.substring("note", 1, 300).alias("problem"), F.length(F.substring("note", 1, 500)).alias("description_chars"), "organization_name", F.greatest(F.coalesce(F.size("own"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_metrics"), F.coalesce(F.array_join(line, ";"), F.lit("")).alias("metrics"))


@query("SELECT conv_id, string_agg(role || ':' || substr(text, 1, 600), '|' ORDER BY turn) AS passages, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE conv_id % 10 = 3) WHERE k <= 10 GROUP BY conv_id")
def implementation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages looked up by id, with ten passages (turns) at most, cut to 600 characters."""
    turns = table(spark, sf_dir, "conversations").where("conv_id % 10 = 3").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("k <= 10")
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(":"), F.substring("text", 1, 600)).alias("line")))).alias("own"))
    return own.select("conv_id", F.array_join(F.transform("own", lambda x: x["line"]), "|").alias("passages"), F.size("own").cast("bigint").alias("n"))


@query("""WITH u AS (SELECT url, 1 AS priority, page_id AS ordinal FROM pages UNION ALL SELECT regexp_replace(source_url, '/[0-9]+$', '') AS url, 2, id FROM records WHERE source_url <> '' UNION ALL SELECT url, 3, page_id FROM pages),
  d AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority, ordinal) AS k FROM u) SELECT url, priority, ordinal FROM d WHERE k = 1 ORDER BY priority, ordinal, url LIMIT 200""")
def discovered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of several sources, each once (from the source that comes first), 200 at most."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    own = records(spark, sf_dir).where("source_url <> ''").select(F.regexp_replace("source_url", "/[0-9]+$", "").alias("url"), F.col("id").alias("ordinal"))
    return P.first_by_url([pages.select("url", F.col("page_id").alias("ordinal")), own, pages.select("url", F.col("page_id").alias("ordinal"))], 200)


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS status, count(*) AS n FROM orders GROUP BY 1")
def retry_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items by status after the failed ones are pending again."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "open").otherwise("done")
    return P.retried(table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("id"), status.alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


_GAP_COLUMNS = "workflow, business_function, total"


@query(f"WITH g AS (SELECT coalesce(nullif(workflow, ''), 'uncategorized') AS workflow, coalesce(nullif(business_function, ''), 'uncategorized') AS business_function, count(*) AS total FROM records GROUP BY 1, 2) SELECT {_GAP_COLUMNS} FROM g")
def public_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap report without its directives."""
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("uncategorized")).alias(c)
    g = records(spark, sf_dir).groupBy(named("workflow"), named("business_function")).agg(F.count("*").alias("total"))
    full = g.select(F.struct("workflow", "business_function", "total", F.struct(F.lit(5).alias("records_needed"), F.array(F.lit("x")).alias("search_terms")).alias("directives"), F.lit("fetch").alias("next_action")).alias("r"))
    return full.select(P.public(F.col("r")).alias("r")).select("r.*")


_X = "SELECT r.id, organization_name, business_function AS problem, workflow AS title, richness, list({'n': metric_name, 'b': baseline_value, 'p': post_value, 'd': absolute_change} ORDER BY seq, partkey, suppkey) FILTER (m.record_id IS NOT NULL) AS outcomes FROM records r LEFT JOIN metrics m ON m.record_id = r.id GROUP BY ALL"
_DECISION = """CASE WHEN organization_name = '' OR problem = '' OR title = '' OR outcomes IS NULL THEN 'quarantine: missing_required_fields' WHEN len(list_filter(outcomes, lambda x: coalesce(x.b, 0) <> 0 AND coalesce(x.p, 0) <> 0 AND x.d IS NOT NULL AND abs(x.b - x.p) <> abs(x.d))) > 0 THEN 'quarantine: contradictory_fields' ELSE 'accept: all_checks_passed' END"""


def _extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir).groupBy(F.col("record_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", "partkey", "suppkey", "metric_name", "baseline_value", "post_value", "absolute_change"))).alias("outcomes"))
    return records(spark, sf_dir).select("id", "organization_name", F.col("business_function").alias("problem"), F.col("workflow").alias("title")).join(m, "id", "left")


@query(f"WITH x AS ({_X}) SELECT {_DECISION} AS verdict, count(*) AS n, min(id) AS first_id FROM x GROUP BY 1")
def extraction_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted records by verdict: quarantined if something required is missing, or if an outcome contradicts itself."""
    return _extractions(spark, sf_dir).groupBy(P.verdict().alias("verdict")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH x AS ({_X}), a AS (SELECT id, unnest(outcomes) AS o FROM x WHERE {_DECISION} LIKE 'accept%') SELECT o.n AS metric_name, count(*) AS n, count(DISTINCT id) AS documents FROM a GROUP BY 1")
def accepted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the accepted records: extractions joined with their verdicts, then flattened."""
    x = _extractions(spark, sf_dir)
    verdicts = x.select("id", P.verdict().alias("verdict"))
    flat = x.join(verdicts.where(F.startswith("verdict", F.lit("accept"))), "id").select("id", F.explode("outcomes").alias("o"))
    return flat.groupBy(F.col("o.metric_name").alias("metric_name")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("documents"))


@query("SELECT d.doc_id, p.url, p.page_id FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def document_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the address of their page, if there is one."""
    return table(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "pages", "page_id", "url"), F.col("doc_id") == F.col("page_id"), "left")
