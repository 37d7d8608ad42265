"""Queries that map terms onto vocabularies. The vocabularies are those of the tables at hand; the operators take any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.rules import employee_band
from factloom.operators import canonical as C
from factloom.operators import coverage
from factloom.operators import vocabulary as V
from factloom.plans.catalog import query
from factloom.sources.tables import notes, records, table

INDUSTRY_ALIASES = {"automobile": "automotive", "building": "construction", "household": "consumer_goods", "furniture": "manufacturing"}
INDUSTRY_KEYWORDS = [("machin", "manufacturing"), ("house", "consumer_goods"), ("auto", "automotive")]
PLACES = {"united states": "United States", "united kingdom": "United Kingdom", "germany": "Germany", "france": "France", "china": "China"}
FUNCTIONS = ["finance", "operations", "customer_support", "information_technology"]
FUNCTION_ALIASES = {"support": "customer_support", "it": "information_technology"}
VENDOR_ALIASES = {"brand#12": "vendor_12", "brand 12": "vendor_12", "brand 23": "vendor_23"}
VENDOR_KEYWORDS = [("brand 3", "vendor_3x"), ("brand", "other_vendor")]
WORKFLOW_ALIASES = {"invoice processing": "accounts_payable", "customer support": "ticketing", "code review": "software_delivery"}
WORKFLOW_KEYWORDS = [("processing", "back_office"), ("claims", "claims_handling"), ("claims processing", "claims"), ("review", "review"), ("detection", "monitoring"), ("management", "planning"), ("inspection", "quality"), ("service", "service_desk")]
TEXT_KEYWORDS = [("process", "process_work"), ("training", "training"), ("robot", "automation"), ("dashboard", "reporting"), ("team", "staff"), ("outsource", "sourcing")]


def _map(table_: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


def _first(pairs: list[tuple[str, str]], key: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({key}, '{k}') THEN '{v}'" for k, v in pairs) + " END"


def _earliest(pairs: list[tuple[str, str]], key: str) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN contains({key}, '{k}') THEN {{'at': instr({key}, '{k}'), 'l': {-len(k)}, 'v': '{v}'}} END" for k, v in pairs) + "], lambda x: x IS NOT NULL))[1].v"


def _clean(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(translate(regexp_replace(lower(trim({x})), '\([^)]*\)', '', 'g'), '_-', '  '), '\s+', ' ', 'g')), ' ?/ ?', '/', 'g')"


_LABEL = "CASE id % 4 WHEN 0 THEN upper(industry) || ' (Division)' WHEN 1 THEN industry || ' / ' || business_function WHEN 2 THEN 'Tank_Storage / ' || industry ELSE industry || '-goods' END"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", "geography", "business_function", "workflow", F.expr(_LABEL).alias("raw"))


@query(f"""WITH l AS (SELECT id, {_LABEL} AS raw FROM records), p AS (SELECT id, raw, unnest(list_filter(string_split({_clean('raw')}, '/'), lambda p: trim(p) <> '')) AS part, generate_subscripts(list_filter(string_split({_clean('raw')}, '/'), lambda p: trim(p) <> ''), 1) AS k FROM l),
  m AS (SELECT id, k, {_map(INDUSTRY_ALIASES, 'trim(part)')} AS exact, {_first(INDUSTRY_KEYWORDS, 'trim(part)')} AS word FROM p), c AS (SELECT *, CASE WHEN exact IS NOT NULL THEN 1.0 WHEN word IS NOT NULL THEN 0.7 ELSE 0.0 END AS conf FROM m),
  b AS (SELECT id, arg_min(coalesce(exact, word), [-conf, k]) AS best, CAST(sum(conf) AS DOUBLE) / count(*) AS mean, max(CAST(exact IS NOT NULL AS INT)) AS ex FROM c GROUP BY id)
  SELECT id, best AS value, CASE WHEN best IS NULL THEN 0.0 ELSE floor(mean * 1000 + 0.5) / 1000 END AS confidence, CASE WHEN ex = 1 THEN 'explicit' ELSE 'inferred' END AS method FROM b""")
def canonical_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry labels of one or more parts, as canonical industries."""
    return _labels(spark, sf_dir).select("id", C.industry(F.col("raw"), INDUSTRY_ALIASES, INDUSTRY_KEYWORDS).alias("e")).select("id", "e.*")


_RAW_PLACE = "CASE id % 3 WHEN 0 THEN replace(geography, ' ', '_') WHEN 1 THEN upper(geography) || ' (HQ)' ELSE '' END"
_RAW_FUNCTION = "CASE id % 3 WHEN 0 THEN business_function || ', sales' WHEN 1 THEN 'Customer Support' ELSE business_function END"


@query(f"""WITH l AS (SELECT id, {_RAW_PLACE} AS g, {_RAW_FUNCTION} AS f FROM records), k AS (SELECT *, {_map(PLACES, _clean('g'))} AS known, translate(lower(trim(f)), '- ', '__') AS k0 FROM l),
  x AS (SELECT *, CASE WHEN regexp_matches(k0, '[,/]') THEN regexp_replace(regexp_extract(k0, '^([^,/]*)', 1), '^[_ ]+|[_ ]+$', '', 'g') ELSE k0 END AS key FROM k), y AS (SELECT *, {_map(FUNCTION_ALIASES, 'key')} AS alias FROM x)
  SELECT id, CASE WHEN g = '' THEN '' ELSE coalesce(known, trim(g)) END AS place, CASE WHEN g = '' THEN 0.0 WHEN known IS NOT NULL THEN 1.0 ELSE 0.3 END AS place_confidence,
  CASE WHEN f = '' THEN '' WHEN key IN ({', '.join(f"'{n}'" for n in FUNCTIONS)}) THEN key ELSE coalesce(alias, key) END AS function, CASE WHEN f = '' THEN 0.0 WHEN key IN ({', '.join(f"'{n}'" for n in FUNCTIONS)}) THEN 1.0 WHEN alias IS NOT NULL THEN 0.9 ELSE 0.5 END AS function_confidence FROM y""")
def canonical_place_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and operational functions of records, with how sure they are."""
    r = records(spark, sf_dir).select("id", F.expr(_RAW_PLACE).alias("g"), F.expr(_RAW_FUNCTION).alias("f"))
    r = r.select("id", C.geography(F.col("g"), PLACES).alias("p"), C.function(F.col("f"), FUNCTIONS, FUNCTION_ALIASES).alias("e"))
    return r.select("id", F.col("p.value").alias("place"), F.col("p.confidence").alias("place_confidence"), F.col("e.value").alias("function"), F.col("e.confidence").alias("function_confidence"))


_BRAND = "p_brand || CASE p_partkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN '® (EU)' ELSE '' END"
_KEY = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(regexp_replace(regexp_replace(raw, '[®™©]|\(r\)|\(tm\)', ' ', 'gi'), '\([^)]*\)', ' ', 'g'), '_-/', '   ')), '\b(inc|corp|corporation|llc|ltd|co|company)\b\.?', ' ', 'g'), '[^a-z0-9+.& ]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT p_partkey AS id, {_BRAND} AS raw FROM part), k AS (SELECT id, raw, {_KEY} AS key FROM l), e AS (SELECT raw, key, {_map(VENDOR_ALIASES, 'key')} AS alias, {_first(VENDOR_KEYWORDS, 'key')} AS word FROM k)
  SELECT raw, coalesce(alias, word, CASE WHEN key <> '' THEN key ELSE raw END) AS value, CASE WHEN alias IS NOT NULL THEN 1.0 WHEN word IS NOT NULL THEN 0.7 ELSE 0.3 END AS confidence, count(*) AS n FROM e GROUP BY ALL""")
def canonical_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors' names as they are written, and the vendors they stand for."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand").select(F.expr(_BRAND).alias("raw"))
    return p.select("raw", C.product(F.col("raw"), VENDOR_ALIASES, VENDOR_KEYWORDS).alias("e")).groupBy("raw", F.col("e.value").alias("value"), F.col("e.confidence").alias("confidence")).agg(F.count("*").alias("n"))


_WF = f"SELECT id, workflow AS raw, {_clean('workflow')} AS key FROM records"
_SLUG = "regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH k AS ({_WF}), e AS (SELECT raw, {_map(WORKFLOW_ALIASES, 'key')} AS alias, {_earliest(WORKFLOW_KEYWORDS, 'key')} AS word FROM k)
  SELECT raw, CASE WHEN raw = '' THEN '' ELSE coalesce(alias, word, {_SLUG}) END AS value, CASE WHEN raw = '' THEN 0.0 WHEN alias IS NOT NULL THEN 1.0 WHEN word IS NOT NULL THEN 0.6 ELSE 0.3 END AS confidence, count(*) AS n FROM e GROUP BY ALL""")
def canonical_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows as they are written, and those they stand for: an alias, or the keyword that comes first."""
    r = records(spark, sf_dir).select(F.col("workflow").alias("raw"))
    return r.select("raw", C.workflow(F.col("raw"), WORKFLOW_ALIASES, WORKFLOW_KEYWORDS).alias("e")).groupBy("raw", F.col("e.value").alias("value"), F.col("e.confidence").alias("confidence")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT w.id, w.raw, {_map(WORKFLOW_ALIASES, 'w.key')} AS alias, {_earliest(WORKFLOW_KEYWORDS, 'w.key')} AS word, {_earliest(TEXT_KEYWORDS, _clean('substr(n.note, 1, 40)'))} AS a, {_earliest(TEXT_KEYWORDS, _clean('n.note'))} AS b FROM ({_WF}) w JOIN notes n ON n.id = w.id),
  f AS (SELECT id, CASE WHEN raw <> '' AND coalesce(alias, word) IS NOT NULL THEN 'stored' WHEN a IS NOT NULL THEN 'description' WHEN b IS NOT NULL THEN 'body' ELSE 'none' END AS step, CASE WHEN raw <> '' AND coalesce(alias, word) IS NOT NULL THEN coalesce(alias, word) ELSE coalesce(a, b, 'uncategorized') END AS value FROM k)
  SELECT step, value, count(*) AS n FROM f GROUP BY ALL""")
def workflow_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by workflow and by the step that told it: what is stored, the description (here 40 characters of the note), the body."""
    r = records(spark, sf_dir).select("id", "workflow").join(notes(spark, sf_dir), "id")
    aliases, words = WORKFLOW_ALIASES, WORKFLOW_KEYWORDS
    own = C.workflow(F.col("workflow"), aliases, words)
    found = r.select(F.when((F.col("workflow") != "") & (own["confidence"] > 0.3), own["value"]).alias("own"), C.earliest_keyword(C.cleaned(F.substring("note", 1, 40)), TEXT_KEYWORDS).alias("a"), C.earliest_keyword(C.cleaned(F.col("note")), TEXT_KEYWORDS).alias("b"))
    step = F.when(F.col("own").isNotNull(), "stored").when(F.col("a").isNotNull(), "description").when(F.col("b").isNotNull(), "body").otherwise("none")
    return found.groupBy(step.alias("step"), F.coalesce("own", "a", "b", F.lit("uncategorized")).alias("value")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS ({_WF}), e AS (SELECT raw, coalesce({_map(WORKFLOW_ALIASES, 'key')}, {_earliest(WORKFLOW_KEYWORDS, 'key')}) AS mapped, {_map(WORKFLOW_ALIASES, 'key')} AS alias FROM k)
  SELECT 'workflow' AS field, count(*) AS rows, count(*) FILTER (raw <> '' AND mapped IS NOT NULL) AS mapped, count(*) FILTER (raw <> '' AND alias IS NOT NULL) AS sure, count(DISTINCT raw) AS distinct_raw, count(DISTINCT CASE WHEN raw <> '' THEN mapped END) AS distinct_values FROM e""")
def vocabulary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the vocabulary of workflows goes."""
    r = records(spark, sf_dir).select(F.col("workflow").alias("raw"))
    return C.coverage(r.select("raw", C.workflow(F.col("raw"), WORKFLOW_ALIASES, WORKFLOW_KEYWORDS).alias("e")), "workflow")


@query("SELECT organization_name AS value, count(*) AS n FROM records WHERE organization_name <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 organizations with most records."""
    return C.top_values(records(spark, sf_dir), "organization_name")


@query(f"""WITH k AS (SELECT r.id, r.business_function AS f, w.key, n.note FROM records r JOIN ({_WF}) w ON w.id = r.id JOIN notes n ON n.id = r.id), e AS (SELECT coalesce({_map(WORKFLOW_ALIASES, 'key')}, {_earliest(WORKFLOW_KEYWORDS, 'key')}, nullif(replace(key, ' ', '_'), ''), {_earliest(TEXT_KEYWORDS, _clean('note'))}, 'uncategorized') AS workflow, coalesce(nullif(f, ''), 'uncategorized') AS function FROM k)
  SELECT workflow, function, count(*) AS n FROM e GROUP BY ALL""")
def record_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by workflow (normalized, else as stored, else as the text says) and function."""
    r = records(spark, sf_dir).select("id", "workflow", "business_function").join(notes(spark, sf_dir), "id")
    own = F.nullif(C.workflow(F.col("workflow"), WORKFLOW_ALIASES, WORKFLOW_KEYWORDS)["value"], F.lit(""))
    return r.groupBy(F.coalesce(own, C.inferred_workflow(F.col("note"), TEXT_KEYWORDS)).alias("workflow"), F.coalesce(F.nullif("business_function", F.lit("")), F.lit("uncategorized")).alias("function")).agg(F.count("*").alias("n"))


@query("SELECT CASE tier WHEN 'silver' THEN 'decision_grade' WHEN 'bronze' THEN 'supporting' WHEN '' THEN 'supporting' ELSE tier END AS tier, count(*) AS n FROM (SELECT CASE id % 5 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN 'bronze' WHEN 3 THEN '' ELSE 'rejected' END AS tier FROM records) GROUP BY 1")
def tier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by tier, older names as today's."""
    old = F.get(F.array(*map(F.lit, ("Gold", " silver", "bronze", "", "rejected"))), (F.col("id") % 5).cast("int"))
    return records(spark, sf_dir).groupBy(C.tier_name(old).alias("tier")).agg(F.count("*").alias("n"))


_PHRASES = """words AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), pairs AS (SELECT item_id, w[i] || ' ' || w[i + 1] AS keyword, i FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM words)),
  k AS (SELECT keyword, min(item_id * 10000 + i) AS position, arg_min(CAST(item_id AS VARCHAR), item_id * 10000 + i) AS value FROM pairs GROUP BY keyword)"""


@query(f"""WITH {_PHRASES}, v AS (SELECT doc_id, lower(text) AS key FROM documents), m AS (SELECT doc_id, keyword, value, position, instr(key, keyword) AS place FROM v JOIN k ON contains(key, keyword)),
  a AS (SELECT doc_id, count(*) AS keywords, arg_min(value, position) AS first_listed FROM m GROUP BY 1), e AS (SELECT doc_id, value AS earliest FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, -length(keyword), position) = 1)
  SELECT v.doc_id, coalesce(keywords, 0) AS keywords, first_listed, earliest FROM v LEFT JOIN a USING (doc_id) LEFT JOIN e USING (doc_id)""")
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document by the benchmark items whose phrases of two words are in it: how many phrases, the item listed first, and that of the phrase that begins first."""
    own = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    b = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", own.alias("w")).where(F.size("w") > 1)
    pairs = b.select("item_id", F.posexplode(F.transform(F.slice("w", F.lit(1), F.size("w") - 1), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))).alias("i", "keyword"))
    keywords = pairs.select("keyword", F.col("item_id").cast("string").alias("value"), (F.col("item_id") * 10000 + F.col("i") + 1).alias("position"))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("key"))
    m = V.pairs_found(docs, "doc_id", keywords)
    best = m.groupBy("doc_id").agg(F.count("*").alias("keywords"), F.min_by("value", "position").alias("first_listed"), F.min_by("value", F.struct("place", -F.length("keyword"), "position")).alias("earliest"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("keywords", F.lit(0)).alias("keywords"), "first_listed", "earliest")


BRANDS, BRAND_KEYWORDS = {"brand 12": "vendor_12", "brand 23": "vendor_23", "brand 6": "vendor_6"}, [("brand 1", "vendor_1x"), ("brand 2", "vendor_2x")]


@query(f"""WITH l AS (SELECT DISTINCT l_orderkey AS id, p_brand AS raw, p_type AS kind FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT id, kind, {_KEY} AS key FROM l),
  e AS (SELECT id, kind, coalesce({_map(BRANDS, 'key')}, {_first(BRAND_KEYWORDS, 'key')}) AS vendor FROM k), s AS (SELECT r.workflow, r.id, kind, vendor FROM e JOIN records r USING (id) WHERE vendor IS NOT NULL),
  n AS (SELECT workflow, vendor, count(DISTINCT id) AS n, min(id) AS first_ FROM s GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY n DESC, first_, vendor) AS k FROM n),
  d AS (SELECT workflow, count(DISTINCT vendor) AS vendors, count(DISTINCT kind) AS families, count(DISTINCT id) AS vendored FROM s GROUP BY 1),
  o AS (SELECT workflow, count(DISTINCT industry) AS industries, count(DISTINCT geography) AS geographies, count(*) AS records,
    count(DISTINCT CASE WHEN employee_count < 10 THEN 1 WHEN employee_count < 50 THEN 2 WHEN employee_count < 200 THEN 3 WHEN employee_count < 1000 THEN 4 WHEN employee_count < 10000 THEN 5 WHEN employee_count IS NOT NULL THEN 6 END) AS bands FROM records GROUP BY 1)
  SELECT workflow, coalesce(vendors, 0) AS vendors, industries, coalesce(families, 0) AS families, geographies, bands, coalesce(vendored, 0) AS vendored, records, t.vendor AS top_vendor,
    coalesce(floor(n / vendored * 1000 + 0.5) / 1000, 0.0) AS share, coalesce(vendored >= 5 AND floor(n / vendored * 1000 + 0.5) / 1000 > 0.6, false) AS concentrated
  FROM o LEFT JOIN d USING (workflow) LEFT JOIN t ON t.workflow = o.workflow AND k = 1""")
def diversity_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How varied each workflow's evidence is in vendors, trades, kinds of technology, places and sizes; brands of order lines are vendors, sure where the vocabulary knows them."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("kind"), C.product(F.col("p_brand"), BRANDS, BRAND_KEYWORDS).alias("e"))
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"))
    entry = lambda value: F.collect_set(F.struct(value.alias("value"), F.col("e.confidence").alias("confidence")))
    own = lines.join(p, "part").groupBy("id").agg(entry(F.col("e.value")).alias("vendors"), entry(F.col("kind")).alias("families"))
    r = records(spark, sf_dir).select("id", "workflow", "industry", "geography", employee_band(F.col("employee_count")).alias("band")).join(own, "id", "left")
    return coverage.diversity(coverage.dimension_counts(r, "workflow", "id"), "workflow")
