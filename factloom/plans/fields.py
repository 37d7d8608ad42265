"""Queries of the fields that texts state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fields as E
from factloom.functions.rules import half_up
from factloom.operators import linking as L
from factloom.plans.catalog import query
from factloom.sources.tables import metrics, records, spread, stories, table


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _found(p: str, group: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract(story, {_q(p)}, {group}, '{flags}'), '')" if flags else f"nullif(regexp_extract(story, {_q(p)}, {group}), '')"


def _number(patterns: list[str], kind: str = "DOUBLE") -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST(replace({_found(p)}, ',', '') AS {kind})" for p in patterns) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _some(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _has(words: list[str], x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def _organization() -> str:
    names = [_strip(_found(p, 1, "")) for p in E.ORGANIZATION]
    return "coalesce(" + ", ".join(f"CASE WHEN length({n}) > 3 AND length({n}) < 100 AND NOT regexp_matches(lower({n}), '^(the|a|an) ') THEN {n} END" for n in names) + ")"


def _cost(p: str) -> str:
    unit = f"lower(regexp_extract(story, {_q(p)}, 2, 'i'))"
    return f"TRY_CAST(replace({_found(p)}, ',', '') AS DOUBLE) * CASE WHEN {unit} IN ('million', 'm') THEN 1e6 WHEN {unit} IN ('billion', 'b') THEN 1e9 WHEN {unit} = 'k' THEN 1e3 ELSE 1.0 END"


_EMPLOYEES = _number(E.EMPLOYEES, "BIGINT")
_BAND = f"CASE WHEN {_EMPLOYEES} IS NULL OR {_EMPLOYEES} = 0 THEN NULL " + " ".join(f"WHEN {_EMPLOYEES} <= {most} THEN '{n}'" for most, n in E.BANDS) + f" ELSE '{E.LARGEST}' END"
_CUED = f"list_filter(string_split(story, '.')[1:5], lambda s: {_has(E.PROBLEM_CUES, 'lower(s)')})[1]"
_FIELDS = {
    "organization_name": _organization(),
    "organization_industry": _some([f"CASE WHEN {_has(w, 'lower(story)')} THEN '{n}' END" for n, w in E.INDUSTRIES.items()]),
    "organization_employee_count": _EMPLOYEES,
    "organization_employee_band": _BAND,
    "problem_business_function": _some([f"CASE WHEN {_has(w, 'lower(story)')} THEN '{n}' END" for n, w in E.FUNCTIONS.items()]),
    "problem_statement": "coalesce(" + ", ".join([*(_strip(_found(p, 1, "is")) for p in E.PROBLEM), _strip(_CUED), _strip("string_split(story, '.')[1]")]) + ")",
    "implementation_cost": "coalesce(" + ", ".join(map(_cost, E.COST)) + ")",
    "implementation_time_value": _number(E.DURATION),
    "implementation_time_unit": "regexp_replace(coalesce(" + ", ".join(_found(p, 2) for p in E.DURATION) + "), 's+$', '')",
    "baseline_value": _number(E.BASELINE),
    "outcome_value": _number(E.OUTCOME),
    "outcome_percentage": _number(E.PERCENT),
    **{n: f"regexp_matches(story, {_q(p)}, 'i')" for n, p in E.EVIDENCE.items()},
    "sample_size": _number(E.SAMPLE, "BIGINT"),
    "measurement_period": "coalesce(" + ", ".join(_found(p, 0) for p in E.PERIOD) + ")",
    "teams_involved": _some([_strip(_found(p, 0)) for p in E.TEAMS]),
    "software": _some([f"CASE WHEN contains(lower(story), {_q(w.lower())}) THEN {_q(w)} END" for w in E.SOFTWARE]),
    "success_factors": _some([_strip(_found(p, 1, "is")) for p in E.SUCCESS]),
    "failure_conditions": _some([_strip(_found(p, 1, "is")) for p in E.FAILURE]),
}
_ARRAYS = ["organization_industry", "problem_business_function", "teams_involved", "software", "success_factors", "failure_conditions"]


_KEYS = ["k", "h"]


def _keyed(texts: DataFrame) -> DataFrame:
    """With the keys by which a story is found again: 96 bits of hashes."""
    return texts.withColumns({"k": F.xxhash64("story"), "h": F.hash("story")})


def _with_fields(texts: DataFrame) -> DataFrame:
    """texts (story and others) with keys and the fields of each story. They are dealt out by the keys, since few bytes may be much work."""
    s = spread(_keyed(texts), *_KEYS).withColumn("low", F.lower("story"))
    found = s.select(*texts.columns, *_KEYS, *(c.alias(n) for n, c in E.fields(F.col("story"), F.col("low")).items()))
    return found.withColumn("organization_employee_band", E.band(F.col("organization_employee_count")))


@query("SELECT id, " + ", ".join((f"array_to_string({x}, '|')" if n in _ARRAYS else x) + f" AS {n}" for n, x in _FIELDS.items()) + " FROM stories")
def field_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 23 fields of each story; lists joined by bars. A text is searched once, however many records have it."""
    s = stories(spark, sf_dir)
    f = _with_fields(s.select("story").distinct()).select(*_KEYS, *(F.array_join(n, "|").alias(n) if n in _ARRAYS else F.col(n) for n in _FIELDS))
    return _keyed(s).select("id", *_KEYS).join(f, _KEYS).select("id", *_FIELDS)


@query(f"""WITH f AS (SELECT story, {', '.join(f'{_FIELDS[n]} AS {n}' for n in ('organization_name', 'implementation_cost', 'has_baseline', 'vendor_reported', 'sample_size'))} FROM stories)
  SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN organization_name IS NULL THEN 'missing_organization' END, CASE WHEN coalesce(implementation_cost, 0) = 0 THEN 'missing_implementation_cost' END, CASE WHEN NOT has_baseline THEN 'no_baseline' END,
  CASE WHEN vendor_reported THEN 'vendor_reported' END, CASE WHEN coalesce(sample_size, 0) = 0 THEN 'no_sample_size' END, CASE WHEN contains(lower(story), 'projected') THEN 'projected_rather_than_observed' END]) AS flag FROM f) WHERE flag IS NOT NULL GROUP BY flag""")
def field_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the doubts about stories' fields."""
    f = _with_fields(stories(spark, sf_dir).groupBy("story").agg(F.count("*").alias("n"))).withColumnRenamed("story", "note")
    return f.select("n", F.explode(E.field_flags()).alias("flag")).groupBy("flag").agg(F.sum("n").alias("n"))


_GEO = [r"\b(?:based|headquartered|headquarters) in ([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)", r"\b(U\.S\.|USA|United States|UK|Germany|Canada|Japan|Australia|India|China|Singapore|Brazil|Netherlands|Sweden|Switzerland|France|Spain|Italy)\b"]
_COUNTRIES = {"us": "United States", "usa": "United States", "u.s.": "United States", "united states": "United States", "uk": "United Kingdom", "united kingdom": "United Kingdom"}
_STAFF = [r"(\d[\d,]*)\s*(?:employees|people|staff|ftes|employees worldwide)", r"(?:more than|over|>|~|around)\s*(\d[\d,]*)\s*employees"]


@query(f"""SELECT id, CASE lower(place) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _COUNTRIES.items())} ELSE place END AS geography, employees FROM (SELECT id, coalesce({', '.join(_strip(_found(p, 1, '')) for p in _GEO)}) AS place,
  coalesce({', '.join(f"TRY_CAST(replace({_found(p, 1, '')}, ',', '') AS BIGINT)" for p in _STAFF)}) AS employees FROM stories)""")
def inferred_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an organization is and how many work there, as its story says; countries by one name."""
    text = F.col("story")
    place = F.coalesce(*(E.stripped(E.found(text, p, 1, "")) for p in _GEO))
    country = F.when(F.lower("place") == "us", "United States")
    for k, v in _COUNTRIES.items():
        country = country.when(F.lower("place") == k, v)
    staff = F.coalesce(*(F.regexp_replace(E.found(text, p, 1, ""), ",", "").try_cast("bigint") for p in _STAFF))
    return stories(spark, sf_dir).select("id", place.alias("place"), staff.alias("employees")).select("id", country.otherwise(F.col("place")).alias("geography"), "employees")


#: Claims that are looked up in the stories, by field.
_CLAIMS = {"rollout_strategy": "The rollout saved", "success_criteria": "Costs were reduced by", "lessons_learned": "It failed because the data was not ready in time. And so on, at length", "implementation_pattern": "early training of all agents", "workflow": "hr"}


@query(f"""WITH c AS (SELECT id, story, unnest([{', '.join(f"{{'field': '{k}', 'value': {_q(v)}}}" for k, v in _CLAIMS.items())}]) AS c FROM stories),
  l AS (SELECT id, c.field AS field, c.value AS value, story, instr(lower(story), lower(c.value[1:50])) AS pos FROM c WHERE length(trim(c.value)) >= 5),
  p AS (SELECT id, field, CASE WHEN pos > 0 THEN substr(story, greatest(pos - 100, 1), least(pos - 1, 100) + length(value[1:50]) + 200) ELSE '' END AS context FROM l)
  SELECT id, CASE WHEN count(*) FILTER (length(context) > 20) >= 4 THEN 'rich' WHEN count(*) FILTER (length(context) > 20) >= 2 THEN 'usable' ELSE 'thin' END AS richness, string_agg(field, ',' ORDER BY field) FILTER (length(context) > 20) AS fields, CAST(sum(length(context)) AS BIGINT) AS context_chars FROM p GROUP BY id""")
def field_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claims a story supports (their first 50 characters, with what stands around them), and how rich that makes it."""
    claims = F.array(*(F.struct(F.lit(k).alias("field"), F.lit(v).alias("value")) for k, v in _CLAIMS.items() if len(v.strip()) >= 5))
    searched = F.substring("c.value", 1, 50)
    at = F.call_function("instr", F.lower("story"), F.lower(searched))
    context = F.when(at > 0, F.substring(F.col("story"), F.greatest(at - 100, F.lit(1)), F.least(at - 1, F.lit(100)) + F.length(searched) + 200)).otherwise("")
    rows = stories(spark, sf_dir).select("id", "story", F.explode(claims).alias("c")).select("id", "c.field", context.alias("context"))
    named = F.when(F.length("context") > 20, F.col("field"))
    n = F.count(named)
    return rows.groupBy("id").agg(
        F.when(n >= 4, "rich").when(n >= 2, "usable").otherwise("thin").alias("richness"), F.nullif(F.array_join(F.sort_array(F.collect_list(named)), ","), F.lit("")).alias("fields"), F.sum(F.length("context")).cast("bigint").alias("context_chars")
    )


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS section, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number FROM documents), c AS (SELECT item_id, lower(substr(text, 1, 50)) AS claim FROM benchmark WHERE length(trim(text)) >= 5)
  SELECT item_id, doc_id, min(number) AS section FROM s JOIN c ON contains(lower(section), claim) GROUP BY ALL""")
def source_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark claim and each document that has its first 50 characters, without regard to case: the first section (here: line) with them."""
    claims = table(spark, sf_dir, "benchmark", "item_id", "text").where(F.length(F.trim("text")) >= 5).select("item_id", F.lower(F.substring("text", 1, 50)).alias("claim"))
    lines = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("number", "key")).select("doc_id", "number", "key", F.sha2("key", 256).alias("digest"))
    return L.located(lines, claims).select("item_id", "doc_id", (F.col("number") + 1).cast("bigint").alias("section"))


@query("""SELECT avg(CAST(n >= 5 AS INT)) AS share, count(*) FILTER (n >= 5) AS complete, count(*) AS records, floor(avg(points) * 100 + 0.5) / 100 AS mean_points FROM (SELECT r.id,
  CAST(organization_name <> '' AS INT) + CAST(employee_count IS NOT NULL AS INT) + CAST(measurement_period IS NOT NULL AS INT) + CAST(has_baseline AS INT) + CAST(sample_size IS NOT NULL AS INT) + CAST(coalesce(m, 0) > 0 AS INT) AS n,
  CASE WHEN organization_name <> '' THEN 15 ELSE 0 END + CASE WHEN has_baseline THEN 15 ELSE 0 END + CASE WHEN coalesce(m, 0) > 0 THEN 15 ELSE 0 END + CASE WHEN sample_size IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN measurement_period IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN independently_verified THEN 10 ELSE 0 END + CASE WHEN source_url <> '' THEN 10 ELSE 0 END AS points
  FROM records r LEFT JOIN (SELECT record_id, count(*) AS m FROM metrics GROUP BY 1) m ON m.record_id = r.id)""")
def analytics_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which five of six fields are filled, and the mean of an additive score of 10 or 15 points a field."""
    m = metrics(spark, sf_dir).groupBy("record_id").agg(F.count("*").alias("m"))
    r = records(spark, sf_dir).join(m, F.col("id") == F.col("record_id"), "left")
    has = {"org": F.col("organization_name") != "", "base": F.col("has_baseline"), "metric": F.coalesce("m", F.lit(0)) > 0, "sample": F.col("sample_size").isNotNull(), "period": F.col("measurement_period").isNotNull(), "verified": F.col("independently_verified"), "url": F.col("source_url") != "", "size": F.col("employee_count").isNotNull()}
    n = sum(has[k].cast("int") for k in ("org", "size", "period", "base", "sample", "metric"))
    points = sum(F.when(has[k], w).otherwise(0) for k, w in (("org", 15), ("base", 15), ("metric", 15), ("sample", 10), ("period", 10), ("verified", 10), ("url", 10)))
    return r.agg(F.avg((n >= 5).cast("int")).alias("share"), F.count_if(n >= 5).alias("complete"), F.count("*").alias("records"), half_up(F.avg(points), 2).alias("mean_points"))
