"""Queries on what comes in nested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.plans.catalog import query
from factloom.plans.extraction import _flag_sql
from factloom.sources import seeds as S
from factloom.sources import variants as V
from factloom.sources.tables import metrics, notes, records, table


@query("""WITH f AS (SELECT id, unnest([""" + ", ".join(_flag_sql(*f) for f in R.FLAGS) + """]) AS flag FROM notes) SELECT 'records' AS output, count(*) AS n FROM records UNION ALL SELECT 'metrics', count(*) FROM metrics
  UNION ALL SELECT 'passages', count(*) FROM (SELECT unnest(string_split(note, '. ')) AS p FROM notes) WHERE trim(p) <> '' UNION ALL SELECT 'flags', count(*) FROM f WHERE flag IS NOT NULL""")
def extraction_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table nested extractions give."""
    m = metrics(spark, sf_dir).groupBy(F.col("record_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("partkey", "suppkey", "metric_name", "percentage_change"))).alias("metrics"))
    n = notes(spark, sf_dir).select("id", F.split("note", r"\. ").alias("passages"), R.quality_flags(F.col("note")).alias("flags"))
    nested = records(spark, sf_dir).select("id", "organization_name", F.col("workflow").alias("title")).join(n, "id").join(m, "id", "left")
    counts = [df.agg(F.lit(name).alias("output"), F.count("*").alias("n")) for name, df in S.fan_out(nested).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


_PROFILE = """'{"workflow": {"value": " ' || upper(workflow) || '"}, "industry": {"value": "' || industry || '", "confidence": 0.9}, "employee_count": {"value": "' || CASE id % 3 WHEN 0 THEN '1,200.7' WHEN 1 THEN 'many' ELSE '85' END || '"}}'"""


@query(f"""WITH p AS (SELECT id, CAST({_PROFILE} AS JSON) AS p FROM records) SELECT id, lower(nullif(trim(p->'workflow'->>'value'), '')) AS workflow, lower(p->'industry'->>'value') AS industry, p->'geography'->>'value' AS geography, CAST(floor(TRY_CAST(replace(p->'employee_count'->>'value', ',', '') AS DOUBLE)) AS BIGINT) AS employee_count FROM p""")
def profile_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from profiles that are kept as JSON."""
    kind = "map<string,struct<value:string,confidence:double>>"
    p = records(spark, sf_dir).select("id", F.from_json(F.expr(_PROFILE), kind).alias("p"))
    names = ("workflow", "industry", "geography", "employee_count")
    p = p.select("id", F.struct(*(F.try_element_at("p", F.lit(n)).alias(n) for n in names)).alias("p"))
    return p.select("id", *(c.alias(n) for n, c in S.asked(F.col("p")).items()))


#: What the events' properties look like once three releases have written them: with more keys, as bare text, or not at all.
_PROPS = """CASE event_id % 6 WHEN 0 THEN 'k=' || CAST(event_id % 7 AS VARCHAR(9)) WHEN 1 THEN '{"k": "' || event_type || '", "at": {"user": ' || CAST(user_id AS VARCHAR(19)) || ', "tags": ["a", 1, null]}}'
  WHEN 2 THEN '{"k": 0.5, "on": true}' WHEN 3 THEN NULL ELSE props END"""


@query(f"""WITH t AS (SELECT {_PROPS} AS p FROM events), j AS (SELECT CASE WHEN json_valid(p) THEN CAST(p AS JSON) ELSE to_json(p) END AS v FROM t),
  d AS (SELECT regexp_replace(x.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, x.type AS kind FROM j, json_tree(j.v) x WHERE j.v IS NOT NULL UNION ALL SELECT '$', 'MISSING' FROM j WHERE v IS NULL),
  n AS (SELECT path, CASE kind WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DECIMAL' WHEN 'NULL' THEN 'VOID' ELSE kind END AS type, count(*) AS n FROM d GROUP BY ALL)
  SELECT *, CASE WHEN path NOT IN ('$', '$.k') THEN 'new' ELSE 'type' END AS reason FROM n WHERE NOT (path = '$' AND type = 'OBJECT') AND NOT (path = '$.k' AND type = 'BIGINT')""")
def props_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and types of the events' properties that aren't those of the first release."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props").select(V.opened(F.expr(_PROPS)).alias("v"))
    return V.unexpected(V.drift(e, "v"), {"$": "OBJECT", "$.k": "BIGINT"})


@query(f"""WITH t AS (SELECT event_id, {_PROPS} AS p FROM events), j AS (SELECT event_id, CASE WHEN json_valid(p) THEN CAST(p AS JSON) END AS v FROM t)
  SELECT event_id, coalesce(TRY_CAST(v ->> '$.k' AS DOUBLE), -1.0) AS k, coalesce(TRY_CAST(v ->> '$.on' AS BOOLEAN), false) AS "on" FROM j""")
def props_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys of the events' properties, with defaults."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props").select("event_id", V.opened(F.expr(_PROPS)).alias("v"))
    return V.picked(e, "v", {"k": ("double", -1.0), "on": ("boolean", False)}).drop("v")
