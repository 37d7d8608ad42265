"""Tables: named scans, scans that put up with missing columns, and evidence records rendered from the star schema."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder; only the named columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; a local one if it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by its keys, for work that is far heavier than the bytes by which a scan is cut: a small file is one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def saved(df: DataFrame) -> DataFrame:
    """df written to a new place in the shared folder and read back, for what is used more than once: computed once, and no long lineage."""
    path = f"{shared_root(df.sparkSession)}/factloom-core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tolerant(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns (name to type) in order: null where df lacks one, and parsed from JSON text where a nested type is stored as text."""

    def column(name: str, kind: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        nested = isinstance(T._parse_datatype_string(kind), (T.ArrayType, T.MapType, T.StructType))
        if nested and isinstance(df.schema[name].dataType, T.StringType):
            return F.from_json(F.col(name), kind).alias(name)
        return F.col(name).cast(kind).alias(name)

    return df.select(*(column(n, k) for n, k in wanted.items()))


#: Evidence records, one an order. The text runs in Spark and in DuckDB alike; names in braces are tables.
RECORDS = """
SELECT o.o_orderkey AS id,
  CASE WHEN o.o_custkey % 23 = 0 THEN '' WHEN o.o_custkey % 29 = 0 THEN 'University of ' || n.n_name ELSE c.c_name END AS organization_name,
  lower(c.c_mktsegment) AS industry, lower(n.n_name) AS geography,
  CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE (o.o_custkey * 37) % 20000 END AS employee_count,
  CASE o.o_orderkey % 13 WHEN 0 THEN 'invoice_processing' WHEN 1 THEN 'customer_support' WHEN 2 THEN 'claims_processing' WHEN 3 THEN 'demand_forecasting'
    WHEN 4 THEN 'recruiting' WHEN 5 THEN 'quality_inspection' WHEN 6 THEN 'contract_review' WHEN 7 THEN 'fraud_detection' WHEN 8 THEN 'it_service_desk'
    WHEN 9 THEN 'inventory_management' WHEN 10 THEN '' WHEN 11 THEN 'code_review' ELSE 'sales_outreach' END AS workflow,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'finance' WHEN 1 THEN 'operations' WHEN 2 THEN 'support' WHEN 3 THEN 'it' ELSE '' END AS business_function,
  CASE WHEN o.o_orderkey % 17 = 0 THEN 'abandoned' WHEN o.o_orderkey % 19 = 0 THEN 'unknown' WHEN o.o_orderstatus = 'F' THEN 'successful' WHEN o.o_orderstatus = 'O' THEN 'partial' ELSE 'failed' END AS result_status,
  CASE WHEN o.o_orderkey % 10 < 7 THEN 'published' WHEN o.o_orderkey % 10 = 7 THEN 'staging' WHEN o.o_orderkey % 10 = 8 THEN 'quarantined' ELSE 'rejected' END AS publication_status,
  o.o_orderkey % 3 = 0 AS has_baseline, o.o_orderkey % 7 = 0 AS independently_verified, o.o_orderkey % 5 = 0 AS vendor_reported,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_orderkey % 1500 END AS sample_size,
  CASE WHEN o.o_orderkey % 8 < 3 THEN NULL ELSE o.o_orderkey % 24 + 1 END AS measurement_period,
  CASE WHEN o.o_orderkey % 9 = 0 THEN '' ELSE 'https://www.site' || (o.o_custkey % 40) || '.example/case-study/' || o.o_orderkey END AS source_url,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'phased' ELSE '' END AS rollout_strategy, CASE WHEN o.o_orderkey % 3 = 1 THEN 'target met' ELSE '' END AS success_criteria,
  CASE WHEN o.o_orderkey % 5 = 2 THEN 'start small' ELSE '' END AS lessons_learned, CASE WHEN o.o_orderkey % 7 < 3 THEN 'pilot first' ELSE '' END AS implementation_pattern,
  CASE WHEN o.o_orderkey % 11 < 4 THEN 'rich' WHEN o.o_orderkey % 11 < 8 THEN 'usable' ELSE 'thin' END AS richness,
  o.o_orderdate AS extracted_at, o.o_totalprice AS total_price, o.o_custkey AS custkey
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey"""

#: Their measured outcomes, one an order line.
METRICS = """
SELECT l.l_orderkey AS record_id, l.l_linenumber AS seq,
  CASE l.l_linenumber % 5 WHEN 0 THEN 'cost savings' WHEN 1 THEN 'hours saved' WHEN 2 THEN 'cycle time' WHEN 3 THEN 'error rate' ELSE 'revenue' END AS metric_name,
  CASE l.l_linenumber % 5 WHEN 0 THEN 'cost' WHEN 1 THEN 'time' WHEN 2 THEN 'time' WHEN 3 THEN 'errors' ELSE 'revenue' END AS metric_category,
  CASE WHEN l.l_partkey % 3 = 0 THEN NULL ELSE CAST(floor(l.l_discount * 100 + 0.5) AS BIGINT) END AS percentage_change,
  CASE WHEN l.l_partkey % 4 = 0 THEN CAST(l.l_quantity AS BIGINT) ELSE NULL END AS absolute_change,
  CASE WHEN l.l_suppkey % 3 = 0 THEN CAST(l.l_quantity AS BIGINT) * 2 ELSE NULL END AS baseline_value,
  CASE WHEN l.l_suppkey % 5 < 2 THEN CAST(l.l_quantity AS BIGINT) ELSE NULL END AS post_value,
  CASE WHEN l.l_returnflag = 'R' THEN 'observed' ELSE 'projected' END AS value_type,
  CASE WHEN l.l_linenumber % 3 = 0 THEN '6 months' WHEN l.l_linenumber % 3 = 1 THEN '2 weeks' ELSE NULL END AS time_period,
  l.l_partkey AS partkey, l.l_suppkey AS suppkey
FROM {lineitem} l"""

#: Notes about them: sentences with the words that the extractors look for.
NOTES = """
SELECT o.o_orderkey AS id,
  CASE WHEN o.o_orderkey % 7 = 0 THEN 'Customer-success story from a leader in retail. ' ELSE '' END
  || CASE o.o_orderkey % 9 WHEN 0 THEN 'The team deployed a new system with predictive models' WHEN 1 THEN 'Acme Corp implemented generative AI and a chatbot' WHEN 2 THEN 'Staff were hired and training began'
     WHEN 3 THEN 'The process redesign was a pilot' WHEN 4 THEN 'They outsource to a managed service' WHEN 5 THEN 'A dashboard for KPI reporting came with new policy' WHEN 6 THEN 'An autonomous robot replaced manual work'
     WHEN 7 THEN 'A hybrid approach with human review' ELSE 'Nothing to see' END
  || CASE WHEN o.o_orderkey % 4 = 0 THEN ' at Bank of Spring.' ELSE '.' END
  || CASE WHEN o.o_orderkey % 3 = 0 THEN ' Costs were reduced by ' || (o.o_custkey % 60) || '% in ' || (o.o_orderkey % 18 + 1) || ' months.' ELSE '' END
  || CASE WHEN o.o_orderkey % 5 = 0 THEN ' The rollout saved ' || (o.o_custkey % 900 + 10) || ' hours for 1,' || (o.o_orderkey % 900 + 100) || ' employees.' ELSE '' END
  || CASE WHEN o.o_orderkey % 8 = 0 THEN ' It brought $' || (o.o_custkey % 90 + 1) || ' million in annual savings.' ELSE '' END
  || CASE WHEN o.o_orderkey % 6 = 1 THEN ' Before the change the baseline was poor, and results improved.' WHEN o.o_orderkey % 6 = 2 THEN ' The project failed.' WHEN o.o_orderkey % 6 = 3 THEN ' It was cancelled after mixed results.' WHEN o.o_orderkey % 6 = 4 THEN ' Gains are projected by the vendor.' ELSE '' END AS note
FROM {orders} o"""


#: The same with more to say: who, what with, how long, how measured, why.
STORIES = f"""
SELECT n.id, n.note
  || CASE n.id % 7 WHEN 0 THEN ' Accenture worked with a Northern Retail Group on it.' WHEN 1 THEN ' Eastfield Logistics deployed Salesforce and UiPath in its warehouse.' WHEN 2 THEN ' The hospital is based in New Haven, with 2,400 staff.' WHEN 3 THEN ' An independent audit of 12 sites verified the outcome.' WHEN 4 THEN ' Billing ran on SAP across the U.S. and the finance team of 14 people.' WHEN 5 THEN ' Process improvement and workflow automation brought cost savings.' ELSE '' END
  || CASE n.id % 6 WHEN 0 THEN ' The main challenge: manual invoices that took 45 minutes each.' WHEN 1 THEN ' They struggled with late tickets from 30 hours to 12 hours.' WHEN 2 THEN ' Before the project, error rate dropped from 9% to 3%.' WHEN 3 THEN ' NPS improved from 31 to 52, and cycle time reduced from 9 days to 4 days.' ELSE '' END
  || CASE n.id % 5 WHEN 0 THEN ' Investment of $2.5 million over 9 months.' WHEN 1 THEN ' The budget was spent: cost 750k, tracked over 6 months.' WHEN 2 THEN ' A key factor: early training of all agents.' WHEN 3 THEN ' It failed because the data was not ready in time.' ELSE '' END AS story
FROM ({NOTES}) n"""


def _render(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render(spark, sf_dir, RECORDS, "orders", "customer", "nation")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render(spark, sf_dir, METRICS, "lineitem")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NOTES, orders=spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STORIES, orders=spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey"))


def with_views(sql: str) -> str:
    """SQL for DuckDB in which records, metrics, notes and stories can be named."""
    names = {n: n for n in ("orders", "customer", "nation", "lineitem")}
    views = {n: t for n, t in (("records", RECORDS), ("metrics", METRICS), ("notes", NOTES), ("stories", STORIES)) if n in sql}
    ctes = ", ".join(f"{n} AS ({t.format(**names)})" for n, t in views.items())
    if not ctes:
        return sql
    body = sql.strip()
    return f"WITH {ctes}, {body[4:].strip()}" if body[:4].upper() == "WITH" else f"WITH {ctes} {body}"
