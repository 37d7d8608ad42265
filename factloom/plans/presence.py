"""Queries about what is there and what is missing: five rules of presence, ids by content, missing information, expected outcomes and economics that don't add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.presence import CONTENT_WORDS, RULES, row_id
from factloom.functions.rules import half_up
from factloom.operators import decision as D
from factloom.operators import scoring as S
from factloom.plans.catalog import query
from factloom.plans.coverage import _R
from factloom.plans.decision import _DIM, _FAM, _IN, _PROFILES, assessments
from factloom.sources.tables import metrics, notes, records, table

_TEXTS, _NUMBERS, _FLAGS = ["organization_name", "workflow", "source_url", "lessons_learned", "note"], ["employee_count", "sample_size", "measurement_period"], ["has_baseline", "vendor_reported"]
_WORDS = lambda x: f"len(list_filter(regexp_split_to_array(CAST({x} AS VARCHAR), '\\s+'), lambda w: w <> ''))"


def _presence(f: str) -> dict[str, str]:
    there = f"{f} IS NOT NULL"
    if f in _TEXTS:
        return {"gap": f"trim({f}) <> ''", "export": f"trim({f}) <> ''", "coverage": f"length(trim({f})) > 10", "content": f"{_WORDS(f)} >= {CONTENT_WORDS}", "completeness": f"{f} <> ''"}
    return {"gap": there, "export": there, "coverage": f if f in _FLAGS else f"{f} > 0", "content": f"{_WORDS(f)} >= {CONTENT_WORDS}", "completeness": there}


_ALL = [*_TEXTS, *_NUMBERS, *_FLAGS]


@query("WITH r AS (SELECT records.*, note FROM records JOIN notes USING (id)) " + " UNION ALL ".join(f"SELECT '{f}' AS field, '{rule}' AS rule, count(*) FILTER ({sql}) AS n FROM r" for f in _ALL for rule, sql in _presence(f).items()))
def presence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records have each field, by each of the five rules: one wide aggregate, turned on its side."""
    r = records(spark, sf_dir).join(notes(spark, sf_dir), "id")
    cells = {f"{f}/{rule}": F.count_if(of(F.col(f), r.schema[f].dataType)) for f in _ALL for rule, of in RULES.items()}
    one = r.agg(*(c.alias(n) for n, c in cells.items()))
    name = F.split("cell", "/")
    return one.unpivot([], list(cells), "cell", "n").select(name[0].alias("field"), name[1].alias("rule"), "n")


@query("SELECT l_orderkey, l_linenumber, sha256('=' || l_orderkey || chr(31) || '=' || l_linenumber || chr(31) || '=' || l_partkey) AS row_id FROM lineitem")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with ids that every run gives them again."""
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", row_id("l_orderkey", "l_linenumber", "l_partkey").alias("row_id"))


_BEST = f"""a AS ({_IN}), f(family, {', '.join(D.COLUMNS)}) AS (VALUES {_FAM}), p(c, w) AS (VALUES {_PROFILES}),
  best AS (SELECT id, max(floor(({' + '.join(f'{_DIM[n]} * w[{i}]' for i, n in enumerate(D.DIMENSIONS, 1))}) * 1000000 + 0.5) / 1000000) AS score FROM a JOIN p ON c = "constraint", f GROUP BY id)"""


@query(f"""WITH {_BEST} SELECT CASE WHEN "constraint" = 'unknown' THEN 'constraint_unknown' WHEN coalesce(volume, 0) = 0 THEN 'volume_unknown' WHEN score < 0.4 THEN 'low_confidence' ELSE 'proceed' END AS reason, count(*) AS n, {_R('min(score)', 4)} AS lowest, {_R('max(score)', 4)} AS highest FROM a JOIN best USING (id) GROUP BY 1""")
def insufficient_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that should wait, by what is missing first, and the scores of their best families."""
    a = assessments(spark, sf_dir)
    best = D.scores(D.against_families(a), "id").groupBy("id").agg(F.max("score").alias("score"))
    return a.join(best, "id").groupBy(D.insufficient(F.col("constraint"), F.col("volume"), F.col("score")).alias("reason")).agg(F.count("*").alias("n"), half_up(F.min("score"), 4).alias("lowest"), half_up(F.max("score"), 4).alias("highest"))


_LINES = """lines AS (SELECT r.workflow, m.record_id, r.organization_name, m.metric_name || ': ' || m.percentage_change || '%' AS line, m.seq, m.partkey, m.suppkey FROM metrics m JOIN records r ON r.id = m.record_id WHERE percentage_change IS NOT NULL)"""


@query(f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN contains(line, ':') THEN trim(split_part(line, ':', 1)) ELSE line[1:30] END AS metric FROM lines),
  n AS (SELECT workflow, metric, count(*) AS occurrences, min(record_id * 100 + seq) AS first_ FROM k GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY occurrences DESC, first_, metric) AS rank FROM n),
  e AS (SELECT workflow, metric, string_agg(organization_name || ' ' || line, '; ' ORDER BY x) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY workflow, metric ORDER BY record_id, seq, partkey, suppkey, line) AS x FROM k) WHERE x <= 3 GROUP BY 1, 2)
  SELECT workflow, metric, occurrences, rank, examples FROM t JOIN e USING (workflow, metric) WHERE rank <= 3""")
def expected_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each workflow's records report most: outcomes by the key of their summary lines, with the first three as examples."""
    line = F.concat("metric_name", F.lit(": "), F.col("percentage_change").cast("string"), F.lit("%"))
    rows = metrics(spark, sf_dir).where("percentage_change IS NOT NULL").join(records(spark, sf_dir).select(F.col("id").alias("record_id"), "workflow", "organization_name"), "record_id")
    rows = rows.select("workflow", "record_id", "organization_name", line.alias("line"), F.struct("record_id", "seq", "partkey", "suppkey", line.alias("line")).alias("order"), (F.col("record_id") * 100 + F.col("seq")).alias("first"))
    return D.outcome_votes(rows, "workflow", 3, 3)


@query(f"""WITH x AS (SELECT id, (c_acctbal * 10)::DOUBLE AS labour, l_discount * 5 + 0.1 AS a, o_totalprice::DOUBLE AS build FROM (SELECT o_orderkey AS id, o_totalprice, c_acctbal, (o_orderkey % 11) / 100.0::DOUBLE AS l_discount FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 100)),
  y AS (SELECT id, build, labour * greatest(0.05::DOUBLE, least(0.7::DOUBLE, a)) AS saving FROM x), z AS (SELECT id, build, saving, build / (saving * 0.5) * 12 AS payback, (3 * saving - build) / build AS roi FROM y)
  SELECT CASE WHEN abs(build / saving * 12 - payback) > 1 THEN 'payback' ELSE 'consistent' END AS invariant, count(*) AS n, {_R('max(payback)', 2)} AS longest, {_R('max(roi)', 2)} AS best FROM z GROUP BY 1""")
def economic_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Economics whose payback isn't costs over savings, which is so for most, since half of the savings are taken to be left."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 100"), F.col("o_custkey") == F.col("c_custkey"))
    share = (F.col("o_orderkey") % 11) / F.lit(100.0) * 5 + 0.1
    e = S.economics((F.col("c_acctbal") * 10).cast("double"), F.lit(60.0), F.lit(1.0), share, F.col("o_totalprice").cast("double"))
    rows = o.select(e["saving"].alias("saving"), e["payback_months"].alias("payback"), F.col("o_totalprice").cast("double").alias("build"))
    roi = (3 * F.col("saving") - F.col("build")) / F.col("build")
    return rows.groupBy(S.broken_invariant(F.col("build"), F.col("saving"), F.lit(0.0), F.col("payback"), roi).alias("invariant")).agg(F.count("*").alias("n"), half_up(F.max("payback"), 2).alias("longest"), half_up(F.max(roi), 2).alias("best"))
