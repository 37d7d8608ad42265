"""Query of the decision engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import decision as D
from factloom.plans.catalog import query
from factloom.sources.tables import records, table

_IN = """SELECT id, CASE id % 6 WHEN 0 THEN 'capacity' WHEN 1 THEN 'errors' WHEN 2 THEN 'speed' WHEN 3 THEN 'cost' WHEN 4 THEN 'compliance' ELSE 'unknown' END AS "constraint", CASE WHEN id % 9 = 0 THEN NULL ELSE (id * 7919) % 900000 END AS volume, (id % 9) / 10.0::DOUBLE AS exception_rate, 0.3::DOUBLE + (id % 4) / 10.0::DOUBLE AS stability,
  0.3::DOUBLE + (id % 7) / 10.0::DOUBLE AS risk_level, ((id % 50) * 5000)::DOUBLE AS budget, (2 + id % 30)::DOUBLE AS weeks, (id % 10) / 10.0::DOUBLE AS urgency, 0.3::DOUBLE + (id % 6) / 10.0::DOUBLE AS readiness, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 11) / 10.0::DOUBLE END AS evidence FROM records"""
_FAM = ", ".join("('" + n + "', " + ", ".join(f"{float(v)}::DOUBLE" for v in p) + ")" for n, p in D.FAMILIES.items())
_MEET = "CASE \"constraint\" || '/' || family " + " ".join(f"WHEN '{k}/{f}' THEN {float(w)}::DOUBLE" for k, by in D.CONSTRAINTS.items() for f, w in by.items()) + " ELSE 0.3::DOUBLE END"
_PROFILES = ", ".join(f"('{k}', [" + ", ".join(f"{x}::DOUBLE" for x in w) + "])" for k, w in D.PROFILES.items())
_DIM = {
    "problem_fit": f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_MEET}))",
    "economic_fit": "greatest(0.1::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, budget / greatest((cost_low + cost_high) / 2, 1.0::DOUBLE)) * 0.4::DOUBLE + labour / 100 * 0.6::DOUBLE))",
    "automation_potential": "((1.0::DOUBLE - least(1.0::DOUBLE, exception_rate * 2)) * 0.6::DOUBLE + stability * 0.4::DOUBLE)",
    "volume_fit": "CASE WHEN volume < 6000 THEN v1 WHEN volume < 60000 THEN v2 WHEN volume < 600000 THEN v3 WHEN volume IS NOT NULL THEN v4 ELSE 0.5::DOUBLE END",
    "exception_fit": "CASE WHEN ex_slope < 0 THEN least(1.0::DOUBLE, exception_rate * -ex_slope + ex_floor) ELSE greatest(ex_floor, 1.0::DOUBLE - exception_rate * ex_slope) END",
    "risk": "greatest(risk_floor, 1.0::DOUBLE - risk_level * CASE WHEN risk_slope > 0 THEN risk_slope ELSE 1.0::DOUBLE END)",
    "feasibility": "(CASE WHEN budget > 10000 THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END + least(1.0::DOUBLE, weeks / weeks_needed) * 0.5::DOUBLE)",
    "organizational_readiness": "readiness",
    "integration_feasibility": "0.6::DOUBLE",
    "time_to_value": "(speed * 0.6::DOUBLE + urgency * 0.4::DOUBLE)",
    "evidence_strength": "coalesce(evidence, 0.5::DOUBLE)",
}


@query(f"""WITH a AS ({_IN}), f(family, {', '.join(D.COLUMNS)}) AS (VALUES {_FAM}), p(c, w) AS (VALUES {_PROFILES}), s AS (SELECT id, family, floor(({' + '.join(f'{_DIM[n]} * w[{i}]' for i, n in enumerate(D.DIMENSIONS, 1))}) * 1000000 + 0.5) / 1000000 AS score, coalesce(family IN ('AI', 'Workflow_Automation') AND volume < 6000, false) AS unsuited FROM a JOIN p ON c = "constraint", f),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, family) AS rank FROM s) SELECT id, family, score, unsuited, rank FROM r WHERE rank <= 3""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best intervention families for each record's situation."""
    return D.decide(assessments(spark, sf_dir), "id")


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A situation for each record."""
    i, c = F.col("id"), records(spark, sf_dir).select("id")
    names = ["capacity", "errors", "speed", "cost", "compliance", "unknown"]
    tenth = lambda m: (i % m) / F.lit(10.0)
    return c.select(
        "id", F.element_at(F.array(*map(F.lit, names)), (i % 6 + 1).cast("int")).alias("constraint"), F.when(i % 9 != 0, (i * 7919) % 900000).alias("volume"), tenth(9).alias("exception_rate"), (0.3 + tenth(4)).alias("stability"), (0.3 + tenth(7)).alias("risk_level"),
        ((i % 50) * 5000).cast("double").alias("budget"), (i % 30 + 2).cast("double").alias("weeks"), tenth(10).alias("urgency"), (0.3 + tenth(6)).alias("readiness"), F.when(i % 5 != 0, tenth(11)).alias("evidence"),
    )


#: Assessments in words, one an order, from what its lines show; {lag} is the number of days between two dates.
_ANSWERS = """SELECT id, CASE WHEN returned > 0.5 THEN 'errors' WHEN lag > 1500 THEN 'speed' WHEN price > 350000 THEN 'cost' WHEN n >= 6 THEN 'capacity' WHEN priority = '1-URGENT' THEN 'compliance' WHEN open = 0 THEN 'visibility' ELSE 'unknown' END AS constraint_,
  CASE WHEN n = 2 THEN NULL ELSE quantity * quantity * 20 END AS volume,
  CASE WHEN returned = 0 THEN 'Almost no exceptions' WHEN returned < 0.2 THEN 'Some (<10%)' WHEN returned < 0.35 THEN '10–30%' WHEN returned < 1 THEN '30%+' ELSE 'Entirely or highly variable' END AS exception_rate,
  CASE WHEN open = 0 THEN 'Very stable' WHEN open < 0.5 THEN 'Somewhat variable' WHEN open < 1 THEN 'Entirely manual' END AS stability, priority AS risk,
  CASE WHEN price < 40000 THEN 'Under $10k' WHEN price < 80000 THEN '$10k–25k' WHEN price < 150000 THEN '$25k–50k' WHEN price < 250000 THEN '$50k–100k' WHEN price < 400000 THEN '$100k–250k' WHEN price < 450000 THEN '$250k+' ELSE '' END AS budget,
  CASE WHEN lag < 50 THEN 'Immediately' WHEN lag < 100 THEN '30 days' WHEN lag < 200 THEN '1–3 months' WHEN lag < 400 THEN '3–6 months' WHEN lag < 800 THEN '6–12 months' WHEN lag < 1600 THEN 'Flexible' END AS timeline,
  CASE WHEN n >= 6 THEN 'Multiple times a day' WHEN n >= 4 THEN 'Hourly' WHEN n >= 2 THEN 'Daily' ELSE 'Weekly' END AS frequency, CASE WHEN n = 3 THEN NULL ELSE returned END AS evidence
FROM (SELECT o_orderkey AS id, min(o_totalprice) AS price, min(o_orderpriority) AS priority, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, min(abs({lag})) AS lag,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS returned, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS open
  FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""


def _words(answer: str, words: tuple[list[tuple[str, float]], float]) -> str:
    found = " ".join(f"WHEN contains(lower({answer}), '{w}') THEN {v}::DOUBLE" for w, v in words[0])
    return f"CASE {found} ELSE {words[1]}::DOUBLE END"


def _looked_up(answer: str, values: tuple[dict[str, float], float]) -> str:
    found = " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in values[0].items())
    return f"CASE {answer} {found} ELSE {float(values[1])}::DOUBLE END"


_CENTS = lambda x: f"floor(({x}) * 100 + 0.5 + 1e-9::DOUBLE) / 100"
_BANDED = _DIM | {
    "problem_fit": _DIM["problem_fit"].replace('"constraint"', "constraint_"),
    "economic_fit": _CENTS("greatest(0.1::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, b_budget / greatest((cost_low + cost_high) / 2, 1.0::DOUBLE)) * 0.4::DOUBLE + labour / 100 * 0.6::DOUBLE))"),
    "automation_potential": _CENTS("b_exceptions * 0.6::DOUBLE + b_stability * 0.4::DOUBLE"),
    "volume_fit": _DIM["volume_fit"].replace("CASE ", "CASE WHEN volume = 0 THEN 0.5::DOUBLE "),
    "exception_fit": _CENTS("CASE family WHEN 'Staffing' THEN least(1.0::DOUBLE, b_rate * 2.0::DOUBLE + 0.3::DOUBLE) ELSE greatest(ex_floor, 1.0::DOUBLE - b_rate * ex_slope) END"),
    "risk": _CENTS("CASE family WHEN 'Staffing' THEN 0.9::DOUBLE ELSE greatest(risk_floor, 1.0::DOUBLE - b_risk * risk_slope) END"),
    "feasibility": _CENTS("CASE WHEN family = 'No_Action' OR budget NOT IN ('Under $10k', '') THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END + least(1.0::DOUBLE, b_weeks / weeks_needed) * 0.5::DOUBLE"),
    "organizational_readiness": "b_readiness",
    "time_to_value": _CENTS("speed * 0.6::DOUBLE + b_urgency * 0.4::DOUBLE"),
}
_UNSUITED = """concat_ws(',', CASE WHEN family IN ('AI', 'Workflow_Automation') AND volume > 0 AND volume < 6000 THEN 'very_low_volume' END,
  CASE WHEN family = 'Workflow_Automation' AND contains(lower(exception_rate), 'highly variable') THEN 'too_many_exceptions' END, CASE WHEN family = 'Software' AND contains(lower(stability), 'entirely manual') THEN 'not_standardized' END)"""


@query(f"""WITH a AS ({_ANSWERS.format(orders='orders', lineitem='lineitem', lag="date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))")}),
  b AS (SELECT *, {_words('exception_rate', D.EXCEPTION_SCORE)} AS b_exceptions, {_words('exception_rate', D.EXCEPTION_RATE)} AS b_rate, {_words('stability', D.STABILITY)} AS b_stability, {_words('risk', D.RISK)} AS b_risk,
    {_looked_up('budget', D.BUDGET)} AS b_budget, {_looked_up('timeline', D.WEEKS)} AS b_weeks, {_words('timeline', D.URGENCY)} AS b_urgency, {_words('frequency', D.READINESS)} AS b_readiness FROM a),
  f(family, {', '.join(D.COLUMNS)}) AS (VALUES {_FAM}), p(c, w) AS (VALUES {_PROFILES}),
  s AS (SELECT id, family, floor(({' + '.join(f'{_BANDED[n]} * w[{i}]' for i, n in enumerate(D.DIMENSIONS, 1))}) * 1000000 + 0.5) / 1000000 AS score, {_UNSUITED} AS unsuited FROM b JOIN p ON c = constraint_, f),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, family) AS rank FROM s) SELECT id, family, score, unsuited, rank FROM r WHERE rank <= 3""")
def decisions_by_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best intervention families for each order's assessment, whose answers in words are read by bands."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    text = _ANSWERS.format(orders="{orders}", lineitem="{lineitem}", lag="datediff(l_shipdate, o_orderdate)")
    answers = spark.sql(text, orders=orders, lineitem=lines).withColumnRenamed("constraint_", "constraint")
    return D.decide_by_answers(answers, "id")
