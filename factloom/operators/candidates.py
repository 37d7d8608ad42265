"""Candidates for a recommendation: whole rows of what is known, the effort that a kind of work takes, and what a choice rests on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.rules import employee_band, half_up
from factloom.sources.tables import tolerant

_METRIC = "struct<id:bigint,metric_name:string,metric_category:string,baseline_value:double,post_value:double,absolute_change:double,percentage_change:double,unit:string>"
# Fields of a candidate that are texts, lists and anything else.
TEXTS = ["organization_name", "organization_type", "canonical_industry", "industry_subsector", "broader_industry", "problem_statement", "intervention_title", "intervention_description", "intervention_implementation_cost_currency", "intervention_implementation_time_unit", "measurement_method"]
LISTS = [
    "organization_industry", "organization_geography", "problem_business_function", "problem_categories", "intervention_families", "intervention_components", "intervention_software", "intervention_vendors", "intervention_teams_involved",
    "success_factors", "failure_conditions", "implementation_challenges", "risks", "limitations",
]
OTHERS = {
    "id": "bigint", "organization_anonymized": "boolean", "organization_employee_count": "bigint", "intervention_implementation_cost": "double", "intervention_implementation_time_value": "double", "intervention_human_review_required": "boolean",
    "intervention_pilot_used": "boolean", "result_status": "string", "has_baseline": "boolean", "has_post_measurement": "boolean", "has_control_group": "boolean", "sample_size": "bigint", "independently_verified": "boolean", "vendor_reported": "boolean",
}
# Code points of a problem and of a description that a candidate shows.
PROBLEM_CHARS, DESCRIPTION_CHARS = 300, 500
# Weeks (least, expected, most), people (likewise), roles and description of each category; the last row is for any other.
EFFORT = {
    "Workflow_Automation": (4, 8, 12, 2, 3, 4, ["Process Owner", "Automation Engineer", "Workflow Lead"], "Rules-based and robotic process automation"),
    "AI": (8, 14, 24, 3, 5, 7, ["AI Engineer", "Data Engineer", "Workflow Owner", "Security Reviewer", "Project Manager"], "Machine learning and AI-powered automation"),
    "Software": (10, 18, 30, 3, 4, 6, ["Implementation Lead", "System Administrator", "Integration Engineer", "Change Lead"], "Platform implementation and system integration"),
    "Process_Redesign": (6, 12, 20, 2, 4, 5, ["Process Lead", "Lean Specialist", "Stakeholder Lead", "Project Manager"], "Lean process redesign and workflow optimization"),
    "Staffing": (4, 8, 16, 2, 3, 4, ["HR Lead", "Hiring Manager", "Training Coordinator"], "Team structure and resource optimization"),
    "Hybrid": (10, 20, 36, 3, 5, 6, ["Technical Lead", "Process Lead", "AI Specialist", "Change Manager"], "Combined intervention approach"),
    None: (4, 8, 16, 2, 3, 4, ["Project Lead", "Technical Lead", "Workflow Owner"], None),
}


def outcome_summary(m: Column) -> Column:
    """A metric in words, by its change in percent or else its absolute change, signed and rounded half up; null without either."""
    signed = lambda x: F.format_string("%+d", F.floor(F.abs(x) + 0.5).cast("long") * F.signum(x).cast("long"))
    percent = F.concat(m["metric_name"], F.lit(": "), signed(m["percentage_change"]), F.lit("%"))
    absolute = F.concat(m["metric_name"], F.lit(": "), signed(m["absolute_change"]), F.lit(" "), m["unit"])
    return F.when(m["percentage_change"].isNotNull(), percent).when(m["absolute_change"].isNotNull(), absolute)


def record_score() -> Column:
    """Evidence from 0 to 100: 50, more for a check by others, a sample, changes with numbers (three at most) and success; less for a vendor's word and failure."""
    c, no = F.col, F.lit(False)
    numbers = F.size(F.filter("metrics", lambda m: m["percentage_change"].isNotNull() | m["absolute_change"].isNotNull()))
    status = F.when(c("result_status").isin("successful", "partial"), 10).when(c("result_status").isin("failed", "abandoned"), -10).otherwise(0)
    yes = lambda name, points: F.when(F.coalesce(c(name), no), points).otherwise(0)
    score = 50 + yes("independently_verified", 15) + F.when(c("sample_size") > 1, 10).otherwise(0) + F.least(F.lit(15), numbers * 5) - yes("vendor_reported", 10) + status
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def candidates(records: DataFrame, metrics: DataFrame, similarity: DataFrame, factors: Sequence[str]) -> DataFrame:
    """A whole row of each record in `similarity`: its own fields, its metrics, what they say, its evidence and how alike it is.

    records: any of TEXTS, LISTS and OTHERS, of which only id must be there;
    nested fields may be JSON text. A missing or null text is empty, a list
    empty, a status unknown, anything else null; a problem shows its first
    300 code points, a description its first 500.
    metrics: record_id, id and the fields of a metric, of which any but
    record_id may be missing. They come in the order of id, the rest breaking ties.
    similarity: id, total and the factors, each from 0 to 1. Null totals count as 0.

    An id that repeats in records gives a row each.
    """
    r = tolerant(records, {**OTHERS, **dict.fromkeys(TEXTS, "string"), **dict.fromkeys(LISTS, "array<string>")})
    r = r.withColumns({**{n: F.coalesce(n, F.lit("")) for n in TEXTS}, **{n: F.coalesce(n, F.array().cast("array<string>")) for n in LISTS}})
    r = r.withColumns({"result_status": F.coalesce(F.nullif("result_status", F.lit("")), F.lit("unknown")), "problem_statement": F.substring("problem_statement", 1, PROBLEM_CHARS), "intervention_description": F.substring("intervention_description", 1, DESCRIPTION_CHARS)})
    fields = [f.split(":") for f in _METRIC[len("struct<") : -1].split(",")]
    m = tolerant(metrics, {"record_id": "bigint", **dict(fields)})
    text = [n for n, kind in fields if kind == "string"]
    own = m.withColumns({n: F.coalesce(n, F.lit("")) for n in text}).groupBy(F.col("record_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*(n for n, _ in fields)))).alias("metrics"))
    s = similarity.select("id", half_up(F.coalesce("total", F.lit(0.0)) * 100, 0).cast("int").alias("similarity_score"), F.struct(*factors).alias("similarity_breakdown"))
    out = r.join(s, "id").join(own, "id", "left").withColumn("metrics", F.coalesce("metrics", F.array().cast(f"array<{_METRIC}>")))
    said = F.array_compact(F.transform("metrics", outcome_summary))
    added = {"organization_employee_band": employee_band(F.col("organization_employee_count")), "outcome_summaries": said, "evidence_score": record_score(), "result_statuses": F.array("result_status")}
    return out.withColumns(added).withColumnRenamed("organization_name", "organization")


def effort(category: Column) -> Column:
    """Weeks, people and roles that work of a category takes, and what that rests on."""

    def row(name: str | None) -> Column:
        *n, roles, said = EFFORT[name]
        numbers = zip(("min_weeks", "expected_weeks", "max_weeks", "min_people", "expected_people", "max_people"), n, strict=True)
        basis = "default estimate" if said is None else f"typical for: {said}"
        return F.struct(*(F.lit(v).alias(k) for k, v in numbers), F.array(*map(F.lit, roles)).alias("roles"), F.lit(basis).alias("basis"))

    first, *rest = (n for n in EFFORT if n)
    out = F.when(category == first, row(first))
    for n in rest:
        out = out.when(category == n, row(n))
    return out.otherwise(row(None))


def trace(comparables: DataFrame, key: str, factors: Sequence[str], *, top: int = 5) -> DataFrame:
    """(key, reasons, gold, decision_grade, mixed, total, uncertainty): what a recommendation rests on.

    comparables: key, rank (from 1), the factors, tier and employee_count.
    reasons are the `top` factors that are greatest among the best `top`
    comparables, each with that value to two digits; equal ones in the order
    of `factors`. Factors that none of them has are left out. mixed are those
    that are neither gold nor decision grade. Uncertain is first of all that
    fewer than two comparables tell their size, then what is mixed. The key
    must not have a factor's name.

    One aggregate a key, whose buffers are a few numbers, so keys may be of any size.
    """
    if key in factors:
        raise ValueError(f"the key {key!r} has the name of a factor")
    best = {n: F.max(F.when(F.col("rank") <= top, F.col(n))).alias(f"_{i}") for i, n in enumerate(factors)}
    count = lambda cond, name: F.count_if(cond).alias(name)
    g = comparables.groupBy(key).agg(*best.values(), count(F.col("tier") == "gold", "gold"), count(F.col("tier") == "decision_grade", "decision_grade"), F.count("*").alias("total"), count(F.col("employee_count") > 0, "sized"))
    one = lambda i, n: F.when(F.col(f"_{i}").isNotNull(), F.struct((-F.col(f"_{i}")).alias("order"), F.lit(i).alias("place"), F.lit(n).alias("factor"), half_up(F.col(f"_{i}"), 2).alias("raw")))
    ordered = F.slice(F.sort_array(F.array_compact(F.array(*(one(i, n) for i, n in enumerate(factors))))), 1, top)
    mixed = F.col("total") - F.col("gold") - F.col("decision_grade")
    doubt = F.when(F.col("sized") < 2, "Few comparable organizations at the customer's employee scale").when(mixed > 0, F.concat(mixed.cast("string"), F.lit(" comparable implementation(s) reported mixed or negative outcomes"))).otherwise("")
    return g.select(key, F.transform(ordered, lambda r: F.struct(r["factor"].alias("factor"), r["raw"].alias("raw"))).alias("reasons"), "gold", "decision_grade", mixed.alias("mixed"), "total", doubt.alias("uncertainty"))
