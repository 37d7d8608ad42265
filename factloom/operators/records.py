"""Rules over whole records: what is missing, what is valid, summaries, context fit and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.rules import blank, employee_band

# Patterns of problems and the workflow and function each stands for; the first that matches holds.
PROBLEMS: list[tuple[str, str, str]] = [
    (r"invoice|payable|payments|billing|reconciliation|procurement|\bap\b", "invoice_processing", "finance"),
    (r"onboard|customer setup|welcome|kickoff|implementation.*customer", "onboarding", "customer_success"),
    (r"support|ticket|escalat|complaint|help ?desk|service ?desk", "ticketing", "support"),
    (r"contract|legal|clause|agreement|mnda", "contract_review", "legal"),
    (r"lead|sales|qualif|prospecting|pipeline", "lead_qualification", "sales"),
    (r"marketing|campaign|lead nurturing|email.*campaign", "marketing_automation", "marketing"),
    (r"ci ?cd|deploy|release|build.*test", "ci_cd", "engineering"),
    (r"knowledge|spreadsheet|tribal|documentation|information|search", "process_automation", "operations"),
    (r"report|reporting|dashboard|kpi|metric|monthly close|reconcil", "process_automation", "finance"),
    (r"manufactur|production|assembly|warehouse|quality.*line", "manufacturing", "operations"),
    (r"supply|inventory|logistics|fulfil", "supply_chain", "operations"),
]
# Patterns of what is wanted; the first that matches holds.
OUTCOMES: list[tuple[str, str]] = [
    (r"(cost|expensive|spend|budget|overhead|saving|save money)", "cost"),
    (r"(time|slow|delay|cycle|long|wait|faster|days)", "time"),
    (r"(error|mistake|quality|rework|defect|accuracy|incorrect)", "quality"),
    (r"(revenue|sell|convert|grow|acquisition|churn)", "revenue"),
    (r"(compliance|regulat|audit)", "compliance"),
    (r"(capacity|scale|volume|throughput|productivity|manual work)", "efficiency"),
]
GOOD_WHEN_LOWER = ("cost", "time", "risk", "errors")
BANDS = ["<10", "10-50", "50-200", "200-1000", "1000-10000", "10000+"]


def first_match(text: Column, pairs: list[tuple[str, str]], otherwise: str) -> Column:
    return F.coalesce(*(F.when(F.rlike(text, F.lit(p)), F.lit(v)) for p, v in pairs), F.lit(otherwise))


def problem(text: Column) -> dict[str, Column]:
    """Workflow, function and wanted outcome of a described problem."""
    t = F.lower(F.trim(text))
    return {"workflow": first_match(t, [(p, w) for p, w, _ in PROBLEMS], "process_automation"), "business_function": first_match(t, [(p, f) for p, _, f in PROBLEMS], "operations"), "wanted": first_match(t, OUTCOMES, "efficiency")}


def missing_fields() -> Column:
    """Which of four fields a record lacks, in order."""
    return F.array_compact(
        F.array(
            F.when(F.col("result_status").isin("", "unknown", "theoretical", "proposed"), "deployment_status"),
            F.when(F.coalesce("measurement_period", F.lit(0)) == 0, "measurement_period"),
            F.when(F.coalesce("sample_size", F.lit(0)) <= 1, "sample_size"),
            F.when(~F.col("has_baseline"), "baseline"),
        )
    )


def issues(tiers: list[str]) -> Column:
    """What is wrong with a record that is to be added, in order; none if it is valid."""
    required = [F.when(blank(F.col(f)), F.lit(f"missing required field: {f}")) for f in ("organization_name", "workflow")]
    return F.array_compact(F.array(*required, F.when(~F.col("richness").isin(*tiers), F.concat(F.lit("invalid richness: "), "richness")), F.when(F.col("employee_count") < 0, "negative employee_count"), F.when(F.coalesce("employee_count", F.lit(1)) == 0, "no employees")))


def summaries(metrics: DataFrame, most: int = 3) -> DataFrame:
    """(record_id, summary): the first `most` measured changes of each record, and whether they are for the better."""
    c = F.col
    better = ((c("percentage_change") < 0) & c("metric_category").isin(*GOOD_WHEN_LOWER)) | (c("percentage_change") > 0)
    line = F.concat("metric_name", F.lit(": "), F.abs("percentage_change").cast("string"), F.lit("% "), F.when(better, "improvement").otherwise("decline"))
    rows = metrics.where(c("percentage_change").isNotNull()).select("record_id", F.struct("seq", "partkey", "suppkey", line.alias("line")).alias("m"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("record_id").orderBy("m"))).where(F.col("k") <= most)
    return rows.groupBy("record_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["line"]), "; ").alias("summary"))


def context_fit(function: str, industry: str, count: int, geography: str) -> Column:
    """Fit of a record to a profile; what a record lacks counts as neutral."""
    at = lambda x: F.array_position(F.array(*map(F.lit, BANDS)), x)
    apart = F.abs(at(employee_band(F.col("employee_count"))) - at(employee_band(F.lit(count))))
    size = F.when(F.col("employee_count").isNull(), 0.5).when(apart == 0, 1.0).when(apart == 1, 0.6).when(apart == 2, 0.3).otherwise(0.0)
    func = F.when(blank(F.col("business_function")), 0.5).when(F.lower("business_function") == function, 1.0).otherwise(0.0)
    place = F.when(blank(F.col("geography")), 0.5).when(F.contains(F.lower("geography"), F.lit(geography)), 1.0).otherwise(0.0)
    trade = F.when(F.col("industry") == industry, 1.0).otherwise(0.0)
    return func * 0.4 + trade * 0.3 + size * 0.2 + place * 0.1


def resolve(asked: DataFrame, registry: DataFrame, domains: DataFrame, evidence: DataFrame) -> DataFrame:
    """(name, industry, via): an organization's industry by its registered name, else by its domain, else by the evidence; the ways are tried in order.

    asked has (name, domain); the others (name or domain, industry), of which
    the first in order counts.
    """
    one = lambda df, key, way: df.groupBy(F.lower(key).alias(f"__{way}")).agg(F.min("industry").alias(way))
    out = asked.join(one(registry, "name", "registry"), F.lower("name") == F.col("__registry"), "left").join(one(domains, "domain", "domains"), F.lower(asked["domain"]) == F.col("__domains"), "left").join(one(evidence, "name", "evidence"), F.lower("name") == F.col("__evidence"), "left")
    ways = ["registry", "domains", "evidence"]
    via = F.coalesce(*(F.when(F.col(w).isNotNull(), F.lit(w)) for w in ways), F.lit("none"))
    return out.select("name", F.coalesce(*ways).alias("industry"), via.alias("via"))


def search_terms() -> Column:
    """Up to five things to search for to fill a gap (workflow, business_function, gold, decision_grade, missing)."""
    c, wf = F.col, F.translate("workflow", "_", " ")
    first = F.split("missing", ",")[0]
    terms = F.array(
        F.concat_ws(" ", wf, c("business_function"), F.lit("implementation")), F.when(c("gold") == 0, F.concat(wf, F.lit(" automation quantified results"))),
        F.when(c("decision_grade") < 3, F.concat_ws(" ", wf, c("business_function"), F.lit("case study outcomes"))), F.when(c("missing") != "", F.concat_ws(" ", wf, F.translate(first, "_", " "))),
    )
    return F.slice(F.array_distinct(F.array_compact(terms)), 1, 5)
