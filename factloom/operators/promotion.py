"""What is done about records that lack something: recovered values, promotions, campaigns, and what is said about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.rules import half_up

# Where to look for a field that is missing; targets of a category; names of families by parts of an intervention's name, in order.
SOURCES = {"rollout_strategy": ["case_study", "implementation_guide"], "success_criteria": ["case_study", "report"], "lessons_learned": ["postmortem", "case_study"], "implementation_pattern": ["implementation_guide", "whitepaper"]}
LEAST = {"total": 5, "gold": 1, "silver": 3}
COVERAGE_TARGET = 0.5
NAMED_FAMILIES = [
    ("Workflow_Automation", ["rpa", "workflow automation", "automation", "robotic"]),
    ("AI", ["ai", "machine learning", "ml", "deep learning", "llm", "gen ai"]),
    ("Software", ["software", "platform", "crm", "erp", "system", "saas"]),
    ("Process_Redesign", ["process redesign", "reengineering", "lean", "six sigma"]),
    ("Staffing", ["staffing", "hiring", "training", "outsource"]),
]
CATEGORIES = {
    "workflow_automation": ["workflow_automation", "rpa", "workflow", "automation", "process_automation"],
    "ai": ["ai", "machine_learning", "artificial_intelligence", "genai", "generative_ai", "llm", "copilot"],
    "process_redesign": ["process_redesign", "process_improvement", "lean", "six_sigma"],
    "software": ["software", "saas", "platform", "erp", "crm", "cloud_migration"],
    "staffing": ["staffing", "hiring", "outsourcing"],
    "hybrid": ["hybrid"],
}
UNITS = ["years", "year", "quarters", "quarter", "months", "month", "weeks", "week", "days", "day"]


def source_types(missing: Column) -> Column:
    """Kinds of sources for missing fields, each once, in the order in which they are named."""
    table = F.create_map(*(x for k, v in SOURCES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.flatten(F.transform(missing, lambda m: F.coalesce(F.try_element_at(table, m), F.array().cast("array<string>")))))


def gaps(records: DataFrame, demand: Mapping[str, float], targets: Mapping[str, int] | None = None) -> DataFrame:
    """Gaps of (workflow, function) categories against the targets: counts, coverage, gap, demand, need. The first three parts of a gap may be below 0. targets: records of each kind that a category should have."""
    targets = targets or LEAST
    c = F.col
    wf, fn = F.coalesce(F.nullif("workflow", F.lit("")), F.lit("unknown_workflow")), F.coalesce(F.nullif("business_function", F.lit("")), F.lit("operations"))
    g = records.where("workflow <> '' OR business_function <> ''").groupBy(wf.alias("workflow"), fn.alias("business_function"))
    g = g.agg(F.count("*").alias("total"), F.count_if(c("level") == "gold").alias("gold"), F.count_if(c("level") == "silver").alias("silver"), *(F.avg((F.trim(f) != "").cast("double")).alias(f) for f in SOURCES))
    short = lambda n: F.least(F.lit(1.0), (F.lit(targets[n]) - c(n)) / targets[n])
    parts = [*(short(n) for n in targets), *(F.greatest(F.lit(0.0), (COVERAGE_TARGET - c(f)) / COVERAGE_TARGET) for f in SOURCES)]
    asked = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in demand.items() for x in kv)), c("workflow")), F.lit(0.4))
    missing = F.array_compact(F.array(*(F.when(c(f) < COVERAGE_TARGET, F.lit(f)) for f in SOURCES)))
    need = F.greatest(F.lit(0), targets["total"] - c("total")) + F.greatest(F.lit(0), targets["gold"] - c("gold"))
    g = g.withColumn("gap", sum(parts[1:], parts[0]) / len(parts)).withColumn("demand", asked).withColumn("missing", missing)
    return g.select("workflow", "business_function", "total", "gold", "silver", half_up(c("gap"), 4).alias("gap"), "demand", half_up(c("gap") * c("demand"), 4).alias("impact"), need.alias("need"), "missing", source_types(c("missing")).alias("sources"))


def benchmark_before(gap: Column) -> Column:
    return half_up(F.greatest(F.lit(0.0), 1 - gap), 3)


def first_number(text: Column) -> Column:
    """The first number in a text."""
    return F.regexp_replace(F.regexp_extract(text, r"(\d[\d,]*\.?\d*)", 1), ",", "").try_cast("double")


def unit_in(text: Column) -> Column:
    """The unit of time in a text, in the singular; empty if none."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(u)), F.lit(u.rstrip("s") if u != "quarters" else u)) for u in UNITS), F.lit(""))


def timeframe(text: Column) -> tuple[Column, Column]:
    """(value, unit) of a period in words: a number counts months if no unit is named, a unit alone counts once."""
    n, unit = first_number(text), unit_in(text)
    return F.when(n.isNotNull(), n).when(unit != "", 1.0), F.when(n.isNotNull(), F.when(unit != "", unit).otherwise("months")).when(unit != "", unit)


def recovered(missing: Column, found: Mapping[str, Column]) -> dict[str, Column]:
    """Of what a second look has found, what was asked for and holds: status, period, sample, baseline."""
    asked = lambda f: F.array_contains(missing, f)
    status = F.lower(F.trim(found["deployment_status"]))
    status = F.when(status.isin("deployed", "pilot"), status).when(status.isin("proposed", "theoretical"), "proposed")
    sample, baseline = first_number(found["sample_size"]), F.trim(found["baseline"])
    return {
        "result_status": F.when(asked("deployment_status"), status), "measurement_period": F.when(asked("measurement_period") & (found["measurement_period"] > 0), found["measurement_period"]),
        "sample_size": F.when(asked("sample_size") & (sample > 1), sample.cast("bigint")), "has_baseline": F.when(asked("baseline") & (baseline != ""), F.lit(True)),
    }


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Recovered outcomes with a value, each once a record (by name and changes), the percentage worked out from before and after where it is missing."""
    c = F.col
    given = lambda x: F.coalesce(c(x) != 0, F.lit(False))
    worked = F.when(given("baseline_value") & c("post_value").isNotNull(), half_up(100.0 * (c("post_value") - c("baseline_value")) / c("baseline_value"), 4))
    rows = metrics.where(given("percentage_change") | given("absolute_change") | given("baseline_value") | given("post_value"))
    return rows.select("record_id", F.substring("metric_name", 1, 120).alias("metric_name"), F.coalesce(c("percentage_change").cast("double"), worked).alias("percentage"), c("absolute_change")).distinct()


def named_family(name: Column) -> Column:
    """The family that an intervention's name stands for: the first with a part of it."""
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.coalesce(*(F.when(has(words), F.lit(f)) for f, words in NAMED_FAMILIES), F.lit("Workflow_Automation"))


def category(raw: Column) -> Column:
    """A category under its common name; others stay as they are."""
    key = F.lower(F.trim(raw))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, names in CATEGORIES.items() for n in names for x in (n, k))), key), key)


def detail(score: Column, filled: Column, lessons: Column) -> Column:
    """Depth of an implementation's description: its own score over 10, else by the fields that are filled."""
    return F.when(F.coalesce(score, F.lit(0)) > 0, score / 10).when(filled >= 2, 0.5).when(filled >= 1, 0.3).when(lessons, 0.2).otherwise(0.0)


def next_action(milestones: DataFrame) -> DataFrame:
    """(plan, action) of (plan, phase, phase_order, phase_status, title, item_order, status): of the first phase in progress, what is blocked, else what isn't begun, else its review."""
    c = F.col
    rank = F.when(c("status") == "blocked", 0).when(c("status") == "not_started", 1).otherwise(2)
    rows = milestones.groupBy("plan").agg(F.min(F.when(c("phase_status") == "in_progress", F.struct("phase_order", rank.alias("rank"), "item_order", "phase", "title"))).alias("m"))
    m = c("m")
    text = F.when(m.isNull(), "Start the first phase").when(m["rank"] == 0, F.concat(F.lit("Resolve blockers in '"), m["phase"], F.lit("': "), m["title"])).when(m["rank"] == 1, F.concat(F.lit("Begin milestone: "), m["title"])).otherwise(F.concat(F.lit("Complete '"), m["phase"], F.lit("' phase review")))
    return rows.select("plan", text.alias("action"))


def with_blockers(milestones: DataFrame, blockers: DataFrame) -> DataFrame:
    """Milestones (id, status) after their blockers (milestone, resolved): blocked while one is open, in progress again once all are resolved."""
    b = blockers.groupBy(F.col("milestone").alias("id")).agg(F.bool_and("resolved").alias("free"))
    status = F.when(F.col("free"), F.when(F.col("status") == "blocked", "in_progress").otherwise(F.col("status"))).when(~F.col("free"), "blocked").otherwise(F.col("status"))
    return milestones.join(b, "id", "left").select("id", status.alias("status"))


def frontier(found: DataFrame, known: DataFrame) -> DataFrame:
    """Addresses (library, url) that are new to a library, each once, pending."""
    return found.select("library", "url").distinct().join(known.select("library", "url"), ["library", "url"], "left_anti").withColumn("status", F.lit("pending"))


def campaigns(gaps_: DataFrame, budget: int) -> DataFrame:
    """The categories of greatest impact whose needs come to no more than the budget, in order, with where they begin."""
    ranks = Window.orderBy(F.desc("impact"), "workflow", "business_function").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a category
    planned = gaps_.where("need > 0").withColumn("spent", F.sum("need").over(ranks)).where(F.col("spent") <= budget)
    return planned.select("workflow", "business_function", "need", "spent", benchmark_before(F.col("gap")).alias("before"))


def review_sample(accepted: DataFrame, id_col: str, k: int, lists: Sequence[str]) -> DataFrame:
    """The first k rows by id, lists joined by semicolons."""
    return accepted.orderBy(id_col).limit(k).select(*(F.array_join(c, "; ").alias(c) if c in lists else F.col(c) for c in accepted.columns))


def rationale(df: DataFrame, parts: Sequence[str], name: str = "rationale") -> DataFrame:
    """df with a sentence on its strongest part (of equals the first named)."""
    best = F.array_max(F.array(*(F.struct(F.col(p).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(p.replace("_", " ")).alias("n")) for i, p in enumerate(parts))))
    return df.withColumn(name, F.concat(F.lit("Strongest on "), best["n"], F.lit(" ("), F.format_number(best["v"], 2), F.lit(")")))
