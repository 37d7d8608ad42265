"""Decision engine: every assessment against every intervention family, in dimensions, as one wide expression.

The families are a table of parameters, so each dimension is one formula for
all of them; an assessment meets the families by an explode of that literal
table, and nothing is shuffled until the best are picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the dimensions, by what holds the work back; another constraint counts as unknown.
DIMENSIONS = ["problem_fit", "economic_fit", "automation_potential", "volume_fit", "exception_fit", "risk", "feasibility", "organizational_readiness", "integration_feasibility", "time_to_value", "evidence_strength"]
PROFILES: dict[str, list[float]] = {
    "capacity": [0.10, 0.20, 0.15, 0.20, 0.05, 0.05, 0.05, 0.05, 0.03, 0.07, 0.05],
    "errors": [0.10, 0.10, 0.25, 0.10, 0.15, 0.08, 0.05, 0.05, 0.05, 0.04, 0.03],
    "speed": [0.10, 0.12, 0.20, 0.10, 0.08, 0.05, 0.08, 0.05, 0.05, 0.14, 0.03],
    "quality": [0.10, 0.08, 0.10, 0.05, 0.18, 0.10, 0.08, 0.15, 0.08, 0.05, 0.03],
    "cost": [0.08, 0.30, 0.18, 0.15, 0.05, 0.05, 0.05, 0.03, 0.03, 0.05, 0.03],
    "visibility": [0.08, 0.08, 0.05, 0.05, 0.05, 0.05, 0.15, 0.10, 0.25, 0.11, 0.03],
    "compliance": [0.10, 0.05, 0.03, 0.03, 0.05, 0.30, 0.15, 0.10, 0.10, 0.06, 0.03],
    "unknown": [0.05, 0.03, 0.02, 0.02, 0.02, 0.03, 0.03, 0.03, 0.02, 0.02, 0.75],
}
# Fixed values by family: cost range in dollars, least labour reduction in percent, fit at volumes below 6,000, 60,000, 600,000 and beyond,
# how exceptions and risk weigh (slope and floor), weeks it takes, and speed to value.
FAMILIES: dict[str, tuple] = {
    "AI": (80_000, 2_000_000, 45, 0.2, 0.6, 0.85, 0.95, 2.5, 0.1, 0.8, 0.2, 16, 0.4),
    "Software": (30_000, 500_000, 25, 0.5, 0.7, 0.85, 0.85, 2.0, 0.2, 0.6, 0.3, 10, 0.6),
    "Workflow_Automation": (20_000, 300_000, 40, 0.2, 0.6, 0.85, 0.95, 2.5, 0.1, 0.7, 0.3, 8, 0.7),
    "Process_Redesign": (40_000, 1_000_000, 20, 0.5, 0.7, 0.85, 0.85, 2.0, 0.2, 0.7, 0.3, 16, 0.6),
    "Staffing": (30_000, 300_000, -20, 0.9, 0.7, 0.4, 0.4, -2.0, 0.3, 0.0, 0.9, 4, 0.9),
    "Hybrid": (100_000, 3_000_000, 30, 0.5, 0.7, 0.85, 0.85, 1.5, 0.3, 0.7, 0.3, 20, 0.3),
    "No_Action": (0, 10_000, 0, 0.5, 0.7, 0.85, 0.85, 2.0, 0.2, 0.7, 0.3, 3, 1.0),
}
# How well a family meets a constraint; others 0.3.
CONSTRAINTS: dict[str, dict[str, float]] = {
    "capacity": {"Staffing": 0.9, "AI": 0.85, "Workflow_Automation": 0.8, "Hybrid": 0.75, "Process_Redesign": 0.5, "Software": 0.4},
    "errors": {"AI": 0.85, "Workflow_Automation": 0.9, "Software": 0.7, "Process_Redesign": 0.6, "Hybrid": 0.75, "Staffing": 0.3},
    "speed": {"Workflow_Automation": 0.9, "AI": 0.8, "Software": 0.7, "Process_Redesign": 0.75, "Staffing": 0.6, "Hybrid": 0.8},
    "cost": {"Workflow_Automation": 0.9, "AI": 0.85, "Software": 0.7, "Process_Redesign": 0.6, "Staffing": -0.2, "Hybrid": 0.8},
    "visibility": {"Software": 0.95, "AI": 0.6, "Process_Redesign": 0.5, "Workflow_Automation": 0.4, "Staffing": 0.1},
    "unknown": {"No_Action": 0.95, "Process_Redesign": 0.4},
}
COLUMNS = ["cost_low", "cost_high", "labour", "v1", "v2", "v3", "v4", "ex_slope", "ex_floor", "risk_slope", "risk_floor", "weeks_needed", "speed"]


def family_table() -> Column:
    rows = [F.struct(F.lit(name).alias("family"), *(F.lit(float(v)).alias(c) for c, v in zip(COLUMNS, p, strict=True))) for name, p in FAMILIES.items()]
    return F.array(*rows)


def meets() -> Column:
    table = F.create_map(*(F.lit(x) for k, by in CONSTRAINTS.items() for f, w in by.items() for x in (f"{k}/{f}", float(w))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at(table, F.concat_ws("/", "constraint", "family")), F.lit(0.3))))


def dimensions() -> dict[str, Column]:
    """The dimensions of (assessment, family): constraint, volume, exception_rate, stability, risk_level, budget, weeks, urgency, readiness, evidence."""
    c, low, one = F.col, F.lit(0.1), F.lit(1.0)
    affordable = F.least(one, c("budget") / F.greatest((c("cost_low") + c("cost_high")) / 2, one))
    handles = F.when(c("ex_slope") < 0, F.least(one, c("exception_rate") * -c("ex_slope") + c("ex_floor"))).otherwise(F.greatest(c("ex_floor"), 1.0 - c("exception_rate") * c("ex_slope")))
    return {
        "problem_fit": meets(),
        "economic_fit": F.greatest(low, F.least(one, affordable * 0.4 + c("labour") / 100 * 0.6)),
        "automation_potential": (1.0 - F.least(one, c("exception_rate") * 2)) * 0.6 + c("stability") * 0.4,
        "volume_fit": F.when(c("volume") < 6_000, c("v1")).when(c("volume") < 60_000, c("v2")).when(c("volume") < 600_000, c("v3")).when(c("volume").isNotNull(), c("v4")).otherwise(0.5),
        "exception_fit": handles,
        "risk": F.greatest(c("risk_floor"), 1.0 - c("risk_level") * F.when(c("risk_slope") > 0, c("risk_slope")).otherwise(1.0)),
        "feasibility": F.when(c("budget") > 10_000, 0.35).otherwise(0.15) + F.least(one, c("weeks") / c("weeks_needed")) * 0.5,
        "organizational_readiness": c("readiness"),
        "integration_feasibility": F.lit(0.6),
        "time_to_value": c("speed") * 0.6 + c("urgency") * 0.4,
        "evidence_strength": F.coalesce(c("evidence"), F.lit(0.5)),
    }


def against_families(assessments: DataFrame) -> DataFrame:
    """Each assessment with each family's parameters, and the weights by what holds its work back."""
    profile = F.coalesce(*(F.try_element_at(F.create_map(*(x for k, w in PROFILES.items() for x in (F.lit(k), F.array(*map(F.lit, w))))), key) for key in (F.col("constraint"), F.lit("unknown"))))
    return assessments.withColumn("weights", profile).withColumn("f", F.explode(family_table())).select("*", "f.*").drop("f")


def scores(rows: DataFrame, *keep: str, fits: dict[str, Column] | None = None, reasons: Column | None = None) -> DataFrame:
    """(keep, family, score, unsuited) of rows from against_families, by dimensions() if no others are given."""
    fits = fits or dimensions()
    score = sum((fits[n] * F.col("weights")[i] for i, n in enumerate(DIMENSIONS) if i), fits[DIMENSIONS[0]] * F.col("weights")[0])
    if reasons is None:
        reasons = F.coalesce(F.col("family").isin("AI", "Workflow_Automation") & (F.col("volume") < 6_000), F.lit(False))
    return rows.select(*keep, "family", (F.floor(score * 1_000_000 + 0.5).cast("double") / 1_000_000).alias("score"), reasons.alias("unsuited"))


# What the answers of an assessment stand for. Of the words, the first that an answer contains counts; budgets and weeks are looked up whole.
EXCEPTION_SCORE = ([("almost no", 0.8), ("some", 0.6), ("<10", 0.6), ("10–30", 0.4), ("30%+", 0.2)], 0.3)
EXCEPTION_RATE = ([("almost no", 0.05), ("some", 0.1), ("<10", 0.1), ("10–30", 0.2), ("30%+", 0.4), ("entire", 0.8)], 0.2)
STABILITY = ([("stable", 0.6), ("somewhat", 0.4)], 0.3)
RISK = ([("critical", 0.9), ("safety", 0.9), ("high", 0.7), ("significant", 0.7), ("medium", 0.5), ("noticeable", 0.5), ("low", 0.3), ("small", 0.3)], 0.5)
URGENCY = ([("immediately", 0.9), ("30 days", 0.7), ("1–3", 0.5), ("3–6", 0.3)], 0.2)
READINESS = ([("multiple times", 0.8), ("hourly", 0.6), ("daily", 0.5)], 0.3)
BUDGET = ({"Under $10k": 10_000, "$10k–25k": 25_000, "$25k–50k": 50_000, "$50k–100k": 100_000, "$100k–250k": 250_000, "$250k+": 500_000}, 100_000)
WEEKS = ({"Immediately": 2, "30 days": 4, "1–3 months": 8, "3–6 months": 16, "6–12 months": 30, "Flexible": 20}, 12)
SMALL_BUDGETS = ["Under $10k", ""]
#: The answers that bands are read from.
ANSWERS = ["exception_rate", "stability", "risk", "budget", "timeline", "frequency"]


def _by_words(answer: str, words: tuple[list[tuple[str, float]], float]) -> Column:
    text = F.lower(F.coalesce(F.col(answer), F.lit("")))
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(v)) for w, v in words[0]), F.lit(words[1]))


def _whole(answer: str, values: tuple[dict[str, float], float]) -> Column:
    return F.coalesce(*(F.when(F.col(answer) == k, F.lit(float(v))) for k, v in values[0].items()), F.lit(float(values[1])))


def banded(rows: DataFrame) -> DataFrame:
    """Add what each answer (ANSWERS, text; null as empty) stands for, as columns that begin with b_; columns of such names are replaced."""
    columns = {
        "b_exceptions": _by_words("exception_rate", EXCEPTION_SCORE),
        "b_rate": _by_words("exception_rate", EXCEPTION_RATE),
        "b_stability": _by_words("stability", STABILITY),
        "b_risk": _by_words("risk", RISK),
        "b_budget": _whole("budget", BUDGET),
        "b_affords": ~F.coalesce("budget", F.lit("")).isin(SMALL_BUDGETS),
        "b_weeks": _whole("timeline", WEEKS),
        "b_urgency": _by_words("timeline", URGENCY),
        "b_readiness": _by_words("frequency", READINESS),
    }
    return rows.withColumns(columns)


def banded_dimensions() -> dict[str, Column]:
    """The dimensions of (assessment from banded(), family), each half up to two places where it is worked out. A volume that is null or 0 isn't known."""
    c, one = F.col, F.lit(1.0)
    cents = lambda x: F.floor(x * 100 + 0.5 + 1e-9).cast("double") / 100
    affordable = F.least(one, c("b_budget") / F.greatest((c("cost_low") + c("cost_high")) / 2, one))
    handles = F.when(c("ex_slope") < 0, F.least(one, c("b_rate") * -c("ex_slope") + c("ex_floor"))).otherwise(F.greatest(c("ex_floor"), 1.0 - c("b_rate") * c("ex_slope")))
    volume = F.nullif(c("volume"), F.lit(0))
    return dimensions() | {
        "economic_fit": cents(F.greatest(F.lit(0.1), F.least(one, affordable * 0.4 + c("labour") / 100 * 0.6))),
        "automation_potential": cents(c("b_exceptions") * 0.6 + c("b_stability") * 0.4),
        "volume_fit": F.when(volume < 6_000, c("v1")).when(volume < 60_000, c("v2")).when(volume < 600_000, c("v3")).when(volume.isNotNull(), c("v4")).otherwise(0.5),
        "exception_fit": cents(handles),
        "risk": cents(F.when(c("risk_slope") > 0, F.greatest(c("risk_floor"), 1.0 - c("b_risk") * c("risk_slope"))).otherwise(c("risk_floor"))),
        "feasibility": cents(F.when(c("b_affords") | (c("family") == "No_Action"), 0.35).otherwise(0.15) + F.least(one, c("b_weeks") / c("weeks_needed")) * 0.5),
        "organizational_readiness": c("b_readiness"),
        "time_to_value": cents(c("speed") * 0.6 + c("b_urgency") * 0.4),
    }


def contraindications() -> Column:
    """Why a family is unsuited, joined by commas: too little volume, too many exceptions, no standard process; empty where nothing speaks against it."""
    has = lambda name, word: F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(word))
    why = {
        "very_low_volume": F.col("family").isin("AI", "Workflow_Automation") & (F.col("volume") > 0) & (F.col("volume") < 6_000),
        "too_many_exceptions": (F.col("family") == "Workflow_Automation") & has("exception_rate", "highly variable"),
        "not_standardized": (F.col("family") == "Software") & has("stability", "entirely manual"),
    }
    return F.concat_ws(",", *(F.when(hit, F.lit(name)) for name, hit in why.items()))


def decide_by_answers(assessments: DataFrame, id_col: str, top: int = 3) -> DataFrame:
    """(id, rank, family, score, unsuited): the best families of assessments answered in words: constraint, volume, evidence (0 to 1 or null) and ANSWERS.

    Nulls count as answers not given; ids must be distinct. An assessment's
    families are the seven of the table, so no window grows with the input.
    """
    rows = against_families(banded(assessments))  # answers are read once, before they meet the families
    scored = scores(rows, id_col, fits=banded_dimensions(), reasons=contraindications())
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "family")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def decide(assessments: DataFrame, id_col: str, top: int = 3) -> DataFrame:
    """(id, rank, family, score, unsuited): the best families of each assessment; unsuited where the volume is too low for automation."""
    scored = scores(against_families(assessments), id_col)
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "family")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# The score below which no family is advised.
CONFIDENT = 0.4


def insufficient(constraint: Column, volume: Column, best: Column) -> Column:
    """Why a decision should wait, the first reason that holds, or proceed."""
    return F.when(constraint == "unknown", "constraint_unknown").when(F.coalesce(volume, F.lit(0)) == 0, "volume_unknown").when(best < CONFIDENT, "low_confidence").otherwise("proceed")


def outcome_votes(rows: DataFrame, group: str, top: int = 5, examples: int = 3) -> DataFrame:
    """(group, metric, occurrences, rank, examples): the commonest outcomes of each group.

    rows: (group, organization_name, line, order, first). An outcome's key is
    what stands before the colon of its line, or the line's first 30
    characters. Of equally common ones the one seen first leads; examples are
    the first lines in the order given, and no group's lines are collected.
    """
    key = F.when(F.contains("line", F.lit(":")), F.trim(F.split("line", ":")[0])).otherwise(F.substring("line", 1, 30))
    keyed = rows.withColumn("metric", key)
    counts = keyed.groupBy(group, "metric").agg(F.count("*").alias("occurrences"), F.min("first").alias("first"))
    place = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    best = counts.withColumn("rank", place([group], F.desc("occurrences"), "first", "metric")).where(F.col("rank") <= top)
    few = keyed.withColumn("x", place([group, "metric"], "order")).where(F.col("x") <= examples)
    told = few.groupBy(group, "metric").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", F.concat_ws(" ", "organization_name", "line").alias("t")))), lambda e: e["t"]), "; ").alias("examples"))
    return best.join(told, [group, "metric"]).select(group, "metric", "occurrences", "rank", "examples")
