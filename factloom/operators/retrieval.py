"""How like a query's profile a record is: six weighted factors, ten for context, and what is said of the records found."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.rules import blank, employee_band, half_up

# Weights of the six factors, and of the ten.
WEIGHTS = {"problem": 0.35, "workflow": 0.25, "intervention": 0.15, "industry": 0.10, "company_size": 0.10, "outcome": 0.05}
CONTEXT_WEIGHTS = {"problem": 0.24, "workflow": 0.22, "operational_function": 0.12, "industry_subsector": 0.10, "broader_industry": 0.08, "organization_size": 0.10, "business_model": 0.06, "geography": 0.04, "regulatory": 0.03, "technology_readiness": 0.01}
# Size bands in order; families of a category; how much is asked about work with a keyword; words of a goal; weights of the six components; other names of functions.
BANDS = ["<10", "10-50", "50-200", "200-1000", "1000-10000", "10000+"]
CATEGORY_FAMILIES = {
    "ai": ["predictive_ai", "generative_ai", "ai_assisted_work", "autonomous_ai", "human_in_the_loop_ai"],
    "software": ["new_software_implementation", "existing_software_optimization", "software"],
    "workflow_automation": ["workflow_simplification", "rules_based_automation", "robotic_process_automation", "rpa"],
    "process_redesign": ["process_redesign", "lean"],
    "staffing": ["staffing_increases", "staffing_reallocation", "outsourcing", "training"],
    "hybrid": ["hybrid_combination"],
}
DEMAND_KEYWORDS = [
    ("invoice", 0.9), ("payment", 0.85), ("reconcil", 0.75), ("billing", 0.8), ("onboard", 0.8), ("ticket", 0.8), ("support", 0.75), ("service call", 0.75), ("lead", 0.75), ("qualif", 0.75), ("marketing", 0.7), ("campaign", 0.7),
    ("ci cd", 0.7), ("deploy", 0.7), ("contract", 0.65), ("rfp", 0.7), ("quoting", 0.7), ("supply chain", 0.7), ("inventory", 0.7), ("logistic", 0.7), ("manufactur", 0.6), ("financial close", 0.75), ("close", 0.7),
    ("procure", 0.7), ("vendor", 0.7), ("hr", 0.65), ("recruit", 0.65), ("workforce", 0.65), ("productivity", 0.6), ("document", 0.55),
]
GOALS = {
    "cost_reduction": ["cost", "cost_savings", "cost_reduction", "savings", "spend"],
    "time_savings": ["time", "cycle_time", "processing_time", "response_time", "resolution_time", "efficiency"],
    "revenue_growth": ["revenue", "revenue_increase", "growth", "conversion"],
    "quality_improvement": ["quality", "error_rate", "defect_rate", "accuracy", "compliance"],
    "risk_reduction": ["risk", "incident", "compliance", "security", "fraud"],
    "customer_satisfaction": ["satisfaction", "csat", "nps", "customer"],
    "employee_productivity": ["productivity", "throughput", "capacity", "output", "utilization"],
}
COMPONENT_WEIGHTS = {"problem_alignment": 0.30, "organizational_similarity": 0.20, "goal_alignment": 0.20, "evidence_strength": 0.15, "implementation_fit": 0.10, "outcome_consistency": 0.05}
FUNCTION_NAMES = {"customer_support": ["support", "customer_service", "service"], "human_resources": ["hr", "people"], "supply_chain": ["supply chain", "logistics"], "operations": ["ops", "back office"]}


def words(text: Column) -> Column:
    """Distinct words between blanks, in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"\s+"), ""))


def parts(text: Column) -> Column:
    """Distinct words between blanks, underscores and dashes, in lower case."""
    return words(F.translate(text, "_-", "  "))


def _listed(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def problem_fit(asked: str, text: Column, own: Column | None = None) -> Column:
    """Shared words over the larger set, half as much again, and a tenth for each phrase of two or three words that is in the text (three tenths at most); own: its words, if they are at hand."""
    q = asked.lower().split()
    phrases = sorted({" ".join(q[i : i + n]) for n in (2, 3) for i in range(len(q) - n + 1)})
    own = words(text) if own is None else own
    shared = F.size(F.array_intersect(own, _listed(sorted(set(q)))))
    hits = sum((F.contains(F.lower(text), F.lit(p)).cast("int") for p in phrases), F.lit(0))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.least(F.lit(1.0), shared / F.greatest(F.size(own), F.lit(len(set(q)))) * 1.5 + F.least(F.lit(0.3), hits * 0.1)))


def workflow_fit(asked: str, workflow: Column, own: Column | None = None) -> Column:
    """Equal 1, one in the other 0.7, else half the Jaccard index of their words; 0 if either is missing. own: its words, if they are at hand."""
    q, r = asked.lower().strip(), F.lower(F.trim(workflow))
    qw = _listed(sorted(set(q.replace("_", " ").replace("-", " ").split())))
    rw = parts(workflow) if own is None else own
    return F.when(blank(workflow) | F.lit(not q), 0.0).when(r == q, 1.0).when(F.contains(r, F.lit(q)) | F.contains(F.lit(q), r), 0.7).otherwise(F.size(F.array_intersect(qw, rw)) / F.size(F.array_union(qw, rw)) * 0.5)


def size_fit(count: int | None, band: str | None, employees: Column) -> Column:
    """Mean of the ratio of sizes and of the nearness of bands, of those that can be told."""
    at = F.array_position(_listed(BANDS), employee_band(employees))
    apart = F.abs(at - (BANDS.index(band) + 1 if band in BANDS else 0))
    has_count = F.lit(bool(count)) & (F.coalesce(employees, F.lit(0)) > 0)
    ratio = F.when(has_count, F.least(employees, F.lit(count or 1)) / F.greatest(employees, F.lit(count or 1))).otherwise(0.0)
    near = F.when(F.lit(band not in BANDS) | employees.isNull(), None).when(apart == 0, 1.0).when(apart == 1, 0.5).when(apart == 2, 0.2)
    n = has_count.cast("int") + near.isNotNull().cast("int")
    return (ratio + F.coalesce(near, F.lit(0.0))) / F.greatest(n, F.lit(1))


def industry_fit(asked: str, industries: Column) -> Column:
    """The first of a record's industries that is equal (1), in or around (0.7), or shares a word (0.3)."""
    q = asked.lower().strip()
    qw = _listed(sorted(set(q.replace("_", " ").replace("-", " ").split())))
    one = lambda i: F.when(i == q, 1.0).when(F.contains(i, F.lit(q)) | F.contains(F.lit(q), i), 0.7).when(F.arrays_overlap(parts(i), qw), 0.3)
    return F.when(F.lit(not q), 0.0).otherwise(F.coalesce(F.get(F.array_compact(F.transform(industries, lambda i: one(F.lower(i)))), 0), F.lit(0.0)))


def intervention_fit(category: str, subcategory: str, own_category: Column, families: Column) -> Column:
    """Category (equal 1, one of its families 0.6) and subcategory (a family 1, in one 0.5), averaged over those asked and told."""
    told = F.lit(bool(category)) & ~blank(own_category)
    kin = F.arrays_overlap(families, _listed(CATEGORY_FAMILIES.get(category, [""])))
    first = F.when(told, F.when(F.lower(own_category) == category, 1.0).when(kin, 0.6).otherwise(0.0)).otherwise(0.0)
    second = F.when(F.lit(not subcategory), None).when(F.array_contains(families, subcategory), 1.0).when(F.exists(families, lambda f: F.contains(f, F.lit(subcategory))), 0.5)
    n = F.lit(1 if category else 0) + second.isNotNull().cast("int")
    return (first + F.coalesce(second, F.lit(0.0))) / F.greatest(n, F.lit(1))


def outcome_fit(asked: str, categories: Column) -> Column:
    """Best of a record's outcome categories: equal 1, in or around 0.7."""
    q = asked.lower().strip()
    one = lambda c: F.when(c == q, 1.0).when(F.contains(c, F.lit(q)) | F.contains(F.lit(q), c), 0.7).otherwise(0.0)
    return F.when(F.lit(not q), 0.0).otherwise(F.coalesce(F.array_max(F.transform(categories, lambda c: one(F.lower(c)))), F.lit(0.0)))


def similarity(q: Mapping[str, object], text_words: Column | None = None, workflow_words: Column | None = None) -> dict[str, Column]:
    """The six factors of a record (text, workflow, category, families, industries, employee_count, outcomes) for a profile, before their weights."""
    c = F.col
    return {
        "problem": problem_fit(q["workflow"], c("text"), text_words), "workflow": workflow_fit(q["workflow"], c("workflow"), workflow_words), "company_size": size_fit(q.get("employee_count"), q.get("size_band"), c("employee_count")),
        "industry": industry_fit(q.get("industry", ""), c("industries")), "intervention": intervention_fit(q.get("category", ""), q.get("subcategory", ""), c("category"), c("families")), "outcome": outcome_fit(q.get("outcome", ""), c("outcomes")),
    }


def scored_variants(records: DataFrame, profiles: Sequence[Mapping[str, object]]) -> DataFrame:
    """(id, totals): the weighted similarity of each record to each of several profiles, in their order.

    Words are cut once a record. A factor is worked out once for each different
    question that it is asked, so profiles that differ in one field share the rest.
    """
    cut = records.withColumns({"text_words": words(F.col("text")), "workflow_words": parts(F.col("workflow"))})
    asked = {"problem": ["workflow"], "workflow": ["workflow"], "company_size": ["employee_count", "size_band"], "industry": ["industry"], "intervention": ["category", "subcategory"], "outcome": ["outcome"]}
    made: dict[tuple, tuple[str, Column]] = {}
    names = []
    for q in profiles:
        found = similarity(q, F.col("text_words"), F.col("workflow_words"))
        names.append({n: made.setdefault((n, *(q.get(f) for f in asked[n])), (f"f{len(made)}", c))[0] for n, c in found.items()})
    rows = cut.select("id", *(c.alias(name) for name, c in made.values()))
    return rows.select("id", F.array(*(weighed({n: F.col(f) for n, f in own.items()}, WEIGHTS) for own in names)).alias("totals"))


def context_similarity(q: Mapping[str, str]) -> dict[str, Column]:
    """The ten factors for a context profile. What a record lacks is neutral (0.5) in function, size, place and rules; a missing model or readiness is neutral on either side."""
    c = F.col
    text = q.get("problem") or q.get("workflow", "")
    asked = sorted(set(re.findall("[a-z0-9]+", text.lower())))
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")))
    problem = F.when(blank(c("text")) | F.lit(not asked), 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(own, _listed(asked))) / max(1, len(asked)) * 1.5))
    terms = [t for t in re.split(r"[_\-\s]+", q.get("workflow", "").lower()) if len(t) >= 4]
    named = F.lit(False)
    for t in terms:
        named = named | F.contains(F.lower("workflow"), F.lit(t))
    flow = workflow_fit(q.get("workflow", ""), c("workflow"))
    fn = q.get("business_function", "").lower()
    kin = {r for r, names in FUNCTION_NAMES.items() if fn in names} | set(FUNCTION_NAMES.get(fn, []))
    own_fn = F.lower(F.trim("business_function"))
    function = F.lit(0.0) if not fn else F.when(blank(c("business_function")), 0.5).when(own_fn == fn, 1.0).when(own_fn.isin(*kin) if kin else F.lit(False), 0.8).otherwise(0.0)
    primary, sub = q.get("industry", ""), q.get("subsector", "")
    own_industry, own_sub = F.get(c("industries"), 0), c("subsector")
    both = F.lit(bool(sub)) & ~blank(own_sub)
    subsector = F.lit(0.0) if not primary else F.when(F.coalesce(own_industry != primary, F.lit(True)), 0.0).when(both & (own_sub == sub), 1.0).when(both, 0.5).otherwise(0.7)
    one = lambda i: F.when(i == primary, 1.0).when(F.arrays_overlap(parts(i), _listed(sorted(set(primary.replace("_", " ").replace("-", " ").split())))), 0.5)
    broader = F.lit(0.0) if not primary else F.coalesce(F.get(F.array_compact(F.transform("industries", one)), 0), F.lit(0.0))
    band = q.get("size_band", "")
    apart = F.abs(F.array_position(_listed(BANDS), employee_band(c("employee_count"))) - (BANDS.index(band) + 1 if band in BANDS else 0))
    size = F.lit(0.0) if not band else F.when(c("employee_count").isNull(), 0.5).when(apart == 0, 1.0).when(apart == 1, 0.6).when(apart == 2, 0.3).otherwise(0.0)
    place, own_place = q.get("geography", "").lower(), F.lower(F.trim("geography"))
    geo = F.lit(0.0) if not place else F.when(blank(c("geography")), 0.5).when(F.contains(own_place, F.lit(place)) | F.contains(F.lit(place), own_place), 1.0).otherwise(0.0)
    rules = q.get("regulation", "")
    regulatory = F.lit(0.0) if not rules else F.when(blank(own_industry), 0.5).when(c("regulation") == rules, 1.0).otherwise(0.0)
    model, ready = q.get("model", "").lower(), q.get("readiness", "").lower()
    own_model = F.lower(F.trim("model"))
    business = F.when(blank(c("model")) | F.lit(not model), 0.5).when(own_model == model, 1.0).otherwise(0.4)
    readiness = F.when(F.coalesce(own_model == ready, F.lit(False)) & F.lit(bool(ready)), 1.0).otherwise(0.5)
    return {
        "problem": problem, "workflow": F.when(named & ~blank(c("workflow")), F.greatest(flow, F.lit(0.9))).otherwise(flow), "operational_function": function, "industry_subsector": subsector, "broader_industry": broader,
        "organization_size": size, "business_model": business, "geography": geo, "regulatory": regulatory, "technology_readiness": readiness,
    }


def weighed(factors: Mapping[str, Column], weights: Mapping[str, float], digits: int | None = None) -> Column:
    """The weighted sum of factors; each weighted one rounded first, if digits are given."""
    one = lambda n: factors[n] * weights[n] if digits is None else half_up(factors[n] * weights[n], digits)
    return sum((one(n) for n in list(weights)[1:]), one(next(iter(weights))))


def status_breakdown(scored: DataFrame) -> DataFrame:
    """(status, n, mean_evidence, negative): what all scored rows (status, evidence) say, before any is cut."""
    return scored.groupBy("status").agg(F.count("*").alias("n"), half_up(F.avg("evidence"), 2).alias("mean_evidence")).withColumn("negative", F.col("status").isin("failed", "abandoned"))


def comparable_tier(similarity_: Column, outcomes: Column) -> Column:
    """Tier of a comparable record from its points."""
    c, org = F.col, F.lower("organization_name")
    academic = F.contains(org, F.lit("university")) | F.contains(org, F.lit("college")) | F.contains(org, F.lit("research"))
    real = (org != "unknown") & ~F.contains(org, F.lit("anonymous"))
    has = outcomes > 0
    points = sum(
        F.when(cond, p).otherwise(0)
        for cond, p in ((real, 2), (c("result_status").isin("successful", "partial", "implemented", "live"), 2), (has, 2), (~c("vendor_reported"), 1), (similarity_ >= 60, 1), (c("independently_verified"), 2), (c("measurement_period").isNotNull(), 1), (F.coalesce(c("employee_count"), F.lit(0)) > 0, 1))
    )
    return F.when(blank(c("organization_name")) | academic, "rejected").when(points >= 8, "gold").when(has & (points >= 4), "decision_grade").otherwise("supporting")


def legacy_tier(points: Column) -> Column:
    """Tier by the older thresholds; a blank organization is not rejected, an academic one is unless verified."""
    org = F.lower("organization_name")
    academic = F.lit(False)
    for w in ("university", "college", "institute of", "school of", "research lab", "academic"):
        academic = academic | F.contains(org, F.lit(w))
    return F.when(academic & ~F.col("independently_verified"), "rejected").when(points >= 8, "gold").when(points >= 4, "silver").when(points >= 1, "bronze").otherwise("rejected")


def steps(x: Column, *pairs: tuple[float, int], otherwise: int = 0) -> Column:
    """Points of the first threshold that x reaches."""
    out = F.when(x >= pairs[0][0], pairs[0][1])
    for at, p in pairs[1:]:
        out = out.when(x >= at, p)
    return out.otherwise(otherwise)


def family_confidence() -> Column:
    """Confidence (0 to 100) in a family from counts: total, family_count, measured, quantified, with_baseline, successful, failed, evidence, organizations, independent."""
    c = F.col
    measured = F.when((c("measured") >= 5) & (c("quantified") >= 3), 25).when((c("measured") >= 3) & (c("quantified") >= 1), 15).when(c("measured") >= 1, 5).otherwise(-10)
    good, bad = c("successful") / c("total"), c("failed") / c("total")
    score = steps(c("total"), (50, 20), (20, 15), (10, 10), (5, 5), otherwise=2) + steps(c("family_count"), (10, 10), (5, 8), (3, 5), (1, 3)) + measured + F.when(good > 0.5, 10).when(good > 0.3, 5).otherwise(0)
    score = score + steps(c("evidence"), (80, 10), (60, 5), (40, 2)) + steps(c("organizations"), (10, 5), (5, 3)) - F.when(bad > 0.5, 20).when(bad > 0.3, 10).when(bad > 0.1, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score + steps(c("independent"), (3, 8), (1, 3)) + F.when(c("with_baseline") >= 3, 5).otherwise(0)))


def labels(families: Column, rank: Column) -> dict[str, Column]:
    """Difficulty, time and advice that families stand for; a substring decides, in order."""
    has = lambda w: F.exists(families, lambda f: F.contains(F.lower(f), F.lit(w)))
    difficulty = F.when(has("ai") | has("hybrid"), "High").when(has("software"), "Medium to High").when(has("process"), "Medium").when(has("automation"), "Low to Medium").when(has("staffing"), "Low").otherwise("Medium")
    time = F.when(has("ai"), "8-24 weeks").when(has("software"), "10-30 weeks").when(has("automation"), "4-12 weeks").when(has("process"), "6-20 weeks").when(has("staffing"), "4-16 weeks").otherwise("To be determined")
    advantage = F.when(has("automation"), "Fast implementation").when(has("software"), "Purpose-built functionality").when(has("process"), "Addresses root causes").when(has("staffing"), "Flexible and reversible").otherwise("Proven approach")
    tradeoff = F.when(has("automation"), "Requires structured processes").when(has("software"), "Vendor lock-in risk").when(has("process"), "Slower to implement").when(has("staffing"), "Hard to scale quickly").otherwise("Requires careful implementation planning")
    return {"difficulty": difficulty, "timeframe": time, "advantage": advantage, "tradeoff": tradeoff, "label": F.when(rank == 1, "recommended").otherwise("alternative")}


def overall_tier(gold: Column, decision_grade: Column, supporting: Column) -> Column:
    return F.when(gold >= 2, "gold").when(gold + decision_grade >= 3, "decision_grade").when(gold + decision_grade + supporting >= 1, "supporting").otherwise("insufficient")


def impact(volume: Column, handling: Column, rate: Column, low: Column, median: Column, high: Column) -> Column:
    """Hours and savings a year from an improvement range; insufficient_input where an input is missing."""
    hours = volume * handling
    known = (volume > 0) & (handling > 0) & (rate > 0) & median.isNotNull()
    whole = lambda x: F.floor(x + 0.5).cast("bigint")
    done = F.struct(F.lit("estimated").alias("status"), whole(hours * low).alias("hours_low"), whole(hours * median).alias("hours"), whole(hours * high).alias("hours_high"), whole(hours * median * rate).alias("savings"))
    none = F.lit(None).cast("bigint")
    return F.when(F.coalesce(known, F.lit(False)), done).otherwise(F.struct(F.lit("insufficient_input").alias("status"), none.alias("hours_low"), none.alias("hours"), none.alias("hours_high"), none.alias("savings")))


def risks() -> Column:
    """What may go wrong with a record (vendor_reported, result_status, families): three at most, or a word on readiness."""
    has = lambda w: F.exists("families", lambda f: F.contains(f, F.lit(w)))
    found = F.array_compact(
        F.array(
            F.when(F.col("vendor_reported"), "Vendor-reported outcome"), F.when(F.col("result_status").isin("failed", "abandoned"), "Similar implementations have failed or been abandoned"),
            F.when(has("automation"), "Complex exceptions may still require manual review"), F.when(has("software"), "Integration with existing systems may take longer than expected"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("Implementation risk depends on organizational readiness"))).otherwise(F.slice(found, 1, 3))


def keyword_demand(workflow: Column) -> Column:
    """The greatest weight of the keywords in a workflow; 0 if it has none."""
    return F.greatest(*(F.when(F.contains(F.lower(workflow), F.lit(k)), v).otherwise(0.0) for k, v in DEMAND_KEYWORDS))


def defended(packages: DataFrame, key: str) -> DataFrame:
    """(key, question, evidence, level, gaps, can_defend): how well a recommendation answers eight questions.

    packages has for each key the counts problem, intervention, organizations,
    implementation, patterns, outcome, metrics, risks, failed, gold and silver,
    and the confidence. A question without an answer is a gap, and so are a
    confidence below 40, no gold or silver evidence and no implementation
    detail; two gaps at most can be defended.
    """
    c, no = F.col, F.lit("unavailable")
    level = lambda n, high, medium, rest="low": F.when(n == 0, no).when(n >= high, "high").when(n >= medium, "medium").otherwise(rest)
    told = F.when((c("implementation") >= 2) & (c("patterns") > 0), c("implementation")).otherwise(0)
    changes = sum((cond.cast("bigint") for cond in (c("gold") == 0, c("silver") == 0, c("implementation") == 0)), (c("confidence") < 40).cast("bigint"))
    answers = [
        ("Why this problem?", c("problem"), level(c("problem"), 5, 2)),
        ("Why this intervention?", c("intervention"), level(c("intervention"), 5, 3)),
        ("Who else solved it?", c("organizations"), F.when(c("organizations") >= 5, "high").when(c("organizations") >= 1, "low").otherwise(no)),
        ("How did they implement it?", told, F.when(told > 0, "high").otherwise(no)),
        ("What outcomes did they achieve?", c("outcome"), level(c("outcome"), 3, 1)),
        ("What risks should we expect?", c("risks") + c("failed"), F.when(c("risks") > 0, "high").when(c("failed") > 0, "medium").otherwise(no)),
        ("How should we measure success?", c("metrics"), F.when(c("metrics") > 0, "medium").otherwise("low")),
        ("What would change this recommendation?", changes, F.when(changes == 0, "high").otherwise("medium")),
    ]
    rows = F.array(*(F.struct(F.lit(q).alias("question"), n.cast("bigint").alias("evidence"), v.alias("level")) for q, n, v in answers))
    open_ = F.size(F.filter(rows, lambda a: a["level"] == "unavailable")) + (c("confidence") < 40).cast("int") + ((c("gold") == 0) & (c("silver") == 0)).cast("int") + (c("implementation") == 0).cast("int")
    out = packages.select(key, rows.alias("answers"), open_.alias("gaps"), ((open_ <= 2) & (c("confidence") >= 40)).alias("can_defend"))
    return out.select(key, F.explode("answers").alias("a"), "gaps", "can_defend").select(key, "a.*", "gaps", "can_defend")


def overlap(asked: str, own: Column) -> Column:
    """Equal 1, one in the other 0.7, else the Jaccard index of the words; 0 if either is missing."""
    q = asked.lower().strip().replace("_", " ").replace("-", " ")
    r = F.translate(F.lower(F.trim(own)), "_-", "  ")
    qw, rw = _listed(sorted(set(q.split()))), words(r)
    return F.when(blank(own) | F.lit(not q), 0.0).when(r == q, 1.0).when(F.contains(r, F.lit(q)) | F.contains(F.lit(q), r), 0.7).otherwise(F.size(F.array_intersect(qw, rw)) / F.size(F.array_union(qw, rw)))


def goal_kinds(goal: str) -> list[str]:
    """The words of the metrics that a goal asks for; none for an unknown goal."""
    g = goal.lower().strip()
    return sorted({w for ws in GOALS.values() if g and any(w in g or g in w for w in ws) for w in ws})


def meets_goal(goal: str, name: Column, category: Column) -> Column:
    """Whether a metric is of the kind that a goal asks for."""
    out = F.lit(False)
    for w in goal_kinds(goal):
        out = out | F.contains(F.lower(name), F.lit(w)) | F.contains(F.lower(category), F.lit(w))
    return out


def goal_level(goal: str, n: Column, quantified: Column) -> Column:
    """How n metrics meet a goal, by whether the first of its kind is quantified: 0.9 if so, else 0.6; none of its kind (null) 0.3; no metric or an unknown goal 0."""
    return F.when(F.lit(not goal_kinds(goal)) | (F.coalesce(n, F.lit(0)) <= 0), 0.0).when(quantified.isNull(), 0.3).when(quantified, 0.9).otherwise(0.6)


def components(a: Mapping[str, object]) -> dict[str, Column]:
    """Five of the six components (0 to 100) of a record for an assessment (workflow, function, industry, employees, geography, goal, budget, weeks); the sixth is its peers' consistency. goal_quantified: whether its first metric that meets_goal() is quantified."""
    c = F.col
    trade = F.when(F.lower("industry") == str(a["industry"]).lower(), 0.8).when(~blank(c("industry")), 0.3).otherwise(0.0)
    at = lambda x: F.array_position(_listed(BANDS), employee_band(x))
    apart = F.abs(at(c("employee_count")) - at(F.lit(int(a["employees"]))))
    near = F.when(c("employee_count").isNull(), 0.0).when(apart == 0, 1.0).when(apart == 1, 0.5).when(apart == 2, 0.2).otherwise(0.0)
    place = F.when(F.lower("geography") == str(a["geography"]).lower(), 0.5).otherwise(0.0)
    n, sample = c("n_metrics"), F.coalesce(c("sample_size"), F.lit(0))
    strength = 50 + F.when(c("n_numeric") > 0, 15).otherwise(0) + F.when(c("independently_verified"), 10).otherwise(0) + F.when(c("has_baseline") | c("with_baseline"), 10).otherwise(0) + steps(n, (3, 10), (1, 5)) - F.when(c("vendor_reported"), 15).otherwise(0) + steps(sample, (30, 10), (10, 5))
    ratio = F.least(c("cost"), F.lit(float(a["budget"]))) / F.greatest(c("cost"), F.lit(float(a["budget"])))
    fit = 50 + F.when(c("cost") > 0, F.when(ratio >= 0.8, 15).when(ratio >= 0.5, 5).otherwise(0)).otherwise(0) + F.when(c("has_software"), 10).otherwise(0) + F.when(c("pilot"), 10).otherwise(0)
    fit = fit + F.when((F.coalesce(c("weeks"), F.lit(0)) > 0) & (c("weeks") <= a["weeks"]), 10).otherwise(0) + F.when(~c("human_review"), 5).otherwise(0)
    held = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("double")
    return {
        "problem_alignment": half_up(F.greatest(overlap(str(a["workflow"]), c("workflow")), overlap(str(a["function"]), c("business_function"))) * 100, 1),
        "organizational_similarity": half_up((trade * 0.3 + near * 0.3 + place * 0.15) * 100, 1), "goal_alignment": half_up(goal_level(str(a["goal"]), n, c("goal_quantified")) * 100, 1), "evidence_strength": held(strength), "implementation_fit": held(fit),
    }
