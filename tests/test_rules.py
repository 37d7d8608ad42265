"""Rule tables against literal texts and rows, worked out by hand and not from the tables."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import fields as E
from factloom.functions import rules as R
from factloom.operators import canonical as C
from factloom.operators import promotion as P
from factloom.operators import records as O
from factloom.operators import retrieval as S


def one(spark, text, **columns):
    return spark.createDataFrame([(text,)], "t string").select(*(c.alias(n) for n, c in columns.items())).first().asDict()


@pytest.mark.parametrize(
    ("text", "workflow", "function", "wanted"),
    [
        ("Invoices pile up and cost too much", "invoice_processing", "finance", "cost"),
        ("Customer onboarding is slow", "onboarding", "customer_success", "time"),
        ("Support tickets are escalated with errors", "ticketing", "support", "quality"),
        ("Legal reviews every clause by hand", "contract_review", "legal", "efficiency"),
        ("We cannot qualify leads, revenue suffers", "lead_qualification", "sales", "revenue"),
        ("Email campaign results", "marketing_automation", "marketing", "efficiency"),
        ("Each release is a risk", "ci_cd", "engineering", "efficiency"),
        ("Tribal knowledge in spreadsheets", "process_automation", "operations", "efficiency"),
        ("The monthly close must pass an audit", "process_automation", "finance", "compliance"),
        ("Throughput of the assembly line", "manufacturing", "operations", "efficiency"),
        ("Stock and logistics", "supply_chain", "operations", "efficiency"),
        ("Something else", "process_automation", "operations", "efficiency"),
        ("AP is manual work", "invoice_processing", "finance", "efficiency"),
    ],
)
def test_problems(spark, text, workflow, function, wanted):
    assert one(spark, text, **O.problem(F.col("t"))) == {"workflow": workflow, "business_function": function, "wanted": wanted}


def test_relevance_counts(spark):
    text = "Acme Corp implemented an RPA platform. The team saved 300 hours; error rate fell 40%. ROI and payback in 6 months at Bank of Spring."
    got = one(spark, text, **{g: R.signals(F.col("t"), g) for g in R.SIGNALS})
    # implemented, saved, ROI, payback, error rate, %, team; "at Bank", Corp, Bank; 40%, saved/fell, hours, months; RPA, platform
    assert got == {"high": 7, "org": 3, "outcome": 3, "intervention": 2}
    label = R.relevance(F.col("t"), *(R.signals(F.col("t"), g) for g in R.SIGNALS))
    assert one(spark, text, x=label)["x"] == "high_relevance"
    assert {one(spark, t, x=label)["x"] for t in ("", "{json}", "<html>", "# title", "// code", "job posting for a team", "please subscribe")} == {"not_relevant"}


def test_metrics(spark):
    text = "Cycle time reduced from 9 days to 4 days. NPS improved from 31 to 52. Error rate dropped from 9% to 3%. Saved 120 hours. $2.5 million in annual savings for a team of 14."
    got = {(m["category"], m["value"]) for m in one(spark, text, m=R.text_metrics(F.col("t")))["m"]}
    assert {("cycle_time", "9 days"), ("customer_satisfaction", "31"), ("error_rate", "9%"), ("hours_saved", "120"), ("cost_savings", "$2.5"), ("headcount", "14")} <= got


def test_fields(spark):
    text = (
        "Eastfield Logistics deployed Salesforce and UiPath in its warehouse with 1,200 employees. The main challenge: manual invoices that took 45 minutes each. "
        "Investment of $2.5 million over 9 months. Handling was reduced by 30% from 40 hours, tracked over 6 months at 12 sites by a third-party audit. It failed because the data was late."
    )
    got = one(spark, text, **E.fields(F.col("t")), band=E.band(E.fields(F.col("t"))["organization_employee_count"]))
    assert got["organization_name"] == "Eastfield Logistics" and got["organization_employee_count"] == 1200 and got["band"] == "enterprise"
    assert got["organization_industry"] == ["logistics"] or "logistics" in got["organization_industry"]
    assert {"finance", "operations"} <= set(got["problem_business_function"]) and got["problem_statement"].startswith("manual invoices that took 45 minutes each.")
    assert got["implementation_cost"] == 2_500_000 and (got["implementation_time_value"], got["implementation_time_unit"]) == (9, "month")
    assert got["outcome_value"] == 30 and got["outcome_percentage"] == 30 and got["baseline_value"] == 40 and got["measurement_period"] == "tracked over 6 months"
    assert got["has_baseline"] and got["independently_verified"] and not got["has_control_group"] and not got["vendor_reported"]
    assert got["software"] == ["Salesforce", "UiPath"] and got["failure_conditions"][0].startswith("the data was late") and got["success_factors"] == []
    empty = one(spark, "", **E.fields(F.col("t")))
    assert empty["organization_name"] is None and empty["implementation_cost"] is None and empty["software"] == [] and not empty["has_baseline"]


def test_vocabularies(spark):
    aliases, words = {"banking": "financial_services", "health care": "healthcare"}, [("insur", "insurance"), ("bank", "banking_kw")]
    e = lambda t: one(spark, t, e=C.industry(F.col("t"), aliases, words))["e"].asDict()
    assert e("Health_Care (US)") == {"value": "healthcare", "confidence": 1.0, "method": "explicit"}
    assert e("Tank Storage / Insurers / Banking") == {"value": "financial_services", "confidence": 0.567, "method": "explicit"}  # (0 + 0.7 + 1) / 3
    assert e("Insurers") == {"value": "insurance", "confidence": 0.7, "method": "inferred"} and e("other")["value"] is None and e("")["confidence"] == 0
    f = lambda t: one(spark, t, e=C.function(F.col("t"), ["sales"], {"hr": "human_resources"}))["e"].asDict()
    assert (f("Sales, Marketing")["confidence"], f("HR")["value"], f("HR")["confidence"], f("Ancillary Revenue / Guests")["value"], f("x")["confidence"]) == (1.0, "human_resources", 0.9, "ancillary_revenue", 0.5)
    w = [("processing", "late"), ("claim", "short"), ("claims", "long")]
    assert one(spark, "Claims processing", x=C.earliest_keyword(C.cleaned(F.col("t")), w))["x"] == "long"  # begins first, and the longer of two
    assert one(spark, "Odd Work!", x=C.workflow(F.col("t"), {}, w))["x"].asDict() == {"value": "odd_work", "confidence": 0.3, "method": "inferred"}
    assert one(spark, "Acme® (EU) Inc.", x=C.product_key(F.col("t")))["x"] == "acme"
    assert [one(spark, t, x=C.tier_name(F.col("t")))["x"] for t in ("silver", "bronze", "", "Gold")] == ["decision_grade", "supporting", "supporting", "gold"]


def test_retrieval_factors(spark):
    p = one(spark, "manual claims processing takes long", a=S.problem_fit("claims processing today", F.col("t")), b=S.workflow_fit("claims", F.lit("claims_processing")), c=S.workflow_fit("invoice_processing", F.lit("claims processing")), d=S.workflow_fit("", F.lit("x")))
    assert p["a"] == pytest.approx(2 / 5 * 1.5 + 0.1) and p["b"] == 0.7 and p["c"] == pytest.approx(0.5 / 3) and p["d"] == 0
    assert one(spark, "", x=S.size_fit(100, "50-200", F.lit(300)))["x"] == pytest.approx((1 / 3 + 0.5) / 2)
    assert one(spark, "", x=S.industry_fit("retail bank", F.array(F.lit("oil"), F.lit("bank"))))["x"] == 0.7
    assert one(spark, "", x=S.overall_tier(F.lit(1), F.lit(2), F.lit(0)), y=S.overall_tier(F.lit(0), F.lit(0), F.lit(0))) == {"x": "decision_grade", "y": "insufficient"}


def test_promotion_rules(spark):
    t = lambda s: tuple(one(spark, s, v=P.timeframe(F.col("t"))[0], u=P.timeframe(F.col("t"))[1]).values())
    assert t("1,200 days") == (1200, "day") and t("late 2024") == (2024, "months") and t("within weeks") == (1, "week") and t("soon") == (None, None)
    assert one(spark, "RPA pilot", x=P.named_family(F.col("t")))["x"] == "Workflow_Automation" and one(spark, "Email tool", x=P.named_family(F.col("t")))["x"] == "AI"  # "ai" inside a word
    assert one(spark, " GenAI ", x=P.category(F.col("t")))["x"] == "ai"
    assert one(spark, "", x=P.source_types(F.array(F.lit("rollout_strategy"), F.lit("lessons_learned"), F.lit("none"))))["x"] == ["case_study", "implementation_guide", "postmortem"]


def test_field_sensitivity_scores_one_by_one(spark, sf_dir):
    from factloom.plans import retrieval as plans

    top = []
    for change in plans.CHANGES:
        rows = plans._scored(spark, sf_dir, plans.PROFILE | change).select("id", F.floor(F.col("total") * 1000 + 0.5).alias("s")).collect()
        top.append({r["id"]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r["s"], r["id"]))[:25], 1)})
    got = {r["field"]: (r["common"], r["moved"]) for r in plans.field_sensitivity(spark, sf_dir).collect()}
    for name, ranks in zip(plans._FIELDS[1:], top[1:], strict=True):
        both = ranks.keys() & top[0].keys()
        assert got[name][0] == len(both) and got[name][1] == pytest.approx(sum(abs(ranks[i] - top[0][i]) for i in both) / len(both) / 25 if both else 1.0, abs=1e-4)


def test_words_are_found_as_by_their_patterns(spark):
    """Whole-word signals are looked up in a set of words; the patterns themselves, case taken off ASCII letters alone, say the same."""
    import random
    import re

    from factloom.functions import rules as R
    from pyspark.sql import functions as F

    rng = random.Random(3)
    parts = ["implemented", "Deployed", "IMPROVED", "roi", "ROIs", "results", "result", "dollars", "pre", "post_", "_team", "pilot2", "saveD", "API", "PaaS", "éroi", "roié", "workflow-", "KiK", "%", "$5", "cloud", "policy", "\n", "rolled out"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", ".", "-", " "]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for group, (cased, patterns) in R.SIGNALS.items():
        got = {r["i"]: r["n"] for r in df.select("i", R.signals(F.col("t"), group).alias("n")).collect()}
        for i, t in enumerate(texts):
            want = None if t is None else sum(bool(re.search(p, t, re.A if cased else re.A | re.I)) for p in patterns)
            assert got[i] == want, (group, t)
