"""Decisions from answers in words, against a plain reading of each band."""

import itertools

from pyspark.sql import functions as F

from factloom.operators import decision as D

SCHEMA = "id long, constraint string, volume long, exception_rate string, stability string, risk string, budget string, timeline string, frequency string, evidence double"
ROWS = [
    ("capacity", 700_000, "Almost no exceptions", "Very stable", "Low: small delays", "$250k+", "Flexible", "Multiple times a day", 0.8),
    ("errors", 3_000, "Some (<10%)", "Somewhat variable", "High", "Under $10k", "Immediately", "Hourly", None),
    ("compliance", 60_000, "30%+, highly variable", "Entirely manual", "Safety critical", "$50k–100k", "30 days", "daily", 0.2),
    ("cost", 0, "Entirely so", "", "Medium", "", "1–3 months", "", None),
    (None, None, None, None, None, None, None, None, None),
    ("not a constraint", 6_000, "10–30%", "UNSTABLE", "noticeable", "else", "else", "weekly", 0.0),
]


def first(words, text):
    return next((v for w, v in words[0] if w in (text or "").lower()), words[1])


def plainly(row):
    constraint, volume, exceptions, stability, risk, budget, timeline, frequency, evidence = row
    out = []
    for family, (low, high, labour, v1, v2, v3, v4, ex, ex_floor, rs, rf, need, speed) in D.FAMILIES.items():
        r = lambda x: round(x + 1e-9, 2)
        rate = first(D.EXCEPTION_RATE, exceptions)
        small = (budget or "") in ("Under $10k", "") and family != "No_Action"
        fit = {
            "problem_fit": max(0, min(1, D.CONSTRAINTS.get(constraint, {}).get(family, 0.3))),
            "economic_fit": r(max(0.1, min(1, min(1, D.BUDGET[0].get(budget, 100_000) / max((low + high) / 2, 1)) * 0.4 + labour / 100 * 0.6))),
            "automation_potential": r(first(D.EXCEPTION_SCORE, exceptions) * 0.6 + first(D.STABILITY, stability) * 0.4),
            "volume_fit": 0.5 if not volume else v1 if volume < 6_000 else v2 if volume < 60_000 else v3 if volume < 600_000 else v4,
            "exception_fit": r(min(1, rate * 2 + 0.3) if family == "Staffing" else max(ex_floor, 1 - rate * ex)),
            "risk": 0.9 if family == "Staffing" else r(max(rf, 1 - first(D.RISK, risk) * rs)),
            "feasibility": r((0.3 if small else 0.7) * 0.5 + min(1, D.WEEKS[0].get(timeline, 12) / need) * 0.5),
            "organizational_readiness": first(D.READINESS, frequency),
            "integration_feasibility": 0.6,
            "time_to_value": r(speed * 0.6 + first(D.URGENCY, timeline) * 0.4),
            "evidence_strength": 0.5 if evidence is None else evidence,
        }
        weights = D.PROFILES.get(constraint, D.PROFILES["unknown"])
        out.append((round(sum(fit[n] * w for n, w in zip(D.DIMENSIONS, weights, strict=True)), 6), family))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def test_bands(spark):
    extra = [("speed", v, e, s, "Low", b, t, "daily", 0.5) for v, e, s, b, t in itertools.product([None, 5_999, 600_000], ["Some", "30%+"], ["stable", None], ["Under $10k", "$25k–50k"], list(D.WEEKS[0]))]
    rows = ROWS + extra
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).withColumns({"b_rate": F.lit("clash"), "note": F.lit("kept out")})
    got = {}
    for r in D.decide_by_answers(df, "id", top=7).collect():
        got.setdefault(r.id, {})[r.family] = (r.score, r.rank)
    for i, row in enumerate(rows):
        want = plainly(row)
        assert {f: round(s, 5) for f, (s, _) in got[i].items()} == {f: round(s, 5) for s, f in want}, row
        assert [f for f, _ in sorted(got[i].items(), key=lambda x: x[1][1])][0] == want[0][1]
    assert D.decide_by_answers(df.limit(0), "id").count() == 0


def test_what_speaks_against_a_family(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], SCHEMA)
    got = {(r.id, r.family): r.unsuited for r in D.decide_by_answers(df, "id", top=7).collect()}
    assert got[1, "AI"] == got[1, "Workflow_Automation"] == "very_low_volume" and got[1, "Staffing"] == ""
    assert got[2, "Workflow_Automation"] == "too_many_exceptions" and got[2, "Software"] == "not_standardized"
    assert {v for (i, _), v in got.items() if i in (0, 3, 4, 5)} == {""}
