"""Evidence wiring against a plain walk over the ladder."""

import random

import pytest
from factloom.operators import wiring as W
from pyspark.sql import functions as F

ASKED = [
    {"workflow": "claims intake", "function": "finance", "industry": "steel", "employee_count": 100, "outcome": "cost"},
    {"workflow": "nobody asks", "function": "legal", "industry": "", "employee_count": None, "outcome": ""},
    {"workflow": "claims desk", "function": "IT", "industry": "paper", "employee_count": 9, "outcome": "time"},
]
SCHEMA = "id long, organization_name string, business_function string, text string, workflow string, industries array<string>, employee_count int, outcomes array<string>, families array<string>"


def rows(seed, n, orgs):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [
        (i, pick(*orgs), pick("finance", "it", "", None), pick("claims intake by hand", "a claims desk", "other words", ""), pick("claims_intake", "desk", "", None), [pick("steel", "paper")], pick(None, 5, 80, 4000), pick([], ["cost"], ["time", "cost"]), pick(["generative_ai"], ["training"], ["staffing_increases", "rpa"]))
        for i in range(n)
    ]


def walk(pairs, steps, least, most):
    """The records found for one question and family, and the step, by trying one step after the other."""
    best = (None, [], 0)
    for k in range(steps):
        scored = sorted(((-p[f"s{k}"], p["id"], p["organization"]) for p in pairs if p[f"s{k}"] is not None))
        found, seen = [], set()
        for s, i, org in scored:
            if org not in seen and len(found) < most:
                seen.add(org)
                found.append((i, -s))
        for s, i, _ in scored:
            if len(found) >= least:
                break
            if (i, -s) not in found:
                found.append((i, -s))
        if found and (best[0] is None or len(scored) > best[2]):
            best = (k, found, len(scored))
        if len(scored) >= least:
            return (k, found, len(scored)) if best[0] == k or best[2] < least else best
    return best


@pytest.mark.parametrize("seed,n,orgs", [(1, 60, ["A", "a", "B", "C", "D", "E", "", None]), (2, 40, ["one", "One", "two"]), (3, 3, ["x"]), (4, 25, ["", None])])
def test_ladder_against_plain_walk(spark, seed, n, orgs):
    df = spark.createDataFrame(rows(seed, n, orgs), SCHEMA)
    kinds = {"AI": "generative_ai", "Workflow_Automation": "rpa"}
    made = [r.asDict() for r in W.pairs(W.factors(df, ASKED, kinds), W.LADDER).collect()]
    chosen, found = W.comparables(df, ASKED, subtypes=kinds)
    steps = {(r["question"], r["family"]): (r["step"], r["reached"]) for r in chosen.collect()}
    got = {}
    for r in found.collect():
        got.setdefault((r["question"], r["family"]), []).append((r["id"], r["likeness"]))
    for q in range(len(ASKED)):
        for family in kinds:
            step, want, reached = walk([p for p in made if (p["question"], p["family"]) == (q, family)], len(W.LADDER), 5, 10)
            assert sorted(got.get((q, family), [])) == sorted(want)
            assert steps.get((q, family), (None, 0)) == (step, reached)


def test_gate_and_strength(spark):
    found = spark.createDataFrame([(0, "AI", i, x) for i, x in enumerate([900_000, 550_000, 549_999, 345_000, 344_999, 100_000, 560_000, 700_000, 360_000])] + [(0, "Hybrid", 1, 200_000)], "question int, family string, id long, likeness long")
    got = {r["family"]: r for r in W.wired(found).collect()}
    a = got["AI"]
    assert (a["results"], a["direct"], a["supporting"], a["evidence"]) == (9, 5, 2, [0, 7, 6, 1, 2]) and a["strength"] == round((90 + 70 + 56 + 55 + 55) / 500 + 1e-9, 2)
    assert (got["Hybrid"]["direct"], got["Hybrid"]["strength"], got["Hybrid"]["evidence"]) == (0, 0.0, [])


def test_evidence_changes_the_ranking(spark):
    decided = spark.createDataFrame([(0, "AI", 1), (0, "Hybrid", 2), (0, "No_Action", 3)], "question int, family string, rank int")
    found = spark.createDataFrame([(0, "Hybrid", 5, 800_000)], "question int, family string, id long, likeness long")
    chosen = spark.createDataFrame([(0, "Hybrid", 2, 1)], "question int, family string, step int, reached long")
    score = lambda seen: seen.select("question", "family", F.coalesce("evidence", F.lit(0.5)).alias("score"))
    got = {r["family"]: r for r in W.with_evidence(decided, chosen, found, score).collect()}
    assert (got["Hybrid"]["rank"], got["Hybrid"]["was"], got["Hybrid"]["step"]) == (1, 2, 2)
    assert got["AI"]["limit"] == "no comparable implementation" and got["AI"]["confidence"] == "low" and got["No_Action"]["limit"] is None


def test_no_row_is_kept_for_each_organization(spark, monkeypatch):
    """With thousands of organizations the aggregates hold a fixed number of rows, and the places stay the same as by a plain walk."""
    df = spark.createDataFrame(rows(5, 3000, [f"org {i}" for i in range(2500)] + ["", None]), SCHEMA)
    sizes, save = [], W.saved
    monkeypatch.setattr(W, "saved", lambda x: (out := save(x), sizes.append(out.count()))[0])
    chosen, found = W.comparables(df, ASKED, subtypes={"AI": "generative_ai"})
    assert max(sizes[1:]) < 100, sizes  # after the factors, of which there is a row a record
    made = [r.asDict() for r in W.pairs(W.factors(df, ASKED, {"AI": "generative_ai"}), W.LADDER).collect()]
    steps, got = {r["question"]: (r["step"], r["reached"]) for r in chosen.collect()}, {}
    for r in found.collect():
        got.setdefault(r["question"], []).append((r["id"], r["likeness"]))
    for q in range(len(ASKED)):
        step, want, reached = walk([p for p in made if p["question"] == q], len(W.LADDER), 5, 10)
        assert sorted(got.get(q, [])) == sorted(want) and steps.get(q, (None, 0)) == (step, reached)
