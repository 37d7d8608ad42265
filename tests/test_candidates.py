"""Candidate rows, effort and traces on literal rows."""

import pytest
from factloom.operators import candidates as C
from factloom.operators import coverage
from pyspark.sql import functions as F

RECORDS = "id long, organization_name string, problem_statement string, intervention_vendors string, organization_employee_count long, result_status string, sample_size long, independently_verified boolean, vendor_reported boolean, extra int"
METRICS = "record_id long, id long, metric_name string, percentage_change double, absolute_change double, unit string"


def made(spark, records, metrics, similarity):
    factors = ["problem", "workflow"]
    out = C.candidates(spark.createDataFrame(records, RECORDS), spark.createDataFrame(metrics, METRICS), spark.createDataFrame(similarity, "id long, total double, problem double, workflow double"), factors)
    return {r["id"]: r for r in out.collect()}


def test_whole_rows(spark):
    records = [
        (1, "Acme", "p" * 400, '["Globex", "Initech"]', 120, "successful", 30, True, False, 7),
        (2, None, None, None, None, None, None, None, None, 7),
        (3, "Low", "short", "not json", 5, "failed", 1, False, True, 7),
        (4, "Unasked", "", None, 1, "failed", 1, False, True, 7),
    ]
    metrics = [
        (1, 2, "hours", None, 12.4, "h"), (1, 1, "cost", -7.5, 3.0, None), (1, 3, "plain", None, None, None), (1, 4, "rise", 2.5, None, None), (1, 5, "same", 0.0, None, None), (1, 6, "fall", None, -0.6, None),
        (9, 1, "nobody's", 1.0, None, None),
    ]
    got = made(spark, records, metrics, [(1, 0.555, 0.5, 1.0), (2, None, None, None), (3, 1.0, 1.0, 1.0)])
    assert sorted(got) == [1, 2, 3]
    a = got[1]
    assert (len(a["problem_statement"]), a["intervention_vendors"], a["organization_employee_band"], a["similarity_score"]) == (300, ["Globex", "Initech"], "50-200", 56)
    assert a["outcome_summaries"] == ["cost: -8%", "hours: +12 h", "rise: +3%", "same: +0%", "fall: -1 "]
    assert [m["id"] for m in a["metrics"]] == [1, 2, 3, 4, 5, 6] and a["metrics"][2]["metric_category"] == ""
    assert a["evidence_score"] == 100 and a["similarity_breakdown"].asDict() == {"problem": 0.5, "workflow": 1.0}
    b = got[2]
    assert (b["organization"], b["result_status"], b["result_statuses"], b["metrics"], b["outcome_summaries"], b["evidence_score"], b["similarity_score"], b["intervention_vendors"]) == ("", "unknown", ["unknown"], [], [], 50, 0, [])
    assert b["has_control_group"] is None and b["organization_employee_band"] is None
    assert (got[3]["evidence_score"], got[3]["intervention_vendors"]) == (30, [])


def test_every_field_is_there(spark):
    got = made(spark, [(1, "A", "", None, 1, "", 1, True, True, 0)] * 2, [], [(1, 0.1, 0.1, 0.1)])
    fields = set(got[1].asDict())
    assert {*C.TEXTS, *C.LISTS, *C.OTHERS} - {"organization_name"} <= fields and "extra" not in fields
    assert len(fields) == len(C.TEXTS) + len(C.LISTS) + len(C.OTHERS) + 7
    assert made(spark, [], [], []) == {}


@pytest.mark.parametrize("category,weeks,people,first", [("AI", 14, 5, "AI Engineer"), ("Hybrid", 20, 5, "Technical Lead"), ("Staffing", 8, 3, "HR Lead"), ("ai", 8, 3, "Project Lead"), (None, 8, 3, "Project Lead")])
def test_effort(spark, category, weeks, people, first):
    e = spark.range(1).select(C.effort(F.lit(category).cast("string")).alias("e")).first()["e"]
    assert (e["expected_weeks"], e["expected_people"], e["roles"][0]) == (weeks, people, first)
    assert e["min_weeks"] < e["expected_weeks"] < e["max_weeks"] and e["min_people"] < e["expected_people"] < e["max_people"]
    assert e["basis"].startswith("typical" if first != "Project Lead" else "default")


def test_trace(spark):
    rows = [("a", 1, 0.5, 0.2, None, "gold", 10), ("a", 2, 0.105, 0.5, None, "supporting", None), ("a", 3, 0.9, 0.9, 0.9, "decision_grade", 3), ("b", 1, 0.0, 0.0, 0.0, "gold", 0), ("b", 2, 0.0, 0.0, 0.0, "gold", None), ("c", 1, 1.0, 0.5, 0.25, "gold", 1), ("c", 2, 1.0, 0.75, 0.25, "gold", 2)]
    df = spark.createDataFrame(rows, "k string, rank int, x double, y double, z double, tier string, employee_count int")
    got = {r["k"]: r for r in C.trace(df, "k", ["x", "y", "z"], top=2).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert [tuple(r) for r in a["reasons"]] == [("x", 0.5), ("y", 0.5)]  # rank 3 isn't among the best two, and equal ones keep their order
    assert (a["gold"], a["decision_grade"], a["mixed"], a["total"], a["uncertainty"]) == (1, 1, 1, 3, "1 comparable implementation(s) reported mixed or negative outcomes")
    assert b["uncertainty"].startswith("Few comparable") and [r["factor"] for r in b["reasons"]] == ["x", "y"]
    assert [tuple(r) for r in c["reasons"]] == [("x", 1.0), ("y", 0.75)] and c["uncertainty"] == ""
    assert C.trace(df.limit(0), "k", ["x"]).count() == 0
    with pytest.raises(ValueError):
        C.trace(df, "x", ["x"])


def test_diversity(spark):
    rows = [
        ("w", 5, [("Globex", 0.7), ("Initech", 0.69)], [("erp", 1.0), ("erp", 0.9), ("rpa", 0.2)], "steel", "France", "<10"),
        ("w", 6, [("Globex", 1.0), ("Globex", 0.8)], None, "", None, None),
        ("w", 7, [("Globex", 1.0)], [("crm", 0.7)], "steel", "Spain", "10-50"),
        ("w", 8, [("Initech", 1.0)], [], " paper ", " ", "10-50"),
        ("w", 9, [("Globex", 1.0), ("Initech", 1.0)], [(None, 1.0), ("", 1.0)], "paper", "Spain", "10-50"),
        ("w", 3, None, None, None, None, None),
        ("tie", 2, [("B", 1.0)], [], None, None, None), ("tie", 1, [("C", 1.0), ("A", 1.0)], [], None, None, None),
        ("none", 1, [], [], "steel", "Spain", None),
        (None, 1, [("A", 1.0)], [], None, None, None),
    ]
    entry = "array<struct<value:string,confidence:double>>"
    df = spark.createDataFrame(rows, f"w string, id long, vendors {entry}, families {entry}, industry string, geography string, band string")
    got = {r["w"]: r for r in coverage.diversity(coverage.dimension_counts(df, "w", "id"), "w").collect()}
    w = got["w"]
    assert (w["vendors"], w["industries"], w["families"], w["geographies"], w["bands"]) == (2, 2, 2, 2, 2)
    assert (w["vendored"], w["records"], w["top_vendor"], w["share"], w["concentrated"]) == (5, 6, "Globex", 0.8, True)
    assert (got["tie"]["top_vendor"], got["tie"]["share"], got["tie"]["concentrated"]) == ("A", 0.5, False)
    assert (got["none"]["top_vendor"], got["none"]["share"], got["none"]["vendored"], got["none"]["concentrated"]) == (None, 0.0, 0, False)
    assert got[None]["vendors"] == 1
    assert coverage.diversity(coverage.dimension_counts(df.limit(0), "w", "id"), "w").count() == 0
