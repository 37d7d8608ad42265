"""Open dictionaries: what survives, what has defaults, what is reported."""

from pyspark.sql import functions as F

from factloom.sources import variants as V

TEXTS = ['{"k": 9, "d": {"e": [1, "x", null]}}', "legacy text", None, '{"k": "9"}', '{"k": 1.5}', "[1]", "", '{"k": null}', "{}", '{"k": "nine"}', '{"k": 9, "k": 8}']


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").withColumn("v", V.opened(F.col("t")))


def test_what_is_no_json_survives(spark):
    got = {r.id: r.s for r in frame(spark).select("id", F.try_variant_get("v", "$", "string").alias("s")).collect()}
    assert got[1] == "legacy text" and got[2] is None and got[6] == ""
    assert got[10] == '{"k": 9, "k": 8}'  # keys that repeat are no object of JSON here: kept as text


def test_defaults(spark):
    df = frame(spark).withColumn("k", F.lit("replaced"))
    got = {r.id: (r.k, r.missing) for r in V.picked(df, "v", {"k": ("bigint", -1), "missing": ("string", "none")}).collect()}
    assert got == {0: (9, "none"), 1: (-1, "none"), 2: (-1, "none"), 3: (9, "none"), 4: (1, "none"), 5: (-1, "none"), 6: (-1, "none"), 7: (-1, "none"), 8: (-1, "none"), 9: (-1, "none"), 10: (-1, "none")}


def test_drift(spark):
    found = V.drift(frame(spark), "v")
    got = {(r.path, r.type): r.n for r in found.collect()}
    assert got == {
        ("$", "OBJECT"): 6, ("$", "STRING"): 3, ("$", "ARRAY"): 1, ("$", "MISSING"): 1,
        ("$.k", "BIGINT"): 1, ("$.k", "STRING"): 2, ("$.k", "DECIMAL"): 1, ("$.k", "VOID"): 1, ("$[]", "BIGINT"): 1,
        ("$.d", "OBJECT"): 1, ("$.d.e", "ARRAY"): 1, ("$.d.e[]", "BIGINT"): 1, ("$.d.e[]", "STRING"): 1, ("$.d.e[]", "VOID"): 1,
    }
    odd = {(r.path, r.type): r.reason for r in V.unexpected(found, {"$": "OBJECT", "$.k": "BIGINT", "$.d": "OBJECT"}).collect()}
    assert odd[("$.k", "STRING")] == odd[("$", "MISSING")] == "type" and odd[("$.d.e", "ARRAY")] == "new"
    assert ("$", "OBJECT") not in odd and ("$.k", "BIGINT") not in odd
    assert V.unexpected(found, {}).count() == found.count()
    assert V.drift(frame(spark).limit(0), "v").count() == 0
    assert {r.path for r in V.drift(frame(spark), "v", depth=1).collect()} == {"$", "$.k", "$.d", "$[]"}
