"""Rules of presence, ids and votes on literal rows."""

from factloom.functions.presence import RULES, row_id
from factloom.operators import decision as D
from factloom.operators import scoring as S
from pyspark.sql import functions as F


def test_rules_on_values_of_each_kind(spark):
    schema = "t string, n int, b boolean, l array<string>, m map<string,int>"
    rows = [("ab", 0, False, [], {}), ("  ", -1, True, [""], {"a": 1}), ("a longer text", 3, None, ["x"], None), (None, None, None, None, None), ("", 1, True, [None, "y"], {})]
    df = spark.createDataFrame(rows, schema).withColumn("i", F.monotonically_increasing_id())
    want = {
        ("gap", "t"): "10100", ("gap", "n"): "11101", ("gap", "b"): "11001", ("gap", "l"): "01101", ("gap", "m"): "01000",
        ("coverage", "t"): "00100", ("coverage", "n"): "00101", ("coverage", "b"): "01001", ("coverage", "l"): "00101", ("coverage", "m"): "01000",
        ("content", "t"): "10100", ("content", "n"): "11101", ("content", "l"): "00101", ("content", "m"): "01000",
        ("completeness", "t"): "11100", ("completeness", "n"): "11101", ("completeness", "l"): "01101",
    }
    for (rule, c), bits in want.items():
        got = df.select("i", RULES[rule](F.col(c), df.schema[c].dataType).alias("x")).orderBy("i").collect()
        assert "".join(str(int(r["x"])) for r in got) == bits, (rule, c)


def test_row_ids(spark):
    rows = [("a", "bc"), ("ab", "c"), (None, "a"), ("", "a"), ("a", "bc")]
    ids = [r["x"] for r in spark.createDataFrame(rows, "a string, b string").select(row_id("a", "b").alias("x")).collect()]
    assert len(set(ids)) == 4 and ids[0] == ids[4]


def test_votes_and_reasons(spark):
    rows = [("w", "o1", "cost: 5%", 1), ("w", "o2", "cost: 6%", 2), ("w", "o3", "a line without a key that is rather long", 3), ("w", "o4", "cost: 7%", 4), ("w", "o5", "cost: 8%", 5), ("w", "o6", "time: 1%", 6)]
    df = spark.createDataFrame(rows, "g string, organization_name string, line string, first int").withColumn("order", F.struct("first"))
    got = [tuple(r) for r in D.outcome_votes(df, "g", 2, 3).orderBy("rank").collect()]
    assert got == [("w", "cost", 4, 1, "o1 cost: 5%; o2 cost: 6%; o4 cost: 7%"), ("w", "a line without a key that is r", 1, 2, "o3 a line without a key that is rather long")]
    cases = spark.createDataFrame([("unknown", 5, 0.9), ("cost", None, 0.9), ("cost", 0, 0.9), ("cost", 5, 0.39), ("cost", 5, 0.4)], "c string, v long, s double")
    assert [r["x"] for r in cases.select(D.insufficient(F.col("c"), F.col("v"), F.col("s")).alias("x")).collect()] == ["constraint_unknown", "volume_unknown", "volume_unknown", "low_confidence", "proceed"]
    sums = spark.createDataFrame([(1200.0, 100.0, 144.0, -0.75), (1200.0, 100.0, 288.0, -0.75), (1200.0, 100.0, 144.0, 3.0)], "b double, s double, p double, r double")
    assert [r["x"] for r in sums.select(S.broken_invariant(F.col("b"), F.col("s"), F.lit(0.0), F.col("p"), F.col("r")).alias("x")).collect()] == ["consistent", "payback", "roi"]
