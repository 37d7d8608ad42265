"""Percentiles over spans of days against sorted lists."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import spans as S
from factloom.sources.tables import saved

FIRST = dt.date(2024, 3, 1)
SHARES = [0.0, 0.25, 0.5, 0.95, 1.0]


def plainly(rows, spans, shares):
    out = {}
    for span, a, b in spans:
        for key in {r[0] for r in rows}:
            v = sorted(r[2] for r in rows if r[0] == key and r[1] and a <= r[1] <= b and r[2] is not None and r[2] == r[2])
            for p in shares if v else []:
                out[span, key, p] = (len(v), v[min(int(len(v) * p), len(v) - 1)])
    return out


@pytest.mark.parametrize("margin", [0.01, 0.0002])
def test_equal_to_sorted_lists(spark, margin):
    """A hot key, days that differ in level, ties, nulls, NaN; with a tiny margin many brackets miss, and the whole range serves."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), FIRST + dt.timedelta(rng.randrange(12)), 0.0) for _ in range(6000)]
    rows = [(k, d, round(rng.gauss(10 * (d.day % 4), 1), 3)) for k, d, _ in rows]
    rows += [("hot", FIRST, 7.0)] * 500 + [("a", FIRST, None), ("a", None, 3.0), ("b", FIRST, float("nan")), ("only nan", FIRST, float("nan")), ("one", FIRST, -1.5)]
    spans = [("all", FIRST, FIRST + dt.timedelta(11)), ("some", FIRST + dt.timedelta(2), FIRST + dt.timedelta(6)), ("day", FIRST, FIRST), ("none", FIRST - dt.timedelta(9), FIRST - dt.timedelta(5)), ("turned", FIRST + dt.timedelta(3), FIRST)]
    df = spark.createDataFrame(rows, "key string, day date, x double").withColumn("v", F.lit("extra"))
    days = saved(S.by_day(df, "key", "day", "x", k=100))
    got = S.percentiles(df, days, spark.createDataFrame(spans, "span string, first date, last date"), SHARES, "key", "day", "x", margin).collect()
    assert {(r.span, r.key, r.share): (r.n, r.value) for r in got} == plainly(rows, spans, SHARES)
    assert len(got) == len({(r.span, r.key, r.share) for r in got})


def test_days_outside_the_bracket_are_not_needed(spark):
    """The rows of days that lie wholly below or above every bracket may be gone: what was kept of them is enough."""
    rows = [("k", FIRST + dt.timedelta(d), float(1000 * d + i)) for d in range(9) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, day date, x double")
    days = saved(S.by_day(df, "key", "day", "x"))
    span = spark.createDataFrame([("all", FIRST, FIRST + dt.timedelta(8))], "span string, first date, last date")
    left = df.where(F.col("day") == FIRST + dt.timedelta(4))
    assert S.percentiles(left, days, span, [0.5], "key", "day", "x").collect()[0].value == 4050.0


def test_days_can_be_added(spark):
    """Sketches of days written at different times serve together; an empty table gives no rows."""
    rows = [("k", FIRST + dt.timedelta(d), float(i * 7 % 100)) for d in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, day date, x double")
    old, new = df.where(F.col("day") < FIRST + dt.timedelta(2)), df.where(F.col("day") >= FIRST + dt.timedelta(2))
    days = saved(S.by_day(old, "key", "day", "x").unionAll(S.by_day(new, "key", "day", "x")))
    spans = [("all", FIRST, FIRST + dt.timedelta(3))]
    named = spark.createDataFrame(spans, "span string, first date, last date")
    got = S.percentiles(df, days, named, SHARES, "key", "day", "x").collect()
    assert {(r.span, r.key, r.share): (r.n, r.value) for r in got} == plainly(rows, spans, SHARES)
    none = df.limit(0)
    assert S.percentiles(none, saved(S.by_day(none, "key", "day", "x")), named, SHARES, "key", "day", "x").count() == 0
