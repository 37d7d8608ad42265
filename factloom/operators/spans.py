"""Percentiles over any span of days, from sketches kept by day and exact counts inside a bracket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.coverage import positions
from factloom.sources.tables import saved

#: Size parameter of a sketch, and how far from a wanted rank (as a share) a bracket reaches; a sketch of 800 errs by about 0.3 %.
SKETCH_K, MARGIN = 800, 0.01


def _plain(value: Column) -> Column:
    """Values that can be ranked: neither null nor NaN, and one zero."""
    return F.when(~F.isnan(value.cast("double")), value.cast("double") + F.lit(0.0))


def by_day(rows: DataFrame, key: str, day: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """(key, day, n, low, high, sketch): what is kept of each key's day, to be written once and added to as days come.

    Null and NaN values and null days count for nothing; a null key is a key of
    its own. Sketches are merged before they are moved, so a hot key costs one
    row a task.
    """
    v = _plain(F.col(value))
    plain = rows.select(F.col(key).alias("key"), F.col(day).cast("date").alias("day"), v.alias("v")).where("v IS NOT NULL AND day IS NOT NULL")
    return plain.groupBy("key", "day").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def _inside(rows: DataFrame, days: DataFrame, wanted: DataFrame) -> DataFrame:
    """(span, key, share, value) of those wanted whose bracket holds the value at their place.

    A day that lies below a bracket counts by its n, one above it not at all;
    only the days that reach into a bracket are read.
    """
    covered = wanted.withColumn("day", F.explode(F.expr("sequence(first, last)")))
    kept = days.select(F.col("key").alias("k"), F.col("day").alias("d"), F.col("n").alias("of_day"), "low", "high")
    met = covered.join(kept, F.expr("key <=> k AND day = d")).drop("k", "d")
    ids = ["span", "key", "share"]
    under = met.where("high < a").groupBy(*ids).agg(F.sum("of_day").alias("below"), F.lit(0).cast("long").alias("inside"))
    reach = met.where("high >= a AND low <= b").select(*ids, "day", "a", "b")
    # Only rows of days that reach into a bracket are moved: what lies below all brackets of its day as a count, the rest with equal values counted.
    ends = reach.groupBy(F.col("key").alias("k"), F.col("day").alias("d")).agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    near = rows.join(ends, F.expr("key <=> k AND day = d")).where("v <= hi").select("k", "d", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
    counts = near.groupBy("k", "d", "v").agg(F.count("*").alias("c"))
    read = counts.join(reach, F.expr("key <=> k AND day = d")).where("v IS NULL OR v <= b")
    read = saved(read.select(*ids, F.when(F.col("v") >= F.col("a"), F.col("v")).alias("v"), "c").groupBy(*ids, "v").agg(F.sum("c").alias("c")))
    parts = read.groupBy(*ids).agg(F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("inside"))
    place = under.unionByName(parts).groupBy(*ids).agg(F.sum("below").alias("below"), F.sum("inside").alias("inside"))
    at = wanted.select(*(F.col(i).alias(f"w_{i}") for i in ids), "rank").join(place, F.expr(" AND ".join(f"{i} <=> w_{i}" for i in ids)))
    at = at.where("rank >= below AND rank < below + inside").select(F.struct(*ids).alias("id"), (F.col("rank") - F.col("below")).alias("at"))
    ranked = positions(read.where("v IS NOT NULL").select(F.struct(*ids).alias("id"), "v", F.col("c").alias("times")), "id", "v", weight="times")
    found = ranked.join(at, "id").where("lo <= at AND at < lo + c")
    return found.select("id.*", F.col("v").alias("value"))


def percentiles(rows: DataFrame, days: DataFrame, spans: DataFrame, shares: list[float], key: str, day: str, value: str, margin: float = MARGIN) -> DataFrame:
    """(span, key, n, share, value): for each span and key that has values there, the sorted values' entry at place floor(n * share).

    spans has (span, first, last), both days included; those whose first day is
    after the last, or that hold no value, give no row. `days` is by_day() of
    the rows. The merged sketch of a span brackets each rank; a bracket that
    misses it, which a sketch allows, is replaced by the whole range, so the
    values are exact whatever `margin` is. A share of 1 and more means the
    greatest value.
    """
    named = spans.select("span", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last")).where("first <= last")
    of_span = named.withColumn("day", F.explode(F.expr("sequence(first, last)"))).join(days, "day")
    merged = of_span.groupBy("span", "first", "last", "key").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda by: F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(min(1.0, max(0.0, s + by))) for s in shares)))
    brackets = merged.select("span", "first", "last", "key", "n", at(-margin).alias("a"), at(margin).alias("b"))
    each = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.get("a", F.lit(i)).alias("a"), F.get("b", F.lit(i)).alias("b")) for i, s in enumerate(shares))))
    asked = brackets.select("span", "first", "last", "key", "n", each.alias("e")).select("span", "first", "last", "key", "n", "e.*")
    rank = F.least(F.floor(F.col("n") * F.col("share")).cast("long"), F.col("n") - 1)
    # Where the margin is less than one value, the value below counts as near, too.
    wanted = asked.withColumns({"rank": rank, "a": F.when(F.col("n") * margin < 1, F.lit(float("-inf"))).otherwise(F.col("a"))})
    wanted = saved(wanted)
    plain = rows.select(F.col(key).alias("key"), F.col(day).cast("date").alias("day"), _plain(F.col(value)).alias("v")).where("v IS NOT NULL AND day IS NOT NULL")
    found = saved(_inside(plain, days, wanted))
    same = F.expr("w.span <=> f.span AND w.key <=> f.key AND w.share = f.share")
    missed = wanted.alias("w").join(found.alias("f"), same, "left_anti").withColumns({"a": F.lit(float("-inf")), "b": F.lit(float("inf"))})
    found = found.unionByName(_inside(plain, days, missed))
    return wanted.alias("w").join(found.alias("f"), same).select("w.span", "w.key", "w.n", "w.share", "f.value")
