"""Corpus coverage: tiers, need for evidence, diversity and outcome ranges, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.rules import blank, half_up
from factloom.sources.tables import saved

# Thresholds of coverage and of need.
EXCELLENT, GOOD, DEVELOPING = 25, 10, 4
MIN_COMPARABLES, MIN_GOLD, MIN_SILVER, FIELD_TARGET = 5, 1, 3, 0.5
CONCENTRATED_FROM, CONCENTRATED_SHARE = 5, 0.6
HIGH_TIERS = ("gold", "decision_grade")
#: Fields of an implementation whose coverage counts.
FIELDS = ["rollout_strategy", "success_criteria", "lessons_learned", "implementation_pattern"]
ACADEMIC = ["university", "college", "institute of", "school of", "research lab", "academic"]


def metric_summary(metrics: DataFrame) -> DataFrame:
    """One row a record: how many metrics, how many quantified, observed, and which kinds there are."""
    quantified = F.col("percentage_change").isNotNull() | (F.coalesce(F.col("absolute_change"), F.lit(0)) != 0)
    sustained = F.coalesce(F.rlike(F.lower("time_period"), F.lit("month|year|quarter")), F.lit(False))
    positive = (F.coalesce(F.col("percentage_change"), F.lit(0)) != 0) | (F.coalesce(F.col("absolute_change"), F.lit(0)) != 0)
    return metrics.groupBy("record_id").agg(
        F.count("*").alias("n_metrics"), F.count_if(F.col("percentage_change").isNotNull() | F.col("absolute_change").isNotNull()).alias("n_numeric"), F.max(quantified).alias("quantified"),
        F.max(F.col("baseline_value").isNotNull()).alias("with_baseline"), F.max(F.col("post_value").isNotNull()).alias("with_post"),
        F.max(F.col("percentage_change").isNotNull()).alias("with_percent"), F.max(F.col("absolute_change").isNotNull()).alias("with_absolute"),
        F.max(sustained).alias("sustained"), F.max(positive).alias("positive"),
    )


def with_metrics(records: DataFrame, metrics: DataFrame) -> DataFrame:
    """Records with their metric summary; the aggregate is joined, never the metrics themselves."""
    out = records.join(metric_summary(metrics), F.col("id") == F.col("record_id"), "left").drop("record_id")
    flags = ["quantified", "with_baseline", "with_post", "with_percent", "with_absolute", "sustained", "positive"]
    return out.fillna(0, ["n_metrics", "n_numeric"]).fillna(False, flags)


def gold_points() -> Column:
    """Points of a record (with its metric summary) towards the gold tier."""
    pairs = [
        (~blank(F.col("organization_name")), 2), (~F.col("result_status").isin("unknown", "theoretical", "proposed"), 2), (F.col("quantified"), 2), (F.col("source_url") != "", 1),
        (F.col("has_baseline"), 1), (F.coalesce(F.col("measurement_period"), F.lit(0)) != 0, 1), (F.coalesce(F.col("sample_size"), F.lit(0)) > 1, 1), (F.col("independently_verified"), 2), (F.col("vendor_reported"), -2),
    ]
    return sum((F.when(c, p).otherwise(0) for c, p in pairs), F.lit(0))


def tier() -> Column:
    """Evidence tier of a record with its metric summary."""
    org = F.lower("organization_name")
    academic = F.greatest(*(F.contains(org, F.lit(w)) for w in ACADEMIC)) & ~F.col("independently_verified")
    points = gold_points()
    return (
        F.when(blank(F.col("organization_name")) | academic, "rejected")
        .when(points >= 8, "gold")
        .when(F.col("quantified") & (F.col("richness") == "rich"), "decision_grade")
        .when(points >= 1, "supporting")
        .otherwise("rejected")
    )


def coverage_level(high: Column, ratio: Column, none: str = "absent") -> Column:
    """Label of a category by how many good records it has, and their share."""
    return F.when(high == 0, none).when((high >= EXCELLENT) & (ratio >= 0.25), "excellent").when((high >= GOOD) | (ratio >= 0.5), "good").when((high >= DEVELOPING) | (ratio >= 0.1), "developing").otherwise("limited")


def category_counts(records: DataFrame) -> DataFrame:
    """What the need of each workflow and function is told from: records with a tier, counted; counts of changes can be added to it."""
    filled = [F.count_if(~blank(F.col(f))).alias(f"filled_{f}") for f in FIELDS]
    return records.groupBy("workflow", "business_function").agg(F.count("*").alias("total"), F.count_if(F.col("tier") == "gold").alias("gold"), F.count_if(F.col("tier") == "decision_grade").alias("decision_grade"), *filled)


def gaps(records: DataFrame, demand: Column) -> DataFrame:
    """Need for evidence by workflow and function, from records with a tier."""
    return gaps_of(category_counts(records), demand)


def gaps_of(counts: DataFrame, demand: Column) -> DataFrame:
    """Need for evidence from category_counts.

    gap is the mean of how far the category falls short of its targets; impact
    weighs it by demand.
    """
    by = counts.withColumns({f"cov_{f}": F.col(f"filled_{f}") / F.col("total") for f in FIELDS})
    short = lambda have, want: F.least(F.lit(1.0), (F.lit(want) - have) / F.lit(float(want)))
    parts = [short(F.col("total"), MIN_COMPARABLES), short(F.col("gold"), MIN_GOLD), short(F.col("decision_grade"), MIN_SILVER)]
    parts += [F.greatest(F.lit(0.0), (FIELD_TARGET - F.col(f"cov_{f}")) / FIELD_TARGET) for f in FIELDS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    need = sum((F.greatest(F.lit(0), F.lit(want) - F.col(have)) for have, want in (("total", MIN_COMPARABLES), ("gold", MIN_GOLD), ("decision_grade", MIN_SILVER))), F.lit(0))
    high = F.col("gold") + F.col("decision_grade")
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"cov_{f}") < FIELD_TARGET, F.lit(f)) for f in FIELDS))), ",")
    out = by.select("workflow", "business_function", "total", "gold", "decision_grade", (total / float(len(parts))).alias("raw"), need.alias("needed"), coverage_level(high, high / F.col("total")).alias("coverage"), missing.alias("missing"))
    return out.withColumn("demand", demand).select("*", half_up(F.col("raw"), 3).alias("gap"), half_up(F.col("raw") * F.col("demand"), 3).alias("impact")).drop("raw")


def concentration(pairs: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """How varied `value` is in each group: distinct values, the commonest (of equals the one seen first by `order`), its share, and whether that is too much."""
    counts = pairs.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = F.max_by(F.col(value), F.struct(F.col("n"), -F.col("first")))
    out = counts.groupBy(group).agg(F.count("*").alias("values"), top.alias("top"), F.max("n").alias("top_n"), F.sum("n").alias("total"))
    share = half_up(F.col("top_n") / F.col("total"), 3)
    return out.select(group, "values", "top", share.alias("share"), ((F.col("total") >= CONCENTRATED_FROM) & (share > CONCENTRATED_SHARE)).alias("concentrated"))


def dimension_counts(rows: DataFrame, group: str, order: str, *, sure: float = 0.7) -> DataFrame:
    """(group, dimension, value, n, first): how many of a group's records have each value of each dimension, and the smallest `order` among them.

    rows: group, order, vendors and families (arrays of structs with value and
    confidence), industry, geography, band. Vendors and families count from a
    confidence of `sure`, once a record. Blank and null values don't count.
    Dimension "record" has one value, and "vendored" one that counts the
    records with a vendor. A record becomes a row for each value it has, and
    rows are counted before they are moved, so a hot group costs no more.
    """
    some = lambda name: F.array_distinct(F.transform(F.filter(F.coalesce(F.col(name), F.array()), lambda e: (e["confidence"] >= sure) & (F.trim(e["value"]) != "")), lambda e: e["value"]))
    pair = lambda dimension, value: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))
    each = lambda dimension, values: F.transform(values, lambda v: pair(dimension, v))
    has = rows.select(group, order, some("vendors").alias("v"), some("families").alias("f"), "industry", "geography", "band")
    single = F.array(*(pair(n, F.trim(n)) for n in ("industry", "geography", "band")), pair("record", F.lit("all")), pair("vendored", F.when(F.size("v") > 0, "all")))
    flat = has.select(group, order, F.explode(F.concat(single, each("vendor", F.col("v")), each("family", F.col("f")))).alias("x")).select(group, order, "x.*")
    return flat.where(F.col("value") != "").groupBy(group, "dimension", "value").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def diversity(counts: DataFrame, group: str) -> DataFrame:
    """How varied each group is, from its `dimension_counts`: distinct values of each dimension, and how much one vendor leads.

    The leading vendor is the commonest, of equals the one seen first, then by
    name; its share is of the records that have a vendor. It is too much above
    CONCENTRATED_SHARE, from CONCENTRATED_FROM such records on. A group without
    vendors has none that leads and a share of 0.
    """
    c = F.col
    of = lambda dimension: F.count_if(c("dimension") == dimension)
    total = lambda dimension: F.coalesce(F.sum(F.when(c("dimension") == dimension, c("n"))), F.lit(0))
    lead = F.min(F.when(c("dimension") == "vendor", F.struct((-c("n")).alias("n"), "first", "value")))
    g = counts.groupBy(group).agg(
        of("vendor").alias("vendors"), of("industry").alias("industries"), of("family").alias("families"), of("geography").alias("geographies"), of("band").alias("bands"),
        total("vendored").alias("vendored"), total("record").alias("records"), lead.alias("lead"),
    )
    share = F.coalesce(half_up(-c("lead.n") / c("vendored"), 3), F.lit(0.0))
    return g.withColumns({"top_vendor": c("lead.value"), "share": share, "concentrated": (c("vendored") >= CONCENTRATED_FROM) & (share > CONCENTRATED_SHARE)}).drop("lead")


def top_absent(pairs: DataFrame, group: str, value: str, pool: int = 50, most: int = 3) -> DataFrame:
    """For each group the first `most` of the `pool` commonest values that it lacks."""
    common = pairs.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(pool)
    ranked = common.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))), lambda x: x["v"]).alias("pool"))  # `pool` values
    present = pairs.groupBy(group).agg(F.collect_set(value).alias("present"))
    return present.select(group, F.array_join(F.slice(F.array_except(ranked.scalar(), F.col("present")), 1, most), ",").alias("absent"))


def positions(values: DataFrame, key: str, value: str, parts: int = 64, weight: str | None = None) -> DataFrame:
    """(key, value, c, lo, n): each distinct value of a key, how often it occurs (a row counts `weight` times, once if not given), how many of the key's n values are smaller.

    Equal values are counted before they are moved, and a key's distinct values
    are ranked in `parts` ranges of about equal size, so that no key's values
    meet in one task, however many it has. Where the ranges part is approximate
    and can differ from one evaluation to the next, so it is written once and
    read by both uses. Null comes after all values.
    """
    counts = values.groupBy(key, value).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    splits = saved(counts.groupBy(key).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("splits"), F.sum("c").alias("n")))
    part = F.when(F.col(value).isNull(), parts).otherwise(F.size(F.filter("splits", lambda s: s < F.col(value))))
    placed = counts.join(splits, key).withColumn("part", part).drop("splits")
    cells = placed.groupBy(key, "part").agg(F.sum("c").alias("m"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(key, "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy(key, "part").orderBy(F.asc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(cells, [key, "part"]).select(key, value, "c", "n", (F.col("base") + F.coalesce(F.sum("c").over(inner), F.lit(0))).alias("lo"))


def at_position(value: str, place: Column) -> Column:
    """As an aggregate over positions(): the value at a place counted from 0."""
    return F.max(F.when((F.col("lo") <= place) & (place < F.col("lo") + F.col("c")), F.col(value)))


def outcome_ranges(values: DataFrame, key: str, value: str) -> DataFrame:
    """Low, median and high of each key's values, outliers beyond 1.5 quartile ranges left out from six values on.

    Quartiles are the values at positions n/4 and 3n/4 of the sorted ones.
    """
    placed = positions(values, key, value)
    n, v = F.col("n"), F.col(value)
    quartiles = placed.groupBy(key).agg(at_position(value, F.floor(n / 4)).alias("q1"), at_position(value, F.floor(3 * n / 4)).alias("q3"))
    inside = v.between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    kept = placed.join(quartiles, key).where((n < 6) | inside)
    # What is kept lies together in the order, so places among it are those in the order less the first.
    ends = kept.groupBy(key).agg(F.min("lo").alias("first"), F.sum("c").alias("m"))
    method = F.when(F.max("n") >= 6, "median_iqr").when(F.max("n") == 1, "single_value").otherwise("median_minmax")
    low, high = (at_position(value, F.col("first") + F.floor((F.col("m") - k) / 2)) for k in (1, 0))
    out = kept.join(ends, key).groupBy(key).agg(F.min(value).alias("low"), ((low + high) / 2).alias("median"), F.max(value).alias("high"), F.max("n").alias("sample_size"), method.alias("method"))
    return out.select(key, *(half_up(F.col(c), 1).alias(c) for c in ("low", "median", "high")), "sample_size", "method")
