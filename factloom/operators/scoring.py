"""Scores of records: evidence, similarity to a profile, roles and economics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the parts of an evidence score, and of a similarity.
EVIDENCE_WEIGHTS = {"source_credibility": 15, "measured_outcomes": 25, "outcome_impact": 20, "sample_size": 5, "independent_validation": 10, "outcome_specificity": 10, "recency": 5, "comparables": 10}
SIMILARITY_WEIGHTS = {"workflow": 0.25, "industry": 0.10, "company_size": 0.10}
BANDS = ["<10", "10-50", "50-200", "200-1000", "1000-10000", "10000+"]


def steps(x: Column, *pairs: tuple[float, float], otherwise: float) -> Column:
    """The value of the first bound that x reaches."""
    out = None
    for bound, value in pairs:
        out = F.when(x >= bound, value) if out is None else out.when(x >= bound, value)
    return out.otherwise(otherwise)


def evidence_parts(today: Column, comparables: Column) -> dict[str, Column]:
    """The parts of a record's evidence score, each from 0 to 1; the record has its metric summary."""
    c, yes = F.col, lambda name: F.col(name)
    bonus = F.when(yes("with_baseline") & yes("with_post"), 0.2).otherwise(0.0)
    outcomes = F.least(F.lit(1.0), F.least(F.lit(1.0), F.least(F.lit(1.0), steps(c("n_metrics"), (3, 1.0), (2, 0.8), (1, 0.5), otherwise=0.0) + bonus) + F.when(yes("with_percent"), 0.1).otherwise(0.0)) + F.when(yes("with_absolute"), 0.1).otherwise(0.0))
    impact = F.least(F.lit(1.0), F.lit(0.5) + F.when(yes("with_baseline"), 0.2).otherwise(0.0) + F.when(yes("sustained"), 0.2).otherwise(0.0) + F.when(yes("positive"), 0.1).otherwise(0.0))
    days = F.datediff(today, c("extracted_at"))
    return {
        "source_credibility": F.when(yes("vendor_reported"), 0.3).when(yes("independently_verified"), 1.0).otherwise(0.6),
        "measured_outcomes": F.when(c("n_metrics") == 0, 0.0).otherwise(outcomes),
        "outcome_impact": F.when(c("n_metrics") == 0, 0.0).when(c("n_numeric") == 0, 0.1).otherwise(impact),
        "sample_size": F.when(F.coalesce(c("sample_size"), F.lit(0)) == 0, 0.3).otherwise(steps(c("sample_size"), (1000, 1.0), (100, 0.8), (10, 0.6), otherwise=0.4)),
        "independent_validation": F.when(yes("independently_verified"), 1.0).when(~yes("vendor_reported"), 0.6).otherwise(0.2),
        "outcome_specificity": F.when(c("n_metrics") == 0, 0.0).otherwise(steps(c("n_numeric") / c("n_metrics"), (0.8, 1.0), (0.5, 0.7), (0.1, 0.4), otherwise=0.1)),
        "recency": F.when(c("extracted_at").isNull(), 0.5).when(days <= 30, 1.0).when(days <= 90, 0.9).when(days <= 365, 0.7).when(days <= 730, 0.5).otherwise(0.3),
        "comparables": steps(comparables, (100, 1.0), (50, 0.8), (10, 0.6), (1, 0.4), otherwise=0.2),
    }


def evidence_score(parts: dict[str, Column]) -> Column:
    """The score from 0 to 100."""
    total = None
    for name, weight in EVIDENCE_WEIGHTS.items():
        total = parts[name] * weight if total is None else total + parts[name] * weight
    return F.floor(total / float(sum(EVIDENCE_WEIGHTS.values())) * 100 + 0.5).cast("int")


def term_similarity(query: Column, term: Column) -> Column:
    """1 if equal, 0.7 if one holds the other, else half their words' Jaccard index."""
    q, t = F.lower(F.trim(query)), F.lower(F.trim(term))
    parts = lambda x: F.array_distinct(F.filter(F.split(F.regexp_replace(x, "[_-]", " "), " +"), lambda w: w != ""))
    union = F.size(F.array_union(parts(q), parts(t)))
    return F.when((q == "") | (t == ""), 0.0).when(q == t, 1.0).when(F.contains(t, q) | F.contains(q, t), 0.7).otherwise(F.lit(0.5) * F.size(F.array_intersect(parts(q), parts(t))) / F.greatest(union, F.lit(1)))


def size_similarity(query: Column, count: Column) -> Column:
    """The smaller head count over the larger; 0 if either is missing."""
    return F.coalesce(F.try_divide(F.least(query, count).cast("double"), F.greatest(query, count)), F.lit(0.0))


def economics(volume: Column, minutes: Column, rate: Column, automatable: Column, build: Column) -> dict[str, Column]:
    """Yearly labour cost, what automation saves of it, and months until it has paid for itself."""
    labour = volume * minutes / 60.0 * rate
    net = labour * F.greatest(F.lit(0.05), F.least(F.lit(0.70), automatable))
    return {"labour": labour, "saving": net, "payback_months": F.try_divide(build, net * 0.5) * 12}


def metric_status(baseline: Column, target: Column, current: Column) -> Column:
    """achieved, on_track (at least half-way) or below_target, in the direction from baseline to target."""
    done = F.when(target >= baseline, current >= target).otherwise(current <= target)
    half = F.when(target >= baseline, current >= baseline + (target - baseline) / 2.0).otherwise(current <= baseline + (target - baseline) / 2.0)
    return F.when(done, "achieved").when(half, "on_track").otherwise("below_target")


def broken_invariant(build: Column, saving: Column, operating: Column, payback: Column, roi: Column) -> Column:
    """Which figure doesn't follow from the others: payback (months, off by more than one), roi (over three years, off by more than one), or consistent."""
    net = saving - operating
    months = F.abs(F.try_divide(build, net) * 12 - payback) > 1
    times = F.abs(F.try_divide(3 * net - build, build) - roi) > 1
    known = (build > 0) & (net > 0) & (payback != 0)
    return F.when(F.coalesce(known & months, F.lit(False)), "payback").when(F.coalesce((build > 0) & (roi != 0) & times, F.lit(False)), "roi").otherwise("consistent")
