"""Filters and projections over records, and rules that say what becomes of one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a report that tell its makers what to do, and aren't for readers.
DIRECTIVES = ["directives", "next_action", "search_terms", "records_needed"]


def json_list(column: str) -> Column:
    """A list that is kept as JSON text; null and what isn't a list are empty."""
    return F.coalesce(F.from_json(F.col(column), "array<string>"), F.array().cast("array<string>"))


def has_member(items: Column, value: str) -> Column:
    """Whether a list has the value, without regard to case."""
    return F.exists(items, lambda x: F.lower(x) == value.lower())


def has_part(items: Column, value: str) -> Column:
    """Whether a member of a list has the value in it, without regard to case."""
    return F.exists(items, lambda x: F.contains(F.lower(x), F.lit(value.lower())))


def relevance_band(fit: Column) -> Column:
    return F.when(fit >= 55, "direct").when(fit >= 35, "supporting").otherwise("adjacent")


def known(column: str, name: str, least: float = 0.5) -> Column:
    """Whether a map of (value, confidence) has a value under the name that is sure enough."""
    entry = F.try_element_at(F.col(column), F.lit(name))
    return F.coalesce((entry["value"] != "") & (entry["confidence"] >= least), F.lit(False))


def confident(column: str, least: float) -> Column:
    """The values of a map of (value, confidence) that are sure enough and not empty."""
    return F.transform(F.filter(F.map_values(column), lambda e: (e["confidence"] >= least) & (e["value"] != "")), lambda e: e["value"])


def source_rank(text: str, has_document: str, url: str) -> Column:
    """How cheap a record's source is to read: 2 a document's text, 1 a link, 0 none."""
    return F.when(F.col(has_document) & (F.length(F.trim(text)) >= 80), 2).when(F.rlike(url, F.lit("^https?://")), 1).otherwise(0)


def first_by_url(sources: list[DataFrame], limit: int) -> DataFrame:
    """(url, priority, ordinal) of sources of (url, ordinal), each address once: from the source that is listed first, then by ordinal."""
    rows = reduce(DataFrame.unionByName, [s.select("url", F.lit(i).alias("priority"), "ordinal") for i, s in enumerate(sources, 1)])
    first = rows.groupBy("url").agg(F.min(F.struct("priority", "ordinal")).alias("f")).select("url", "f.*")
    return first.orderBy("priority", "ordinal", "url").limit(limit)


def retried(work: DataFrame) -> DataFrame:
    """Work items, the failed ones pending again."""
    return work.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def public(report: Column) -> Column:
    """A report struct without directives."""
    return report.dropFields(*DIRECTIVES)


def verdict() -> Column:
    """What becomes of an extraction (organization_name, problem, title, outcomes): accepted, or quarantined and why."""
    lacks = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    given = lambda x: F.coalesce(x != 0, F.lit(False))
    odd = lambda o: given(o["baseline_value"]) & given(o["post_value"]) & o["absolute_change"].isNotNull() & (F.abs(o["baseline_value"] - o["post_value"]) != F.abs(o["absolute_change"]))
    missing = lacks("organization_name") | lacks("problem") | lacks("title") | F.coalesce(F.size("outcomes") <= 0, F.lit(True))
    return F.when(missing, "quarantine: missing_required_fields").when(F.exists("outcomes", odd), "quarantine: contradictory_fields").otherwise("accept: all_checks_passed")
