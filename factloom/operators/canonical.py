"""Raw terms onto vocabularies: the value, how sure it is, and how it was found.

A vocabulary is a parameter: aliases (term to value), keywords (parts of terms,
in order, with their values), and labels. Terms are never dropped: what no
vocabulary knows stays as it is, with little confidence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.rules import half_up, slug

Pairs = Sequence[tuple[str, str]]


def cleaned(raw: Column) -> Column:
    """Lower case, without parentheses, underscores and hyphens as blanks, no blanks around slashes."""
    text = F.translate(F.regexp_replace(F.lower(F.trim(raw)), r"\([^)]*\)", ""), "_-", "  ")
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r" ?/ ?", "/")


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """The table's value of a key, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key) if table else F.lit(None).cast("string")


def first_keyword(key: Column, keywords: Pairs) -> Column:
    """The value of the first listed keyword that is in the key."""
    return F.coalesce(*(F.when(F.contains(key, F.lit(k)), F.lit(v)) for k, v in keywords))


def earliest_keyword(key: Column, keywords: Pairs) -> Column:
    """The value of the keyword that begins first in the key; of those that begin together, the longest."""
    hits = F.array(*(F.when(F.contains(key, F.lit(k)), F.struct(F.instr(key, k).alias("at"), F.lit(-len(k)).alias("length"), F.lit(i).alias("order"), F.lit(v).alias("value"))) for i, (k, v) in enumerate(keywords)))
    return F.array_min(F.array_compact(hits))["value"]


def entry(value: Column, confidence: float, method: str) -> Column:
    return F.struct(value.alias("value"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))


def industry(raw: Column, aliases: Mapping[str, str], keywords: Pairs) -> Column:
    """(value, confidence, method) of an industry label of one or more parts between slashes.

    A part that is an alias is sure, one with a keyword 0.7 so, another not at
    all. The value is that of the surest part (the first of several), the
    confidence the mean over all parts.
    """

    def part(p: Column) -> Column:
        exact, word = lookup(p, aliases), first_keyword(p, keywords)
        return F.struct(F.when(exact.isNotNull(), 1.0).when(word.isNotNull(), 0.7).otherwise(0.0).alias("confidence"), F.coalesce(exact, word).alias("value"), F.when(exact.isNotNull(), "explicit").otherwise("inferred").alias("method"))

    parts = F.filter(F.split(cleaned(raw), "/"), lambda p: F.trim(p) != "")
    found = F.transform(parts, lambda p: part(F.trim(p)))
    best = F.aggregate(found, F.struct(F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("value"), F.lit("inferred").alias("method")), lambda a, x: F.when(x["confidence"] > a["confidence"], x).otherwise(a))
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x["confidence"])
    sure = F.when(best["value"].isNotNull(), half_up(total / F.size(found), 3)).otherwise(0.0)
    return F.struct(best["value"].alias("value"), sure.alias("confidence"), best["method"].alias("method"))


def geography(raw: Column, aliases: Mapping[str, str]) -> Column:
    known = lookup(cleaned(raw), aliases)
    return F.when(F.coalesce(raw, F.lit("")) == "", entry(F.lit(""), 0.0, "explicit")).when(known.isNotNull(), entry(known, 1.0, "explicit")).otherwise(entry(F.trim(raw), 0.3, "inferred"))


def function(raw: Column, names: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """The first of a list between commas or slashes: a known name is sure, an alias 0.9, another 0.5."""
    key = F.translate(F.lower(F.trim(raw)), "- ", "__")
    key = F.when(F.rlike(key, F.lit("[,/]")), F.regexp_replace(F.split(key, "[,/]")[0], "^[_ ]+|[_ ]+$", "")).otherwise(key)
    other = lookup(key, aliases)
    return F.when(F.coalesce(raw, F.lit("")) == "", entry(F.lit(""), 0.0, "explicit")).when(key.isin(*names), entry(key, 1.0, "explicit")).when(other.isNotNull(), entry(other, 0.9, "explicit")).otherwise(entry(key, 0.5, "inferred"))


def product_key(raw: Column) -> Column:
    """A vendor's or technology's name without marks, parentheses and legal suffixes."""
    text = F.regexp_replace(F.regexp_replace(raw, r"(?i)[®™©]|\(r\)|\(tm\)", " "), r"\([^)]*\)", " ")
    text = F.regexp_replace(F.lower(F.translate(text, "_-/", "   ")), r"\b(inc|corp|corporation|llc|ltd|co|company)\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9+.& ]", " "), r"\s+", " "))


def product(raw: Column, aliases: Mapping[str, str], keywords: Pairs) -> Column:
    """A vendor or technology: an alias is sure, a keyword 0.7, else the cleaned name 0.3."""
    key = product_key(raw)
    alias, word = lookup(key, aliases), first_keyword(key, keywords)
    return F.when(alias.isNotNull(), entry(alias, 1.0, "explicit")).when(word.isNotNull(), entry(word, 0.7, "inferred")).otherwise(entry(F.when(key != "", key).otherwise(raw), 0.3, "inferred"))


def workflow(raw: Column, aliases: Mapping[str, str], keywords: Pairs) -> Column:
    """A workflow: an alias is sure, the earliest keyword 0.6, else its slug 0.3."""
    key = cleaned(raw)
    alias, word = lookup(key, aliases), earliest_keyword(key, keywords)
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", entry(F.lit(""), 0.0, "explicit")).when(alias.isNotNull(), entry(alias, 1.0, "explicit")).when(word.isNotNull(), entry(word, 0.6, "inferred")).otherwise(entry(slug(raw), 0.3, "inferred"))


def inferred_workflow(text: Column, keywords: Pairs) -> Column:
    """A workflow from free text: the earliest keyword, else uncategorized; null for no text."""
    word = earliest_keyword(cleaned(text), keywords)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.coalesce(word, F.lit("uncategorized")))


def classified(stored: Column, description: Column, body: Column, aliases: Mapping[str, str], keywords: Pairs) -> Column:
    """(value, confidence, method) in three steps: what is stored, else the description's first 2,000 characters (0.4), else the body's first 3,000 (0.35); else uncategorized."""
    own = workflow(stored, aliases, keywords)
    a, b = earliest_keyword(cleaned(F.substring(description, 1, 2000)), keywords), earliest_keyword(cleaned(F.substring(body, 1, 3000)), keywords)
    known = (F.trim(F.coalesce(stored, F.lit(""))) != "") & (own["method"].isNotNull()) & (own["confidence"] > 0.3)
    return F.when(known, own).when(a.isNotNull(), entry(a, 0.4, "description")).when(b.isNotNull(), entry(b, 0.35, "body")).otherwise(entry(F.lit("uncategorized"), 0.2, "none"))


def tier_name(tier: Column) -> Column:
    """Tiers of older makes under today's names."""
    t = F.lower(F.trim(F.coalesce(tier, F.lit(""))))
    return F.when(t == "silver", "decision_grade").when(t.isin("bronze", ""), "supporting").otherwise(t)


def coverage(df: DataFrame, name: str) -> DataFrame:
    """(field, rows, mapped, sure, distinct_raw, distinct_values) of a table of (raw, e: entry): how far a vocabulary goes."""
    mapped = (F.col("e.value") != "") & (F.col("e.confidence") > 0.3)
    return df.agg(
        F.lit(name).alias("field"), F.count("*").alias("rows"), F.count_if(F.coalesce(mapped, F.lit(False))).alias("mapped"), F.count_if(F.coalesce(F.col("e.confidence") == 1, F.lit(False))).alias("sure"),
        F.count_distinct("raw").alias("distinct_raw"), F.count_distinct(F.when(mapped, F.col("e.value"))).alias("distinct_values"),
    )


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """(value, n) of the k commonest values that are not empty; of equally common ones the first in order."""
    return df.where(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
