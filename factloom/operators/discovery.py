"""Where to look: searches, useful addresses, paragraphs and windows of long texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What searches are made of.
PROBLEMS = [
    "manual reporting", "invoice processing", "customer support resolution", "call center wait times", "supply chain forecasting", "inventory management", "employee onboarding", "document review", "contract analysis", "quality control inspection",
    "production scheduling", "demand planning", "accounts payable", "accounts receivable", "payroll processing", "compliance reporting", "risk assessment", "fraud detection", "predictive maintenance", "workforce scheduling",
]
INTERVENTIONS = [
    "process redesign", "workflow simplification", "RPA automation", "AI implementation", "machine learning", "chatbot deployment", "predictive analytics", "software implementation", "cloud migration", "ERP implementation",
    "CRM implementation", "BI tool deployment", "staffing increase", "staffing reallocation", "outsourcing", "managed services", "training program", "governance framework", "organizational restructuring", "policy change",
]
OUTCOMES = ["case study", "results", "outcomes", "ROI", "savings", "cost reduction", "time savings", "efficiency gain", "implementation", "deployment"]
INDUSTRIES = ["manufacturing", "healthcare", "finance", "banking", "insurance", "retail", "logistics", "telecom", "energy", "government"]
FAILURES = ["failed", "abandoned", "cancelled", "over budget", "underperformed", "reverted", "lessons learned", "postmortem", "retrospective", "what went wrong"]
# Parts of addresses that are of no use, and words of which a title or snippet must have one.
USELESS = ["facebook.com", "twitter.com", "youtube.com", "instagram.com", "linkedin.com/feed", "amazon.com", "wikipedia.org/wiki/LinkedIn", ".pdf", "reddit.com", "quora.com"]
USEFUL = ["case study", "implementation", "outcome", "transformation", "automation", "erp", "rpa", "saved", "reduced", "improved", "roi", "results", "success"]
# Words of which a paragraph on a transformation has two.
TRANSFORMATION = [
    "automated", "automation", "digital transformation", "workflow", "operational efficiency", "cost savings", "process improvement", "lean", "re-engineered", "restructuring", "shared services", "outsourcing", "insourcing",
    "ai implementation", "machine learning", "rpa", "robotic process", "cloud migration", "erp implementation", "supply chain optimization", "self-service", "digitization",
]
# Headings of the two parts of a filing, how far in each must stand at least and at most (as a share), and what a long text is searched for.
ITEMS = [("Item 7.", "ITEM 7.", 5000, 0.5), ("Item 1.", "ITEM 1.", 2000, 0.3)]
SUBJECTS = ["artificial intelligence", "machine learning"]


def searches(spark: SparkSession) -> DataFrame:
    """(query, problem, intervention, outcome, industry): all problems, interventions and outcomes; fewer of them by industry; problems with words for failure."""
    listed = lambda v: F.explode(F.array(*map(F.lit, v)))
    one = spark.range(1)
    quoted = F.concat(F.lit('"'), F.col("problem"), F.lit('" '))
    nothing = F.lit(None).cast("string")
    three = one.select(listed(PROBLEMS).alias("problem")).select("problem", listed(INTERVENTIONS).alias("intervention")).select("problem", "intervention", listed(OUTCOMES).alias("outcome"))
    three = three.select(F.concat(quoted, F.concat_ws(" ", "intervention", "outcome")).alias("query"), "problem", "intervention", "outcome", nothing.alias("industry"))
    trades = one.select(listed(PROBLEMS[:15]).alias("problem")).select("problem", listed(INTERVENTIONS[:15]).alias("intervention")).select("problem", "intervention", listed(INDUSTRIES).alias("industry"))
    trades = trades.select(F.concat(quoted, F.concat_ws(" ", "intervention", "industry"), F.lit(" case study")).alias("query"), "problem", "intervention", F.lit("case study").alias("outcome"), "industry")
    bad = one.select(listed(PROBLEMS[:15]).alias("problem")).select("problem", listed(FAILURES).alias("term"))
    bad = bad.select(F.concat(quoted, F.col("term")).alias("query"), "problem", nothing.alias("intervention"), F.lit("failure").alias("outcome"), nothing.alias("industry"))
    return three.unionAll(trades).unionAll(bad)


def useful(url: Column, title: Column, snippet: Column) -> Column:
    """Whether an address is worth reading: none of the useless ones, and a telling word in title or snippet."""
    said = F.lower(F.concat_ws(" ", title, snippet))
    bad, good = F.lit(False), F.lit(False)
    for w in USELESS:
        bad = bad | F.contains(F.lower(url), F.lit(w))
    for w in USEFUL:
        good = good | F.contains(said, F.lit(w))
    return ~bad & good


def clean_url(url: Column) -> Column:
    """An address with its scheme; of a redirect, the address it leads to."""
    full = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    target = F.nullif(F.regexp_extract(full, r"[?&]uddg=([^&]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(target), full)


def paragraphs(docs: DataFrame, id_col: str, text_col: str, keywords: Sequence[str], least: int = 2, cut: int = 2000) -> DataFrame:
    """(id, paragraph, keywords, words, text): paragraphs between blank lines with so many of the keywords; the text is cut for display."""
    p = docs.select(id_col, F.posexplode(F.split(text_col, r"\n\s*\n")).alias("paragraph", "p"))
    found = F.array_compact(F.array(*(F.when(F.contains(F.lower("p"), F.lit(k)), F.lit(k)) for k in keywords)))
    words = F.size(F.filter(F.split("p", r"\s+"), lambda w: w != ""))
    return p.withColumn("keywords", found).where(F.size("keywords") >= least).select(id_col, "paragraph", "keywords", words.alias("words"), F.substring("p", 1, cut).alias("text"))


def window(text: Column, subjects: Sequence[str] = SUBJECTS) -> tuple[Column, Column]:
    """(rule, start from 1) of the 16,000 characters that are worth most: a filing's Item 7, then Item 1, a short text's head, 500 before a subject, else past the first 2,000."""
    n = F.length(text)
    rule, start = None, None
    when = lambda chain, cond, value: F.when(cond, value) if chain is None else chain.when(cond, value)
    for a, b, least, share in ITEMS:
        for heading in (a, b):
            at = F.instr(text, heading) - 1
            ok = (at >= least) & (at < n * share)
            rule, start = when(rule, ok, F.lit(a.lower().rstrip("."))), when(start, ok, at + 1)
    rule, start = rule.when(n <= 20_000, "head"), start.when(n <= 20_000, 1)
    for s in subjects:
        at = F.instr(F.lower(text), s) - 1
        ok = (at > 2000) & (at < n * 0.5)
        rule, start = rule.when(ok, "subject"), start.when(ok, F.greatest(at - 500, F.lit(0)) + 1)
    return rule.otherwise("middle"), start.otherwise(2001)
