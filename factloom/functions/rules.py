"""Text rules: keyword and pattern classifiers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Intervention families and the substrings that show them, in order.
FAMILIES: dict[str, list[str]] = {
    "process_redesign": ["redesign", "reengineer", "restructure", "reorganization"],
    "workflow_simplification": ["simplif", "streamline", "lean", "eliminate step"],
    "existing_software_optimization": ["optimize", "upgrade", "migrate", "configuration"],
    "new_software_implementation": ["implemented", "deployed", "rolled out", "new system"],
    "rules_based_automation": ["rules", "if-then", "workflow automation", "decision tree"],
    "robotic_process_automation": ["rpa", "robot", "bot", "automation", "software robot"],
    "predictive_ai": ["predictive", "forecast", "ml model", "prediction"],
    "generative_ai": ["generative", "llm", "gpt", "large language model", "gen ai"],
    "ai_assisted_work": ["ai assist", "copilot", "ai-powered", "intelligent assist"],
    "autonomous_ai": ["autonomous", "self-driving", "fully automated", "unattended"],
    "human_in_the_loop_ai": ["human in the loop", "human review", "supervised ai", "human oversight"],
    "staffing_increases": ["hired", "staff", "headcount", "team expand", "recruit"],
    "staffing_reallocation": ["reallocate", "reassign", "shift", "redeploy"],
    "outsourcing": ["outsource", "offshore", "third party", "managed service"],
    "managed_services": ["managed service", "msa", "sla-based"],
    "training": ["training", "upskill", "workshop", "certification", "learn"],
    "governance": ["governance", "policy", "compliance", "oversight", "steering"],
    "organizational_restructuring": ["restructure", "reorg", "new department", "center of excellence"],
    "policy_changes": ["policy change", "new policy", "regulation", "compliance update"],
    "better_measurement_reporting": ["dashboard", "reporting", "analytics", "kpi", "measurement"],
    "no_intervention": ["no change", "status quo", "no intervention", "do nothing"],
    "further_investigation": ["pilot", "proof of concept", "feasibility", "assessment"],
    "hybrid_combination": ["hybrid", "combination", "integrated approach", "multi-pronged"],
}

# Result statuses and their substrings; of several that match the last one holds.
STATUSES: dict[str, list[str]] = {
    "successful": ["success", "improved", "exceeded", "achieved", "positive"],
    "failed": ["failed", "unsuccessful", "did not meet", "worse"],
    "partial": ["partial", "mixed", "some improvement", "limited"],
    "neutral": ["no change", "no impact", "similar", "comparable"],
    "abandoned": ["abandoned", "cancelled", "terminated", "stopped", "scrapped"],
}

# The flag, the pattern looked for in the text, whether in lower case, whether its absence raises the flag.
FLAGS: list[tuple[str, str, bool, bool]] = [
    ("no_baseline", r"baseline|before|pre-implementation", True, True),
    ("no_percentage_change", r"\d+%", False, True),
    ("projected_rather_than_observed", r"projected|expected|estimated to", True, False),
    ("marketing_claim", r"marketing|leader in|industry-first", True, False),
    ("no_sample_size", r"sample|n=|participants|organization", True, True),
    ("vendor_reported", r"vendor|partner|sponsored", True, False),
]

# Metric categories and their patterns, all without regard to case; the first match of each counts.
METRIC_PATTERNS: list[tuple[str, str]] = [
    ("cost_savings", r"([$][\d,]+(?:\.\d+)?)\s*(?:million|billion|k)?\s+(?:\w+\s+){0,3}(?:savings|saved)"),
    ("cost_savings", r"sav(?:ed|ings)\s*(?:of\s*)?[$]?([\d,]+(?:\.\d+)?)\s*(?:million|billion|k)?"),
    ("hours_saved", r"(\d[\d,]*)\s*(?:hours?|hrs?)\s*(?:saved|reduced|freed)"),
    ("hours_saved", r"sav(?:ed|ings)\s*(?:of\s*)?(\d[\d,]*)\s*(?:hours?|hrs?)"),
    ("percentage_change", r"(\d+\.?\d*)\s*%\s*(?:improvement|reduction|increase|decrease)"),
    ("percentage_change", r"(?:improved|reduced|increased|decreased)\s*(?:by\s*)?(\d+\.?\d*)\s*%"),
    ("cycle_time", r"(?:cycle|response|resolution|processing)\s*(?:time\s*)?(?:reduced|decreased|improved)\s*(?:from\s*)?([\d.]+\s*\w+)\s*(?:to\s*)?([\d.]+\s*\w+)?"),
    ("revenue", r"([$][\d,]+(?:\.\d+)?)\s*(?:million|billion|k)?\s+(?:\w+\s+){0,3}(?:revenue|income)"),
    ("revenue", r"revenue\s*(?:increased|grew|rose)\s*(?:by\s*)?(\d+\.?\d*)\s*%"),
    ("customer_satisfaction", r"(?:csat|nps|customer satisfaction)\s*(?:score\s*)?(?:improved|increased|rose)\s*(?:from\s*)?([\d.]+)\s*(?:to\s*)?([\d.]+)?"),
    ("error_rate", r"(?:error|mistake|defect)\s*(?:rate\s*)?(?:reduced|decreased|dropped)\s*(?:from\s*)?([\d.]+%?)\s*(?:to\s*)?([\d.]+%?)?"),
    ("headcount", r"(\d[\d,]*)\s*(?:employees?|people|staff|headcount|fte)"),
    ("headcount", r"(?:team|staff|workforce)\s*(?:of\s*)?(\d[\d,]*)"),
]

# Signals of relevance by group, with whether case matters in the group.
SIGNALS: dict[str, tuple[bool, list[str]]] = {
    "high": (False, [
        r"\bimplemented\b", r"\bdeployed\b", r"\bintroduced\b", r"\bredesigned\b",
        r"\bautomated\b", r"\bmigrated\b", r"\badopted\b", r"\bpiloted\b",
        r"\brolled\s*out\b", r"\blaunched\b", r"\btransformed\b",
        r"\breduced\b", r"\bincreased\b", r"\bsaved\b", r"\bgenerated\b",
        r"\bimproved\b", r"\bfailed\b", r"\babandoned\b",
        r"\bROI\b", r"\bpayback\b", r"\bcost\s*savings\b",
        r"\bhours?\s*saved\b", r"\bcycle\s*time\b", r"\bresponse\s*time\b",
        r"\berror\s*rate\b", r"\bconversion\s*rate\b", r"\bproductivity\b",
        r"\befficiency\b", r"\bthroughput\b", r"\bcapacity\b",
        r"\brevenue\b", r"\bprofit\b", r"\bmargin\b",
        r"\bcase\s*study\b", r"\bresults?\b", r"\boutcomes?\b",
        r"\b(?:before|after|baseline|post|pre)\b",
        r"\bdollar[s]?\b", r"\$[\d,]", r"\bpercent\b", r"%",
        r"\bteam\b", r"\bproject\b", r"\binvestment\b",
        r"\bpilot\b", r"\btrial\b", r"\bexperiment\b",
        r"\bstaff(?:ing|ed)?\b", r"\bhired\b", r"\boutsourced\b",
        r"\boffshored\b", r"\bcenter\s*of\s*excellence\b",
        r"\bgovernance\b", r"\bcompliance\b", r"\bpolicy\b",
    ]),
    "org": (True, [
        r"\b(?:at|for|by|with)\s+[A-Z][a-zA-Z]+",
        r"\b(?:Inc|Corp|LLC|Ltd|Company|Co\.|Group|Partners)\b",
        r"\b(?:University|College|Institute|School|Department)\b",
        r"\b(?:Hospital|Clinic|Medical|Health)\b",
        r"\b(?:Bank|Insurance|Financial)\b",
        r"\b(?:Government|Agency|Ministry|Department|City|County|State|Federal)\b",
        r"\b(?:Startup|Enterprise|Vendor|Consulting|Firm)\b",
        r"\b(?:Company|Corporation|Organization)\b",
    ]),
    "outcome": (True, [
        r"\d+%", r"\$[\d,]+(?:\.\d+)?", r"\d+x\b",
        r"(?:reduced|increased|decreased|improved|saved|dropped|fell|rose)\s+",
        r"(?:from|to)\s+\$?[\d,]+",
        r"[\d,]+(?:\.\d+)?\s*(?:hours?|days?|weeks?|months?|years?)",
        r"[\d,]+(?:\.\d+)?\s*(?:FTE|employees?|people|staff|agents?)",
        r"[\d,]+(?:\.\d+)?\s*(?:transactions?|calls?|tickets?|cases?|orders?)",
    ]),
    "intervention": (False, [
        r"\b(?:AI|ML|RPA|ERP|CRM|BI|API|SaaS|IaaS|PaaS)\b",
        r"\b(?:automation|robot|chatbot|copilot|agent|workflow)\b",
        r"\b(?:software|platform|system|tool|solution|application)\b",
        r"\b(?:cloud|migrate|migration|digital)\b",
        r"\b(?:process|workflow|operation)\s*(?:redesign|reengineer|improve|optimize|simplif)\b",
        r"\b(?:training|upskill|reskill|workshop|certification)\b",
        r"\b(?:outsource|offshore|managed\s*services)\b",
        r"\b(?:governance|policy|compliance|framework)\b",
        r"\b(?:restructure|reorganize|reorg|consolidate)\b",
        r"\b(?:dashboard|reporting|analytics|KPI|metric)\b",
    ]),
}
# What rules a text out.
EXCLUDE = [
    r"^\s*$", r"^\{", r"^<", r"^#", r"^\/\/",
    r"(?:login|signup|subscribe|password|cookie)",
    r"(?:job\s*(?:posting|listing|opening|requisition))",
    r"(?:spam|scam|phishing)",
    r"(?:404|not\s*found|page\s*not\s*found)",
]


def has_any(text: Column, words: list[str]) -> Column:
    """Whether text has any of the words as a substring."""
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def plain(text: Column) -> Column:
    """Lower case, with hyphens and dashes as blanks."""
    return F.translate(F.lower(text), "-–", "  ")


def families(text: Column) -> Column:
    """The families that a text shows, in order."""
    of = lambda t: F.array_compact(F.array(*(F.when(has_any(t, words), F.lit(name)) for name, words in FAMILIES.items())))
    return F.element_at(F.transform(F.array(plain(text)), of), 1)  # so that the text is made plain once


def family_counts(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(family, n, first_id) of the families that occur: one aggregate as wide as the families, then turned, so rows are neither multiplied nor shuffled."""
    flags = df.select(F.col(id_col).alias("id"), plain(F.col(text)).alias("t")).select("id", *(F.when(has_any(F.col("t"), w), F.col("id")).alias(f) for f, w in FAMILIES.items()))
    wide = flags.agg(*(F.struct(F.count(f).alias("n"), F.min(f).alias("first_id")).alias(f) for f in FAMILIES))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.col(f)["n"].alias("n"), F.col(f)["first_id"].alias("first_id")) for f in FAMILIES))).alias("r")).select("r.*").where("n > 0")


def result_status(text: Column) -> Column:
    """The last of the statuses that match, or unknown."""
    t = plain(text)
    return F.coalesce(*(F.when(has_any(t, STATUSES[s]), F.lit(s)) for s in reversed(STATUSES)), F.lit("unknown"))


def first_status(text: Column) -> Column:
    """The first status that matches, failure before success; for short field texts."""
    t = F.lower(text)
    order = {"failed": STATUSES["failed"], "successful": STATUSES["successful"], "partial": STATUSES["partial"], "ongoing": ["ongoing", "in progress", "pilot"]}
    return F.coalesce(*(F.when(has_any(t, w), F.lit(s)) for s, w in order.items()), F.lit("unknown"))


def quality_flags(text: Column) -> Column:
    """Names of the doubts that a text raises, in order."""
    found = []
    for name, pattern, lower, absent in FLAGS:
        hit = F.rlike(F.lower(text) if lower else text, F.lit(pattern))
        raised = ~hit if absent else hit
        if name == "no_baseline":
            raised = raised | F.contains(F.lower(text), F.lit("no baseline"))
        found.append(F.when(raised, F.lit(name)))
    return F.array_compact(F.array(*found))


def text_metrics(text: Column) -> Column:
    """(pattern number, category, value as found) of the first match of each pattern that matches; a value that is found is never empty."""
    found = F.array(*(F.regexp_extract(text, f"(?i){p}", 1) for _, p in METRIC_PATTERNS))
    names = F.array(*(F.lit(c) for c, _ in METRIC_PATTERNS))
    return F.filter(F.transform(found, lambda value, i: F.struct(i.cast("int").alias("pattern"), F.get(names, i).alias("category"), value.alias("value"))), lambda m: m["value"] != "")


def _as_words(pattern: str) -> list[str] | None:
    """The words of which any shows the pattern, if it is nothing but whole words of letters: one, one with an optional end, or a choice."""
    whole = re.fullmatch(r"\\b(?:\(\?:([A-Za-z|]+)\)|([A-Za-z]+)(\??|\[[a-z]\]\?))\\b", pattern)
    if not whole:
        return None
    choice, word, end = whole.groups()
    if choice:
        return choice.lower().split("|")
    if end.startswith("["):
        return [word.lower(), word.lower() + end[1]]
    return [word.lower(), word.lower()[:-1]] if end else [word.lower()]


def signals(text: Column, group: str) -> Column:
    """How many of a group's patterns the text has.

    Patterns that are whole words are looked up in the text's set of words, which
    is made once for all of them; only the others are searched for. Case is
    taken off A-Z alone, as the patterns do.
    """
    cased, patterns = SIGNALS[group]
    plain = {p: None if cased else _as_words(p) for p in patterns}
    found = sum((F.rlike(text, F.lit(p if cased else f"(?i){p}")).cast("int") for p in patterns if not plain[p]), F.lit(0))
    listed = [w for w in plain.values() if w]
    if not listed:
        return found
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.array_distinct(F.split(low, "[^a-z0-9_]+"))
    single = F.array(*(F.lit(w[0]) for w in listed if len(w) == 1)).cast("array<string>")
    any_of = F.array(*(F.array(*map(F.lit, w)) for w in listed if len(w) > 1)).cast("array<array<string>>")
    count = lambda words: F.size(F.array_intersect(words, single)) + F.size(F.filter(any_of, lambda c: F.arrays_overlap(c, words)))
    return found + F.when(text.isNotNull(), F.element_at(F.transform(F.array(own), count), 1))


def relevance(text: Column, high: Column, org: Column, outcome: Column, intervention: Column) -> Column:
    """Label of a text from its signals."""
    total, words = high + org + outcome + intervention, F.size(F.split(F.trim(text), r"\s+"))
    bad = sum((F.rlike(F.lower(text), F.lit(p)).cast("int") for p in EXCLUDE), F.lit(0))
    return (
        F.when(bad > 0, "not_relevant")
        .when((total >= 8) & (org >= 1) & (outcome >= 1) & (intervention >= 1), "high_relevance")
        .when((total >= 5) & ((org >= 1) | (outcome >= 1)), "high_relevance")
        .when((total >= 3) & (words >= 100), "possible_relevance")
        .otherwise("not_relevant")
    )


def slug(text: Column) -> Column:
    """Lower case with runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_number(text: Column) -> Column:
    """The first number in a text, without commas; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(text, ",", ""), r"(\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def host(url: Column) -> Column:
    """The host of a URL in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def employee_band(count: Column) -> Column:
    return F.when(count < 10, "<10").when(count < 50, "10-50").when(count < 200, "50-200").when(count < 1000, "200-1000").when(count < 10000, "1000-10000").when(count.isNotNull(), "10000+")


def company_name(name: Column) -> Column:
    """A company's name without legal suffixes and what they leave dangling."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), r"(?i)[,\s]+(?:inc|corp|corporation|llc|ltd|limited|co|company|plc|gmbh)\.?$", ""), r"[\s&,]+$", ""))


def half_up(x: Column, digits: int) -> Column:
    """x rounded at so many digits, halves up."""
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits


def blank(x: Column) -> Column:
    return F.coalesce(F.trim(x) == "", F.lit(True))
