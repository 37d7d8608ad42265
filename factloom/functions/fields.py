"""Fields that free text states about an implementation, as column expressions."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.rules import has_any

# The kinds of organization a name ends with, and what follows or precedes such a name.
_KINDS = "Inc|Corp|LLC|Ltd|Company|Co\\.|Group|Partners|Systems|Technologies|Solutions|Services|Industries|Health|Financial|Bank|Insurance|Manufacturing|Logistics|Retail|Energy|Pharma|Automotive|Telecom|Airlines|Hospital|University|Institute|Agency|Department|Ministry|Authority|Association|Foundation|Center|Centre|Clinic|School|District|City|County|State|Federal|Government|Enterprises|Holdings|International|Global|Worldwide"
_NAME = rf"(?:a|an|the)?\s*(?:Fortune\s+\d+\s+)?([A-Z][A-Za-z\s&.,]{{3,50}}?(?:{_KINDS}))"
_ACTS = r"\s+(?:implemented|deployed|adopted|rolled out|launched|introduced|automated|transformed|migrated|upgraded|engaged|partnered|reduced|increased|improved|saved|achieved|realized|gained|reported|announced)"
ORGANIZATION = [
    rf"(?:McKinsey|BCG|Bain|Deloitte|PwC|EY|KPMG|Accenture)\s+(?:helped|worked with|partnered with|advised)\s+{_NAME}",
    rf"{_NAME}{_ACTS}",
]
# Substrings of lower-cased text that show an industry, a business function, a product.
INDUSTRIES: dict[str, list[str]] = {
    "healthcare": ["healthcare", "hospital", "clinic", "medical", "pharma", "patient"],
    "manufacturing": ["manufacturing", "factory", "production", "assembly", "industrial"],
    "finance": ["bank", "financial", "insurance", "investment", "credit", "lending"],
    "retail": ["retail", "e-commerce", "store", "consumer", "merchandise"],
    "technology": ["software", "tech", "SaaS", "platform", "cloud", "IT"],
    "logistics": ["logistics", "shipping", "warehouse", "supply chain", "transportation"],
    "energy": ["energy", "utility", "oil", "gas", "electric", "power"],
    "government": ["government", "federal", "state", "municipal", "public sector", "agency"],
    "education": ["university", "college", "school", "education", "academic"],
    "telecom": ["telecom", "telecommunications", "wireless", "broadband", "network"],
}
FUNCTIONS: dict[str, list[str]] = {
    "customer_support": ["customer support", "customer service", "call center", "help desk", "contact center"],
    "finance": ["finance", "accounting", "accounts payable", "accounts receivable", "payroll", "billing", "invoice"],
    "operations": ["operations", "supply chain", "logistics", "manufacturing", "production", "warehouse", "inventory"],
    "human_resources": ["HR", "human resources", "recruiting", "hiring", "onboarding", "talent", "workforce"],
    "sales": ["sales", "revenue", "lead", "pipeline", "CRM", "customer acquisition"],
    "marketing": ["marketing", "advertising", "campaign", "brand", "content"],
    "it": ["IT", "infrastructure", "software", "development", "engineering", "DevOps", "cloud"],
    "legal": ["legal", "contract", "compliance", "regulatory", "risk", "audit"],
    "procurement": ["procurement", "purchasing", "sourcing", "vendor management", "supplier"],
}
SOFTWARE = [
    "Salesforce", "SAP", "Oracle", "Microsoft", "Google", "AWS", "Azure", "ServiceNow", "Workday", "HubSpot", "Zendesk", "Slack", "Zoom", "Tableau", "Power BI", "Looker", "Snowflake", "Databricks",
    "TensorFlow", "PyTorch", "OpenAI", "GPT", "LLM", "RPA", "UiPath", "Automation Anywhere", "Blue Prism", "Zapier", "Python", "Java", "JavaScript", "SQL", "NoSQL",
]
# Upper ends of the employee bands of this extractor.
BANDS = [(50, "startup"), (200, "small"), (1000, "mid-market"), (10000, "enterprise"), (50000, "large enterprise")]
LARGEST = "global enterprise"
# Patterns without regard to case; of several, the first that gives a value counts.
EMPLOYEES = [r"(\d[\d,]*)\s*(?:employees?|people|staff|headcount|workers?|agents?|FTE)", r"(?:team|staff|workforce|organization|company)\s*(?:of\s*)?(\d[\d,]*)", r"(\d[\d,]*)\s*(?:person|employee|agent)\s+(?:team|organization|company)"]
DURATION = [
    r"(\d+)\s*(weeks?|months?|years?)\s*(?:implementation|deployment|project|rollout|migration)?",
    r"(?:implementation|deployment|project|rollout|migration|pilot)\s*(?:took|lasted|spanned|duration|timeline)?\s*(?:of\s*)?(\d+)\s*(weeks?|months?|years?)",
    r"(?:in|within|over)\s*(\d+)\s*(weeks?|months?|years?)",
]
COST = [
    r"(?:cost|investment|budget|spend|spent|price)\s*(?:of\s*)?[\$£€]?([\d,]+(?:\.\d+)?)\s*(million|billion|k|M|B|K)?",
    r"[\$£€]([\d,]+(?:\.\d+)?)\s*(million|billion|k|M|B|K)?\s*(?:implementation|project|deployment|investment|budget)?",
    r"[\$£€]([\d,]+(?:\.\d+)?)\s*(million|billion|k|M|B|K)",
    r"cost\s*(?:of\s*)?[\$£€]?([\d,]+(?:\.\d+)?)\s*(million|billion|k|M|B|K)",
]
BASELINE = [
    r"(?:before|prior to|previously|originally|baseline|pre-implementation)\s*[,:]?\s*(?:was|were|had|averaged)?\s*(?:a\s*)?([\d,]+(?:\.\d+)?)\s*(?:hours?|days?|minutes?|seconds?|transactions?|calls?|tickets?|cases?|%|percent|FTE|agents?|employees?|staff)?",
    r"(?:from|starting at)\s*([\d,]+(?:\.\d+)?)\s*(?:hours?|days?|minutes?|transactions?|calls?|tickets?|cases?|%)",
]
OUTCOME = [
    r"(?:reduced|decreased|improved|increased|saved|achieved|gained|recovered|eliminated)\s*(?:by\s*)?([\d,]+(?:\.\d+)?)\s*(?:hours?|days?|minutes?|%|percent|dollars?|FTE|transactions?|calls?|tickets?)?",
    r"(?:to|down to|up to)\s*([\d,]+(?:\.\d+)?)\s*(?:hours?|days?|minutes?|%|percent|transactions?|calls?|tickets?)",
    r"([\d,]+(?:\.\d+)?)\s*(?:hours?|days?|%|percent)\s*(?:reduction|improvement|savings?|increase|decrease)",
    r"(?:savings?|reduction|improvement|increase|decrease)\s*(?:of\s*)?([\d,]+(?:\.\d+)?)\s*(?:hours?|days?|%|percent|dollars?|FTE)?",
]
PERCENT = [
    r"([\d,]+(?:\.\d+)?)\s*%\s*(?:of\s*)?(?:reduction|improvement|savings?|increase|decrease|gain)",
    r"(?:reduced|decreased|improved|increased|saved)\s*(?:by\s*)?([\d,]+(?:\.\d+)?)\s*%",
    r"([\d,]+(?:\.\d+)?)\s*(?:percent|percentage)\s*(?:reduction|improvement|savings?|increase|decrease)",
    r"([\d,]+(?:\.\d+)?)\s*%",
]
SAMPLE = [
    r"(?:sample|n|N|participants|organizations?|companies?|sites?|locations?)\s*(?:of|=|:)?\s*(\d[\d,]*)",
    r"(\d[\d,]*)\s*(?:organizations?|companies?|sites?|locations?|participants?|teams?|agents?|employees?)",
    r"(\d+)\s*(?:pilot|study|trial)\s*(?:sites?|organizations?|companies?)",
]
PROBLEM = [
    r"(?:problem|challenge|issue|pain point|bottleneck)\s*[,:]?\s*(.{10,200})",
    r"(?:struggling|struggled|facing|faced)\s*(?:with\s*)?(.{10,200})",
    r"(?:before|prior to)\s*(?:the\s*)?(?:implementation|intervention|project|deployment)\s*[,:]?\s*(.{10,200})",
]
PROBLEM_CUES = ["problem", "challenge", "issue", "bottleneck", "struggled", "manual", "time-consuming", "inefficient"]
SUCCESS = [r"(?:success|key|critical|important)\s*(?:factor|reason|driver|enabler)\s*[,:]?\s*(.{10,100})", r"(?:worked|succeeded|effective)\s*(?:because|due to|thanks to)\s*(.{10,100})"]
FAILURE = [r"(?:failed|failure|abandoned|cancelled|unsuccessful)\s*(?:because|due to|reason|factor)\s*[,:]?\s*(.{10,100})", r"(?:didn't work|did not work|failed)\s*(?:because|due to|when|after)\s*(.{10,100})"]
# Patterns of which the whole match counts.
PERIOD = [r"(\d+)\s*(?:month|year|week|quarter)\s*(?:measurement|observation|study|follow-up|post-implementation)", r"(?:measured|tracked|observed|monitored)\s*(?:over|for)\s*(\d+)\s*(?:months?|years?|weeks?)"]
TEAMS = [r"(?:team|group|department|unit)\s*(?:of\s*)?(\d+)\s*(?:people|members?|staff|agents?|employees?)?", r"(?:involved|engaged|assigned|dedicated)\s*(\d+)\s*(?:team|group|people|members?|staff)"]
# Patterns that only have to occur.
EVIDENCE: dict[str, str] = {
    "has_baseline": r"baseline|before|pre-implementation|previously|originally|starting (?:at|with|from)|(?:took|averaged|was|were|had)\s+[\d,]+(?:\.\d+)?\s*(?:hours?|days?|minutes?|transactions?|calls?|tickets?|%)|from\s+[\d,]+(?:\.\d+)?\s*(?:hours?|days?|minutes?|transactions?|calls?|tickets?|%)",
    "has_post_measurement": r"after|post-implementation|following|subsequently|measured|results|outcome|(?:reduced|decreased|improved|increased|saved|dropped|fell)\s+(?:to|by|from)\s+[\d,]+",
    "has_control_group": r"control group|comparison group|randomized|RCT|experimental design",
    "independently_verified": r"independent|third[- ]party|audit|verified|peer[- ]reviewed|published|academic",
    "vendor_reported": r"vendor|partner|sponsored|case study by|customer success story|white paper",
}


def _split(pattern: str) -> list[str]:
    """The alternatives of a pattern that stand outside of its groups; none of these patterns has a bracket or bar in a class."""
    parts, depth = [""], 0
    for piece in re.findall(r"\\.|.", pattern):
        depth += {"(": 1, ")": -1}.get(piece, 0)
        if piece == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += piece
    return parts


def _starts(pattern: str) -> list[str] | None:
    """What the alternatives of a pattern begin with, if each begins with letters, with one of some signs or with a group of such."""
    out = []
    for part in _split(pattern):
        if literal := re.match(r"[A-Za-z0-9 %-]+(?![?*{])", part):
            out.append(literal[0])
        elif signs := re.match(r"\[((?:\\?[^\w\\\]^-])+)\](?![?*{])", part):
            out += re.findall(r"[^\\]", signs[1])
        elif (group := re.match(r"\((?:\?:)?", part)) and (inner := _group(part, group.end())) is not None and (more := _starts(inner)):
            out += more
        else:
            return None
    return out


def _group(pattern: str, at: int) -> str | None:
    """What stands in a group whose inside begins at a place, if the group has to occur."""
    depth, place = 1, at
    for piece in re.findall(r"\\.|.", pattern[at:]):
        depth += {"(": 1, ")": -1}.get(piece, 0)
        if not depth:
            return None if pattern[place + 1 : place + 2] in ("?", "*", "{") else pattern[at:place]
        place += len(piece)
    return None


@cache
def needed(pattern: str) -> list[list[str]]:
    """Lists of lower-case words: a text that matches has one of each list. From the groups of a pattern that have to occur; words of one letter tell nothing."""
    found = [_starts(pattern)]
    if len(_split(pattern)) == 1:
        outer = [m.end() for m in re.finditer(r"(?<!\\)\((?:\?:)?", pattern) if _depth(pattern[: m.start()]) == 0]
        found += [_starts(inner) for at in outer if (inner := _group(pattern, at)) is not None]
    if re.search(r"\*%(?=\\|$)", pattern):  # outside of groups
        found.append(["%"])
    words = [tuple(dict.fromkeys(w.lower() for w in x)) for x in found if x and all(len(w) > 1 or not w.isalnum() for w in x)]
    return [list(x) for x in dict.fromkeys(words)]


def _depth(pattern: str) -> int:
    bare = re.sub(r"\\.", "", pattern)
    return bare.count("(") - bare.count(")")


@cache
def quick(pattern: str) -> str:
    """The same pattern, looked for only where one of the letters stands that it begins with."""
    starts = _starts(pattern)
    return f"(?=[{''.join(sorted({x[0] for x in starts}))}])(?:{pattern})" if starts and all(x[0].isalnum() for x in starts) else pattern


def may_match(low: Column, pattern: str) -> Column:
    """Whether lower-cased text has the words that a match needs."""
    return reduce(lambda x, words: x & has_any(low, words), needed(pattern), F.lit(True))


def found(text: Column, pattern: str, group: int = 1, flags: str = "(?i)", low: Column | None = None) -> Column:
    """A group of the pattern's first match, or null; with low, the text in lower case, only texts are searched that have the words that a match needs.

    Not by nullif: its argument is worked out beforehand, for all of coalesced patterns. Nor by a lambda, under which nothing is compiled.
    """
    x = F.get(F.array_remove(F.array(F.regexp_extract(text, flags + quick(pattern), group)), ""), 0)
    return F.when(may_match(low, pattern), x) if low is not None and needed(pattern) else x


def matches(text: Column, pattern: str, low: Column) -> Column:
    """Whether the pattern occurs, without regard to case; alternatives by themselves, each in texts that have what it needs."""
    return reduce(lambda x, y: x | y, (may_match(low, p) & F.rlike(text, F.lit(f"(?i){quick(p)}")) for p in _split(pattern)))


def number(text: Column, patterns: list[str], low: Column | None = None, kind: str = "double") -> Column:
    """The number that the first pattern with one finds."""
    return F.coalesce(*(F.regexp_replace(found(text, p, low=low), ",", "").try_cast(kind) for p in patterns))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def those(items: dict[str, Column]) -> Column:
    """The names, none of which is empty, of the conditions that hold, in order. Not by array_compact: it is a lambda."""
    return F.array_remove(F.array(*(F.when(c, F.lit(n)).otherwise("") for n, c in items.items())), "")


def named(low: Column, words: dict[str, list[str]]) -> Column:
    """The names of which a word is in lower-cased text, in order; words with capitals never are."""
    return those({n: has_any(low, [x for x in w if x == x.lower()]) for n, w in words.items()})


def organization(text: Column, low: Column | None = None) -> Column:
    """The organization that acts: a name that ends as organizations' names do, of 4 to 99 characters, without an article."""
    ok = lambda n: (F.length(n) > 3) & (F.length(n) < 100) & ~F.rlike(F.lower(n), F.lit("^(the|a|an) "))
    name = lambda p: F.get(F.filter(F.array(stripped(found(text, p.replace(ends, f"(?=[A-Z]){ends}"), 1, ""))), ok), 0)
    ends = f"(?:{_KINDS})"
    helped, acts = ORGANIZATION
    # The name's end stands before the verb; only texts with both are searched for where the name begins.
    by_others = F.when(may_match(low, helped), name(helped)) if low is not None else name(helped)
    return F.coalesce(by_others, F.when(F.rlike(text, F.lit(f"(?=[A-Z]){ends}{_ACTS}")), name(acts)))


def cost(text: Column, low: Column | None = None) -> Column:
    """An amount of money, scaled by the word or letter after it."""

    def of(p: str) -> Column:
        amount = F.regexp_replace(found(text, p, low=low), ",", "").try_cast("double")
        unit = F.lower(F.regexp_extract(text, f"(?i){quick(p)}", 2))
        # The unit is looked for only where there is an amount.
        return F.when(amount.isNotNull(), amount * F.when(unit.isin("million", "m"), 1e6).when(unit.isin("billion", "b"), 1e9).when(unit == "k", 1e3).otherwise(1.0))

    return F.coalesce(*map(of, COST))


def duration_unit(text: Column, low: Column | None = None) -> Column:
    return F.regexp_replace(F.coalesce(*(found(text, p, 2, low=low) for p in DURATION)), "s+$", "")


def band(count: Column) -> Column:
    """The size band that a stated count of employees falls in; none for 0."""
    out = F.when(count.isNull() | (count == 0), None)
    for most, name in BANDS:
        out = out.when(count <= most, name)
    return out.otherwise(LARGEST)


def problem_statement(text: Column, low: Column | None = None) -> Column:
    """What comes after a word for problem, else the first of five sentences with such a word, else the first sentence."""
    sentences = F.slice(F.split(text, r"\."), 1, 5)
    cued = F.get(F.filter(sentences, lambda s: has_any(F.lower(s), PROBLEM_CUES)), 0)
    cued = cued if low is None else F.when(has_any(low, PROBLEM_CUES), cued)
    return F.coalesce(*(stripped(found(text, p, 1, "(?is)", low)) for p in PROBLEM), stripped(cued), stripped(F.get(sentences, 0)))


def captures(text: Column, patterns: list[str], group: int = 1, flags: str = "(?is)", low: Column | None = None) -> Column:
    """What each pattern finds, of those that find something."""
    return F.array_compact(F.array(*(stripped(found(text, p, group, flags, low)) for p in patterns)))


def fields(text: Column, low: Column | None = None) -> dict[str, Column]:
    """The fields by name; the employee band is band() of the count. low is the text in lower case, best a column of its own: it is used some hundred times."""
    low = F.lower(text) if low is None else low
    return {
        "organization_name": organization(text, low), "organization_industry": named(low, INDUSTRIES), "organization_employee_count": number(text, EMPLOYEES, low, "bigint"),
        "problem_business_function": named(low, FUNCTIONS), "problem_statement": problem_statement(text, low), "implementation_cost": cost(text, low),
        "implementation_time_value": number(text, DURATION, low), "implementation_time_unit": duration_unit(text, low), "baseline_value": number(text, BASELINE, low), "outcome_value": number(text, OUTCOME, low), "outcome_percentage": number(text, PERCENT, low),
        **{n: matches(text, p, low) for n, p in EVIDENCE.items()},
        "sample_size": number(text, SAMPLE, low, "bigint"), "measurement_period": F.coalesce(*(found(text, p, 0, low=low) for p in PERIOD)),
        "teams_involved": captures(text, TEAMS, 0, "(?i)", low), "software": those({w: F.contains(low, F.lit(w.lower())) for w in SOFTWARE}),
        "success_factors": captures(text, SUCCESS, low=low), "failure_conditions": captures(text, FAILURE, low=low),
    }


def field_flags() -> Column:
    """Doubts about a row of those fields with its text `note`, in order."""
    c = F.col
    none = lambda n: F.coalesce(c(n) == 0, F.lit(True))
    return F.array_compact(
        F.array(
            F.when(c("organization_name").isNull(), "missing_organization"), F.when(none("implementation_cost"), "missing_implementation_cost"), F.when(~c("has_baseline"), "no_baseline"),
            F.when(c("vendor_reported"), "vendor_reported"), F.when(none("sample_size"), "no_sample_size"), F.when(F.contains(F.lower("note"), F.lit("projected")), "projected_rather_than_observed"),
        )
    )
