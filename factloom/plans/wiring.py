"""Decisions with the evidence found for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import decision as D
from factloom.operators import wiring as W
from factloom.plans.catalog import query
from factloom.plans.coverage import _R
from factloom.plans.decision import _DIM, _FAM, _PROFILES
from factloom.plans.retrieval import _REC, _rec
from factloom.sources.tables import saved

#: Questions: the work, and what is known of it.
ASKED = [
    {"workflow": "claims processing new system", "function": "finance", "industry": "building", "employee_count": 800, "outcome": "cost"},
    {"workflow": "invoice_processing", "function": "support", "industry": "automobile", "employee_count": 15000, "outcome": "time"},
    {"workflow": "customer support chatbot", "function": "legal", "industry": "machinery", "employee_count": 40, "outcome": "errors"},
    {"workflow": "demand forecasting with predictive models", "function": "operations", "industry": "household", "employee_count": None, "outcome": "revenue"},
    {"workflow": "code_review", "function": "it", "industry": "", "employee_count": 5200, "outcome": ""},
]
#: What holds each back, and the figures that decisions go by.
SITUATIONS = [
    ("capacity", 90_000, 0.2, 0.6, 0.4, 120_000.0, 12.0, 0.5, 0.6),
    ("errors", 4_000, 0.1, 0.5, 0.5, 60_000.0, 8.0, 0.7, 0.5),
    ("unknown", None, 0.4, 0.4, 0.6, 20_000.0, 20.0, 0.3, 0.4),
    ("speed", 700_000, 0.3, 0.5, 0.3, 200_000.0, 16.0, 0.9, 0.7),
    ("cost", 30_000, 0.05, 0.6, 0.5, 40_000.0, 6.0, 0.4, 0.8),
]
FIGURES = ["constraint", "volume", "exception_rate", "stability", "risk_level", "budget", "weeks", "urgency", "readiness"]

_lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def _phrases(asked: str) -> list[str]:
    q = asked.lower().split()
    return sorted({" ".join(q[i : i + n]) for n in (2, 3) for i in range(len(q) - n + 1)})


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_Q = ", ".join(
    f"({i}, '{q['workflow']}', {_list(sorted(set(q['workflow'].split())))}, {_list(sorted(set(q['workflow'].replace('_', ' ').split())))}, {_list(_phrases(q['workflow']))}, '{q['function']}', '{q['industry']}', {_lit(q['employee_count'])}, '{q['outcome']}', {', '.join(map(_lit, s))})"
    for i, (q, s) in enumerate(zip(ASKED, SITUATIONS, strict=True))
)
_K = ", ".join(f"('{f}', '{s}')" for f, s in W.SUBTYPES.items())
_PART_OF = "CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.7"
_SQL = f"""WITH {_REC}, q(question, asked, aw, awu, phrases, fn, trade, people, aim, {', '.join('"' + n + '"' for n in FIGURES)}) AS (VALUES {_Q}), k(family, kind) AS (VALUES {_K}),
  open_ AS (SELECT rec.*, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS tw, list_distinct(list_filter(regexp_split_to_array(translate(lower(workflow), '_-', '  '), '\\s+'), lambda w: w <> '')) AS ww FROM rec JOIN (SELECT id FROM records WHERE publication_status = 'published') USING (id) WHERE len(families) > 0),
  fit AS (SELECT o.id, question, families, organization_name, lower(business_function) = fn AS fn_met,
    least(1.0, len(list_intersect(tw, aw)) / greatest(len(tw), len(aw)) * 1.5 + least(0.3, 0.1 * len(list_filter(phrases, lambda p: contains(lower(text), p))))) AS f_problem,
    CASE WHEN workflow = '' THEN 0.0 WHEN lower(workflow) = asked THEN 1.0 WHEN contains(lower(workflow), asked) OR contains(asked, lower(workflow)) THEN 0.7 ELSE len(list_intersect(ww, awu)) / (len(ww) + len(awu) - len(list_intersect(ww, awu))) * 0.5 END AS f_workflow,
    CASE WHEN people > 0 AND coalesce(employee_count, 0) > 0 THEN least(employee_count, people) / greatest(employee_count, people) ELSE 0.0 END AS f_size,
    CASE WHEN trade = '' THEN 0.0 WHEN industries[1] = trade THEN 1.0 ELSE 0.0 END AS f_industry,
    CASE WHEN aim = '' THEN 0.0 ELSE coalesce(list_max(list_transform(outcomes, lambda c: {_PART_OF.format(a="c", b="aim")} ELSE 0.0 END)), 0.0) END AS f_outcome FROM open_ o, q),
  scored AS (SELECT *, list_contains(families, kind) AS kind_met, CASE WHEN list_contains(families, kind) THEN 1.0 WHEN len(list_filter(families, lambda f: contains(f, kind))) > 0 THEN 0.5 ELSE 0.0 END AS f_kind FROM fit, k),
  level AS (SELECT id, question, family, organization_name, unnest([
    {{'step': 0, 'met': fn_met AND kind_met, 't': f_problem * 0.35 + f_workflow * 0.25 + f_size * 0.1 + f_industry * 0.1 + f_outcome * 0.05 + f_kind * 0.15}}, {{'step': 1, 'met': fn_met, 't': f_problem * 0.35 + f_workflow * 0.25 + f_size * 0.1 + f_industry * 0.1 + f_outcome * 0.05}},
    {{'step': 2, 'met': true, 't': f_problem * 0.35 + f_workflow * 0.25 + f_size * 0.1 + f_industry * 0.1 + f_outcome * 0.05}}, {{'step': 3, 'met': true, 't': f_problem * 0.35 + f_workflow * 0.25 + f_industry * 0.1}}]) AS s FROM scored),
  steps AS (SELECT id, question, family, organization_name, s.step AS step, CAST(floor(s.t * 1000000 + 0.5) AS BIGINT) AS likeness FROM level WHERE s.met AND floor(s.t * 1000000 + 0.5) > 0),
  reached AS (SELECT question, family, step, count(*) AS reached FROM steps GROUP BY ALL),
  chosen AS (SELECT question, family, step, reached FROM reached QUALIFY row_number() OVER (PARTITION BY question, family ORDER BY CASE WHEN reached >= 5 THEN step ELSE 99 END, reached DESC, step) = 1),
  own AS (SELECT s.*, row_number() OVER (PARTITION BY question, family, coalesce(nullif(lower(organization_name), ''), '#' || id) ORDER BY likeness DESC, id) AS o FROM steps s JOIN chosen USING (question, family, step)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY question, family ORDER BY o > 1, likeness DESC, id) AS place FROM own),
  found AS (SELECT question, family, id, likeness, floor(likeness / 10000 + 0.5) AS h FROM placed WHERE (o = 1 AND place <= 10) OR (o > 1 AND place <= 5)),
  apt AS (SELECT *, row_number() OVER (PARTITION BY question, family ORDER BY likeness DESC, id) AS k FROM found WHERE h >= {W.SUPPORTING}),
  cards AS (SELECT question, family, {_R('avg(h) / 100', 2)} AS strength, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS evidence FROM apt WHERE k <= 5 GROUP BY ALL),
  w AS (SELECT question, family, count(*) AS results, count(*) FILTER (h >= {W.DIRECT}) AS direct, count(*) FILTER (h >= {W.SUPPORTING} AND h < {W.DIRECT}) AS supporting FROM found GROUP BY ALL),
  f(family, {', '.join(D.COLUMNS)}) AS (VALUES {_FAM}), p(c, w) AS (VALUES {_PROFILES}),
  all_ AS (SELECT q.*, f.*, p.w AS pw, coalesce(results, 0) AS results, coalesce(direct, 0) AS direct, coalesce(supporting, 0) AS supporting, CASE WHEN results > 0 THEN coalesce(strength, 0.0) END AS strength, coalesce(cards.evidence, '') AS cards, chosen.step, coalesce(reached, 0) AS reached
    FROM q JOIN p ON c = "constraint", f LEFT JOIN w ON w.question = q.question AND w.family = f.family LEFT JOIN cards ON cards.question = q.question AND cards.family = f.family LEFT JOIN chosen ON chosen.question = q.question AND chosen.family = f.family),
  marks AS (SELECT *, floor(({' + '.join(f'{_DIM[n]} * pw[{i}]' for i, n in enumerate(D.DIMENSIONS, 1))}) * 1000000 + 0.5) / 1000000 AS score, floor(({' + '.join(f'{_DIM[n] if n != "evidence_strength" else "0.5::DOUBLE"} * pw[{i}]' for i, n in enumerate(D.DIMENSIONS, 1))}) * 1000000 + 0.5) / 1000000 AS before FROM (SELECT *, strength AS evidence FROM all_)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY before DESC, family) AS was, row_number() OVER (PARTITION BY question ORDER BY score DESC, family) AS rank,
    CASE WHEN family = 'No_Action' THEN NULL WHEN results = 0 THEN 'no comparable implementation' WHEN direct + supporting = 0 THEN 'none bears on the decision' WHEN direct = 0 THEN 'supporting only' END AS limit_ FROM marks)
  SELECT question, family, CAST(step AS INT) AS step, reached, results, direct, supporting, strength, cards AS evidence, limit_ AS "limit", score, was, rank, CASE WHEN bool_or(was = 1 AND limit_ IS NOT NULL) OVER (PARTITION BY question) THEN 'low' ELSE 'high' END AS confidence FROM ranked"""


@query(_SQL)
def evidence_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five decisions over all families: what comparable records were found for each and how far conditions had to be relaxed, and the ranking that follows."""
    rows = saved(_rec(spark, sf_dir, "publication_status = 'published'")).where(F.size("families") > 0)  # families are found once, and not again for the condition
    chosen, found = W.comparables(rows, ASKED)
    schema = "question int, constraint string, volume long, exception_rate double, stability double, risk_level double, budget double, weeks double, urgency double, readiness double"
    asked = spark.createDataFrame([(i, *s) for i, s in enumerate(SITUATIONS)], schema)
    families = D.against_families(asked)
    before = D.decide(asked.withColumn("evidence", F.lit(None).cast("double")), "question", len(D.FAMILIES)).select("question", "family", "rank")
    out = W.with_evidence(before, chosen, found, lambda seen: D.scores(families.join(seen.select("question", "family", "evidence"), ["question", "family"]), "question").drop("unsuited"))
    return out.select("question", "family", "step", "reached", "results", "direct", "supporting", "strength", F.coalesce(F.array_join("evidence", ","), F.lit("")).alias("evidence"), "limit", "score", "was", "rank", "confidence")
