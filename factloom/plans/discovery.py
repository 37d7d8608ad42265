"""Queries on where to look."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.rules import host
from factloom.operators import discovery as D
from factloom.plans.catalog import query
from factloom.sources.tables import notes, records, stories, table


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _any(words: list[str], x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query(f"""SELECT '"' || p || '" ' || i || ' ' || o AS query, o AS outcome, NULL::VARCHAR AS industry FROM (SELECT unnest({_list(D.PROBLEMS)}) AS p), (SELECT unnest({_list(D.INTERVENTIONS)}) AS i), (SELECT unnest({_list(D.OUTCOMES)}) AS o)
  UNION ALL SELECT '"' || p || '" ' || i || ' ' || t || ' case study', 'case study', t FROM (SELECT unnest({_list(D.PROBLEMS[:15])}) AS p), (SELECT unnest({_list(D.INTERVENTIONS[:15])}) AS i), (SELECT unnest({_list(D.INDUSTRIES)}) AS t)
  UNION ALL SELECT '"' || p || '" ' || f, 'failure', NULL FROM (SELECT unnest({_list(D.PROBLEMS[:15])}) AS p), (SELECT unnest({_list(D.FAILURES)}) AS f)""")
def query_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All searches."""
    return D.searches(spark).select("query", "outcome", "industry")


#: Parts of words, as the texts at hand have none of the real ones.
PARTS = ["th", "ion", "er", "an", "qu", "zz"]


@query(rf"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '
\s*
')) AS p, generate_subscripts(regexp_split_to_array(text, '
\s*
'), 1) AS i FROM documents), k AS (SELECT *, list_filter([{', '.join(f"CASE WHEN contains(lower(p), '{w}') THEN '{w}' END" for w in PARTS)}], lambda x: x IS NOT NULL) AS k FROM p)
  SELECT doc_id, CAST(i - 1 AS INT) AS paragraph, array_to_string(k, ',') AS keywords, CAST(len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')) AS INT) AS words, length(substr(p, 1, 2000)) AS shown FROM k WHERE len(k) >= 2""")
def keyword_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with two of the keywords."""
    p = D.paragraphs(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", PARTS)
    return p.select("doc_id", "paragraph", F.array_join("keywords", ",").alias("keywords"), "words", F.length("text").alias("shown"))


@query(f"SELECT id, count(*) AS n FROM (SELECT id, unnest([{', '.join(f'CASE WHEN contains(lower(story), {chr(39)}{w}{chr(39)}) THEN 1 END' for w in D.TRANSFORMATION)}]) AS x FROM stories) WHERE x IS NOT NULL GROUP BY id HAVING count(*) >= 2")
def transformation_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories (of one paragraph each) that tell of a transformation, and by how many words."""
    return D.paragraphs(stories(spark, sf_dir), "id", "story", D.TRANSFORMATION).select("id", F.size("keywords").cast("bigint").alias("n"))


_TEXT = "CASE doc_id % 5 WHEN 0 THEN repeat('x ', 2600) || 'Item 7. ' || text || repeat(' tail', 4000) WHEN 1 THEN repeat('y ', 1100) || 'ITEM 1. ' || text || repeat(' tail', 3000) WHEN 2 THEN repeat('z ', 1500) || 'Machine Learning ' || text || repeat(' tail', 5000) WHEN 3 THEN text || repeat(' tail', 4100) ELSE text END"
_AT = lambda h: f"(instr(t, '{h}') - 1)"
_RULES = [(f"{_AT(h)} >= {least} AND {_AT(h)} < length(t) * {share}", f"'{a.lower().rstrip('.')}'", f"{_AT(h)} + 1") for a, b, least, share in D.ITEMS for h in (a, b)]
_RULES += [("length(t) <= 20000", "'head'", "1")] + [(f"(instr(lower(t), '{w}') - 1) > 2000 AND (instr(lower(t), '{w}') - 1) < length(t) * 0.5", "'subject'", f"greatest(instr(lower(t), '{w}') - 501, 0) + 1") for w in D.SUBJECTS]


@query(f"""WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents), s AS (SELECT doc_id, t, CASE {' '.join(f'WHEN {c} THEN {r}' for c, r, _ in _RULES)} ELSE 'middle' END AS rule, CASE {' '.join(f'WHEN {c} THEN {at}' for c, _, at in _RULES)} ELSE 2001 END AS start FROM d) SELECT doc_id, rule, CAST(start AS INT) AS start, length(substr(t, start, 16000)) AS n FROM s""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a reader with little room begins in each document (here with a filing's headings and long tails put in)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.expr(_TEXT).alias("t"))
    rule, start = D.window(F.col("t"))
    return d.select("doc_id", "t", rule.alias("rule"), start.cast("int").alias("start")).select("doc_id", "rule", "start", F.length(F.substring(F.col("t"), F.col("start"), F.lit(16000))).alias("n"))


_URL = "CASE id % 7 WHEN 0 THEN 'https://youtube.com/watch/' || id WHEN 1 THEN source_url || '.pdf' ELSE source_url END"
_GOOD = _any(D.USEFUL, "lower(workflow || ' ' || note)")
_BAD = _any(D.USELESS, "lower(url)")


@query(f"WITH u AS (SELECT {_URL} AS url, workflow, note FROM records JOIN notes USING (id) WHERE source_url <> '') SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS n, count(*) FILTER (NOT {_BAD} AND {_GOOD}) AS useful FROM u GROUP BY 1")
def url_usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, and how many of their pages are worth reading."""
    u = records(spark, sf_dir).where("source_url <> ''").join(notes(spark, sf_dir), "id").select(F.expr(_URL).alias("url"), "workflow", "note")
    return u.groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_if(D.useful(F.col("url"), F.col("workflow"), F.col("note"))).alias("useful"))


_RAW = "CASE id % 4 WHEN 0 THEN '//duck.example/l/?uddg=' || replace(replace(source_url, ':', '%3A'), '/', '%2F') || '&rut=1' WHEN 1 THEN replace(source_url, 'https:', '') ELSE source_url END"


@query(f"SELECT id, CASE WHEN contains(raw, 'uddg=') THEN url_decode(regexp_extract(raw, '[?&]uddg=([^&]+)', 1)) WHEN starts_with(raw, '//') THEN 'https:' || raw ELSE raw END AS url FROM (SELECT id, {_RAW} AS raw FROM records WHERE source_url <> '')")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as they are met, made whole: schemes added, redirects followed on paper."""
    raw = records(spark, sf_dir).where("source_url <> ''").select("id", F.expr(_RAW).alias("raw"))
    return raw.select("id", D.clean_url(F.col("raw")).alias("url"))
