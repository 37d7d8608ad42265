"""Queries that turn text into structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.plans.catalog import query
from factloom.sources.tables import notes, records, table


def _any(words: list[str], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_T = "translate(lower(note), '-–', '  ')"
_FAMILIES = "list_filter([" + ", ".join(f"CASE WHEN {_any(w)} THEN '{n}' END" for n, w in R.FAMILIES.items()) + "], lambda x: x IS NOT NULL)"
_STATUS = "COALESCE(" + ", ".join(f"CASE WHEN {_any(R.STATUSES[s])} THEN '{s}' END" for s in reversed(R.STATUSES)) + ", 'unknown')"


@query(f"SELECT family, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest({_FAMILIES}) AS family FROM (SELECT id, {_T} AS t FROM notes)) GROUP BY family")
def family_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by intervention family."""
    return R.family_counts(notes(spark, sf_dir), "note", "id")


@query("SELECT family, count(*) AS n FROM (SELECT unnest(" + _FAMILIES + ") AS family FROM (SELECT translate(lower(text), '-–', '  ') AS t FROM documents)) GROUP BY family")
def family_detection_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the raw documents."""
    return R.family_counts(table(spark, sf_dir, "documents", "doc_id", "text"), "text", "doc_id").drop("first_id")


@query(f"SELECT id, {_STATUS} AS status FROM (SELECT id, {_T} AS t FROM notes)")
def result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note's result status: the last that matches."""
    return notes(spark, sf_dir).select("id", R.result_status(F.col("note")).alias("status"))


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN {_any(R.STATUSES['failed'])} THEN 'failed' WHEN {_any(R.STATUSES['successful'])} THEN 'successful'
  WHEN {_any(R.STATUSES['partial'])} THEN 'partial' WHEN {_any(['ongoing', 'in progress', 'pilot'])} THEN 'ongoing' ELSE 'unknown' END AS status FROM (SELECT lower(note) AS t FROM notes)) GROUP BY status""")
def status_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by the first status that matches."""
    return notes(spark, sf_dir).groupBy(R.first_status(F.col("note")).alias("status")).agg(F.count("*").alias("n"))


def _flag_sql(name: str, pattern: str, lower: bool, absent: bool) -> str:
    t = "lower(note)" if lower else "note"
    hit = f"{'NOT ' if absent else ''}regexp_matches({t}, '{pattern}')"
    extra = " OR contains(lower(note), 'no baseline')" if name == "no_baseline" else ""
    return f"CASE WHEN {hit}{extra} THEN '{name}' END"


@query("SELECT flag, count(*) AS n FROM (SELECT unnest([" + ", ".join(_flag_sql(*f) for f in R.FLAGS) + "]) AS flag FROM notes) WHERE flag IS NOT NULL GROUP BY flag")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the doubts that notes raise."""
    return notes(spark, sf_dir).select(F.explode(R.quality_flags(F.col("note"))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


_METRIC_ROWS = " UNION ALL ".join(f"SELECT id, {i} AS pattern, '{c}' AS category, regexp_extract(note, '{p}', 1, 'i') AS value FROM notes WHERE regexp_matches(note, '{p}', 'i')" for i, (c, p) in enumerate(R.METRIC_PATTERNS))


@query(f"SELECT id, pattern, category, value, CAST(replace(replace(value, '$', ''), ',', '') AS DOUBLE) AS amount FROM ({_METRIC_ROWS})")
def metric_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured outcomes named in notes, with their amounts."""
    m = notes(spark, sf_dir).select("id", F.explode(R.text_metrics(F.col("note"))).alias("m")).select("id", "m.*")
    return m.withColumn("amount", F.regexp_replace("value", "[$,]", "").cast("double"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS BIGINT) AS words, regexp_matches(text, '[0-9]') AS has_digits, contains(text, '%') AS has_percent, regexp_matches(text, '[$€£]') AS has_currency,
  greatest(1, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) // 250 AS BIGINT)) AS minutes FROM documents""")
def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, digits, currency and reading time of documents."""
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")).cast("long")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", "text", words.alias("words"))
    return docs.select("doc_id", "words", F.rlike("text", F.lit("[0-9]")).alias("has_digits"), F.contains("text", F.lit("%")).alias("has_percent"), F.rlike("text", F.lit("[$€£]")).alias("has_currency"), F.greatest(F.lit(1), F.floor(F.col("words") / 250)).cast("long").alias("minutes"))


def _count_sql(group: str) -> str:
    cased, patterns = R.SIGNALS[group]
    flag = "" if cased else ", 'i'"
    return " + ".join(f"CAST(regexp_matches(note, '{p}'{flag}) AS INT)" for p in patterns)


_BAD = " + ".join(f"CAST(regexp_matches(lower(note), '{p}') AS INT)" for p in R.EXCLUDE)


@query(f"""WITH s AS (SELECT id, {', '.join(f'{_count_sql(g)} AS {g}_' for g in R.SIGNALS)}, {_BAD} AS bad, len(regexp_split_to_array(trim(note), '\\s+')) AS words FROM notes),
  t AS (SELECT *, high_ + org_ + outcome_ + intervention_ AS total FROM s)
  SELECT id, high_ AS high, org_ AS org, outcome_ AS outcome, intervention_ AS intervention, CASE WHEN bad > 0 THEN 'not_relevant' WHEN total >= 8 AND org_ >= 1 AND outcome_ >= 1 AND intervention_ >= 1 THEN 'high_relevance'
  WHEN total >= 5 AND (org_ >= 1 OR outcome_ >= 1) THEN 'high_relevance' WHEN total >= 3 AND words >= 100 THEN 'possible_relevance' ELSE 'not_relevant' END AS label FROM t""")
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of relevance in each note, and its label."""
    found = notes(spark, sf_dir).select("id", "note", *(R.signals(F.col("note"), g).alias(g) for g in R.SIGNALS))
    return found.select("id", *R.SIGNALS, R.relevance(F.col("note"), *(F.col(g) for g in R.SIGNALS)).alias("label"))


@query("SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS n, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host."""
    return table(spark, sf_dir, "pages", "url").groupBy(R.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("SELECT id, regexp_replace(regexp_replace(lower(note), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM notes")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the notes."""
    return notes(spark, sf_dir).select("id", R.slug(F.col("note")).alias("slug"))


@query("""SELECT id, CASE WHEN v <> '' THEN CAST(v AS DOUBLE) END AS value FROM (SELECT id, regexp_extract(replace(note, ',', ''), '(\\d+(?:\\.\\d+)?)', 1) AS v FROM notes)""".replace("\\\\", "\\"))
def first_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number in each note."""
    return notes(spark, sf_dir).select("id", R.clean_number(F.col("note")).alias("value"))


@query("""SELECT id, CASE WHEN instr(note, '. ') = 0 THEN note ELSE substr(note, 1, CAST(instr(note, '. ') AS BIGINT)) END AS first_sentence, greatest(1, length(note) // 4) AS input_tokens,
  floor((greatest(1, length(note) // 4) * 0.15 + 300 * 0.6) / 1000000 * 10000000 + 0.5) / 10000000 AS cost FROM notes""")
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentence, estimated tokens and price of a model call on each note."""
    tokens = F.greatest(F.lit(1), F.floor(F.length("note") / 4)).cast("long")
    at = F.instr("note", ". ")
    price = F.floor((tokens * F.lit(0.15) + F.lit(300) * F.lit(0.6)) / 1_000_000 * 10_000_000 + 0.5).cast("double") / 10_000_000
    return notes(spark, sf_dir).select("id", F.when(at == 0, F.col("note")).otherwise(F.substring(F.col("note"), F.lit(1), at)).alias("first_sentence"), tokens.alias("input_tokens"), price.alias("cost"))


@query("""SELECT organization_name AS raw, trim(regexp_replace(regexp_replace(trim(organization_name || CASE id % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' & Co' ELSE '' END), '(?i)[,\\s]+(?:inc|corp|corporation|llc|ltd|limited|co|company|plc|gmbh)\\.?$', ''), '[\\s&,]+$', '')) AS name, count(*) AS n
  FROM records GROUP BY 1, 2""".replace("\\\\", "\\"))
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names without their legal suffixes."""
    suffix = F.element_at(F.array(*map(F.lit, (", Inc.", " GmbH", " & Co", ""))), (F.col("id") % 4 + 1).cast("int"))
    r = records(spark, sf_dir).select(F.col("organization_name").alias("raw"), R.company_name(F.concat("organization_name", suffix)).alias("name"))
    return r.groupBy("raw", "name").agg(F.count("*").alias("n"))


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headed sections of web pages. HTML can't be parsed in SQL; tests hold it against literal pages."""
    from factloom.sources.html import sections

    return sections(table(spark, sf_dir, "pages")).select("page_id", F.posexplode("sections").alias("number", "s")).select("page_id", "number", "s.heading", F.length("s.text").alias("n_chars"))


@query()
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of web pages within their own hosts."""
    from factloom.sources.html import links

    return links(table(spark, sf_dir, "pages"))


@query()
def html_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be read of web pages, in characters and words."""
    from factloom.sources.html import clean_text

    return clean_text(table(spark, sf_dir, "pages")).select("page_id", F.length("clean_text").alias("n_chars"), F.size(F.split("clean_text", " ")).alias("n_words"))


_PATH = "url || CASE page_id % 5 WHEN 0 THEN '/report.PDF?x=1' WHEN 1 THEN '/deck.pptx#2' WHEN 2 THEN '/notes.md' ELSE '' END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN e IN ('pdf', 'docx', 'pptx', 'md', 'txt') THEN e ELSE 'html' END AS kind FROM (SELECT lower(regexp_extract({_PATH}, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS e FROM pages)) GROUP BY kind")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by the kind of document they lead to."""
    from factloom.sources.html import document_type

    return table(spark, sf_dir, "pages", "page_id", "url").groupBy(document_type(F.expr(_PATH)).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, substr(md5(url || coalesce(title, '')), 1, 16) AS doc_key, substr(sha256(html), 1, 16) AS content_hash, title FROM
  (SELECT *, coalesce(nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'i')), ''), regexp_extract(url, '([^/]*)/?$', 1)) AS title FROM pages)""")
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, key and content hash of web pages."""
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("html", "(?i)<title[^>]*>([^<]*)</title>", 1)), F.lit("")), F.regexp_extract("url", "([^/]*)/?$", 1))
    p = table(spark, sf_dir, "pages").withColumn("title", title)
    return p.select("page_id", F.substring(F.md5(F.concat("url", F.coalesce("title", F.lit(""))).cast("binary")), 1, 16).alias("doc_key"), F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 16).alias("content_hash"), "title")


#: Pages with a table for each order: what its lines took before and after, a span over both headings.
_TABLES = """<html><body><p>Results of {id}</p><table><caption>Order {id}</caption><tr><th rowspan="2">Metric</th><th colspan="2">Hours</th></tr><tr><th>before</th><th>after</th></tr>"""


@query("""SELECT l_orderkey AS id, 'Order ' || l_orderkey AS caption, 'line ' || l_linenumber AS name, p.period, CASE p.period WHEN 'Hours before' THEN l_quantity * 1000 ELSE l_quantity END AS value,
  CASE p.period WHEN 'Hours before' THEN 'hours' ELSE '%' END AS unit, count(*) AS n FROM lineitem, (VALUES ('Hours before'), ('Hours after')) p(period) GROUP BY ALL""")
def html_table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics read from a page of each order, whose table shows its lines."""
    from factloom.sources import html_tables as H

    amount = F.col("l_quantity").cast("bigint")
    row = F.format_string("<tr><td>line %d<td>%s hours<td>%d%%</tr>", F.col("l_linenumber"), F.format_number(amount * 1000, 0), amount)
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(F.col("l_orderkey").alias("id"), row.alias("row"))
    head = F.replace(F.lit(_TABLES), F.lit("{id}"), F.col("id").cast("string"))
    pages = lines.groupBy("id").agg(F.array_join(F.collect_list("row"), "").alias("rows")).select("id", F.concat(head, "rows", F.lit("</table>")).alias("html"))  # the lines of an order: seven at most
    found = H.metrics(H.tables(pages).drop("html"), "id")
    return found.groupBy("id", "caption", "name", "period", "value", "unit").agg(F.count("*").alias("n"))
