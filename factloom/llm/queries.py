"""The registered queries of this subpackage: one for each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import documents, shared_dir


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Shares of a window; the other sources have the rest by their tokens.
MIXTURE = {"src0": 0.15, "src1": 0.1, "src2": 0.1}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.packing import pack

    pieces = pack(documents(spark, sf_dir, "doc_id", "text", "source"), tokenizer_path("byte_bpe_50k.json"), targets=MIXTURE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window_id", F.col("queue").alias("source"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.syncmers import compare_with_edits

    return compare_with_edits(documents(spark, sf_dir, "doc_id", "text"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=3, percent=85)


def fold(modulus: int, value: int):
    """Whether crc32 of the doc_id as text leaves `value`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == value, F.lit(False))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.ppm import score

    found = score(documents(spark, sf_dir, "doc_id", "text"), ~fold(7, 2))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.quality import fit, score

    docs = documents(spark, sf_dir, "doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold(4, 2))
    return score(docs, fit(docs, labels)).select("doc_id", fold(4, 2).alias("held_out"), "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.language import fit, identify

    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs.where(~fold(5, 0))))
    return found.select("doc_id", fold(5, 0).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.secrets import BASE_KINDS, scan

    found = scan(documents(spark, sf_dir, "doc_id", "text"), f"{shared_dir(spark)}/ledger")
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(join(base).cast("binary"), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.sharding import shard

    placed = shard(documents(spark, sf_dir, "doc_id", "text"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.token_counts import count_tokens, zipf_vocabulary

    found = count_tokens(documents(spark, sf_dir, "doc_id", "text"), zipf_vocabulary(tokenizer_path("piece_bpe_32k.model")))
    return found.select("doc_id", "n_tokens", "token_score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.decontamination import find_matches

    found = find_matches(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.divergence import audit

    return audit(documents(spark, sf_dir, "text", "lang", "source"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.mixing import mix

    mixed = mix(documents(spark, sf_dir, "doc_id", "text", "source"))
    shards = F.array_join(F.array_sort(F.array_distinct(F.transform("pieces", lambda x: x["shard"]))).cast("array<string>"), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("pieces").alias("n_pieces"), shards.alias("shards"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.resampling import resample

    return resample(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_syncmers": op2_syncmers,
    "op3_minhash": op3_minhash,
    "op4_ppm": op4_ppm,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_divergence": op11_divergence,
    "op12_mixing": op12_mixing,
    "op13_resampling": op13_resampling,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for the queries that SQL can express. The others depend on a tokenizer, a trained model,
#: signatures' hashes or places of matches; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
  e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
  l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  reach AS (SELECT doc_id AS n, doc_id AS m FROM s UNION SELECT reach.n, l.b FROM reach JOIN l ON reach.m = l.a),
  c AS (SELECT n AS doc_id, min(m) AS component_id FROM reach GROUP BY n)
  SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op9_decontamination": rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  bi AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
  win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM bi),
  di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
  hit AS (SELECT doc_id, i, di.k, item FROM di JOIN win ON win.k = di.k AND win.x = array_to_string(w[i:i + di.k - 1], ' ')),
  h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  e AS (SELECT r, lang, source, unnest(w) AS term FROM d),
  k AS (SELECT lang, term, count(*) AS total FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
  v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
  c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY lang, source, term),
  g AS (SELECT lang, source, coalesce(sum(n), 0) AS source_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
  s AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (source_n + v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (total + 1)) // (lang_n + v) AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
  f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
  p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
  t AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM s WHERE n > 0 AND p > q)
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM p UNION ALL FROM t) QUALIFY part = 'pair' OR rank <= 200""",
}
