"""What comes in from files and from extractors: texts, seed records, and nested extractions taken apart."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; of HTML files what stands outside of tags, scripts and styles, with single blanks."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    bare = F.regexp_replace(F.regexp_replace("text", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    html = F.rlike(F.lower("path"), F.lit(r"\.html?$"))
    return raw.select("path", F.when(html, F.trim(F.regexp_replace(bare, r"\s+", " "))).otherwise(F.col("text")).alias("text"))


def seed_files(spark: SparkSession, path: str, wanted: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records, broken): what JSON files have, whether a record a line, one record or one list over any number of lines, or a list as an object's only value.

    A file is read by lines if its first line is a whole record; else it is one
    document. Nothing is inferred: the wanted columns (name to type) are the
    schema. broken has (path, line, text) of every line or document that isn't
    JSON, or has something else than records; `line` is 0 for a document.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    opening = F.trim(F.substring_index(F.ltrim("text"), "\n", 1))
    kinds = whole.select("path", (opening.startswith("{") & F.try_parse_json(opening).isNotNull()).alias("by_line"))
    by_line = lines.join(kinds.where("by_line"), "path", "left_semi").where(F.trim("text") != "").select("path", F.monotonically_increasing_id().alias("line"), "text")
    documents = whole.join(kinds.where("NOT by_line"), "path", "left_semi").where(F.trim("text") != "").select("path", F.lit(0).cast("bigint").alias("line"), "text")
    parsed = by_line.unionByName(documents).withColumn("v", F.try_parse_json("text"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.when(F.size(F.map_keys(F.try_variant_get("v", "$", "map<string, variant>"))) == 1, F.try_variant_get(F.map_values(F.try_variant_get("v", "$", "map<string, variant>"))[0], "$", "array<variant>")), F.array("v"))
    items = parsed.select("path", "line", "text", F.explode_outer(F.when(F.col("v").isNotNull(), listed)).alias("item"))
    fields = F.try_variant_get("item", "$", "map<string, variant>")
    items = items.withColumn("is_record", F.coalesce(F.size(fields) >= 0, F.lit(False)))
    good = items.where("is_record").select(*(F.try_variant_get("item", f"$.{n}", kind).alias(n) for n, kind in wanted.items()))
    return good, items.where("NOT is_record").select("path", "line", "text").distinct()


def seeds(spark: SparkSession, path: str, wanted: Mapping[str, str], key: str, *, broken: str = "report") -> DataFrame:
    """Seed records with the wanted columns in order; of records with one key the first by content, and those without one go.

    What can't be read as a record is never passed over in silence: with broken
    "fail" it is an error, with "report" a warning that says how much and where.
    """
    rows, bad = seed_files(spark, path, wanted)
    some = bad.limit(5).collect()
    if some:
        said = f"{bad.count()} lines or files below {path} are not seed records, such as " + "; ".join(f"{r['path'].rsplit('/', 1)[-1]}: {r['text'][:60]!r}" for r in some)
        if broken == "fail":
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    rows = rows.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.min(F.struct(*(c for c in wanted if c != key))).alias("r")).select(*(F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in wanted))


def fan_out(extractions: DataFrame) -> dict[str, DataFrame]:
    """Tables records, metrics, passages and flags of nested extractions (id, organization_name, title, metrics, passages, flags)."""
    e = extractions
    return {
        "records": e.select("id", "organization_name", "title"),
        "metrics": e.select(F.col("id").alias("record_id"), F.posexplode("metrics").alias("seq", "m")).select("record_id", "seq", "m.*"),
        "passages": e.select(F.col("id").alias("record_id"), F.posexplode("passages").alias("seq", "text")).where(F.trim("text") != ""),
        "flags": e.select(F.col("id").alias("record_id"), F.explode(F.array_distinct("flags")).alias("flag")),
    }


def asked(profile: Column) -> dict[str, Column]:
    """A query from a profile of fields with a value each: texts in lower case, a whole number of employees, else null."""
    value = lambda n: F.nullif(F.trim(profile[n]["value"]), F.lit(""))
    count = F.floor(F.regexp_replace(value("employee_count"), ",", "").try_cast("double")).cast("bigint")
    return {"workflow": F.lower(value("workflow")), "industry": F.lower(value("industry")), "geography": value("geography"), "employee_count": count}
