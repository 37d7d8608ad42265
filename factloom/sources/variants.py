"""Open dictionaries as VARIANT: legacy text that isn't JSON survives, keys have defaults, and drift is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opened(text: Column) -> Column:
    """JSON text as a VARIANT; text that isn't JSON as the string it is, null where there is none."""
    return F.coalesce(F.try_parse_json(text), text.try_cast("variant"))


def picked(df: DataFrame, column: str, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Add a column for each wanted key (name to type and default) of a VARIANT column.

    A key that is missing, null or can't be cast to its type has its default, and so has
    every key of a value that is no object; a column of the same name is replaced. A
    name must not contain a quote.
    """
    found = {name: F.coalesce(F.try_variant_get(F.col(column), f"$['{name}']", kind), F.lit(default).cast(kind)) for name, (kind, default) in wanted.items()}
    return df.withColumns(found)


def kind_of(value: Column) -> Column:
    """The type of a VARIANT without its inner parts: OBJECT, ARRAY, DECIMAL, BIGINT and so on; VOID for JSON's null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z_]+", 0)


def drift(df: DataFrame, column: str, depth: int = 3) -> DataFrame:
    """(path, type, n): how often each key holds each type, down to `depth` keys; the path of the whole is `$`, `[]` stands for the entries of an array.

    Rows without a value count as MISSING at `$`. Counts are combined before
    they are moved, so a path that all rows have is one row a task.
    """
    level = df.select(F.lit("$").alias("path"), F.col(column).alias("value"))
    kinds = level.select("path", F.coalesce(kind_of(F.col("value")), F.lit("MISSING")).alias("type"))
    for _ in range(depth):
        below = level.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("value").outer()))
        path = F.concat(F.col("path"), F.coalesce(F.concat(F.lit("."), F.col("key")), F.lit("[]")))
        level = below.toDF("path", "whole", "pos", "key", "value").select(path.alias("path"), "value")
        kinds = kinds.unionAll(level.select("path", kind_of(F.col("value")).alias("type")))
    return kinds.groupBy("path", "type").agg(F.count("*").alias("n"))


def unexpected(found: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The rows of drift() whose path is not wanted (path to type), or holds another type, with `reason` new or type."""
    names = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)) if wanted else F.create_map().cast("map<string,string>")
    expected = F.try_element_at(names, F.col("path"))
    return found.withColumn("reason", F.when(expected.isNull(), "new").when(expected != F.col("type"), "type")).where("reason IS NOT NULL")
