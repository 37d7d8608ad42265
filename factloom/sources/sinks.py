"""Writers: exports, reports, upserts and gated inserts of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """The columns in the order of their names, nested ones as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in sorted(df.columns)))


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write df as jsonl, csv (with a header, nested values as JSON) or parquet; as many files as it has partitions."""
    if kind == "jsonl":
        df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)
    elif kind == "csv":
        flat(df).write.mode("overwrite").option("header", True).csv(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def export_all(tables: dict[str, DataFrame], path: str, kinds: list[str]) -> None:
    for name, df in tables.items():
        for kind in kinds:
            export(df, f"{path}/{name}_{kind}", kind)


def report(df: DataFrame, path: str) -> None:
    """Write a report (a bounded number of rows) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def admitted(new: DataFrame, have: DataFrame, keys: list[str], gate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows refused with a reason): those with all keys filled that pass the gate and that `have` lacks, keys without regard to case; of several new ones with the same keys, the one that sorts first."""
    norm = [F.lower(F.trim(k)).alias(f"__{k}") for k in keys]
    reason = F.coalesce(*(F.when(F.coalesce(F.trim(k), F.lit("")) == "", F.lit(f"missing {k}")) for k in keys), F.when(~F.coalesce(gate, F.lit(False)), F.lit("below the gate")))
    marked = new.withColumn("__reason", reason).select("*", *norm)
    known = have.select(*norm).distinct().withColumn("__known", F.lit(True))
    marked = marked.join(known, [f"__{k}" for k in keys], "left").withColumn("__reason", F.coalesce("__reason", F.when(F.col("__known"), "duplicate")))
    own = [f"__{k}" for k in keys] + ["__reason", "__known"]
    ok = marked.where(F.col("__reason").isNull())
    first = ok.groupBy(*(f"__{k}" for k in keys)).agg(F.min(F.struct(*new.columns)).alias("r")).select("r.*")
    return first, marked.where(F.col("__reason").isNotNull()).withColumnRenamed("__reason", "reason").drop(*(c for c in own if c != "__reason"))
