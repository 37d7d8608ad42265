"""Ranking: first per entity with a limit, ties, retrieval scores and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.rules import half_up


def best_per_entity(df: DataFrame, entity: str, score: str, id_col: str, limit: int, least: int = 0) -> DataFrame:
    """The `limit` best rows with one an entity (rows without an entity all count), filled up to `least` with the best of the rest.

    Only the best of each entity, and the best rest, are ever sorted together:
    both are cut to what can matter before they meet.
    """
    key = F.coalesce(F.nullif(F.lower(entity), F.lit("")), F.concat(F.lit("#"), F.col(id_col).cast("string")))
    if not least:  # whole rows go through one aggregate that combines before the shuffle
        whole = F.struct(F.col(score).alias("__s"), (-F.col(id_col)).alias("__i"), F.struct(*df.columns).alias("__r"))
        best = df.groupBy(key.alias("__key")).agg(F.max(whole).alias("b")).select("b.__r.*")
        return best.orderBy(F.desc(score), id_col).limit(limit)
    top = df.groupBy(key.alias("__key")).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(id_col)).alias("i"))).alias("b")).select((-F.col("b.i")).alias(id_col))
    marked = df.join(top.withColumn("__first", F.lit(True)), id_col, "left").withColumn("__first", F.coalesce("__first", F.lit(False)))
    kept = marked.where("__first").orderBy(F.desc(score), id_col).limit(limit)
    rest = marked.where("NOT __first").orderBy(F.desc(score), id_col).limit(least)
    both = kept.unionByName(rest).withColumn("__place", F.row_number().over(Window.orderBy(F.desc("__first"), F.desc(score), id_col)))  # limit + least rows
    return both.where(F.col("__first") | (F.col("__place") <= least)).drop("__first", "__place")


def close_calls(df: DataFrame, group: str, score: str, id_col: str, top: int, within: float) -> DataFrame:
    """The `top` of each group with rank, label, and whether the next one is closer than `within`."""
    w = Window.partitionBy(group).orderBy(F.desc(score), id_col)
    few = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top + 1)  # cut within each task before the shuffle
    ranked = few.withColumn("gap", F.col(score) - F.lead(score).over(w)).where(F.col("rank") <= top)
    close = F.coalesce((F.col("gap") < within) & (F.col("rank") < top), F.lit(False))
    return ranked.select(group, id_col, "rank", F.when(F.col("rank") == 1, "recommended").otherwise("alternative").alias("label"), close.alias("close"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their ranks."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def at_k(ranked_: DataFrame, labels: DataFrame, ks: list[int], total: DataFrame | None = None) -> DataFrame:
    """(k, precision, recall, irrelevant), averaged over queries; labels are (query, id, label), of all that can be found or, with total (query, relevant), of those ranked."""
    total = total or labels.where("label = 'relevant'").groupBy("query").agg(F.count("*").alias("relevant"))
    cut = ranked_.join(labels, ["query", "id"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    hits = cut.groupBy("query", "k").agg(F.count_if(F.col("label") == "relevant").alias("hit"), F.count_if(F.coalesce("label", F.lit("irrelevant")) == "irrelevant").alias("miss")).join(total, "query")
    hits = hits.select("k", F.floor(F.col("hit") * 1_000_000 / F.col("k")).alias("p"), F.floor(F.col("hit") * 1_000_000 / F.col("relevant")).alias("r"), F.floor(F.col("miss") * 1_000_000 / F.col("k")).alias("i"))
    mean = lambda c: half_up(F.sum(c) / F.count("*") / 1_000_000, 4)
    return hits.groupBy("k").agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("i").alias("irrelevant"))


def displacement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query, moved): mean change of rank of the ids in both rankings, over k; 1 if they share none."""
    both = a.select("query", "id", F.col("rank").alias("ra")).join(b.select("query", "id", F.col("rank").alias("rb")), ["query", "id"])
    moved = both.groupBy("query").agg(F.sum(F.abs(F.col("ra") - F.col("rb"))).alias("d"), F.count("*").alias("n"))
    return a.select("query").distinct().join(moved, "query", "left").select("query", half_up(F.coalesce(F.col("d") / F.col("n") / k, F.lit(1.0)), 4).alias("moved"))
