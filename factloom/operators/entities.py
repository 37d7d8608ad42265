"""One identity for an organization: components of shared names, domains and beginnings, and the name that stands for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.tables import saved


def plain_name(name: Column) -> Column:
    """A name in small letters, its words by single blanks; empty where it has none."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def beginning(name: Column, words: int) -> Column:
    """The first words of a plain name that has more than those, else null."""
    parts = F.split(name, " ")
    return F.when(F.size(parts) > words, F.array_join(F.slice(parts, 1, words), " "))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges (a, b): the smallest id that can be reached from it. An edge with a null end is none.

    Large and small stars by turns: each id's neighbours are hung on the
    smallest of them, first those above it, then those below. A minimum is
    combined before it is moved, and what is joined to it is one row an id, so
    an id with very many neighbours can be split. Every turn is a written
    table; their number grows with the logarithm of the longest chain.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    loops = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    e, seen = saved(e), None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = saved(small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()
        if state == seen:
            return loops.join(e.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("root"))
        seen = state


def entities(mentions: DataFrame, keys: dict[str, Column], name: str = "name", id_col: str = "id") -> DataFrame:
    """(id, name, entity, canonical, via, size): each mention's organization, the name elected for it, and what led there.

    Mentions that agree in one of `keys` (kind to column; null and empty agree
    with nothing) are one organization, along chains of any length. Its id is
    the smallest of its mentions', its name the commonest (of equals the
    shortest, then the first; empty only where no mention has one). `via` is
    `itself` for mentions by that name, else the first kind of key that a
    mention shares with one of those, else `chain`. Ids must be distinct and not
    null. Members of a key are linked to its smallest id only, so a key that a
    third of all mentions share costs a row each.
    """
    kinds = list(keys)
    flat = F.array(*(F.struct(F.lit(i).alias("kind"), c.cast("string").alias("value")) for i, c in enumerate(keys.values())))
    plain = saved(mentions.select(F.col(id_col).alias("id"), F.coalesce(F.col(name), F.lit("")).alias("name"), flat.alias("keys")))
    held = plain.select("id", F.inline("keys")).where("value <> ''")
    first = held.groupBy("kind", "value").agg(F.min("id").alias("first"))
    edges = held.join(first, ["kind", "value"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
    whole = plain.join(components(edges), "id", "left").select("id", "name", F.coalesce("root", "id").alias("entity"))
    named = whole.groupBy("entity", "name").agg(F.count("*").alias("c"))
    better = F.struct(F.col("name") == "", -F.col("c"), F.length("name"), F.col("name"))
    elected = named.groupBy("entity").agg(F.min_by("name", better).alias("canonical"), F.sum("c").alias("size"))
    known = saved(whole.join(elected, "entity"))
    of = known.where("name = canonical").select("id")
    bearers = held.join(of, "id").select("kind", "value").distinct()
    shared = held.join(bearers, ["kind", "value"]).groupBy("id").agg(F.min("kind").alias("kind"))
    via = F.when(F.col("name") == F.col("canonical"), "itself").otherwise(F.coalesce(F.get(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit("chain")))
    return known.join(shared, "id", "left").select("id", "name", "entity", "canonical", via.alias("via"), "size")
