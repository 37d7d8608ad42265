"""Evidence for decisions: comparable records by a ladder of relaxed conditions, a gate of relevance, and scores with what was found.

A question is asked with all its conditions first. Where too few records meet
them, conditions are dropped one after the other. All steps of that ladder are
counted in one pass: each pair of question and record has a mask of the
conditions it meets, a step asks for some of its bits, and each step has its
own likeness. So a step more costs an aggregate's column and no scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.rules import half_up
from factloom.operators import retrieval as S
from factloom.sources.tables import saved

#: Bits of the mask.
FUNCTION, SUBTYPE = 1, 2
# Likeness in hundredths from which a record bears on a decision directly, or in support.
DIRECT, SUPPORTING = 55, 35
# The first kind of each family, which questions ask for.
SUBTYPES = {"AI": "generative_ai", "Software": "new_software_implementation", "Workflow_Automation": "rpa", "Process_Redesign": "process_redesign", "Staffing": "staffing_increases", "Hybrid": "hybrid_combination"}


#: Room for an id: a likeness times this, less the id, holds both and sorts by likeness, then by the smaller id.
ROOM = 10**20
#: Parts that organizations are dealt out over, at least.
PARTS = 256


@dataclass(frozen=True)
class Step:
    """Conditions that a record must meet (bits of the mask), and the factors of its likeness."""

    mask: int
    factors: tuple[str, ...]


_ALL = ("problem", "workflow", "company_size", "industry", "outcome")
#: Everything; without the kind of intervention; without the function; work and trade alone.
LADDER = (Step(FUNCTION | SUBTYPE, (*_ALL, "intervention")), Step(FUNCTION, _ALL), Step(0, _ALL), Step(0, ("problem", "workflow", "industry")))


def factors(records: DataFrame, asked: Sequence[Mapping[str, object]], subtypes: Mapping[str, str]) -> DataFrame:
    """(id, organization, questions, kinds): of each record, what it has of each question and of each kind.

    Words are cut once a record, factors worked out once a question or once a
    kind; a pair only adds them up.
    """
    org = F.coalesce(F.nullif(F.lower("organization_name"), F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")))
    cut = records.withColumns({"text_words": S.words(F.col("text")), "workflow_words": S.parts(F.col("workflow"))})
    return cut.select("id", org.alias("organization"), F.array(*(_factors(i, q) for i, q in enumerate(asked))).alias("questions"), F.array(*(_kind(family, s) for family, s in subtypes.items())).alias("kinds"))


def pairs(made: DataFrame, ladder: Sequence[Step]) -> DataFrame:
    """(id, organization, question, family, s0, s1, ...): of each record and question, the likeness at each step in millionths; null where a condition isn't met or nothing is alike.

    made: as `factors` gives it. The questions are a stated set, so the pairs
    are explodes of two short arrays.
    """
    rows = made.select("id", "organization", "kinds", F.explode("questions").alias("q")).select("id", "organization", "q", F.explode("kinds").alias("k"))
    value = lambda n: F.col(f"k.{n}") if n == "intervention" else F.col(f"q.{n}")
    mask = F.col("q.met").bitwiseOR(F.col("k.met"))

    def at(step: Step) -> Column:
        total = reduce(lambda a, b: a + b, (value(n) * S.WEIGHTS[n] for n in step.factors))
        millionths = F.floor(total * 1_000_000 + 0.5)
        return F.when((mask.bitwiseAND(F.lit(step.mask)) == step.mask) & (millionths > 0), millionths)

    return rows.select("id", "organization", "q.question", "k.family", *(at(s).alias(f"s{k}") for k, s in enumerate(ladder)))


def _factors(i: int, q: Mapping[str, object]) -> Column:
    found = S.similarity({**q, "category": ""}, F.col("text_words"), F.col("workflow_words"))
    met = F.when(F.lower("business_function") == str(q["function"]).lower(), FUNCTION).otherwise(0)
    return F.struct(F.lit(i).alias("question"), met.alias("met"), *(found[n].cast("double").alias(n) for n in _ALL))


def _kind(family: str, subtype: str) -> Column:
    own = F.when(F.array_contains("families", subtype), SUBTYPE).otherwise(0)
    return F.struct(F.lit(family).alias("family"), own.alias("met"), S.intervention_fit("", subtype, F.lit(None).cast("string"), F.col("families")).cast("double").alias("intervention"))


def comparables(records: DataFrame, asked: Sequence[Mapping[str, object]], *, subtypes: Mapping[str, str] = SUBTYPES, ladder: Sequence[Step] = LADDER, least: int = 5, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """The step chosen for each question and family, and the records found there.

    Chosen is the first step that at least `least` records reach, or else the
    first of those that most reach. Of it come the `most` records most alike,
    one an organization (a record without one stands for itself); if they are
    fewer than `least`, the best of the others fill up. Ties go by id.

    First: (question, family, step, reached), for those that any record reaches.
    Second: (question, family, id, likeness), likeness in millionths.

    records: id, organization_name, business_function, text, workflow,
    industries, employee_count, outcomes, families. Organizations are dealt out
    by hash over a fixed number of parts. A first pass counts the steps and finds
    the best of each part; different parts are different organizations, so a place
    is never below the part's best in that place. A second pass takes only the
    records that reach the last place wanted, so no task holds a row for each
    question, family and organization. Where fewer parts than places have any,
    all are taken. The records are read again only if some question has under
    `least` organizations, and then for those alone.
    """
    made = pairs(saved(factors(records, asked, subtypes)), ladder)  # what derives from texts is derived once
    steps, room, places = range(len(ladder)), F.lit(Decimal(ROOM)), max(least, most)
    joint = lambda s: F.col(s).cast("decimal(7,0)") * room - F.col("id").cast("decimal(20,0)")  # noqa: E731  of fixed length, so that the aggregate needs no sort
    known = reduce(lambda a, b: a | b, (F.col(f"s{k}").isNotNull() for k in steps))
    part = F.pmod(F.xxhash64("organization"), F.lit(max(PARTS, 16 * places)))
    parts = made.where(known).groupBy("question", "family", part.alias("part")).agg(*(F.count(f"s{k}").alias(f"n{k}") for k in steps), *(F.max(joint(f"s{k}")).alias(f"b{k}") for k in steps))

    last = lambda k: F.get(F.sort_array(F.collect_list(f"b{k}"), asc=False), places - 1)
    counts = parts.groupBy("question", "family").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in steps), *(last(k).alias(f"b{k}") for k in steps))
    reached = F.array(*(F.col(f"n{k}") for k in steps))
    first = F.get(F.filter(F.transform(reached, lambda n, i: F.when(n >= least, i)), lambda i: i.isNotNull()), 0)
    step = F.coalesce(first, F.array_position(reached, F.array_max(reached)).cast("int") - 1)
    pick = lambda prefix: F.get(F.array(*(F.col(f"{prefix}{k}") for k in steps)), F.col("step"))
    chosen = saved(counts.withColumn("step", step).withColumns({"reached": pick("n"), "last": pick("b")}).select("question", "family", "step", "reached", "last"))  # a row a question and family

    near = made.join(F.broadcast(chosen), ["question", "family"]).withColumn("likeness", pick("s")).withColumn("b", joint("likeness")).where("b IS NOT NULL AND (last IS NULL OR b >= last)")
    best = saved(near.groupBy("question", "family", "organization").agg(F.max("b").alias("b")))  # little more than `places` organizations a question and family
    found = best.groupBy("question", "family").agg(F.count("*").alias("organizations"))  # all of them, or `places` at least
    chosen = chosen.drop("last").join(F.broadcast(found), ["question", "family"])

    at = Window.partitionBy("question", "family").orderBy(F.desc("likeness"), "id")
    top = best.join(F.broadcast(found), ["question", "family"]).withColumn("l", F.round(F.col("b") / room).cast("decimal(7,0)"))
    top = top.select("question", "family", "organization", "organizations", (F.col("l") * room - F.col("b")).cast("long").alias("id"), F.col("l").cast("long").alias("likeness"))
    top = top.withColumn("k", F.row_number().over(at)).where(F.col("k") <= most)

    short = chosen.where((F.col("organizations") < least) & (F.col("reached") > F.col("organizations")))
    rest = made.join(F.broadcast(short), ["question", "family"]).withColumn("likeness", pick("s")).where("likeness IS NOT NULL")
    rest = rest.join(F.broadcast(top.where(F.col("organizations") < least).select("question", "family", "id")), ["question", "family", "id"], "left_anti")  # under `least` rows each
    rest = rest.withColumn("k", F.row_number().over(at) + F.col("organizations")).where(F.col("k") <= least)
    columns = ["question", "family", "id", "likeness"]
    return chosen.drop("organizations"), top.select(*columns).unionByName(rest.select(*columns))


def relevance(hundredths: Column) -> Column:
    """direct, supporting, or adjacent, which is no evidence."""
    return F.when(hundredths >= DIRECT, "direct").when(hundredths >= SUPPORTING, "supporting").otherwise("adjacent")


def wired(found: DataFrame, cards: int = 5) -> DataFrame:
    """(question, family, results, direct, supporting, strength, evidence): what the records found say once adjacent ones are left out.

    strength is the mean likeness of the best `cards` that bear on the decision,
    from 0 to 1, and 0 if none does; evidence lists their ids, best first.
    """
    likeness = F.floor(F.col("likeness") / 10_000 + 0.5)
    rows = found.withColumn("h", likeness).withColumn("band", relevance(F.col("h")))
    apt = F.when(F.col("band") != "adjacent", F.struct((-F.col("likeness")).alias("l"), "id", "h"))
    g = rows.groupBy("question", "family").agg(F.count("*").alias("results"), F.count_if(F.col("band") == "direct").alias("direct"), F.count_if(F.col("band") == "supporting").alias("supporting"), F.slice(F.sort_array(F.collect_list(apt)), 1, cards).alias("top"))
    mean = F.aggregate("top", F.lit(0.0), lambda s, x: s + x["h"]) / F.greatest(F.size("top"), F.lit(1)) / 100
    return g.select("question", "family", "results", "direct", "supporting", half_up(mean, 2).alias("strength"), F.transform("top", lambda x: x["id"]).alias("evidence"))


def with_evidence(decided: DataFrame, chosen: DataFrame, found: DataFrame, score) -> DataFrame:
    """Families of each question with their evidence, ranked anew by a score that counts it.

    decided: rows of (question, family, rank, ...) before evidence; score gives
    (question, family, score) of such rows with their column `evidence` set to
    the strength found (null: nothing was comparable, which counts as unknown).

    Adds step, reached, results, direct, supporting, strength, evidence, score,
    rank, was (the rank before), limit (what weakens the case) and confidence,
    which is low if the family that came first before has no direct evidence.
    """
    seen = decided.join(wired(found), ["question", "family"], "left").join(chosen, ["question", "family"], "left").withColumnRenamed("rank", "was")
    seen = seen.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("results", "direct", "supporting", "reached")})
    limit = F.when(F.col("family") == "No_Action", None).when(F.col("results") == 0, "no comparable implementation").when(F.col("direct") + F.col("supporting") == 0, "none bears on the decision").when(F.col("direct") == 0, "supporting only")
    seen = saved(seen.withColumn("limit", limit))
    marks = score(seen.drop("evidence").withColumn("evidence", F.col("strength")))
    weak = seen.where((F.col("was") == 1) & F.col("limit").isNotNull()).select("question", F.lit("low").alias("confidence"))
    w = Window.partitionBy("question").orderBy(F.desc("score"), "family")
    out = seen.join(marks, ["question", "family"]).join(weak, "question", "left").withColumn("rank", F.row_number().over(w))
    return out.withColumn("confidence", F.coalesce("confidence", F.lit("high")))
