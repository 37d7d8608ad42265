"""Vocabularies from tables against plain loops."""

import random

import pytest
from factloom.operators import vocabulary as V


def frames(spark, aliases, keywords):
    return spark.createDataFrame(aliases, "alias string, value string"), spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(keywords)], "keyword string, value string, position int")


def loop(key, aliases, keywords, by_place, sure):
    if not key:
        return "", 0.0, "explicit"
    exact = [v for a, v in aliases if a == key]
    if exact:
        return min(exact), 1.0, "explicit"
    hits = [(key.find(k), -len(k), i, v) for i, (k, v) in enumerate(keywords) if k and k in key]
    if hits:
        return (min(hits) if by_place else min(hits, key=lambda h: h[2]))[3], sure, "inferred"
    return key, 0.3, "inferred"


@pytest.mark.parametrize("by_place", [False, True])
def test_thousands_of_keywords_against_a_loop(spark, by_place, tmp_path):
    rng = random.Random(5)
    letters = "aab cde-éü"
    text = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(*n)))
    keywords = list({text((1, 7)): f"v{i % 90}" for i in range(2500)}.items()) + [("", "never")]
    values = [text((0, 25)) for _ in range(400)] + ["", None, "zz", "a"]
    aliases = [(v, f"alias{i}") for i, v in enumerate(values[:30]) if v]
    a, k = frames(spark, aliases, keywords)
    k.write.json(str(tmp_path / "k.jsonl"))
    read = V.load(spark, str(tmp_path / "k.jsonl"), "keyword", "value", "position")
    out = V.classified(spark.createDataFrame([(v,) for v in values], "key string"), a, read, by_place=by_place, sure=0.6).collect()
    assert {r["key"]: tuple(r)[1:] for r in out} == {v: loop(v, aliases, keywords, by_place, 0.6) for v in values}


def test_industries_of_several_parts(spark):
    aliases, keywords = frames(spark, [("energy", "energy/general"), ("retail", "retail/general"), ("food and beverage", "retail/food")], [("chemical", "manufacturing/chemicals"), ("bank", "finance/banking"), ("chem", "science/chemistry")])
    about = spark.createDataFrame([("energy/general", "energy", "general"), ("manufacturing/chemicals", "manufacturing", "chemicals"), ("finance/banking", "finance", "banking"), ("retail/food", "retail", "food")], "value string, industry string, subsector string")
    raw = ["Tank Storage / Energy / Chemicals", "Chemicals (bulk) / Energy", "Investment-Banking", "food and beverage", "no such thing", "", None, "Banking / Chemical"]
    got = {r["raw"]: (r["industry"], r["subsector"], r["confidence"], r["mapped"]) for r in V.industries(spark.createDataFrame([(x,) for x in raw], "raw string"), aliases, keywords, about).collect()}
    assert got["Tank Storage / Energy / Chemicals"] == ("energy", "general", 0.567, True)  # the surest part, though it isn't the first
    assert got["Chemicals (bulk) / Energy"] == ("energy", "general", 0.85, True)
    assert got["Investment-Banking"] == ("finance", "banking", 0.7, True) and got["Banking / Chemical"] == ("finance", "banking", 0.7, True)
    assert got["food and beverage"] == ("retail", "food", 1.0, True)
    assert got["no such thing"] == got[""] == got[None] == (None, None, 0.0, False)


def test_the_index_meets_few_keywords(spark):
    """Keywords that share common parts with all values meet only those values that have their rarest part."""
    keywords = spark.createDataFrame([(f"common {i:04}", str(i), i) for i in range(1000)], "keyword string, value string, position int")
    values = spark.createDataFrame([(f"a common {i:04} thing",) for i in range(0, 1000, 50)], "key string")
    got = V.found(values, keywords).collect()
    assert sorted(r["keyword"] for r in got) == [f"common {i:04}" for i in range(0, 1000, 50)] and all(r["at"] == 3 for r in got)


def test_claims_are_located_as_by_a_loop(spark):
    from factloom.operators import linking
    from pyspark.sql import functions as F

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    docs = [(d, k, text(rng.choice([0, 5, 60]))) for d in range(40) for k in range(3)]
    claims = [(i, t[3:3 + rng.choice([2, 8, 20])]) for i, (_, _, t) in enumerate(docs[::4]) if len(t) > 20] + [(900, "abab"), (901, "not there at all")]
    sections = spark.createDataFrame(docs, "doc_id int, number int, key string").withColumn("digest", F.sha2("key", 256))
    got = {(r["item_id"], r["doc_id"]): r["number"] for r in linking.located(sections, spark.createDataFrame(claims, "item_id int, claim string")).collect()}
    want = {}
    for i, c in claims:
        for d, k, t in docs:
            if c in t:
                want.setdefault((i, d), k)
    assert got == want
