"""Components and elected names against a plain union-find."""

import random
from collections import Counter

from pyspark.sql import functions as F

from factloom.operators import entities as E


def roots(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    """A long chain, a star with a third of all ids, random pairs, loops, repeats and null ends."""
    rng = random.Random(2)
    order = rng.sample(range(300), 300)
    edges = list(zip(order, order[1:])) + [(700, i) for i in range(701, 1000)] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(200)]
    edges += [(2000, 2000), edges[0], edges[0]]
    ids = {x for e in edges for x in e}
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long")
    got = E.components(df).collect()
    assert {r.id: r.root for r in got} == roots(ids, edges) and len(got) == len(ids)
    assert E.components(df.limit(0)).count() == 0


def test_chain_of_aliases_ends_in_one_entity(spark):
    rows = [
        (1, "Acme Corp", "acme.example", "x"),
        (2, "Acme Corp", None, "x"),
        (3, "ACME Holdings", "acme.example", "y"),
        (4, "Roadrunner", "rr.example", "y"),
        (5, "roadrunner", "rr2.example", None),
        (6, None, "rr2.example", None),
        (7, "", None, ""),
        (8, None, "", None),
        (9, "Other", "other.example", None),
    ]
    df = spark.createDataFrame(rows, "id long, name string, domain string, alias string").withColumns({"entity": F.lit(0), "kind": F.lit("clash")})
    keys = {"name": E.plain_name(F.col("name")), "domain": F.col("domain"), "alias": F.col("alias")}
    got = {r.id: tuple(r)[1:] for r in E.entities(df, keys).collect()}
    assert {i: got[i][1] for i in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 8, 9: 9}
    assert {got[i][2] for i in range(1, 7)} == {"Acme Corp"} and got[7][2] == ""
    assert [got[i][3] for i in range(1, 10)] == ["itself", "itself", "domain", "chain", "chain", "chain", "itself", "itself", "itself"]
    assert [got[i][4] for i in (1, 7, 9)] == [6, 1, 1]
    assert E.entities(df.limit(0), keys).count() == 0


def test_entities_against_a_plain_walk(spark):
    """One domain holds a third of all mentions; names repeat."""
    rng = random.Random(9)
    rows = [(i, f"n{rng.randrange(150)}", "hot" if i % 3 == 0 else f"d{rng.randrange(400)}") for i in range(400)]
    edges = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] == b[1] or a[2] == b[2])]
    want = roots(range(400), edges)
    df = spark.createDataFrame(rows, "id long, name string, domain string")
    got = E.entities(df, {"name": F.col("name"), "domain": F.col("domain")}).collect()
    assert {r.id: r.entity for r in got} == want
    for e in set(want.values()):
        names = Counter(n for i, n, _ in rows if want[i] == e)
        best = min(names, key=lambda n: (-names[n], len(n), n))
        assert {(r.canonical, r.size) for r in got if r.entity == e} == {(best, sum(names.values()))}


def test_plain_names(spark):
    df = spark.createDataFrame([(" Åcme &  Söhne, Inc. ",), ("हिन्दी!",), ("...",), (None,)], "n string")
    assert [r[0] for r in df.select(E.plain_name(F.col("n"))).collect()] == ["åcme söhne inc", "हिन्दी", "", ""]
    assert [r[0] for r in spark.range(1).select(E.beginning(F.lit("a b c"), 2)).unionAll(spark.range(1).select(E.beginning(F.lit("a b"), 2))).collect()] == ["a b", None]
