"""Exact top-k with bounds against all pairs."""

import random

import pytest
from factloom.operators import topk as N
from pyspark.sql import functions as F


def brute(queries, docs, k, by):
    out = []
    for q, text in queries:
        own = set((text or "").lower().split())
        scored = []
        for i, t in docs:
            words = set((t or "").lower().split())
            n = len(own & words)
            if n:
                scored.append((-(n / max(len(own), len(words)) if by == "share" else float(n)), i, n))
        out += [(q, i, n, -s, rank + 1) for rank, (s, i, n) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(seed, docs, queries):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.03)), 400)}" if rng.random() < 0.7 else rng.choice(["the", "of", "And", "a"])
    made = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 20, 60])))) for i in range(docs)]
    asked = [(f"q{i}", " ".join(word() for _ in range(rng.choice([1, 5, 25])))) for i in range(queries)]
    asked += [("copy", made[3][1]), ("part", " ".join(made[7][1].split()[:9])), ("none", None), ("stop", "the of and a"), ("far", "zzz")]
    return made + [(docs + i, made[i][1]) for i in range(15)] + [(docs + 90, None)], asked


@pytest.mark.parametrize("by", ["share", "count"])
@pytest.mark.parametrize("small", [False, True])
def test_nearest_against_all_pairs(spark, monkeypatch, by, small):
    if small:
        for name, value in (("BLOCK_BYTES", 900), ("DOCS", 7), ("CELLS", 200)):
            monkeypatch.setattr(N, name, value)
    docs, asked = corpus(3, 400, 30)
    d = spark.createDataFrame(docs, "id long, text string").repartition(3)
    best, counts = N.nearest(spark.createDataFrame(asked, "id string, text string"), d, 8, by=by, count_where=F.col("id") % 2 == 0)
    got = sorted((r["query"], r["id"], r["shared"], r["score"], r["rank"]) for r in best.collect())
    assert got == brute(asked, docs, 8, by)
    want = {q: sum(bool(set((t or "").lower().split()) & set((x or "").lower().split())) for i, x in docs if i % 2 == 0) for q, t in asked}
    assert {r["query"]: r["n"] for r in counts.collect()} == {q: n for q, n in want.items() if n}


def test_common_words_leave_the_index():
    """Once a query has k good documents, the lists of its commonest words are not read any more."""
    queries = [(i, [b"the", b"of"] + [f"r{i}_{k}".encode() for k in range(6)]) for i in range(50)]
    index = N.Index(queries, True)
    assert index.begin[index.number[b"the"] + 1] - index.begin[index.number[b"the"]] == 50
    index.keep(index.may_leave_out(N.np.full(50, 0.9)))
    assert all(index.begin[index.number[w] + 1] == index.begin[index.number[w]] for w in (b"the", b"of")) and len(index.lists) == 50


def test_little(spark):
    d = spark.createDataFrame([(1, "a b")], "id long, text string")
    q = spark.createDataFrame([("q", "B c")], "id string, text string")
    assert [tuple(r) for r in N.nearest(q, d, 3)[0].collect()] == [("q", 1, 1, 0.5, 1)]
    assert N.nearest(q.limit(0), d, 3)[0].count() == N.nearest(q, d.limit(0), 3)[0].count() == 0
    with pytest.raises(ValueError):
        N.nearest(q, d, 3, by="luck")
