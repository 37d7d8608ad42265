import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from factloom.llm import mixing as M
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"


def words(t):
    out, now = 0, False
    for c in t or "":
        out += not now and c not in WS
        now = c not in WS
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """By raising the level until all words are given, sources at their limit being taken out one after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free} | {s: most * sizes[s] for s in capped}
        over = {s for s in free if now[s] > most * sizes[s]}
        if not over:
            return now
        capped |= over


def test_word_count(spark):
    texts = ["", None, " ", "a", " a b\x0b\x0cc\r\n", "é 日本 x y", "x" * 5000, "\x00 \x1f a"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", M.word_count(F.coalesce("t", F.lit(""))).alias("n")).collect()
    assert [r["n"] for r in sorted(got)] == [words(t) for t in texts]


@pytest.mark.parametrize("good,bad,sample", [(5, 7, 4), (1, 1, 1), (40, 3, 21), (300, 500, 200), (3, 400, 390), (20, 20, 39), (50_000, 90_000, 3)])
def test_draws_follow_the_law(spark, good, bad, sample):
    many = 6000
    x = spark.range(many).select(M.hypergeometric(*(F.lit(v).cast("long") for v in (good, bad, sample)), [F.col("id")]).alias("x")).groupBy("x").count().collect()
    seen = {r["x"]: r["count"] for r in x}
    law = {k: math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) for k in range(max(0, sample - bad), min(good, sample) + 1)}
    assert set(seen) <= set(law)
    chi = sum((seen.get(k, 0) - many * p) ** 2 / (many * p) for k, p in law.items() if many * p >= 5)
    free = sum(many * p >= 5 for p in law.values())
    assert chi < free + 5 * math.sqrt(2 * free) + 5


def test_tree_is_exact(spark):
    for shards in (1, 2, 7, 64):
        quota = [1000, 0, 1, 37, 250_000, 3]
        rows = M.split(spark.createDataFrame([(quota,)], "quota array<long>"), shards, 3).collect()
        assert sorted(r["shard"] for r in rows) == list(range(shards))
        assert np.array([r["quota"] for r in rows]).sum(axis=0).tolist() == quota and min(min(r["quota"]) for r in rows) >= 0
        each = [sum(r["quota"]) for r in rows]
        assert max(each) - min(each) <= 1


def corpus(seed=5, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "Ü", "tiny" if i % 40 == 0 else "a", None])
        rows.append((i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.choice([1, 5, 60, 700 if source != "tiny" else 2]))), source, "clash", i))
    rows += [(n, None, "hot", "x", 0), (n + 1, "", "void", "x", 0), (n + 2, " \n", None, "x", 0), (n + 3, "w " * 9000, "long", "x", 0), (None, "no id here", "a", "x", 0), (7, "seven again", "b", "x", 0), (7, "seven again", "b", "x", 0)]
    return rows


def test_mix_gives_targets_exactly(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, pieces int")
    got = M.mix(df, block_words=16, shards=9).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += words(r[1])
    want, taken, per_shard, ranks = targets(sizes), Counter(), Counter(), defaultdict(dict)
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["pieces"])
        taken[r["source"]] += r["taken"]
        for p in r["pieces"]:
            assert 0 <= p["first"] and p["words"] > 0 and p["first"] + p["words"] <= r["size"]
            ranks[r["source"]].setdefault(p["rank"], p["shard"])
            assert ranks[r["source"]][p["rank"]] == p["shard"]
    assert all(taken[s] == round(want[s]) for s in sizes)
    for own in ranks.values():  # disjoint blocks: the ranks are a run from 0, and go to the shards in turn
        assert sorted(own) == list(range(len(own))) and [own[k] for k in sorted(own)] == sorted(own.values())
        per_shard.update(own.values())
    assert max(per_shard.values()) - min(per_shard.get(k, 0) for k in range(9)) <= 1
    again = M.mix(df.repartition(7), block_words=16, shards=9).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["pieces"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, "only one here", "s")], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in M.mix(df).collect()] == [(3.0, 3)]
    assert M.mix(df.limit(0)).count() == 0
    assert [(r["target"], r["taken"]) for r in M.mix(df.withColumn("text", F.lit(None).cast("string"))).collect()] == [(0.0, 0)]
    with pytest.raises(ValueError):
        M.mix(df, shards=0)


def test_write_mix(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(40 + i)), f"s{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = M.mix(df, block_words=8, shards=4).cache()
    M.write_mix(df, mixed, str(tmp_path / "mix"))
    out = spark.read.parquet(str(tmp_path / "mix")).collect()
    took = Counter()
    for r in out:
        own = [w.split("_") for w in r["text"].split()]
        assert all(int(d[1:]) == r["doc_id"] for d, _ in own) and [int(k) for _, k in own] == list(range(r["first"], r["first"] + len(own)))
        took[r["doc_id"]] += len(own)
    assert {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]} == dict(took)
    assert set(r["shard"] for r in out) <= set(range(4))
