import random

import numpy as np
from factloom.llm import minhash as M

SCHEMA = "doc_id long, text string, digest string, n int"


def brute(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.setdefault(d, []).append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d in names}, {d: len(s[0]) for d, s in sets.items()}


def corpus(seed, families, size):
    rng = random.Random(seed)
    docs = []
    for f in range(families):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, size)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
            docs.append((rng.randint(0, 10**7), rng.choice([" ", "\n"]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return docs


def test_groups_match_brute_force(spark):
    for words, percent, block in ((3, 85, 256), (5, 80, 4)):  # small blocks: every opened bucket is cut
        docs = corpus(words, 60, 12)
        docs += [(10**8, None), (10**8 + 1, ""), (10**8 + 2, " \n"), (10**8 + 3, "one"), (10**8 + 4, "ONE"), (10**8 + 5, "long " * 40_000)]
        df = spark.createDataFrame([(d, t, "clash", 7) for d, t in docs], SCHEMA).repartition(4)
        got = M.near_duplicates(df, words=words, percent=percent, block_rows=block).collect()
        groups, sizes = brute(docs, words, percent)
        assert len(got) == len(docs)
        for r in got:
            assert r["component_id"] == groups[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] == sizes[r["doc_id"]]


def test_repeated_ids_and_nulls(spark):
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (None, "alone in here"), (3, None)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 3, True)]
    assert sorted(str((r["component_id"], r["kept"])) for r in got if r["doc_id"] is None) == ["(1, False)", "(None, False)"]
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_one_id_are_linked(spark):
    a, b, c = ("a b c d e f g h i j", "q r s t u v w x y z", "one more text of ten words is this here now")
    rows = [(2, a), (2, b), (1, b), (3, c), (None, c), (3, ""), (4, " "), (4, a), (None, "n o t h e r e"), (None, "N O T H E R E"), (None, None), (None, None)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(1, 1, True)] + [(2, 1, False)] * 2 + [(3, 3, True)] * 2 + [(4, 1, False)] * 2
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["3"] + ["None"] * 4


def test_near_texts_without_ids_are_linked(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, None, " ".join(w)) for i, w in enumerate((words, [*words, "x"], ["y", *words], [f"v{i}" for i in range(50)]))]
    from factloom.llm.common import durable, shared_dir

    folder = shared_dir(spark)
    got = M.grouped(durable(spark.createDataFrame(rows, "row long, id long, text string"), folder, "rows"), folder).collect()
    assert sum(r["first"] for r in got) == 2 and {r["row"] for r in got if r["first"]} > {3}


def test_estimate_is_near_and_bands_miss_nothing():
    rng = np.random.default_rng(5)
    for j, n in ((0.85, 9), (0.85, 60), (0.8, 500), (0.5, 3000)):
        for _ in range(20):
            h = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            shared = int(np.ceil(j * n))
            half = (n - shared) // 2
            a, b = np.unique(h[: shared + half]), np.unique(np.concatenate([h[:shared], h[shared + half :]]))
            s = np.stack([M.registers(a), M.registers(b)])
            est = M.estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0][0]
            assert abs(est - shared / n) < max(0.1, 1.5 / n)
            if j >= 0.8:
                assert M.hopeful(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]), round(100 * j))[0]
                _, _, key = M.band_keys(M.densified(s[:1]))
                assert np.isin(M.band_keys(M.densified(s[1:]))[2], key).any()


def test_chance_collisions_are_corrected():
    rng = np.random.default_rng(6)
    lucky = []
    for _ in range(200):
        s = np.stack([M.registers(np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))) for _ in "ab"])
        lucky.append(((s[0] == s[1]) & (s[0] > 0)).sum())
    assert abs(np.mean(lucky) - M.chance(np.array(4000), np.array(4000)) * M.REGISTERS) < 0.15


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    from factloom.llm.common import shared_dir

    got = {r["node"]: r["component"] for r in M.components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark), "t").collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    assert all(got.get(x, x) == find(x) for x in up)


def test_linked_sets_meet_by_their_rarest_shingles():
    rng = np.random.default_rng(12)
    for percent in (80, 85, 100):
        for _ in range(300):
            n = int(rng.integers(1, 60))
            both = rng.choice(2**40, n, replace=False).astype(np.uint64)
            sets = [np.concatenate([both[rng.random(n) > 0.06], rng.choice(2**40, rng.integers(0, n // 8 + 1), replace=False).astype(np.uint64) + np.uint64(2**50)]) for _ in "ab"]
            order = rng.permutation(both)  # any order in common will do
            keys = [dict(zip(k.tolist(), zip(s, g, strict=True), strict=True)) for k, s, g in (M.prefix(len(s), order[np.isin(order, s)], percent) for s in sets)]
            if M.alike(*map(np.sort, sets), percent):
                a, b = keys if len(sets[0]) <= len(sets[1]) else keys[::-1]
                assert any(k in b and a[k][0] and b[k][1] for k in a)


def test_near_texts_that_are_not_linked_do_not_meet(spark, monkeypatch):
    """A family of edits, each too far from the others: few rows are compared, and none in all blocks."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(150):
        w = list(base)
        for k in rng.sample(range(1, 30), 7):
            w[4 * k] = f"new{d}-{k}"
        docs.append((d, " ".join(w)))
    docs += [(200 + d, docs[d][1] + " and more") for d in range(5)]
    made, blocks = [], M.blocks

    def counted(*args):
        made.append(blocks(*args).count())
        return blocks(*args)

    monkeypatch.setattr(M, "blocks", counted)
    got = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), words=3, percent=85, block_rows=8).collect()
    groups, _ = brute(docs, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == groups
    assert sum(groups[d] != d for d in groups) == 5 and max(made) <= len(docs)
