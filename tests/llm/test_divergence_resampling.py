import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from factloom.llm import common, divergence, resampling
from pyspark.sql import functions as F


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_audit(rows, least=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        df[lang].update(set(terms(text)))
        count[lang, source].update(terms(text))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        own = {s: [count[lang, s][t] for t in kept] for s in sources}
        total = [sum(own[s][i] for s in sources) for i in range(len(kept))]
        shares = lambda c: [1 + 10**9 * (n + 1) // (sum(c) + len(kept)) for n in c]
        p, q = {s: shares(c) for s, c in own.items()}, shares(total)
        for s in sources:
            pair = [(x, sum((a - b) ** 2 // b for a, b in zip(p[s], p[x], strict=True))) for x in sources if x != s]
            term = [(t, (a - b) ** 2 // b) for t, n, a, b in zip(kept, own[s], p[s], q, strict=True) if n and a > b]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def corpus(seed, n=240, vocab=60):
    rng = random.Random(seed)
    names = [f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocab)] + ["É", "日本", "Up"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de"]), "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "Z", "é", "twin1", "twin2"])
        rows.append((" ".join(names[min(len(names) - 1, int(rng.expovariate(0.08)))] + rng.choice([" ", "-1,", "_"]) for _ in range(rng.randint(0, 30))), lang, source))
    rows += [("same words same words", "en", "twin1"), ("same words same words", "en", "twin2")] * 3
    return rows + [(None, "en", "void"), ("", "xx", None), (" 12 ", "xx", "q"), ("once", None, None), ("solo solo solo", "yy", "one")]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        for name, value in (("HELD_TERMS", 50), ("PAIRS", 7), ("HELD_PAIRS", 5)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, value int, number int").repartition(3)
    got = [tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == brute_audit(rows)
    assert sorted(tuple(r) for r in divergence.audit(df, least_docs=2, top=3).collect()) == brute_audit(rows, 2, 3)


def test_audit_of_little(spark):
    df = spark.createDataFrame([("a a", "en", "s")], "text string, lang string, source string")
    assert divergence.audit(df.limit(0)).count() == 0 and divergence.audit(df).count() == 0
    assert [tuple(r) for r in divergence.audit(df, least_docs=1).collect()] == []
    two = df.union(df.withColumn("source", F.lit("t")))
    assert sorted(tuple(r) for r in divergence.audit(two).collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_large_counts_stay_exact(spark):
    n, all_ = 40_000_000_000, 90_000_000_000_000
    got = spark.createDataFrame([(n, all_)], "n long, a long").select(divergence.share("n", "a")).first()[0]
    assert got == 1 + 10**9 * (n + 1) // all_


def test_word_lists_cut_no_word():
    rng = random.Random(4)
    data = "".join(rng.choice("abc é\n") for _ in range(3000)).encode()
    for piece in (1, 7, 64, 5000):
        assert [w for part in common.word_lists(data, resampling.WORD_BYTES, piece) for w in part] == data.translate(resampling.WORD_BYTES).split()
    assert list(common.word_lists(None, resampling.WORD_BYTES)) == list(common.word_lists(b"  ", resampling.WORD_BYTES)) == []


def brute_resample(docs, target, words=1, buckets=10_000, percent=10, least=20):
    def features(t):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))]
        return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, words + 1) for i in range(len(w) - k + 1)], len(w)

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in features(x)[0])
    many, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (many + buckets) / ((s[b] + 1) * (wanted + buckets))))
    rows = []
    for i, f, n in found:
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["alpha", "Beta", "7", "é日", "rare" + str(rng.randint(0, 99))]) + rng.choice([" ", "-", "\n"]) for _ in range(rng.randint(0, 90)))) for i in range(n)]


@pytest.mark.parametrize("words,buckets", [(1, 10_000), (3, 512)])
def test_resampling_against_brute_force(spark, words, buckets, monkeypatch):
    monkeypatch.setattr(resampling, "STEP", 17)
    docs = texts(3, 300) + [(900, None), (901, ""), (902, "-- "), (None, "word " * 30), (905, "many words " * 4000)]
    target = [t.upper() for _, t in texts(8, 20)] + [None, ""]
    df = spark.createDataFrame([(*d, "clash", 0) for d in docs], "doc_id long, text string, score string, rank int").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), words=words, buckets=buckets, percent=30).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_resample(docs, target, words, buckets, 30)


def test_resampling_of_repeats_and_little(spark):
    docs = texts(5, 60)
    df = spark.createDataFrame(docs + docs[:20], "doc_id long, text string")
    target = spark.createDataFrame([("alpha beta",)], "text string")
    got = resampling.resample(df, target, percent=50).collect()
    drawn = sorted(r["rank"] for r in got if r["rank"])
    eligible = sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) >= 20 for _, t in docs + docs[:20])
    assert len(got) == 80 and drawn == list(range(1, eligible * 50 // 100 + 1))
    assert resampling.resample(df.limit(0), target).count() == 0
    assert resampling.resample(df, target.limit(0)).count() == 80
    with pytest.raises(ValueError):
        resampling.resample(df, target, buckets=100_000)


def test_sort_count_and_gather():
    rng = np.random.default_rng(1)
    stream, cuts = rng.integers(0, 50, 1000).astype("<u2"), np.sort(rng.integers(0, 1001, 40))
    values, lengths = resampling.run_lengths(np.sort(stream))
    assert dict(zip(values.tolist(), lengths.tolist(), strict=True)) == Counter(stream.tolist())
    offsets, gains = np.concatenate([[0], cuts, [1000]]), rng.integers(-99, 99, 50)
    assert resampling.sums_by_document(stream, offsets, gains).tolist() == [int(gains[stream[a:b]].sum()) for a, b in zip(offsets, offsets[1:], strict=False)]
