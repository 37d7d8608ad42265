import hashlib
import random

from factloom.llm import syncmers as S
from pyspark.sql import functions as F

TEXTS = ["", None, "a", "short text", "The quick brown fox jumps over the lazy dog again and again. " * 5, "no-blanks" * 3000, "é日本🤗 " * 40, "x" * 200]


def test_anchors_against_brute_force(spark):
    """A k-mer is chosen if the least hash of its s-mers is the first's or the last's."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    hashes = {}

    def xxh(parts):
        todo = sorted({p for p in parts if p not in hashes})
        if todo:
            for r in spark.createDataFrame([(p,) for p in todo], "p binary").select("p", F.xxhash64("p").alias("h")).collect():
                hashes[bytes(r["p"])] = r["h"]

    got = {r["i"]: sorted(set(r["a"])) for r in df.select("i", S.anchors(F.coalesce("text", F.lit("")).cast("binary")).alias("a")).collect()}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        want = []
        k, s, w = S.K, S.S, S.K - S.S + 1
        parts = [b[j : j + s] for j in range(len(b) - s + 1)] + [b[j : j + k] for j in range(len(b) - k + 1)] + [b]
        xxh([p for p in parts if p])
        pack = lambda h, at: ((h % (1 << 64)) >> (S.PLACE_BITS + 2)) << S.PLACE_BITS | at
        for j in range(len(b) - k + 1):
            inner = [hashes[b[j + x : j + x + s]] for x in range(w)]
            if min(inner) in (inner[0], inner[-1]):
                want.append(pack(hashes[b[j : j + k]], j))
        if 0 < len(b) < k:
            want = [pack(hashes[b], 0)]
        assert got[i] == sorted(set(want)), i


def test_edits_and_likeness(spark):
    texts = [f"document {i} has its own words {i * 7919 % 1000} and {i * 104729 % 997} tells of them at some length " * (1 + i % 4) for i in range(40)]
    texts[7] = texts[6]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "z"), (502, "a second row of 502"), (None, "null id comes first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.compare_with_edits(df).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str)
    edited = [(i, (t or "")[: len(t or "") - len(t or "") // 2] + (order[(i + 1) % len(order)][1] or "")[: len(t or "") // 2]) for i, (_, t) in enumerate(order)]
    direct = {r["i"]: r["fingerprint"] for r in S.fingerprint(spark.createDataFrame(edited, "i int, text string")).collect()}
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    for i, (d, t) in enumerate(order):
        assert by[(d, len(t or ""))]["edited_fingerprint"] == direct[i]
    assert by[(18, len(texts[6]))]["near_next"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert by[(500, 0)]["near_next"] == 1.0 and by[(501, 0)]["near_next"] == 0.0


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 4)
    rows = [(i * i, f"text number {i} " * (i % 5)) for i in range(50)]
    got = {r["doc_id"]: r["edited_sha256"] for r in S.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (d, t) in enumerate(rows):
        h = len(t) // 2
        assert got[d] == hashlib.sha256((t[: len(t) - h] + rows[(i + 1) % 50][1][:h]).encode()).hexdigest()


def alike(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", *(S.sketch_of(F.col(c).cast("binary")).alias(c) for c in "ab"))
    return [r["x"] for r in df.select("i", S.likeness(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()], [tuple(r) for r in df.orderBy("i").collect()]


def brute_likeness(a, b):
    """From two sketches: the longest rising run by trying each anchor as the last one."""
    one, two = ({x >> S.PLACE_BITS: x & (1 << S.PLACE_BITS) - 1 for x in s} for s in (a, b))
    if not one and not two:
        return 1.0
    union = sorted(set(one) | set(two))[: S.SKETCH]
    places = sorted((one[h], two[h]) for h in union if h in one and h in two)
    best = []
    for i, (_, y) in enumerate(places):
        best.append(1 + max((best[j] for j in range(i) if places[j][1] < y), default=0))
    return max(best, default=0) / len(union)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_likeness_of_planted_edits(spark):
    """What is put in, taken out, replaced or moved costs its own share; the estimate's standard error is about 0.06."""
    pairs, want = [], []
    for seed in range(12):
        t = prose(seed, 2000)
        mid = len(t) // 2
        for n in (40, 200, 2000):
            new = prose(900 + seed, n)[:n]
            pairs += [(t, t[:mid] + new + t[mid:]), (t, t[:mid] + t[mid + n :]), (t, t[:mid] + new + t[mid + n :]), (t, "PREFIX " * (n // 7) + t)]
            share = len(t) / (len(t) + n)
            want += [share, 1 - n / len(t), (len(t) - n) / (len(t) + n), share]
        pairs += [(t, t[mid:] + t[:mid]), (t, t[-len(t) // 4 :] + t[: -(len(t) // 4)]), (t, prose(500 + seed, 2000))]
        want += [0.5, 0.75, 0.0]
    got, sketches = alike(spark, pairs)
    assert all(abs(g - brute_likeness(a, b)) < 1e-12 for g, (_, a, b) in zip(got, sketches, strict=True))
    off = [g - w for g, w in zip(got, want, strict=True)]
    assert max(map(abs, off)) < 0.27 and abs(sum(off) / len(off)) < 0.03
    near = [w >= 0.8 for w in want]
    found = [g >= 0.7 for g in got]
    assert sum(n and f for n, f in zip(near, found, strict=True)) / sum(near) >= 0.97  # recall of near copies
    assert sum(f and w >= 0.6 for f, w in zip(found, want, strict=True)) / sum(found) >= 0.97  # precision


def test_likeness_against_brute_force(spark):
    rng = random.Random(7)
    words = [prose(k, 1) * 3 for k in range(30)]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(60)] + [("", ""), ("", "x"), ("x", "x"), ("x", "y")]
    got, sketches = alike(spark, pairs)
    assert all(abs(g - brute_likeness(a, b)) < 1e-12 for g, (_, a, b) in zip(got, sketches, strict=True))
    assert len({round(g, 3) for g in got}) > 8


def test_pieces_make_the_same_sketch(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate(["", "ab", prose(1, 5), prose(2, 3000), "same " * 5000, prose(3, 20) * 200])]
    df = spark.createDataFrame(texts, "i int, t string")
    whole = {r["i"]: r["s"] for r in df.select("i", S.sketch(S.anchors(F.col("t").cast("binary"))).alias("s")).collect()}
    monkeypatch.setattr(S, "PIECE", 97)
    assert {r["i"]: r["s"] for r in df.select("i", S.sketch_of(F.col("t").cast("binary")).alias("s")).collect()} == whole


def test_empty_and_lone(spark):
    df = spark.createDataFrame([(5, "alone in the world, this text is")], "doc_id long, text string")
    assert S.compare_with_edits(df).first()["near_next"] == 1.0
    assert S.compare_with_edits(df.limit(0)).count() == 0
    clash = df.withColumn("sketch", F.lit(1)).withColumn("fingerprint", F.lit(2))
    assert len(S.fingerprint(clash).first()["fingerprint"]) % 16 == 0
