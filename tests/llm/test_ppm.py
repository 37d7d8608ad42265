import collections
import math
import random

from factloom.llm import ppm as P
from pyspark.sql import functions as F


class Direct:
    """The same model, symbol by symbol."""

    def __init__(self, texts):
        self.ctx = collections.defaultdict(collections.Counter)
        for t in texts:
            b = [254] * P.ORDER + list(t.encode()) + [255]
            for i in range(P.ORDER, len(b)):
                for d in range(P.ORDER + 1):
                    self.ctx[tuple(b[i - d : i])][b[i]] += 1

    def chances(self, before):
        """Probability of every symbol after the bytes before."""
        out, left, gone = {}, 1.0, set()
        for d in range(P.ORDER, -1, -1):
            c = {k: v for k, v in self.ctx.get(tuple(before[len(before) - d :]), {}).items() if k not in gone}
            t, s = sum(c.values()), len(c)
            if s:
                out |= {k: left * v / (t + s) for k, v in c.items()}
                left *= s / (t + s)
                gone |= set(c)
        rest = [k for k in range(256) if k != 254 and k not in gone]
        return out | {k: left / len(rest) for k in rest}

    def score(self, t):
        b = [254] * P.ORDER + list(t.encode()) + [255]
        return sum(math.log10(self.chances(b[:i])[b[i]]) for i in range(P.ORDER, len(b)))


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcde éü\n.") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)]


def test_scores_match_a_direct_model(spark, monkeypatch):
    rows = [(i, t, i % 3 != 1, "clash") for i, t in enumerate(texts(4, 50))] + [(60, None, True, ""), (61, "ab" * 400, True, ""), (61, "ab" * 400, True, ""), (None, "null id", False, ""), (62, "\udcff".encode("utf-8", "replace").decode(), False, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean, score string")
    direct = Direct([t or "" for _, t, train, _ in rows if train])
    words = collections.Counter(w for _, t, train, _ in rows if train for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(words.values()), len(words)
    for size, many in ((1 << 20, P.GROUP_GRAMS), (300, 40)):  # one chunk, and many; no context dealt by three bytes, and some
        monkeypatch.setattr(P, "GROUP_GRAMS", many)
        got = P.score(df.drop("score"), F.col("train"), chunk_bytes=size).collect()
        assert len(got) == len(rows)
        by = {(r["doc_id"], r["n_tokens"]): r for r in got}
        for d, t, train, _ in rows:
            tokens = [*(t or "").encode().lower().split(), None]
            r = by[(d, len(tokens))]
            assert r["train"] == train and r["train_tokens"] == n and r["n_known"] == sum(words[w] > 0 for w in tokens)
            assert math.isclose(r["base_score"], sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
            assert math.isclose(r["score"], direct.score(t or ""), rel_tol=1e-5)


def test_chances_add_up_to_one():
    model = Direct(texts(9, 30))
    for before in ([254] * 5, list(b"abcab"), [0, 1, 2, 3, 4]):
        assert math.isclose(sum(model.chances(before).values()), 1.0, rel_tol=1e-9)


def test_long_text_in_batches(monkeypatch):
    monkeypatch.setattr(P, "BATCH", 64)
    t = ["abc" * 100, "", "x"]
    (k, c), _ = P.listed(t, [True, False, True])
    monkeypatch.setattr(P, "BATCH", 1 << 20)
    (k2, c2), _ = P.listed(t, [True, False, True])
    assert (k == k2).all() and (c == c2).all()


def test_no_training_and_empty(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.score(df, F.lit(False)).collect()}
    assert math.isclose(got[1]["score"], -3 * math.log10(P.SYMBOLS), rel_tol=1e-6) and got[1]["train_tokens"] == 0 and got[2]["n_tokens"] == 1
    assert P.score(df.limit(0), F.lit(True)).count() == 0
