import random
import re

import pytest
from factloom.llm import decontamination as D
from factloom.llm import token_counts as T


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench, n):
    windows = {}
    for item, t in bench:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("null" if item is None else str(item))
    out = []
    for _, t in docs:
        w, hit, items = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    items |= windows[tuple(w[i : i + k])]
                    hit |= set(range(i, i + k))
        out.append((len(w), len(hit), sorted(items)))
    return out


def tables(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "日本", "Don't", "x_y"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ","]) for _ in range(n))
    bench = [(i, make(rng.randint(0, 40))) for i in range(20)] + [(90, "only three words"), (91, None), (None, "an item of no name"), (90, "Again under ninety here"), (92, "...")]
    docs = []
    for i in range(60):
        t = make(rng.randint(0, 30))
        if i % 3 == 0:
            p = (rng.choice(bench)[1] or "").upper()
            t += " | " + p + " | " + make(5)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, make(30_000)), (0, docs[0][1]), (103, "Only! THREE words")]
    return docs, bench


@pytest.mark.parametrize(("window", "block"), [(10, 4 << 20), (4, 4 << 20), (4, 300), (1, 4 << 20), (12, 4 << 20), (14, 4 << 20)])
def test_hits_match_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    monkeypatch.setattr(D, "PIECE_WORDS", 20)
    docs, bench = tables(spark, window)
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_words int").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), list(r["hit_items"])) for r in D.find_matches(df, b, window=window).collect())
    assert got == sorted(brute(docs, bench, window))


def all_matches(w, items, n):
    """Every (item, item_start, doc_start, words) of words w that no word more at either end would keep verbatim."""
    out = set()
    for item, x in items:
        least = min(n, len(x))
        for p in range(len(w)):
            for q in range(len(x)):
                if w[p] == x[q] and not (p and q and w[p - 1] == x[q - 1]):
                    k = 0
                    while p + k < len(w) and q + k < len(x) and w[p + k] == x[q + k]:
                        k += 1
                    if k >= least:
                        out.add((item, q, p, k))
    return out


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_all_longest_matches_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    monkeypatch.setattr(D, "PIECE_WORDS", 9)
    docs, bench = tables(spark, 5)
    docs = [d for d in docs if d[0] != 102] + [(200, f"{bench[3][1]} {bench[4][1]} x {bench[3][1]}"), (201, "go " * 40)]
    bench = [*bench, (95, "go " * 15), (96, bench[3][1])]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    items = [(str(i) if i is not None else "null", words(t)) for i, t in bench]
    got = [(r["text"], [tuple(m) for m in r["matches"]]) for r in D.find_matches(df, b, window=6).collect()]
    assert sum(len(m) for _, m in got) > 50
    for text, matches in got:
        assert len(matches) == len(set(matches)) and set(matches) == all_matches(words(text), items, 6)


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(1, "clean text", "a", 5, "b")], "doc_id long, text string, matches string, N_words int, n_words_aside string")
    assert D.decontaminate(df, spark.createDataFrame([(1, "other")], "item_id long, text string")).collect() == df.collect()


def test_affected_documents_go(spark):
    docs, bench = tables(spark, 8)
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    left = D.decontaminate(df, b)
    assert left.columns == ["doc_id", "text"]
    assert left.count() == sum(h == 0 for _, h, _ in brute(docs, bench, 10))
    assert D.decontaminate(df, b.limit(0)).count() == len(docs) and D.decontaminate(df.limit(0), b).count() == 0


def test_suffixes_are_in_order():
    import numpy as np

    depth = 12
    ids = np.concatenate([np.random.default_rng(1).integers(1, 4, 500), np.zeros(depth + 2, np.int64)])
    at, keys = D.suffix_array(ids, 1, depth)
    suffixes = [tuple(ids[i : i + depth]) for i in at]
    assert suffixes == sorted(suffixes) and sorted(at.tolist()) == list(range(500)) and (keys[1:] >= keys[:-1]).all()


def unigram(vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=any(p == "<0x00>" for p, _ in vocabulary)))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


TEXTS = ["", " ", "  ", "a", "▁", "▁a", " a", "a▁ b", "\n", "日本語 x", "🤗🤗 é", "hello  world ", "<unk> <0x0A>", "a\x00b", "aab" * 50, "z" * 5000, "tie aabb abab", "é́ ​"]


def test_counts_match_the_library():
    public = pytest.importorskip("public_tokenizers")
    vocabulary = T.zipf_vocabulary(public.path("piece_bpe_32k.model"))
    tok, counter = unigram(vocabulary), T.Counter(vocabulary)
    for t in TEXTS:
        assert counter.text(t)[0] == len(tok.encode(t, add_special_tokens=False).ids), repr(t[:20])


@pytest.mark.parametrize("seed", range(20))
def test_ties_match_the_library(seed):
    """Scores from a few values only, so that many segmentations are equally good."""
    rng = random.Random(seed)
    pieces = {"<unk>": 0.0} | {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 4))): float(rng.choice([-1, -2, -2, -3])) for _ in range(25)}
    vocabulary = list(pieces.items())
    tok, counter = unigram(vocabulary), T.Counter(vocabulary)
    for _ in range(60):
        t = "".join(rng.choice("abc d") for _ in range(rng.randint(0, 25)))
        ids = tok.encode(t, add_special_tokens=False).ids
        assert counter.text(t)[0] == len(ids), t


def test_count_tokens_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "a" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    out = T.count_tokens(df, [("<unk>", 0.0), ("▁a", -1.0), ("a", -1.5), ("▁b", -2.0)]).collect()
    assert sorted(r["n_tokens"] for r in out) == [0, 0, 1, 2, 2, 200_000]
    assert T.count_tokens(df.limit(0), [("a", -1.0)]).count() == 0
    assert {r["n_tokens"] for r in T.count_tokens(df.limit(3), []).collect()} == {0, 2}
