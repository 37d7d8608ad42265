"""The registered queries on a small table, each against its contract worked out by plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from factloom.llm import queries
from factloom.llm.sharding import minimax_cuts
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = {"en": "the of and to in is that it was for on are with as his they be at one have this".split(), "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(21), str(tmp_path_factory.mktemp("registered"))
    docs, labels = [], []
    for i in range(200):
        lang, bad = rng.choice(["en", "de"]), i % 5 == 0
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(8, 120))]
        docs.append((i, " ".join(w.upper() + rng.choice(["!!", "$$"]) for w in words) if bad else " ".join(words) + ".", lang, f"src{i % 4}"))
        labels.append((i, int(not bad), 0))
    item = " ".join(rng.choice(WORDS["de"]) for _ in range(25))
    odd = [None, "", " \n ", "½ ² ① 12", "a <|endoftext|> x", docs[3][1], docs[3][1], f"see {item} end", "token = 'abcdefgh' AKIA" + "A1" * 9 + " " + "0f" * 15, "é日本🤗 " * 50, "one"]
    docs += [(1000 + i, t, None if i % 2 else "en", None if i == 4 else "src9") for i, t in enumerate(odd)]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(5, item), (6, "never seen words here"), (7, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def rows(spark, name, path):
    out = [r.asDict() for r in queries.QUERIES[name](spark, path).collect()]
    return out, {r["doc_id"]: r for r in out}


def held(i, modulus, value):
    return zlib.crc32(str(i).encode()) % modulus == value


def test_op1(spark, folder):
    from tokenizers import Tokenizer

    path, docs, _ = folder
    pieces, _ = rows(spark, "op1_packing", path)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ends = {}
    for i, t, *_ in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1].tolist()] and sum(p["length"] for p in own) == len(ids)
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    full = sum(ends.values()) // 1024
    assert all(ends[s] == 1024 for s in range(full)) and all(n & (n - 1) == 0 for n in ends.values())


def test_op2(spark, folder):
    path, docs, _ = folder
    out, by = rows(spark, "op2_syncmers", path)
    assert len(out) == len(docs)
    for k, (i, t, *_) in enumerate(docs):  # ids ascend
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        assert by[i]["n_chars"] == len(t) and by[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= by[i]["near_edited"] <= 1 and 0 <= by[i]["near_next"] <= 1
    assert by[1005]["fingerprint"] == by[1006]["fingerprint"] == by[3]["fingerprint"] and by[1005]["near_next"] == 1


def test_op4(spark, folder):
    path, docs, _ = folder
    out, by = rows(spark, "op4_ppm", path)
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, *_ in docs}
    count = Counter(w for i, own in tokens.items() if not held(i, 7, 2) for w in own)
    n, v = sum(count.values()), len(count)
    assert len(out) == len(docs)
    for i, own in tokens.items():
        r = by[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 7, 2), len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    assert np.mean([by[i]["score"] > by[i]["base_score"] for i in range(200) if held(i, 7, 2)]) > 0.5


def test_op5(spark, folder):
    path, docs, _ = folder
    out, by = rows(spark, "op5_quality", path)
    assert len(out) == len(docs) and all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert np.mean([by[i]["predicted"] == int(i % 5 != 0) for i in range(200) if held(i, 4, 2)]) > 0.9


def test_op6(spark, folder):
    path, docs, _ = folder
    out, by = rows(spark, "op6_language", path)
    assert len(out) == len(docs) and all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 for r in out)
    assert all((by[i]["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t)) for i, t, *_ in docs)
    assert np.mean([by[i]["lang_pred"] == lang for i, _, lang, _ in docs[:200] if held(i, 5, 0)]) > 0.9


def test_op7(spark, folder):
    path, docs, _ = folder
    out, by = rows(spark, "op7_secrets", path)
    assert len(out) == len(docs)
    kinds = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    for i, t, *_ in docs:
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p, flags, least) in enumerate(kinds) for m in re.finditer(p, t or "", flags) if len(m[2] if k == 0 else m[0]) >= least)
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert [by[i][f"n_{k}"] for k, *_ in kinds] == [sum(s[2] == k for s in spans) for k, *_ in kinds]
        assert by[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(by[i]["spans"].split(","))
    assert by[1008]["n_assign"] == by[1008]["n_access"] == by[1008]["n_hex"] == 1


def test_op8(spark, folder):
    path, docs, _ = folder
    out, by = rows(spark, "op8_sharding", path)
    sizes, slots, groups = Counter(), {}, Counter()
    for i, t, *_ in docs:
        r, data = by[i], (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= r["shard"] < 40
        sizes[r["shard"]] += r["size"]
        groups[t or ""] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert by[3]["shard"] == by[1005]["shard"] == by[1006]["shard"] and by[1000]["shard"] == by[1001]["shard"]
    order = {r["t"]: r["h"] % (1 << 64) for r in spark.createDataFrame([(t,) for t in groups], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    assert max(sizes.values()) == minimax_cuts([groups[t] for t in sorted(groups, key=order.get)], 40)[0]


def test_op9_and_op10(spark, folder):
    path, docs, item = folder
    _, by = rows(spark, "op9_decontamination", path)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(words(item)[k : k + 10]) for k in range(16)} | {tuple("never seen words here".split())}
    for i, t, *_ in docs:
        w, hit = words(t), set()
        for n in (4, 10):
            for k in range(len(w) - n + 1):
                hit |= set(range(k, k + n)) if tuple(w[k : k + n]) in windows else set()
        items = ["5"] if hit else []
        assert (by[i]["n_words"], by[i]["n_hit"], by[i]["n_items"], by[i]["items_sha256"], by[i]["contaminated"]) == (len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)), i
    assert by[1007]["n_hit"] == 25
    out, by = rows(spark, "op10_token_counts", path)
    assert len(out) == len(docs) and by[1000]["n_tokens"] == 0 and by[1005]["n_tokens"] == by[3]["n_tokens"] > 0


def test_op11_to_op13(spark, folder):
    """The queries carry their contracts' columns over all rows; the operators are held against brute force in tests of their own."""
    path, docs, _ = folder
    out, _ = rows(spark, "op12_mixing", path)
    count = lambda t: len((t or "").encode().split())
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((i, count(t)) for i, t, *_ in docs) and all(r["taken"] <= 3 * r["size"] for r in out)
    total, own, taken = sum(r["size"] for r in out), Counter(), Counter()
    source = {i: s for i, _, _, s in docs}
    for r in out:
        own[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(r["source_size"] == own[source[r["doc_id"]]] and abs(taken[source[r["doc_id"]]] - r["target"]) <= 0.5 for r in out) and abs(sum(taken.values()) - total) <= len(own)
    out, by = rows(spark, "op13_resampling", path)
    words = {i: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t, *_ in docs}
    assert {i: r["n_features"] for i, r in by.items()} == words
    many = sum(n >= 20 for n in words.values())
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, many // 10 + 1)) and all(words[r["doc_id"]] >= 20 for r in out if r["rank"])
    out = [r.asDict() for r in queries.QUERIES["op11_divergence"](spark, path).collect()]
    sources = {((lang or ""), (s or "")) for _, _, lang, s in docs}
    pairs = {(r["lang"], r["source"], r["item"]) for r in out if r["part"] == "pair"}
    assert pairs == {(a, s, t) for a, s in sources for b, t in sources if a == b and s != t} and list(out[0]) == ["lang", "source", "part", "item", "value", "rank"]
