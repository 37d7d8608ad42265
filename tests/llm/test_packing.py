import numpy as np
import pytest
from factloom.llm.packing import encoder, pack

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, queue int, ids string"


def rows():
    out = [(i, "word%d and more " % i * (i % 7), f"s{i % 3}") for i in range(60)]
    out += [(100, None, None), (101, "", "s0"), (102, "x" * 50_000, "s1"), (103, "tail", None), (1, out[1][1], "s2"), (None, "null id", "s2")]
    return [(*r, 1, "clash") for r in out]


def check(pieces, n_seq=1024):
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
    sizes = {s: sum(p["length"] for p in own) for s, own in by_seq.items()}
    assert sorted(sizes) == list(range(len(sizes)))
    total = sum(sizes.values())
    assert all(sizes[s] == n_seq for s in range(total // n_seq))
    assert all(sizes[s] & (sizes[s] - 1) == 0 for s in sizes)  # no padding at all


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def test_every_token_is_in_one_piece(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    pieces = [p.asDict() for p in pack(df, PATH, window_sequences=2, targets={"s1": 0.2}).collect()]
    check(pieces)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
    by_doc, got = {}, []
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["queue"]), []).append(p)
    for (d, q), own in by_doc.items():  # ids are unique within a source here
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
        got.append((str(d), q, b"".join(p["ids"] for p in own), own[0]["doc_tokens"]))
    want = [(str(i), s or "", np.array(ids_of(t), "<u4").tobytes(), len(ids_of(t))) for i, t, s, *_ in rows()]
    assert sorted(got) == sorted(want)


def walk(queues, shares, window):
    """Deficit round-robin, round by round: [(window, queue, document)]. Queues without a share have the rest by their tokens, or come last."""
    left, out, k = {q: list(enumerate(n)) for q, n in sorted(queues.items())}, [], 0
    rest = 1 - sum(shares.values())
    others = {q: sum(n) for q, n in queues.items() if not shares.get(q)}
    deficit = dict.fromkeys(left, 0.0)
    aimed = {q for q in left if shares.get(q)}
    while any(left.values()):
        late = rest < 1e-9 and not any(left[q] for q in aimed)
        weight = {q: shares[q] for q in aimed if left[q]} | ({q: (1 if late else rest) * n / sum(others.values()) for q, n in others.items()} if (late or rest > 1e-9) and any(left[q] for q in others) else {})
        for q in sorted(weight):
            deficit[q] += window * weight[q] / sum(weight.values())
            while left[q] and left[q][0][1] <= deficit[q] + 1e-6:
                i, n = left[q].pop(0)
                deficit[q] -= n
                out.append((k, q, i))
        k += 1
    return out


@pytest.mark.parametrize("shares", [{}, {"a": 0.5}, {"a": 0.7, "b": 0.3}, {"c": 0.1, "gone": 0.2, "b": 0.0}, {f"q{i}": 0.001 for i in range(300)}])
def test_windows_match_a_plain_walk(spark, shares):
    """One partition, so that the queues' order is that of the rows; more than 256 sources, all real queues."""
    rng = np.random.default_rng(len(shares))
    names = [*"abc", *(f"q{i}" for i in range(300))]
    docs = [(i, "x " * int(rng.choice([0, 3, 30, 400])), names[int(rng.choice(3, p=[0.5, 0.3, 0.2])) if i % 3 else 3 + i % 300]) for i in range(1500)]
    pieces = [p.asDict() for p in pack(spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1), PATH, targets=shares, sequence_tokens=64, window_sequences=8).collect()]
    check(pieces, 64)
    queues, numbers = {}, {}
    for i, t, s in docs:
        numbers.setdefault(s, []).append(i)
        queues.setdefault(s, []).append(next(p["doc_tokens"] for p in pieces if p["doc_id"] == i))
    want = [(k, q, numbers[q][i]) for k, q, i in walk(queues, shares, 512)]
    order = sorted((p for p in pieces if p["start"] == 0), key=lambda p: (p["sequence_id"], p["offset"]))
    assert [(p["window_id"], p["queue"], p["doc_id"]) for p in order] == want
    assert sum(p["length"] != p["doc_tokens"] for p in pieces) <= 2.2 * max(p["sequence_id"] for p in pieces)  # only sequence ends cut


def test_windows_hold_the_targets(spark):
    df = spark.createDataFrame([(i, "one two three four five six seven " * (1 + i % 5), "ab"[i % 2]) for i in range(3000)], "doc_id long, text string, source string")
    pieces = [p.asDict() for p in pack(df, PATH, targets={"a": 0.75, "b": 0.25}, sequence_tokens=64, window_sequences=4).collect()]
    check(pieces, 64)
    last, longest = min(max(p["window_id"] for p in pieces if p["queue"] == q) for q in "ab"), max(p["doc_tokens"] for p in pieces)
    for w in range(last):  # the deficit of a source stays below one document
        assert 0 <= 0.75 * 256 * (w + 1) - sum(p["length"] for p in pieces if p["window_id"] <= w and p["queue"] == "a") <= longest
    with pytest.raises(ValueError):
        pack(df, PATH, targets={"a": 3.0})


def test_edges(spark):
    df = spark.createDataFrame([(1, "t", "s")], "doc_id long, text string, source string")
    assert pack(df.limit(0), PATH).collect() == [] and sum(p["length"] for p in pack(df.union(df), PATH, targets={"none": 1.0}).collect()) == 4


def test_encoder_matches_tokenizers():
    fast = encoder(PATH)
    for t in ["", " ", "  a\n\n b", "a <|endoftext|> x", "<|endoftext", "日本語 🤗 é́", "don't WE'LL 123,45", "a" * 3000, "\t  x\x00y", " " * 2000 + "z"]:
        assert [*fast(t), 0] == ids_of(t), repr(t[:20])
