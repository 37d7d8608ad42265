import random

import pytest
from factloom.llm import common, quality, secrets
from factloom.llm.packing import encoder
from pyspark.sql import functions as F

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    junk = lambda n: " ".join(rng.choice(vocabulary).upper() + rng.choice(["!!", "$$$", "%%%"]) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        docs.append((i, (junk if bad else prose)(rng.randint(30, 90)), "en", f"src{i % 3}"))
        if i % 2:
            labels.append((i, int(not bad), 0))
        elif bad:
            labels.append((i, 0, 0))
    near = docs[1][1].split()
    near[40 % len(near)] = "changed"
    docs += [(1000, docs[1][1], "en", "src0"), (1001, " ".join(near), "en", "src1")]
    items = [(0, prose(30)), (1, prose(12)), (2, "short one")]
    docs += [(1100, prose(20) + " " + items[0][1][:120].upper() + " " + prose(10), "en", "src1")]
    docs += [(1200, prose(40) + ' token = "' + "0123456789abcdef" * 2 + '" ' + prose(10), "en", "src2"), (1300, prose(50), None, None)]
    docs += [(1300, docs[-1][1], None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in docs], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, items


def shingles(t, k=5):
    w = t.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_run_matches_brute_force(spark, folder):
    path, docs, items = folder
    machine = quality.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    left = {i: (t, s) for i, t, _, s in docs if machine.score(*quality.Features()(t, len(t))) >= 0.5}
    assert {i for i in left if i < 240} == {i for i in range(240) if i % 6}  # junk goes, prose stays
    sets = {i: shingles(t) for i, (t, _) in left.items()}
    kept = {i: v for i, v in left.items() if not any(j < i and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)}
    assert 1 in kept and 1000 not in kept and 1001 not in kept
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [t.lower().replace(".", " ").split()] for i in range(max(1, len(w) - 9))}
    clean = {}
    for i, (t, s) in kept.items():
        w = t.lower().replace(".", " ").split()
        if not any(tuple(w[a : a + len(g)]) == g for g in grams for a in range(len(w))):
            clean[i] = (t, s)
    assert set(kept) - set(clean) == {1100}
    want = {}
    for i, (t, _) in clean.items():
        out, at = "", 0
        for _, a, b in secrets.find(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        want[i] = len(encoder(public_tokenizers.path("byte_bpe_50k.json"))(out + t[at:])) + 1
    got = {}
    for r in corpus_pipeline.run(spark, path).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(got) == set(want)
    for i, pieces in got.items():
        assert sum(n for _, n, _ in pieces) == want[i] == pieces[0][2]


def test_stages_return_documents(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_columns_of_any_name_come_through(spark, folder):
    path, _, _ = folder
    names = ["score", "predicted", "Spans", "blob", "rule_version", "n_words", "matches", "hit_spans", "hit_items", "row", "doc", "id"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        r = out.where("doc_id = 7").first()
        assert all(r[n] == f"{n} of 7" for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).where("doc_id = 7").count() >= 1


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c = ("a b c d e f g h i j", "q r s t u v w x y z", "one more text of ten words is this here now")
    for rows, want in (
        ([(2, a), (2, b), (1, b)], [(1, b)]),
        ([(None, a), (None, a), (None, b), (7, b), (None, None), (9, c)], [(None, a), (7, b), (None, None), (9, c)]),
    ):
        left = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3), "").collect()
        assert sorted(map(str, map(tuple, left))) == sorted(str((*r, "x")) for r in want)


def test_sweep(spark):
    path = common.shared_dir(spark)
    common.durable(spark.range(3).toDF("x"), path, "t")
    common.sweep(spark, [path])
    assert path not in common.folders
    with pytest.raises(Exception):
        spark.read.parquet(f"{path}/t")
