"""Steps that went wrong or grew too fast on larger tables."""

from factloom.operators import coverage as C
from factloom.operators import linking as L
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_positions_are_cut_once(spark):
    """Approximate cuts can differ between two evaluations, so the plan holds none of them; nulls come last."""
    rows = [("k", float(i % 997)) for i in range(5000)] + [("k", None)] * 7 + [("null", None)]
    placed = C.positions(spark.createDataFrame(rows, "k string, v double").repartition(7), "k", "v")
    assert "percentile_approx" not in placed._jdf.queryExecution().optimizedPlan().toString()
    values = sorted(v for k, v in rows if k == "k" and v is not None)
    got = {(r["k"], r["v"]): (r["c"], r["lo"], r["n"]) for r in placed.collect()}
    want = {("k", v): (values.count(v), values.index(v), 5007) for v in set(values)}
    assert got == want | {("k", None): (7, 5000, 5007), ("null", None): (1, 0, 1)}


def test_names_are_joined_without_a_broadcast(spark):
    names = ["Acme", "acme corp", "Ac", "Beta Holdings", "be", "", None, "Gamma & Co", "acme corporation"]
    registry = ["ACME Corp", "Beta", "Be", "Gamma", "Gamma Ltd", "Acme-Corp", "gammaco", None, ""]
    frames = [spark.createDataFrame([(n,) for n in x], "name string") for x in (names, registry)]
    out = L.prefix_matches(*frames)
    bare = lambda n: "".join(c for c in (n or "").lower() if c.isascii() and c.isalnum())
    meets = lambda a, r: a == r or (len(r) >= 4 and a.startswith(r)) or (len(a) >= 4 and r.startswith(a))
    want = {n: min(hits) for n in names if n and (hits := [r for r in registry if bare(r) and meets(bare(n), bare(r))])}
    assert {r["name"]: r["entry"] for r in out.collect()} == want
    assert "BroadcastExchange" not in plan(out) and out._jdf.queryExecution().analyzed().toString().count("strategy=merge") == 2


def test_pairs_are_found_by_junctions(spark):
    """As parts of values, within longer words too; each value is met by whole junctions, not by short substrings."""
    import random

    from factloom.operators import vocabulary as V

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    keywords = [(f"{word()} {word()}", f"v{i}", i) for i in range(200)]
    values = [(i, "".join(rng.choice(["a", "b", "c", "ab", "ca", " ", " ", "\n", "é", "  ", "-"]) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(300, None), (301, ""), (302, " a b ")]
    out = V.pairs_found(spark.createDataFrame(values, "id long, key string"), "id", spark.createDataFrame(keywords, "keyword string, value string, position int"))
    rows = out.collect()
    first = {k: i for k, _, i in reversed(keywords)}
    assert {(r["id"], r["keyword"]) for r in rows} == {(i, k) for i, t in values for k in first if t and k in t}
    assert len(rows) == len({(r["id"], r["keyword"]) for r in rows}) and all(r["position"] == first[r["keyword"]] and r["value"] == f"v{r['position']}" for r in rows)
    text = dict(values)
    for i in text:
        mine = [r for r in rows if r["id"] == i]
        assert sorted((r["place"], -len(r["keyword"])) for r in mine) == [(r["place"], -len(r["keyword"])) for r in sorted(mine, key=lambda r: (text[i].find(r["keyword"]), -len(r["keyword"])))]
    assert "key" not in out.columns and "instr" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_fields_of_a_small_file_are_found_in_many_tasks(spark, sf_dir):
    """The orders are one file and so one task of a scan; patterns over their stories are not."""
    from factloom.functions import fields as E
    from factloom.plans import fields as plans
    from factloom.sources.tables import notes, stories

    assert all(df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) for df in (notes(spark, sf_dir), stories(spark, sf_dir)))
    assert "_common_expr" not in plans.field_extraction(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    texts = ["Then Acme Corp implemented it", "The Acme Corp implemented it", "Deloitte advised a Northern Retail Group on it", "Acme Corp", "implemented by Acme Corp", "An Old Bank saved", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(E.organization(F.col("t"))).collect()]
    assert got == ["Then Acme Corp", None, "Northern Retail", None, None, None, None, None]


def test_large_sets_meet_by_many_words(spark):
    """Sets of many words that are alike by 85 % at the least are found, also where all that differs is rarest; a few rare words in common are not enough."""
    common = [f"c{i}" for i in range(2600)]
    docs = [common + [f"a{i}" for i in range(400)], common + [f"b{i}" for i in range(400)], common[:2550], common[:2210] + [f"r{i}" for i in range(30)], [f"d{i}" for i in range(2000)] + [f"r{i}" for i in range(30)]]
    docs += [[w] for d in docs for w in d if w[0] in "ab"]  # no word is alone
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    sets = L.token_sets(frame, "doc_id", "text")
    met = L.met_heads(L.token_heads(sets, 85), 85)
    pairs = {(a, r["b"]) for r in met.collect() for a in r["a"]}
    links = {(a, b) for a in range(5) for b in range(5) if a < b and 100 * len(set(docs[a]) & set(docs[b])) >= 85 * max(len(docs[a]), len(docs[b]))}
    assert links == {(0, 1), (0, 2), (1, 2), (2, 3)} and links <= pairs and (3, 4) not in pairs
    assert {(r["a"], r["b"]) for r in L.confirmed(met, sets, 85).collect() if r["b"] < 5} == links


def test_fields_are_searched_once_a_text(spark, tmp_path, monkeypatch):
    """Two orders with one text give two rows and one search; a pattern is only tried on texts with the words that it needs, with the same result as without."""
    from factloom.functions import fields as E
    from factloom.plans import fields as plans
    from factloom.sources.tables import stories

    orders = spark.createDataFrame([(k, 7) for k in (2, 2522, 5042, 3, 2523, 5)], "o_orderkey long, o_custkey long")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    searched, real = [], plans._with_fields
    monkeypatch.setattr(plans, "_with_fields", lambda texts: searched.append(texts.count()) or real(texts))
    rows = {r["id"]: tuple(r)[1:] for r in plans.field_extraction(spark, str(tmp_path)).collect()}
    assert set(rows) == {2, 2522, 5042, 3, 2523, 5} and searched == [stories(spark, str(tmp_path)).select("story").distinct().count()] == [3]
    assert rows[2] == rows[2522] == rows[5042] and rows[3] == rows[2523] != rows[2]
    flags = {r["flag"]: r["n"] for r in plans.field_flags(spark, str(tmp_path)).collect()}
    assert searched == [3, 3] and flags["missing_implementation_cost"] == sum(not r[list(plans._FIELDS).index("implementation_cost")] for r in rows.values())
    assert E.needed(E.TEAMS[1]) == [["involved", "engaged", "assigned", "dedicated"], ["team", "group", "people", "member", "staff"]] and E.needed(E.SAMPLE[0]) == [] and E.needed(E.PERCENT[3]) == [["%"]]


def test_guards_of_patterns_lose_no_match(spark):
    """Every pattern on texts made of what the patterns are made of: words, their beginnings, numbers, signs, in either case."""
    import random
    import re

    from factloom.functions import fields as E

    many = [(p, "(?i)") for x in (E.EMPLOYEES, E.DURATION, E.COST, E.BASELINE, E.OUTCOME, E.PERCENT, E.SAMPLE, E.PERIOD, E.TEAMS, list(E.EVIDENCE.values())) for p in x]
    many += [(p, "(?is)") for x in (E.PROBLEM, E.SUCCESS, E.FAILURE) for p in x] + [(E.ORGANIZATION[0], "")]
    rng = random.Random(5)
    signs = {r"\[A-Z\]\[A-Za-z\\s&\.,\]\{3,50\}\?": "Acme Big ", r"\.\{10,\d+\}": "something said at length", r"\[\\d,\]\+|\\d\[\\d,\]\*|\\d\+": "12", r"\\s[*+]": " ", r"\[[^]]*-[^]]*\]": "-", r"\[\\\$[^]]*\]\??": "$", r"\[,:\]\?": ":", r"\\\.": ".", r"\?": ""}

    def made(pattern):
        pattern = re.sub(r"\(\?:\\\.\\d\+\)\?", "", rng.choice(E._split(pattern)))
        while m := re.search(r"\((?:\?:)?([^()]*)\)(\??)", pattern):
            pattern = pattern[: m.start()] + rng.choice([*m[1].split("|"), *[""] * bool(m[2])]) + pattern[m.end() :]
        for sign, text in signs.items():
            pattern = re.sub(sign, text, pattern)
        return pattern

    case = lambda x: rng.choice([str, str, str, str.upper, str.title])(x)
    pieces = lambda: [rng.choice([lambda: made(rng.choice(many)[0]), lambda: made(rng.choice(many)[0])[: rng.randint(1, 12)], lambda: rng.choice(["1,200", "$3", "9 %", "\u0130", "\u212a", "\n"])])() for _ in range(rng.randint(1, 4))]
    texts = [made(p) for p, _ in many for _ in range(3)] + [rng.choice(["", " "]).join(map(case, pieces())) for _ in range(1500)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t")).cache()
    plain = lambda p, f: F.get(F.filter(F.array(F.regexp_extract("t", f + p, 0)), lambda x: x != ""), 0)
    guarded = frame.select(*(E.found(F.col("t"), p, 0, f, F.col("low")).alias(f"p{i}") for i, (p, f) in enumerate(many))).collect()
    want = frame.select(*(plain(p, f).alias(f"p{i}") for i, (p, f) in enumerate(many))).collect()
    assert [many[i] for i in range(len(many)) if [r[i] for r in guarded] != [r[i] for r in want]] == []
    assert [many[i] for i in range(len(many)) if not any(r[i] for r in want)] == []
    evidence = frame.select(*(E.matches(F.col("t"), p, F.col("low")).eqNullSafe(F.rlike("t", F.lit(f"(?i){p}"))) for p in E.EVIDENCE.values())).collect()
    assert all(all(r) for r in evidence)
    frame.unpersist()


def test_links_of_word_sets_against_a_loop(spark):
    """Only pairs of which enough comes after the first shared word are held against each other."""
    import random

    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(25)] for _ in range(6)]
    docs = [(i, " ".join(w if rng.random() > 0.06 else f"w{rng.randint(0, 80)}" for w in base[i % 6][: rng.randint(18, 25)])) for i in range(90)] + [(90, ""), (91, None), (92, "lone")]
    classes = L.token_classes(spark.createDataFrame(docs, "id long, t string"), "id", "t").cache()
    out = L.token_links(classes, 85)
    sets = {}
    for i, t in docs:
        sets.setdefault(frozenset((t or "").split()), i)
    reps = [(i, s) for s, i in sets.items() if s]
    want = {(a, b, len(x & y)) for a, x in reps for b, y in reps if a < b and 100 * len(x & y) >= 85 * max(len(x), len(y))}
    assert len(want) > 20 and {tuple(r) for r in out.collect()} == want
    assert "resta" in out._jdf.queryExecution().optimizedPlan().toString()


def test_classes_that_nearly_match_in_cells(spark):
    """As a loop over all pairs, with families in one cell and in many; a cell has its sets once, not once a pair, and texts aren't written as words."""
    import random

    rng = random.Random(17)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (1, 3, 6, 7, 20, 60, 120)]
    docs = [(i, " ".join(w if rng.random() > 0.03 else f"W{rng.randint(0, 400)}" for w in base[i % 7])) for i in range(280)] + [(300, ""), (301, None), (302, "lone"), (303, " \n"), (304, base[6][0])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    first, links = {}, {}
    for i, t in docs:
        first.setdefault(frozenset((t or "").lower().split()), i)
    reps = [(i, s) for s, i in first.items() if s]
    for a, x in reps:
        for b, y in reps:
            if a < b and 100 * len(x & y) >= 85 * max(len(x), len(y)):
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    want = {(i, c := first[frozenset((t or "").lower().split())], links.get(c, 0)) for i, t in docs}
    assert len(links) > 60 and max(links.values()) > 15
    old = {n: getattr(L, n) for n in ("CELL", "PAIRS", "SENT_IDS", "COUNTERS")}
    for new in ({}, {"CELL": 4, "PAIRS": 8, "SENT_IDS": 0, "COUNTERS": 64}):
        vars(L).update(old | new)
        try:
            out = L.near_classes(frame, "doc_id", "text", 85)
            assert sorted(tuple(r) for r in out.collect()) == sorted(want)
            assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()
        finally:
            vars(L).update(old)
    met = spark.createDataFrame([(b, list(range(b))) for b in range(1, 40)] + [(50, [45])], "b long, a array<long>")
    dealt, asked = L.in_cells(met)
    assert dealt.count() == 40 and asked.count() == 42 and sum(len(r["a"]) for r in dealt.collect()) == 781


def test_variants_of_a_profile_share_their_factors(spark, sf_dir):
    """Five profiles that differ in one field each ask eleven different questions, not thirty; words are cut once a record."""
    from factloom.operators import retrieval as S
    from factloom.plans import retrieval as plans

    profiles = [plans.PROFILE | c for c in plans.CHANGES]
    rows = plans._rec(spark, sf_dir).cache()
    out = S.scored_variants(rows, profiles)
    assert out._jdf.queryExecution().optimizedPlan().toString().count(r"split(lower(text") == 1
    assert {f"f{i}" for i in range(11)} == {c.split("#")[0] for c in out._jdf.queryExecution().analyzed().toString().replace("AS ", "\n").split() if c[:1] == "f" and c[1:].split("#")[0].isdigit()}
    single = [{r["id"]: r["t"] for r in rows.select("id", S.weighed(S.similarity(q), S.WEIGHTS).alias("t")).collect()} for q in profiles]
    assert all(r["totals"] == [one[r["id"]] for one in single] for r in out.collect())
    rows.unpersist()


def test_families_are_found_once_a_record(spark, sf_dir):
    """What the sets of families are used for reads them again, and not the texts; no list of metrics is made to find the first that meets a goal."""
    from factloom.plans import linking, retrieval

    for query in (linking.family_consistency, retrieval.component_scores):
        text = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "redesign" not in text and "collect_list" not in text


def test_answers_are_read_before_they_meet_the_families(spark, sf_dir):
    """Once an assessment and not once a family; so are the weights by what holds its work back."""
    from factloom.plans import decision as plans

    for query in (plans.decisions, plans.decisions_by_answers):
        above, below = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)
        assert "AS weights" in below and "AS weights" not in above
    assert "almost no" in below and "almost no" not in above


def test_claims_are_located_without_moving_texts(spark):
    """Claims with whole words meet sections by the rarest of these; texts are searched where they are read. Short claims and too many go by substrings."""
    import random

    rng = random.Random(8)
    line = lambda: "".join(rng.choice(["a", "b", "c", "\u00e9", " ", " ", "  "]) for _ in range(rng.choice([0, 4, 40])))
    docs = [(d, k, line()) for d in range(60) for k in range(4)]
    claims = [(i, t[2 : 2 + rng.choice([3, 9, 25])]) for i, (_, _, t) in enumerate(docs) if len(t) > 20] + [(900, " a b "), (901, "no such thing here"), (902, ""), (903, None), (904, "a  b"), (905, " ")]
    sections = spark.createDataFrame(docs, "doc_id int, number int, key string").withColumn("digest", F.sha2("key", 256))
    asked = spark.createDataFrame(claims, "item_id int, claim string")
    want = {}
    for i, c in claims:
        for d, k, t in docs:
            if c and c in t:
                want.setdefault((i, d), k)
    bound = L.SENT_CHARACTERS
    for most in (bound, 10):
        L.SENT_CHARACTERS = most
        try:
            assert {(r["item_id"], r["doc_id"]): r["number"] for r in L.located(sections, asked).collect()} == want
        finally:
            L.SENT_CHARACTERS = bound
    worded = plan(L.located(sections, spark.createDataFrame([(1, "of whole words"), (2, "a b c")], "item_id int, claim string")))
    assert "digest" not in worded and "sha2" not in worded and "instr" not in worded
