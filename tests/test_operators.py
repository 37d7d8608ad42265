"""Operators on small literal rows."""

from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.operators import coverage, linking, ranking, scoring, stateful
from factloom.sources import html
from factloom.sources.tables import tolerant


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_families_in_order_and_by_substring(spark):
    t = "A generative-AI copilot with human review cut both queues"
    assert one(spark, t, R.families(F.col("t"))) == ["robotic_process_automation", "generative_ai", "ai_assisted_work", "human_in_the_loop_ai", "further_investigation"]  # "pilot" is in "copilot"
    assert one(spark, None, R.families(F.col("t"))) == []


def test_last_status_wins(spark):
    assert one(spark, "It improved, then was cancelled", R.result_status(F.col("t"))) == "abandoned"
    assert one(spark, "nothing", R.result_status(F.col("t"))) == "unknown"
    assert one(spark, "It improved, then failed", R.first_status(F.col("t"))) == "failed"


def test_metric_patterns(spark):
    found = one(spark, "Costs reduced by 12.5% and saved 1,200 hours for 300 employees", R.text_metrics(F.col("t")))
    assert {(m["category"], m["value"]) for m in found} >= {("percentage_change", "12.5"), ("hours_saved", "1,200"), ("headcount", "300")}


def test_text_helpers(spark):
    assert one(spark, "  Invoice -- Processing! ", R.slug(F.col("t"))) == "invoice_processing"
    assert one(spark, "https://www.Example.com:80/a?b", R.host(F.col("t"))) == "example.com"
    assert one(spark, "$1,234.5 million", R.clean_number(F.col("t"))) == 1234.5
    assert one(spark, "none", R.clean_number(F.col("t"))) is None
    assert one(spark, "Acme & Co., Inc.", R.company_name(F.col("t"))) in ("Acme & Co.", "Acme")


def test_coverage_levels(spark):
    rows = [(0, 0.0), (3, 0.5), (5, 0.15), (12, 0.6), (30, 0.3), (10, 0.4), (1, 0.01)]
    got = [r["l"] for r in spark.createDataFrame(rows, "h int, r double").select(coverage.coverage_level(F.col("h"), F.col("r")).alias("l")).collect()]
    assert got == ["absent", "good", "developing", "good", "excellent", "good", "limited"]


def test_concentration_and_absent(spark):
    pairs = spark.createDataFrame([("g", "a", i) for i in range(4)] + [("g", "b", 9), ("h", "a", 10), ("h", "c", 11)], "g string, v string, o int")
    got = {r["g"]: r for r in coverage.concentration(pairs, "g", "v", "o").collect()}
    assert got["g"]["concentrated"] and got["g"]["share"] == 0.8 and got["g"]["top"] == "a"
    assert got["h"]["top"] == "a" and not got["h"]["concentrated"]
    assert {r["g"]: r["absent"] for r in coverage.top_absent(pairs, "g", "v").collect()} == {"g": "c", "h": "b"}


def test_outcome_ranges_leave_outliers(spark):
    v = spark.createDataFrame([("k", float(x)) for x in (1, 2, 3, 4, 5, 6, 100)] + [("s", 7.0)], "k string, v double")
    got = {r["k"]: (r["low"], r["median"], r["high"], r["sample_size"], r["method"]) for r in coverage.outcome_ranges(v, "k", "v").collect()}
    assert got == {"k": (1.0, 3.5, 6.0, 7, "median_iqr"), "s": (7.0, 7.0, 7.0, 1, "single_value")}


def test_token_links_match_brute_force(spark):
    import random

    rng = random.Random(3)
    docs = []
    for i in range(60):
        base = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))]
        docs.append((i, " ".join(base)))
        if rng.random() < 0.6:
            docs.append((100 + i, " ".join(base[:-1] + ["x"] if rng.random() < 0.5 else base)))
    classes = linking.token_classes(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    got = {(r["a"], r["b"]) for r in linking.token_links(classes, 85).collect()}
    sets = {}
    for i, t in sorted(docs):
        s = frozenset(t.split())
        if s and s not in sets.values():
            sets[i] = s
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * max(len(sets[a]), len(sets[b]))}
    assert got == want


def test_relations_are_counted(spark):
    claims = spark.createDataFrame([("A", "up"), ("a", "up"), ("a", "down"), ("a", "neutral"), ("", "up")], "subject string, direction string")
    assert {(r["relation"], r["n"]) for r in linking.relations(claims).collect()} == {("supports", 1), ("contradicts", 2)}


def test_merge_keeps_filled_values(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, ""), (2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in linking.merged_non_empty(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_reachable_depth(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "src int, dst int")
    got = linking.reachable(links, spark.createDataFrame([(0,)], "node int"), 3)
    assert {tuple(r) for r in got.collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_best_per_entity_fills_up(spark):
    df = spark.createDataFrame([(1, "X", 9), (2, "x", 8), (3, "", 7), (4, "", 6), (5, "y", 5)], "id long, org string, s int")
    assert [r["id"] for r in ranking.best_per_entity(df, "org", "s", "id", 3).collect()] == [1, 3, 4]
    assert {r["id"] for r in ranking.best_per_entity(df, "org", "s", "id", 9, 5).collect()} == {1, 2, 3, 4, 5}


def test_metric_status(spark):
    df = spark.createDataFrame([(10.0, 20.0, 20.0), (10.0, 20.0, 15.0), (10.0, 20.0, 11.0), (10.0, 4.0, 4.0), (10.0, 4.0, 7.0)], "b double, t double, c double")
    assert [r["s"] for r in df.select(scoring.metric_status(F.col("b"), F.col("t"), F.col("c")).alias("s")).collect()] == ["achieved", "on_track", "below_target", "achieved", "on_track"]


def test_phases(spark):
    m = spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 1, False), (1, 2, False)], "p int, f int, d boolean")
    assert [r["status"] for r in stateful.phases(m, "p", "f", F.col("d")).orderBy("f").collect()] == ["complete", "in_progress", "not_started"]


def test_html_parts(spark):
    page = "<html><title>T</title><script>x</script><h1>One</h1><p>a  b</p><ul><li>c</li></ul><h2>Two</h2><table><tr><th>h</th><td>v</td></tr></table><a href='/x#y'>go</a><a href='http://else.where/'>no</a></html>"
    df = spark.createDataFrame([(1, "http://host.example/p", page), (2, "http://host.example/q", None)], "page_id long, url string, html string")
    s = {r["page_id"]: [(x["heading"], x["text"]) for x in r["sections"]] for r in html.sections(df).collect()}
    assert s == {1: [("One", "a b\nc"), ("Two", "Table:\nh | v")], 2: []}
    assert {r["page_id"]: r["tables"] for r in html.tables(df).collect()} == {1: [["h | v"]], 2: []}
    assert [tuple(r) for r in html.links(df).collect()] == [(1, 0, "http://host.example/x")]


def test_html_blocks_without_end_tags():
    texts = lambda page: [(x["heading"], x["text"]) for x in html.parsed(page).sections]
    assert texts("<body><h1>One</h1><p>a<p>b <b>c</b><h2>Two</h2><ul><li>d<li>e<ul><li>f</ul></ul><div><p>g</div>loose<p>h") == [("One", "a\nb c"), ("Two", "d\nf\ne\ng\nloose\nh")]
    assert texts("<h1>One</h1><li><p>a</li><blockquote><p>b</blockquote>loose<pre>c") == [("One", "a\nb\nc")]
    # What follows in an open p's parent is kept, as a paragraph of its own.
    assert texts("<p>a<ul><li>b</ul>c</p>loose<p>d<div>e</div>f") == [("", "a\nb\nc\nd\ne\nf")]
    assert html.parsed("<table><tr><th>a<td>b<tr><td>c<table><tr><td>d</table></table>").tables[0] == [["a", "b"], []]
    assert html.parsed("<table><thead><tr><th>a<tbody><tr><td>b<td>c</table><p>d").tables == [[["a"], ["b", "c"]]]
    assert texts("<div><table><tr><td></div></p>x</table></div><p>y") == [("", "Table:\nx\ny")]
    assert texts("<h1>A</h1><p>b<table><tr><td>c<td>d<tr><th><th></table><p>e<table></table>") == [("A", "b\nTable:\nc | d\ne")]


def test_tolerant_scan(spark):
    df = spark.createDataFrame([(1, '["a"]')], "id int, tags string")
    assert tuple(tolerant(df, {"id": "bigint", "tags": "array<string>", "gone": "double"}).first()) == (1, ["a"], None)


def test_stream_alerts_fire_once(spark, tmp_path):
    from factloom.streaming.demand import alerts, claims, run_once

    src, out = tmp_path / "in", tmp_path / "out"
    rows = [("2024-01-01 0%d:00:00" % i, 40.0, i % 3) for i in range(6)]
    for k in (0, 3):
        spark.createDataFrame(rows[k : k + 3], "ts string, value double, user int").coalesce(1).write.mode("append").parquet(str(src))
    schema = "ts string, value double, user int"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp"))
    run_once(alerts(stream(), 100.0), str(out), str(tmp_path / "c1"))
    assert sorted(r["alert"] for r in spark.read.parquet(str(out)).collect()) == [0.75, 0.9, 1.0]
    run_once(claims(stream(), "user", "10 days"), str(tmp_path / "out2"), str(tmp_path / "c2"))
    assert sorted(r["user"] for r in spark.read.parquet(str(tmp_path / "out2")).collect()) == [0, 1, 2]
