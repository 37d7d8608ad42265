from pyspark.sql import functions as F

from factloom.sources import sinks


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "x,y")], "id int, tags array<string>, note string")
    sinks.export_all({"t": df}, str(tmp_path), ["jsonl", "csv", "parquet"])
    assert spark.read.json(f"{tmp_path}/t_jsonl").count() == 2
    back = spark.read.option("header", True).csv(f"{tmp_path}/t_csv")
    assert back.columns == ["id", "note", "tags"] and back.orderBy("id").collect()[1]["note"] == "x,y"
    sinks.report(df, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2


def test_admitted(spark):
    new = spark.createDataFrame([(1, "A", "w", "gold"), (2, "a", "W", "gold"), (3, "", "w", "gold"), (4, "B", "w", "bronze"), (5, "C", "w", "gold"), (6, "D", "w", None)], "id int, org string, title string, tier string")
    have = spark.createDataFrame([("c", "W")], "org string, title string")
    added, refused = sinks.admitted(new, have, ["org", "title"], F.col("tier") == "gold")
    assert [r["id"] for r in added.collect()] == [1]
    assert {(r["id"], r["reason"]) for r in refused.collect()} == {(3, "missing org"), (4, "below the gate"), (5, "duplicate"), (6, "below the gate")}
    assert added.columns == new.columns


def test_files_and_seeds(spark, tmp_path):
    from factloom.sources import seeds

    (tmp_path / "a.html").write_text("<html><script>no()</script><p>One <b>two</b></p>\n three</html>")
    (tmp_path / "b.txt").write_text("plain\n<text>")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in seeds.text_files(spark, str(tmp_path / "*.*")).collect()}
    assert got == {"a.html": "One two three", "b.txt": "plain\n<text>"}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text('{"id": "1", "title": "b"}\n{"id": "1", "title": "a", "more": 3}\n{"title": "no id"}\n')
    rows = seeds.seeds(spark, str(tmp_path / "s"), {"id": "string", "title": "string", "gone": "int"}, "id").collect()
    assert [tuple(r) for r in rows] == [("1", "a", None)]


def test_seed_files_of_any_layout(spark, tmp_path):
    import pytest
    from factloom.sources import seeds

    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "lines.json").write_text('{"id": "1", "n": 3}\n\n{"id": "2", "n": "x"}\nnot json\n')
    (folder / "list.json").write_text('[\n  {"id": "3", "n": 1},\n  {"id": "4",\n   "tags": ["a", "b"]},\n  7\n]\n')
    (folder / "one.json").write_text('{\n "id": "5"\n}')
    (folder / "inside.json").write_text('{"records": [\n {"id": "6"}, {"id": "7", "n": null}]}')
    (folder / "cut.json").write_text('[{"id": "8"},\n {"id": ')
    (folder / "empty.json").write_text("")
    wanted = {"id": "string", "n": "int", "tags": "array<string>"}
    good, bad = seeds.seed_files(spark, str(folder), wanted)
    assert {(r["id"], r["n"], tuple(r["tags"] or ())) for r in good.collect()} == {("1", 3, ()), ("2", None, ()), ("3", 1, ()), ("4", None, ("a", "b")), ("5", None, ()), ("6", None, ()), ("7", None, ())}
    assert sorted(r["path"].rsplit("/", 1)[1] for r in bad.collect()) == ["cut.json", "lines.json", "list.json"]
    with pytest.warns(UserWarning, match="3 lines or files"):
        assert seeds.seeds(spark, str(folder), wanted, "id").count() == 7
    with pytest.raises(ValueError):
        seeds.seeds(spark, str(folder), wanted, "id", broken="fail")
