"""Versioned tables: merges by rule, files left alone, stops between the steps, two writers, replays."""

import random

import pytest
from factloom.sources import versions as V
from pyspark.sql import functions as F

SCHEMA = "id long, name string, n long, at int"


def made(spark, path, rows, file_rows=None, monkeypatch=None):
    if file_rows:
        monkeypatch.setattr(V, "FILE_ROWS", file_rows)
    t = V.VersionedTable(spark, str(path), "id")
    t.create(spark.createDataFrame([], SCHEMA).schema)
    if rows:
        t.merge(spark.createDataFrame(rows, SCHEMA))
    return t


def content(t, version=None):
    return sorted(tuple(r) for r in t.read(version).collect())


def test_rules(spark, tmp_path):
    rows = [(1, "a", 5, 1), (2, "b", None, 1), (3, "", 7, 9)]
    new = spark.createDataFrame([(1, "", None, 0), (2, "B", 4, 2), (3, "c", 1, 3), (4, None, 2, 1), (4, "d", 2, 0)], SCHEMA)
    want = {
        "update": [(1, "a", 5, 0), (2, "B", 4, 2), (3, "c", 1, 3), (4, "d", 2, 0)],
        "replace": [(1, "", None, 0), (2, "B", 4, 2), (3, "c", 1, 3), (4, "d", 2, 0)],
        "keep": [*rows, (4, "d", 2, 0)],
    }
    for rule, out in want.items():
        t = made(spark, tmp_path / rule, rows)
        assert t.merge(new, rule) == 2 and content(t) == out and content(t, 1) == rows
    t = made(spark, tmp_path / "newer", rows)
    t.merge(new, "replace", newer="at", gate=F.col("n") > 3)
    assert content(t) == [(1, "a", 5, 1), (2, "B", 4, 2), (3, "", 7, 9)]
    sums = V.VersionedTable(spark, str(tmp_path / "add"), "id")
    sums.create(spark.createDataFrame([], "id long, n long").schema)
    for _ in range(2):
        sums.merge(spark.createDataFrame([(1, 2), (1, 3), (2, -1)], "id long, n long"), "add")
    assert content(sums) == [(1, 10), (2, -2)]
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(None, "x", 1, 1)], SCHEMA))


def test_only_touched_files_are_written_anew(spark, tmp_path, monkeypatch):
    t = made(spark, tmp_path / "t", [(i * 2, f"r{i}", i, 0) for i in range(400)], 50, monkeypatch)
    before = {r["file"]: r for r in t.manifest(t.head()).collect()}
    assert len(before) > 4 and sum(r["rows"] for r in before.values()) == 400
    t.merge(spark.createDataFrame([(10, "ten", 1, 1), (14, "fourteen", 1, 1)], SCHEMA))
    after = {r["file"] for r in t.manifest(t.head()).collect()}
    gone = set(before) - after
    assert len(gone) == 1 and before[next(iter(gone))]["low"] <= 10 <= before[next(iter(gone))]["high"]
    assert len(content(t)) == 400 and (10, "ten", 1, 1) in content(t)
    # Keys within a range but not in the file: the filter leaves most files alone.
    odd = spark.createDataFrame([(k,) for k in range(101, 700, 60)], "key long")
    assert len(t.touched(t.head(), odd)) <= 4
    every = spark.createDataFrame([(i * 2,) for i in range(400)], "key long")
    assert set(t.touched(t.head(), every)) == after  # no file that has a key is passed over
    assert sorted(r["id"] for r in t.matching(spark.createDataFrame([(10,), (11,), (798,)], "key long")).collect()) == [10, 798]


def test_against_a_plain_dictionary(spark, tmp_path, monkeypatch):
    rng, t, have = random.Random(2), made(spark, tmp_path / "t", [], 40, monkeypatch), {}
    for step in range(5):
        rows = [(rng.randint(0, 150), rng.choice(["", None, f"v{step}"]), rng.choice([None, step]), step) for _ in range(60)]
        one = {}
        for r in rows:
            one[r[0]] = max(one.get(r[0], r), r, key=lambda x: tuple((v is not None, v) for v in x[1:]))
        for k, r in one.items():
            old = have.get(k)
            have[k] = r if old is None else (k, r[1] or old[1], old[2] if r[2] is None else r[2], r[3])
        t.merge(spark.createDataFrame(rows, SCHEMA))
    norm = lambda r: tuple(str(x) for x in r)
    assert sorted(map(norm, content(t))) == sorted(map(norm, have.values()))


@pytest.mark.parametrize("stop", ["_described", "_manifest", "_publish"])
def test_a_stop_between_the_steps_changes_nothing(spark, tmp_path, monkeypatch, stop):
    t = made(spark, tmp_path / "t", [(1, "a", 1, 1)])
    new = spark.createDataFrame([(1, "b", 2, 2), (2, "c", 2, 2)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(V.VersionedTable, stop, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.merge(new, batch=("w", 1))
    assert content(t) == [(1, "a", 1, 1)] and t.versions() == [0, 1]
    t.merge(new, batch=("w", 1))
    assert content(t) == [(1, "b", 2, 2), (2, "c", 2, 2)]
    t.vacuum(keep=1)
    assert content(t) == [(1, "b", 2, 2), (2, "c", 2, 2)] and t.versions() == [2]


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second finds its version taken after it has done its work, and does it again on the first one's."""
    a, b = made(spark, tmp_path / "t", [(1, "a", 1, 1)]), V.VersionedTable(spark, str(tmp_path / "t"), "id")
    publish, raced = V.VersionedTable._publish, []

    def meanwhile(self, number, what):
        if self is a and not raced:
            raced.append(b.merge(spark.createDataFrame([(1, "", 9, 1), (3, "b", 3, 3)], SCHEMA)))
        publish(self, number, what)

    monkeypatch.setattr(V.VersionedTable, "_publish", meanwhile)
    assert a.merge(spark.createDataFrame([(1, "z", None, 2), (2, "y", 2, 2)], SCHEMA)) == 3 and raced == [2]
    assert content(b) == [(1, "z", 9, 2), (2, "y", 2, 2), (3, "b", 3, 3)]
    monkeypatch.setattr(V.VersionedTable, "_publish", publish)
    with pytest.raises(V.Conflict):
        a._publish(3, {})


def test_replays_do_nothing(spark, tmp_path):
    t = made(spark, tmp_path / "t", [(1, "a", 1, 1)])
    rows = spark.createDataFrame([(1, "b", 2, 2)], SCHEMA)
    assert t.merge(rows, batch=("s", 4)) == 2 == t.merge(spark.createDataFrame([(1, "no", 2, 2)], SCHEMA), batch=("s", 4)) and content(t) == [(1, "b", 2, 2)]
    assert t.merge(rows, batch=("other", 0)) == 3


def test_filters_are_asked_for_few_keys_only(spark, tmp_path, monkeypatch):
    """Many keys in a file's range always hit its filter, so it is taken as it is; filters hold the places of all keys of their file."""
    t = made(spark, tmp_path / "t", [(i * 2, "r", i, 0) for i in range(3000)], 1500, monkeypatch)
    files = t.manifest(t.head()).collect()
    for f in files:
        keys = spark.read.parquet(f"{t.path}/data/{f['file']}").select(F.pmod(F.xxhash64("id"), F.lit(f["bits"])).alias("at"))
        bits = {n * V.BITMAP + i * 8 + b for n, m in f["filter"].items() for i, x in enumerate(m) for b in range(8) if x >> b & 1}
        assert bits == {r["at"] for r in keys.collect()} and f["rows"] == keys.count()
    manifest = t.manifest
    monkeypatch.setattr(t, "manifest", lambda head: manifest(head).withColumn("filter", F.expr("CAST(map() AS MAP<BIGINT, BINARY>)")))  # nothing hits
    odd = lambda n: spark.createDataFrame([(i * 2 + 1,) for i in range(n)], "key long")
    assert t.touched(t.head(), odd(2 * 256)) == [min(files, key=lambda f: f["low"])["file"]] and t.touched(t.head(), odd(256)) == []
