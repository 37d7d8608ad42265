"""Cooldowns and leases by runs against a plain walk."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from factloom.operators import machines as M
from pyspark.sql import functions as F


def walk(rows, fails, span):
    out, states = {}, {}
    for key, at, tie, failed in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        states[key], out[tie] = M.step(states.get(key, (0, 0)), at, bool(failed), fails, span)
        out[tie] = (out[tie], states[key][1] if states[key][1] > at else None)
    return out


def events(seed, n, gap):
    rng = random.Random(seed)
    rows, at = [], {k: 1_700_000_000_000_000 for k in ("hot", "b", "c", None)}
    for i in range(n):
        k = "hot" if i % 3 else rng.choice(["b", "c", None])
        at[k] += rng.choice([0, 1, gap // 9, gap, 70_000_000])
        rows.append((k, at[k], i, rng.random() < 0.6 if rng.random() < 0.97 else None))
    return rows


@pytest.mark.parametrize("fails", [1, 2, 3])
def test_transfer_functions_compose(fails):
    for seed in range(30):
        rng = random.Random(seed)
        times = sorted(rng.randint(100, 400) for _ in range(40))
        failed = [rng.random() < 0.6 for _ in times]
        cut = sorted(rng.sample(range(1, 40), 4))
        parts = list(zip([0, *cut], [*cut, 40], strict=True))
        parts = [(a, b) for a, b in parts if a < b]
        for entry in [(c, 0) for c in range(fails)] + [(0, u) for u in (90, 130, 251, 399, 400, 500)]:
            want = entry
            for t, f in zip(times, failed, strict=True):
                want, _ = M.step(want, t, f, fails, 37)
            got = entry
            for a, b in parts:
                got = M.entered(times[a], M.transfer(times[a:b], failed[a:b], fails, 37), got)
            norm = lambda s: (s[0], s[1] if s[1] > times[-1] else 0)  # noqa: E731  a time that has passed is as good as none
            assert norm(got) == norm(want), (seed, entry)


@pytest.mark.parametrize("fails,run_rows", [(2, 20_000), (2, 5), (1, 3), (3, 11)])
def test_cooldowns_against_plain_walk(spark, monkeypatch, fails, run_rows):
    monkeypatch.setattr(M, "RUN_ROWS", run_rows)
    monkeypatch.setattr(M, "CELL", 1_000_000)
    rows = events(4, 400, 40_000_000)
    base = datetime.fromtimestamp(0, timezone.utc)
    df = spark.createDataFrame([(k, base + timedelta(microseconds=at), i, f) for k, at, i, f in rows], "k string, ts timestamp, id long, failed boolean").repartition(3)
    got = {r["id"]: (r["outcome"], r["u"]) for r in M.cooldowns(df, "k", "ts", "id", F.col("failed"), fails=fails, seconds=90).withColumn("u", F.unix_micros("until")).collect()}
    assert got == walk(rows, fails, 90_000_000)


def test_leases(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 5, 2), ("a", 10, 3), ("b", 3, 4), ("a", 25, 5)], "k string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"] for r in M.leases(df, "k", "ts", "id", seconds=10).collect()}
    assert got == {1, 3, 4, 5}
    assert M.leases(df.limit(0), "k", "ts", "id", seconds=10).count() == 0


def test_stream_agrees_with_plain_walk(spark, tmp_path):
    """Files out of order within the hour that is waited for, in several batches and two runs."""
    from factloom.streaming import breaker

    rows = [(k or "none", at, i, bool(f)) for k, at, i, f in events(9, 240, 40_000_000)]
    order = sorted(rows, key=lambda r: r[1] + random.Random(r[2]).randint(0, 1_200_000_000))
    schema = "k string, ts timestamp, id long, failed boolean"
    base = datetime.fromtimestamp(0, timezone.utc)
    put = lambda part, n: spark.createDataFrame([(k, base + timedelta(microseconds=at), i, f) for k, at, i, f in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    got = {}
    src = tmp_path / "src"
    src.mkdir()
    for n, part in enumerate((order[:130], order[130:])):
        for j in range(0, len(part), 50):
            put(part[j : j + 50], f"{n}_{j}")
            for f in (tmp_path / f"in{n}_{j}").glob("*.parquet"):
                f.rename(src / f"{n}_{j:03}.parquet")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        breaker.run_once(breaker.cooldowns(stream, "k", "ts", "id", F.col("failed"), fails=2, seconds=90, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out")).withColumn("u", F.unix_micros("until")).collect()
    got = {r["id"]: (r["outcome"], r["u"]) for r in out}
    want = walk(rows, 2, 90_000_000)
    passed = max(at for _, at, _, _ in rows) - 3_600_000_000 - 2_000_000
    assert len(out) == len(got) and got == {i: want[i] for i in got}
    assert {i for _, at, i, _ in rows if at < passed} <= set(got)


def test_runs_come_to_python_one_at_a_time(spark, monkeypatch):
    """However many runs a batch holds, the lists of only one of them are made at once."""
    import pyarrow as pa
    from factloom.operators import machines as M
    from pyspark.sql import functions as F

    given = {}
    real = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema, *a: (given.setdefault(f.__name__, f), real(df, f, schema, *a))[1])
    events = spark.createDataFrame([("a", 1_000_000 * i, i) for i in range(5)], "key string, at long, id long").withColumn("ts", F.timestamp_micros("at"))
    M.cooldowns(events, "key", "ts", "id", F.lit(True), fails=1, seconds=2)
    one = [{"at": t * 1_000_000, "tie": t, "failed": True} for t in range(4)]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("tie", pa.int64()), ("failed", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 50), pa.array(list(range(50)), pa.int64()), pa.array([one] * 50, kind)], names=["key", "run", "events"])
    made = list(given["functions"](iter([batch])))
    assert [b.num_rows for b in made] == [1] * 50 and [b.column("run")[0].as_py() for b in made] == list(range(50))
    assert [tuple(r.values()) for r in made[0].column("rows")[0].as_py()] == M.transfer([e["at"] for e in one], [True] * 4, 1, 2_000_000)
