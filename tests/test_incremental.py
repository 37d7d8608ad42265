"""The gap report kept from changes against a full run over what holds at the end."""

import random

import pytest
from factloom.operators import coverage as C
from factloom.operators.incremental import GapReport
from pyspark.sql import functions as F

SCHEMA = "id long, seq long, workflow string, business_function string, publication_status string, tier string, " + ", ".join(f"{f} string" for f in C.FIELDS)


def changes(seed, n):
    rng = random.Random(seed)
    row = lambda i, seq: (i, seq, rng.choice(["w1", "w2", "", None]), rng.choice(["f1", "", None]), rng.choice(["published", "published", "staging"]), rng.choice(["gold", "decision_grade", "supporting"]), *(rng.choice(["x", "", None]) for _ in C.FIELDS))
    return [row(rng.randint(0, 25), seq) for seq in range(n)]


def full(spark, rows):
    last = {}
    for r in rows:
        last[r[0]] = max(last.get(r[0], r), r, key=lambda x: x[1])
    df = spark.createDataFrame([r for r in last.values() if r[4] == "published" and (r[2] or "").strip()], SCHEMA).withColumn("business_function", F.coalesce("business_function", F.lit("")))
    return sorted(str(r) for r in C.gaps(df, F.lit(0.4)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_replays(spark, tmp_path, seed):
    rows = changes(seed, 90)
    batches = [rows[i : i + 30] for i in range(0, 90, 30)]
    random.Random(seed).shuffle(batches)
    report = GapReport(spark, str(tmp_path / "r"))
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        report.apply(df, number)
        if number == 1:
            report.apply(df, number)  # once more
    assert sorted(str(r) for r in report.report(F.lit(0.4)).collect()) == full(spark, rows)


def test_stop_between_counts_and_records(spark, tmp_path, monkeypatch):
    rows = changes(3, 60)
    report = GapReport(spark, str(tmp_path / "r"))
    report.apply(spark.createDataFrame(rows[:30], SCHEMA), 0)
    second = spark.createDataFrame(rows[30:], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(report.records, "merge", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            report.apply(second, 1)
    report.apply(second, 1)
    assert sorted(str(r) for r in report.report(F.lit(0.4)).collect()) == full(spark, rows)


def test_as_a_stream(spark, tmp_path):
    rows = changes(4, 60)
    for k in (0, 30):
        spark.createDataFrame(rows[k : k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    report = GapReport(spark, str(tmp_path / "r"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(report.on_batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(str(r) for r in report.report(F.lit(0.4)).collect()) == full(spark, rows)


def test_records_and_changes_meet_once(spark, tmp_path, monkeypatch):
    """A batch looks once for the records' files that it touches; a stop after the counts are merged, before the records' version is made, is made good."""
    rows, report, looked = changes(5, 60), GapReport(spark, str(tmp_path / "r")), []
    find = report.records.touched
    monkeypatch.setattr(report.records, "touched", lambda *a: looked.append(1) or find(*a))
    report.apply(spark.createDataFrame(rows[:30], SCHEMA), 0)
    assert len(looked) == 1
    second = spark.createDataFrame(rows[30:], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(report.records, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            report.apply(second, 1)
    assert (report.counts.head()["applied"], report.records.head()["applied"]) == ({"changes": 1}, {"changes": 0})
    report.apply(second, 1)
    assert sorted(str(r) for r in report.report(F.lit(0.4)).collect()) == full(spark, rows)
