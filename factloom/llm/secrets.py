"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every file is addressed by the SHA-256 of its bytes. The
ledger holds a row for each blob and rule version that has been scanned, with
its findings. A scan reads only blobs that the ledger lacks for the current
rule version, adds them, and joins the findings back to every path and version
that has the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, durable, shared_dir, text_of

# The kinds in the order in which ties are listed, their patterns,
# what a quick look for one of these strings must find before the pattern runs,
# the group that is measured and its least length.
RULES: list[tuple[str, str, tuple[str, ...], int, int]] = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("=", ":"), 2, 6),
    ("access", r"AKIA[A-Z0-9]+", ("AKIA",), 0, 20),
    ("hex", r"[0-9a-f]{24,}", (), 0, 24),
    ("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", ("PRIVATE KEY",), 0, 1),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", ("gh",), 0, 40),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", ("xox",), 0, 15),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",), 0, 29),
    ("google_api", r"\bAIza[A-Za-z0-9_-]{35}", ("AIza",), 0, 39),
]
BASE_KINDS = ("assign", "access", "hex")
KINDS = [r[0] for r in RULES]
#: New blobs whose digests, or findings (blobs and spans) that are sent to all tasks (below 100 bytes each); more are joined.
SENT_DIGESTS = 100_000
SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"


def rule_version(rules: list = RULES) -> str:
    """An id that changes with any rule."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules: list = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each match that is long enough, in code points, by start and then kind as listed."""
    spans = []
    for rank, (kind, pattern, hints, group, least) in enumerate(rules):
        if not hints or any(h in text for h in hints):
            spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


def scan_blobs(blobs: DataFrame, rules: list = RULES) -> DataFrame:
    """(blob, rule_version, spans) of a table of (blob, text)."""
    version = rule_version(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in by_bytes(batches, "text"):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, rules)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([version] * len(spans)), pa.array(spans, kind)], names=["blob", "rule_version", "spans"])

    return blobs.select("blob", "text").mapInArrow(scan, f"blob string, rule_version string, spans {SPAN_TYPE}")


def ledger(spark, path: str, version: str | None = None) -> DataFrame:
    """(blob, rule_version, spans) of the ledger at path, of one rule version or all; empty if there is none yet.

    The table is partitioned by rule version, so that a scan reads only its own.
    Two scans at a time may each have added a blob.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"blob string, rule_version string, spans {SPAN_TYPE}")
    found = spark.read.schema(f"blob string, spans {SPAN_TYPE}, rule_version string").parquet(path).select("blob", "rule_version", "spans")
    return found if version is None else found.where(F.col("rule_version") == version)


def scan(versions: DataFrame, ledger_path: str, *, text_col: str = "text", rules: list = RULES) -> DataFrame:
    """Scan every historical version in `versions`, and add `spans` (and `blob`) to each of its rows.

    Appends to the ledger at `ledger_path` what it lacked: one row for each
    unseen (blob, rule version) pair, so that a second scan of the same
    versions reads no text twice. Copies of a text are scanned once, whatever
    their number, and a change of any rule scans all blobs anew.

    Null text is an empty blob without findings. Repeated rows each get the
    findings. An empty table adds nothing. Columns of `versions` that are named
    blob, rule_version or spans are replaced.
    """
    spark = versions.sparkSession
    folder, text = shared_dir(spark), text_of(text_col)
    keyed = versions.drop("blob", "rule_version", "spans").withColumn("blob", F.sha2(text.cast("binary"), 256))
    seen = ledger(spark, ledger_path, rule_version(rules)).select("blob")
    fresh = durable(keyed.select("blob").distinct().join(seen, "blob", "left_anti"), folder, "fresh")
    texts = keyed.select("blob", text.alias("text"))
    if fresh.count() <= SENT_DIGESTS:  # only the texts of new blobs are moved
        unseen = texts.join(F.broadcast(fresh), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    else:  # copies are merged within each task before they are moved, so that a hot blob isn't
        unseen = texts.groupBy("blob").agg(F.first("text").alias("text")).join(fresh, "blob", "left_semi")
    scan_blobs(unseen, rules).write.mode("append").partitionBy("rule_version").parquet(ledger_path)
    # Blobs with findings are few, and each is in the ledger once, so a blob with very many copies can be split in the join.
    found = ledger(spark, ledger_path, rule_version(rules)).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    if (found.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= SENT_DIGESTS:
        found = F.broadcast(found)
    return keyed.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.lit([]).cast(SPAN_TYPE)))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans (sorted by start; overlapping ones as one) replaced by mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(span["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit((1 << 31) - 1))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
