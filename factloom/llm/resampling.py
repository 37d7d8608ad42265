"""Importance resampling towards a target distribution, over hashed features.

The features of a text (runs of words) are hashed into buckets. A pass over the
documents writes their buckets as packed 16-bit streams, a row for each few MB
of text, with the places where documents begin. What follows reads those
streams and never the texts: each is sorted and run-length encoded for the
counts of the corpus; with those and the target's, a bucket has a gain (the
log ratio of its shares); a document's weight is the sum of its gains, gathered
over its part of a stream. Gumbel noise makes the highest scores a draw without
replacement, with chances in proportion to the weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import by_bytes, durable, shared_dir, texts_as_bytes, word_lists

#: Buckets must fit into 16 bits.
MOST_BUCKETS = 1 << 16
#: Words whose buckets a task remembers; features that are gathered at a time.
CACHE_WORDS, STEP = 150_000, 1 << 20
#: Lower-cases A-Z and makes each byte that isn't part of a word a blank: words are digits, a-z and all bytes from 0x80.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets:
    """The buckets of a text's features, as 16-bit numbers; keeps those of words it has seen."""

    def __init__(self, words: int, buckets: int):
        self.words, self.buckets, self.cache = words, buckets, {}

    def _single(self, word: bytes) -> int:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = self.cache[word] = zlib.crc32(word) % self.buckets
        return found

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, int]:
        """(buckets, number of words). The order of the features in the stream doesn't matter."""
        parts, n, before = [], 0, []
        for own in word_lists(text, WORD_BYTES):
            parts.append(np.fromiter(map(self._single, own), "<u2", len(own)))
            if self.words > 1:
                line = before + own
                for k in range(2, self.words + 1):  # runs that end in this list
                    runs = [zlib.crc32(b" ".join(line[i - k + 1 : i + 1])) % self.buckets for i in range(max(k - 1, len(before)), len(line))]
                    parts.append(np.array(runs, "<u2"))
                before = line[-(self.words - 1) :]
            n += len(own)
        return (np.concatenate(parts) if parts else np.empty(0, "<u2")), n


def write_streams(docs: DataFrame, folder: str, name: str, *, id_col: str | None, text_col: str, words: int, buckets: int) -> DataFrame:
    """A table of (ids, n_words, offsets, stream): a row for each few MB of text, with the stream's places at which documents begin."""
    id_ = F.col(id_col) if id_col else F.lit(None).cast("long")
    rows = docs.select(id_.alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Buckets(words, buckets)
        for batch in by_bytes(batches, "text"):
            found = [make(t) for t in texts_as_bytes(batch, "text")]
            offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int64)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id"))
            columns = [ids, pa.array([[f[1] for f in found]], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([np.concatenate([f[0] for f in found]).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "n_words", "offsets", "stream"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("stream", T.BinaryType())])
    return durable(rows.mapInArrow(pack, schema), folder, name)


def run_lengths(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ordered array, and how often each stands in it."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def bucket_counts(streams: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: streams sorted and run-length encoded, summed in tasks, then in Spark; a number a bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column("stream"):
                values, lengths = run_lengths(np.sort(np.frombuffer(stream.as_buffer(), "<u2")))
                total[values] += lengths
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's share in the target over that in the corpus, each smoothed by one, rounded down."""
    many, total, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (total + many) / ((s + 1) * (wanted + many)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def sums_by_document(stream: np.ndarray, offsets: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The sum of gains over each document's part of a stream; a document without features has 0."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a in range(0, len(stream), STEP):
        part = gains[stream[a : a + STEP]]
        docs = np.arange(np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets[:-1], a + len(part), "left"))
        first, last = np.maximum(offsets[docs], a) - a, np.minimum(offsets[docs + 1], a + len(part)) - a
        some = last > first
        out[docs[some]] += np.add.reduceat(part, first[some])
    return out


def weights(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of each document of the streams."""
    kind = streams.schema["ids"].dataType.elementType
    shared = streams.sparkSession.sparkContext.broadcast(gains)  # eight bytes a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                offsets = np.array(batch.column("offsets")[k].as_py(), np.int64)
                sums = sums_by_document(np.frombuffer(batch.column("stream")[k].as_buffer(), "<u2"), offsets, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("n_words")[k].values, pa.array(np.diff(offsets)), pa.array(sums)], names=["id", "n_words", "n_features", "weight"])

    return streams.mapInArrow(weigh, T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))]))


def ranked(rows: DataFrame, folder: str, *order) -> DataFrame:
    """rows with their rank (from 1) in this order, which must be one of all rows.

    The rows are sorted by ranges and written with their numbers in them; a
    count for each range (as many as Spark has shuffle partitions) then says
    where a range begins. No task has more than its range.
    """
    spark, at = rows.sparkSession, F.monotonically_increasing_id()  # the range above, the number in it in the last 33 bits
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    put = durable(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", at), folder, "ordered")
    sizes = sorted((r["part"], r["n"]) for r in put.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    bases, total = [], 0
    for part, n in sizes:
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "__part long, __base long")
    joined = put.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(base), "__part")
    return joined.withColumn("rank", F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__base")


def resample(docs: DataFrame, target: DataFrame, *, words: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Weigh each document by how much likelier the target makes its features, and draw `percent` of those of `least_words` words or more.

    Features are all runs of 1 to `words` words, repeats counted. Returns the id
    column, n_features, weight, score and rank, all long; a document that isn't
    drawn has no rank. The noise of a score depends on seed and id alone, so
    reruns agree. Equal scores go by the smaller id.

    Null and empty texts have no features, weight 0, and are never drawn
    (unless least_words is 0). A null id is drawn with the noise of the word
    "null" and comes last among equals. Repeated rows each have a row and a
    chance, and the same score. An empty target leaves only the smoothing; an
    empty table gives no rows. Other columns are not carried, so their names
    can't clash.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    folder = shared_dir(docs.sparkSession)
    streams = write_streams(docs, folder, "streams", id_col=id_col, text_col=text_col, words=words, buckets=buckets)
    wanted = write_streams(target, folder, "target", id_col=None, text_col=target_text_col, words=words, buckets=buckets)
    gains = gains_of(bucket_counts(streams, buckets), bucket_counts(wanted, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = durable(weights(streams, gains).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), folder, "weights")
    enough = F.col("n_words") >= least_words
    many = scored.where(enough).count() * percent // 100
    placed = ranked(scored.where(enough), folder, F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
