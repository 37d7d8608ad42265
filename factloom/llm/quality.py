"""Quality classification by a factorisation machine.

A text is a sparse vector: hashed words, structure statistics (shares of letter
cases, digits, symbols and blanks, lengths, repetition) in steps, and metadata
(the n_chars column, in steps). Its score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairs of features interact at a cost linear in the number of features.
The model is fitted by Adagrad on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, small_batches, widened

WORD_BUCKETS, STAT_BUCKETS, FACTORS = 1 << 14, 1 << 10, 8
#: Labelled rows a fit takes at most: its documented bound.
SAMPLE_ROWS = 12_000
STEPS = 16
CACHE_WORDS = 150_000

_kinds = np.zeros(256, np.int64)  # of bytes: symbol 0, lower 1, upper 2, digit 3, blank 4, line end 5, beyond ASCII 6
_kinds[97:123], _kinds[65:91], _kinds[48:58], _kinds[[32, 9, 13]], _kinds[10], _kinds[128:] = 1, 2, 3, 4, 5, 6


class Features:
    """Indices and values of a text's features; keeps the buckets of words it has seen."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def _bucket(self, word: bytes) -> int:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            found = self.cache[word] = zlib.crc32(word) % WORD_BUCKETS
        return found

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        data = (text or "").encode("utf-8", "replace")
        words, lines = data.lower().split(), data.split(b"\n")
        buckets, counts = np.unique(np.fromiter(map(self._bucket, words), np.int64, len(words)), return_counts=True)
        values = np.log1p(counts)
        if len(values):
            values = values / np.sqrt((values * values).sum())
        raw = np.frombuffer(data, np.uint8)
        kinds = np.bincount(_kinds[raw], minlength=7) / max(1, len(raw))
        ends = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
        stats = [
            *kinds,
            math.log1p(len(data)) / 16,
            math.log1p(len(words)) / 14,
            min(1.0, len(data) / max(1, len(words)) / 32),
            len(buckets) / max(1, len(words)),
            len(set(lines)) / len(lines),
            min(1.0, len(lines) / max(1, len(words))),
            float((_kinds[ends] == 0).mean()) if len(ends) else 0.0,
            math.log1p(n_chars) / 16 if n_chars is not None and n_chars >= 0 else 1.0,
            (np.bincount(raw, minlength=256).max() / len(raw)) if len(raw) else 0.0,
        ]
        # Each statistic lights the two steps it lies between, in proportion.
        at = np.clip(np.sqrt(np.array(stats)), 0, 1) * (STEPS - 1)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        first = WORD_BUCKETS + np.arange(len(stats)) * STEPS + low
        index = np.concatenate([buckets, first, first + 1])
        value = np.concatenate([values, (1 - (at - low)) * 0.5, (at - low) * 0.5])
        return index, value


@dataclass
class Machine:
    """w0, w, v of a factorisation machine."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.v[index] * value[:, None]
        s = v.sum(axis=0)
        z = self.w0 + float(self.w[index] @ value) + 0.5 * float(s @ s - (v * v).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], *, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, factors: int = FACTORS, seed: int = 1) -> Machine:
    """Fit a machine to 0/1 labels by Adagrad on the log loss. Without rows it scores 1/2 throughout; with one label only, it leans to that."""
    rng = np.random.default_rng(seed)
    n = WORD_BUCKETS + STAT_BUCKETS
    w, v, w0 = np.zeros(n), rng.normal(0, 0.05, (n, factors)), 0.0
    gw, gv, g0 = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
    for _ in range(epochs if rows else 0):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            size = np.array([len(rows[i][0]) for i in part])
            index, x = (np.concatenate([rows[i][j] for i in part]) for j in (0, 1))
            row, starts = np.repeat(np.arange(len(part)), size), np.cumsum(size) - size
            vx = v[index] * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            z = w0 + np.add.reduceat(w[index] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([labels[i] for i in part])) / len(part)
            unique, inverse = np.unique(index, return_inverse=True)
            dx = d[row] * x
            uw = np.bincount(inverse, dx, len(unique)) + decay * w[unique]
            each = dx[:, None] * (s[row] - vx)
            uv = np.stack([np.bincount(inverse, each[:, f], len(unique)) for f in range(factors)], axis=1) + decay * v[unique]
            g0 += d.sum() ** 2
            gw[unique] += uw * uw
            gv[unique] += uv * uv
            w0 -= rate * d.sum() / math.sqrt(g0)
            w[unique] -= rate * uw / np.sqrt(gw[unique])
            v[unique] -= 0.3 * rate * uv / np.sqrt(gv[unique])
    return Machine(w0, w, v)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", size_col: str = "n_chars", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on the labelled rows whose ids' hashes are smallest, `sample_rows` at most.

    Rows without a label teach nothing; of several labels for an id the
    largest counts. Only the sample's labels are broadcast, and only its
    features reach the driver; both are bounded by sample_rows.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    size = F.col(size_col).cast("long") if size_col in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.alias("n_chars")).join(F.broadcast(picked), "id").select("id", "text", "n_chars", "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in by_bytes(batches, "text"):
            found = [make(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())],
                names=["id", "label", "index", "value"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    table = rows.mapInArrow(features, f"id {id_type}, label int, index binary, value binary").orderBy(F.xxhash64("id"), "id", "index").limit(sample_rows).collect()
    return train([(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in table], [r["label"] for r in table])


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", size_col: str = "n_chars", threshold: float = 0.7) -> DataFrame:
    """Add score (likelihood of label 1) and predicted (1 from `threshold` up) to each row.

    Null text counts as empty, and is scored as such. Repeated rows are each
    scored. A missing or null n_chars is a step of its own. Columns of docs
    with the added names are replaced.
    """
    kept = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(machine), kept.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, model = Features(), shared.value
        for batch in by_bytes(batches, text_col):
            sizes = batch.column(size_col).to_pylist() if size_col in names else [None] * batch.num_rows
            found = [model.score(*make(t, n)) for t, n in zip(batch.column(text_col).to_pylist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=[*names, "score", "predicted"])

    return kept.mapInArrow(judge, widened(kept, ("score", "double"), ("predicted", "int")))
