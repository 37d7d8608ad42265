"""The k nearest rows to each query by shared words, exactly, without touching what can't matter.

The queries are an index: for each word, the queries that have it. Documents
stream past it, and nothing is shuffled but the k best of each task. As a task
fills up, each query has a threshold, its k-th best score so far. A document
that shares only a few words with a query can't reach it, so that many of the
query's words need no lookup: the commonest ones, whose lists are the longest,
are taken out of the index, and a document that has none of the query's other
words is never paired with it. For those that have some, an upper bound (the
words found, and as many of the left-out ones as the document has) is held
against the threshold before the left-out words are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of query words that a broadcast block may have; documents scored at a time; cells of a table of documents and queries.
BLOCK_BYTES, DOCS, CELLS = 4 << 20, 512, 1 << 22
#: How much the lists must have shrunk since the index was last cut for another cut.
WORTH = 0.9


class Index:
    """Words of a block of queries, and of each word the queries that have it."""

    def __init__(self, queries: list[tuple[object, list[bytes]]], by_share: bool):
        """by_share: a score is shared words over the larger set; else it is their number."""
        self.names, self.by_share = [q for q, _ in queries], by_share
        self.number: dict[bytes, int] = {}
        sets = [[self.number.setdefault(w, len(self.number)) for w in set(words)] for _, words in queries]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        query, word = np.repeat(np.arange(len(sets)), self.sizes), np.array([w for s in sets for w in s], np.int64)
        common = np.bincount(word, minlength=len(self.number))
        order = np.lexsort((word, common[word], query))  # each query's words, rarest among the queries first
        self.query, self.word = query[order], word[order]
        self.place = np.arange(len(order)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.keep(np.zeros(len(sets), np.int64))

    def keep(self, out: np.ndarray) -> None:
        """Take the `out` commonest words of each query out of the lists."""
        self.out = out
        here = self.place < (self.sizes - out)[self.query]
        order = np.argsort(self.word[here], kind="stable")
        self.lists, self.begin = self.query[here][order], np.concatenate([[0], np.cumsum(np.bincount(self.word[here], minlength=len(self.number)))])
        self.left_out = np.unique(self.word[~here])
        self.column = np.full(len(self.number), -1)
        self.column[self.left_out] = np.arange(len(self.left_out))
        self.asks = np.zeros((len(self.sizes), len(self.left_out)), np.float32)
        self.asks[self.query[~here], self.column[self.word[~here]]] = 1

    def may_leave_out(self, thresholds: np.ndarray) -> np.ndarray:
        """How many of a query's words don't suffice to reach its threshold, all being found."""
        need = np.ceil(thresholds * self.sizes * (1 - 1e-12)) if self.by_share else np.ceil(thresholds)
        return np.maximum(need - 1, 0).astype(np.int64)

    def score(self, shared: np.ndarray, query: np.ndarray, doc_sizes: np.ndarray) -> np.ndarray:
        return shared / np.maximum(self.sizes[query], doc_sizes) if self.by_share else shared.astype(float)


class Best:
    """The k best of each query so far: score first, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.rows = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, float)]  # query, id, shared, score
        self.thresholds = np.zeros(queries)

    def add(self, *rows: np.ndarray) -> None:
        q, i, n, s = (np.concatenate(x) for x in zip(self.rows, rows, strict=True))
        order = np.lexsort((i, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        within = place < self.k
        self.rows = [q[within], *(x[order[within]] for x in (i, n, s))]
        self.thresholds[q[place == self.k - 1]] = s[order[place == self.k - 1]]


def matches(batches: Iterator[pa.RecordBatch], index: Index, k: int) -> Iterator[pa.RecordBatch]:
    """(id, text, full) to (query, id, shared, score) of the k best, and (query, null, how many `full` rows share a word)."""
    best, lookups = Best(len(index.sizes), k), len(index.query)
    any_ = np.zeros(len(index.sizes), np.int64)
    width = max(1, min(DOCS, CELLS // max(1, len(index.sizes))))
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        ids, full = batch.column("id").to_numpy(zero_copy_only=False), batch.column("full").to_numpy(zero_copy_only=False)
        for a in range(0, len(texts), width):
            words = [set((t or b"").split()) for t in texts[a : a + width]]
            sizes = np.array([len(w) for w in words], np.int64)
            found = [[v for v in map(index.number.get, w) if v is not None] for w in words]
            doc, word = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.array([v for x in found for v in x], np.int64)
            docs, queries, shared = pairs(index, doc, word, sizes, best.thresholds)
            score = index.score(shared, queries, sizes[docs])
            good = (score >= best.thresholds[queries]) & (shared > 0)
            best.add(queries[good], ids[a : a + width][docs[good]].astype(np.int64), shared[good], score[good])
            some = full[a : a + width].astype(bool)
            if some.any():
                any_ += sharing(index, doc, word, some)
            out = index.may_leave_out(best.thresholds)
            kept = int((index.place < (index.sizes - out)[index.query]).sum())
            if kept < WORTH * lookups:
                index.keep(out)
                lookups = kept
    q, i, n, s = best.rows
    names = lambda at: pa.array([index.names[x] for x in at.tolist()])
    if len(q):
        yield pa.RecordBatch.from_arrays([names(q), pa.array(i), pa.array(n), pa.array(s)], names=["query", "id", "shared", "score"])
    if len(at := np.flatnonzero(any_)):
        yield pa.RecordBatch.from_arrays([names(at), pa.nulls(len(at), pa.int64()), pa.array(any_[at]), pa.nulls(len(at), pa.float64())], names=["query", "id", "shared", "score"])


def pairs(index: Index, doc: np.ndarray, word: np.ndarray, sizes: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, query, shared words) of those that have a word of the lists in common and whose bound reaches the threshold."""
    many = index.begin[word + 1] - index.begin[word]
    at = np.repeat(index.begin[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    table = np.bincount(np.repeat(doc, many) * len(index.sizes) + index.lists[at], minlength=len(sizes) * len(index.sizes)).reshape(len(sizes), len(index.sizes))
    docs, queries = np.nonzero(table)
    shared = table[docs, queries]
    column = index.column[word]
    has = np.zeros((len(sizes), len(index.left_out)), np.float32)
    has[doc[column >= 0], column[column >= 0]] = 1
    bound = shared + np.minimum(index.out[queries], has.sum(axis=1).astype(np.int64)[docs])
    hope = index.score(bound, queries, sizes[docs]) >= thresholds[queries]
    docs, queries, shared = docs[hope], queries[hope], shared[hope]
    step = max(1, CELLS // max(1, len(index.left_out)))
    more = [np.einsum("ij,ij->i", has[docs[i : i + step]], index.asks[queries[i : i + step]]) for i in range(0, len(docs), step)]
    return docs, queries, shared + (np.concatenate(more).astype(np.int64) if more else 0)


def sharing(index: Index, doc: np.ndarray, word: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Of each query, how many of `some` documents have any of its words, left-out ones too."""
    mine = some[doc]
    doc, word = doc[mine], word[mine]
    many = index.begin[word + 1] - index.begin[word]
    at = np.repeat(index.begin[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    hit = np.zeros((len(some), len(index.sizes)), bool)
    hit[np.repeat(doc, many), index.lists[at]] = True
    column = index.column[word]
    has = np.zeros((len(some), len(index.left_out)), np.float32)
    has[doc[column >= 0], column[column >= 0]] = 1
    return (hit | (has @ index.asks.T > 0)).sum(axis=0)


def nearest(queries: DataFrame, docs: DataFrame, k: int, *, by: str = "share", count_where=None) -> tuple[DataFrame, DataFrame]:
    """The k rows nearest to each query, and how many rows share a word with it at all.

    queries: (id, text); docs: (id, text), ids whole numbers. Words are cut at
    ASCII white space, in lower case, and count once. by "share": shared words
    over the larger set; by "count": shared words. Ties go to the smaller id;
    rows that share no word have no place.

    First: (query, id, shared, score, rank). Second: (query, n), of the rows of
    docs for which count_where holds (none if it isn't given).

    The queries are read in blocks of BLOCK_BYTES, each broadcast by itself, and
    the documents are read once a block. Each task hands on k rows a query.
    """
    spark = docs.sparkSession
    if by not in ("share", "count"):
        raise ValueError("by must be share or count")
    asked = queries.select(F.col("id").alias("query"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    rows = docs.select(F.col("id").cast("long").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), (F.lit(False) if count_where is None else F.coalesce(count_where, F.lit(False))).alias("full"))
    kind = asked.schema["query"].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField("id", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("score", T.DoubleType())])
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast([(r["query"], r["text"].encode().split()) for r in part])
        one = rows.mapInArrow(lambda batches, shared=shared: matches(batches, Index(shared.value, by == "share"), k), schema)
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = found.where("id IS NOT NULL").withColumn("rank", place).where(F.col("rank") <= k)
    return best, found.where("id IS NULL").groupBy("query").agg(F.sum("shared").alias("n"))
