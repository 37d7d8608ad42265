"""Divergence between the sources of each language, by the words they use.

Each source's words become shares of a fixed total, smoothed and rounded down
to whole numbers, so that all arithmetic is exact. Two sources differ by the
sum over terms of (p - q)^2 / q, and a source's own terms by the same measure
against its language.

Terms with the same counts in the same sources add the same to every pair, so
terms are grouped by their sparse vector of counts and each distinct vector is
evaluated once, times the number of its terms. Where a source has none of a
term its share is one constant. So a vector is evaluated over the pairs of
sources that both have its terms; what one side alone has goes by that side's
count only, and follows from a histogram of each source's counts; the rest is
one value a pair, times all terms. The cost grows with the squares of the
vectors' lengths and not with terms times pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import by_bytes, durable, shared_dir, texts_as_bytes, word_lists

#: What the shares of a source come to, nearly.
TOTAL = 1_000_000_000
#: Terms that a task counts before it passes them on; pairs evaluated at a time; pairs whose sums a task holds.
HELD_TERMS, PAIRS, HELD_PAIRS = 200_000, 1 << 20, 1 << 20
#: Parts of a source's histogram.
PARTS = 16
#: Lower-cases A-Z and makes each byte that isn't part of a term a blank: terms are a-z and all bytes from 0x80.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PAIR = T.StructType([T.StructField("lang", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("value", T.LongType())])


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), summed over as much as a task may hold."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in held.items():
            if count:
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(count), np.int64))) for x in (lang, source)]
                columns = [*same, pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(count.values(), pa.int64()), pa.array([docs[w] for w in count], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in by_bytes(batches, "text"):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts_as_bytes(batch, "text"), strict=True):
            count, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in word_lists(text, TERM_BYTES):
                count.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(c) for c, _ in held.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


def share(n: str, all_: str):
    """1 + floor(TOTAL * (n + 1) / all_), whole numbers throughout."""
    return F.expr(f"1 + CAST(CAST({TOTAL} AS DECIMAL(18,0)) * CAST({n} + 1 AS DECIMAL(19,0)) AS DECIMAL(38,0)) div nullif({all_}, 0)")


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Sums:
    """Sums by language and pair of source numbers."""

    def __init__(self):
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        key, old = (a.astype(np.int64) << 32) | b, self.held.get(lang)
        if old:
            key, value = np.concatenate([old[0], key]), np.concatenate([old[1], value])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.held[lang] = key[first], np.add.reduceat(value[order], first)

    def size(self) -> int:
        return sum(len(k) for k, _ in self.held.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lang, (key, value) in self.held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(value)], names=PAIR.names)
        self.held.clear()


def structs(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes of the lists of a column, and the fields of all their structs in one."""
    flat = column.flatten()
    return np.diff(column.offsets.to_numpy()), [flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def shared_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, m, cells): over all pairs of a vector's sources, what it adds beyond the sums of each side alone, m times."""
    sums = Sums()
    for batch in batches:
        sizes, (number, p, p0) = structs(batch.column("cells"), ["number", "p", "p0"])
        langs = np.array(batch.column("lang").to_pylist(), object)
        m = batch.column("m").to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        begin, run = (np.cumsum(sizes) - sizes)[row], sizes[row]  # of each cell: where its vector begins, and how long it is
        for lang in dict.fromkeys(langs.tolist()):
            own = np.flatnonzero((langs == lang)[row])
            while len(own):
                many = max(1, int(np.searchsorted(np.cumsum(run[own]), PAIRS, "right")))
                part, own = own[:many], own[many:]
                n = run[part]
                left = np.repeat(part, n)
                right = np.repeat(begin[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                keep = left != right
                a, b = left[keep], right[keep]
                if len(a):
                    sums.add(lang, number[a], number[b], m[row[a]] * (f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])))
            if sums.size() > HELD_PAIRS:
                yield from sums.batches()
    yield from sums.batches()


def single_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, number, p0, own, others): what a source's own terms add to its pairs with all others of the language, either way, if these have none of them."""
    sums = Sums()
    for batch in batches:
        for k in range(batch.num_rows):
            lang, me, mine = (batch.column(n)[k].as_py() for n in ("lang", "number", "p0"))
            _, (p, times) = structs(batch.column("own").slice(k, 1), ["p", "times"])
            _, (number, p0) = structs(batch.column("others").slice(k, 1), ["number", "p0"])
            number, p0 = number[number != me], p0[number != me]
            step = max(1, PAIRS // max(1, len(p)))
            for i in range(0, len(number), step):
                n, q0 = number[i : i + step], p0[i : i + step]
                out = (times[:, None] * (f(p[:, None], q0[None, :]) - f(np.int64(mine), q0)[None, :])).sum(axis=0)
                back = (times[:, None] * (f(q0[None, :], p[:, None]) - f(q0, np.int64(mine))[None, :])).sum(axis=0)
                here = np.full(len(n), me)
                sums.add(lang, np.concatenate([here, n]), np.concatenate([n, here]), np.concatenate([out, back]))
        if sums.size() > HELD_PAIRS:
            yield from sums.batches()
    yield from sums.batches()


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """How far the sources of each language are from each other, and which terms set each apart.

    A language keeps the terms that at least `least_docs` of its documents have.
    Each (language, source) that occurs gives a kept term the share p = 1 +
    floor(10^9 (n + 1) / (N + V)): n its occurrences there, N those of all kept
    terms, V their number. The language itself has shares likewise. With f =
    floor((p - q)^2 / q), rows of part "pair" rank the other sources of the
    language by the sum of f over the kept terms, q being theirs; those of part
    "term" rank the terms that the source has and uses more than the language
    does (q being its), `top` at most. Ranks go by value, then by item.

    Null text, language and source count as ''. Repeated rows count each. A
    source without terms has pairs all the same, and a language without kept
    terms has pairs of value 0. An empty table gives no rows. Other columns are
    not carried, so their names can't clash. The sources of one language are
    numbered in one task: the result has a row for each pair of them.
    """
    folder = shared_dir(docs.sparkSession)
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    numbered = own.select("lang", "source").distinct().withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    numbers = durable(numbered, folder, "numbers")

    counts = own.mapInArrow(tally, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vector = F.sort_array(F.collect_list(F.struct("number", "n"))).alias("vector")  # a cell for each source of the language at most
    terms = counts.join(numbers, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector).where(F.col("docs") >= least_docs).select("lang", "term", "vector")
    terms = durable(terms, folder, "terms")

    cells = terms.select("lang", "term", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("total"), F.explode("vector").alias("cell")).select("lang", "term", "total", "cell.number", "cell.n")
    per_source = cells.groupBy("lang", "number").agg(F.sum("n").alias("source_n"))
    per_lang = per_source.groupBy("lang").agg(F.sum("source_n").alias("lang_n")).join(terms.groupBy("lang").agg(F.count("*").alias("v")), "lang")
    groups = numbers.join(per_source, ["lang", "number"], "left").join(per_lang, "lang", "left").na.fill(0, ["source_n", "lang_n", "v"])
    groups = groups.withColumn("p0", F.coalesce(share("0", "source_n + v"), F.lit(1)))  # where nothing is kept, p0 meets no term
    groups = durable(groups, folder, "groups")

    ranks = lambda rows, part: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    pairs = ranks(pair_values(terms, groups, folder), "pair")
    shares = cells.join(groups, ["lang", "number"]).select("lang", "source", F.col("term").alias("item"), share("n", "source_n + v").alias("p"), share("total", "lang_n + v").alias("q"))
    apart = shares.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    return pairs.unionByName(ranks(apart, "term").where(F.col("rank") <= top))


def pair_values(terms: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language."""
    classes = durable(terms.groupBy("lang", "vector").agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id()), folder, "classes")
    cells = classes.select("id", "lang", "m", F.explode("vector").alias("cell"), (F.size("vector") > 1).alias("several")).select("id", "lang", "m", "several", "cell.number", "cell.n")
    cells = cells.join(groups, ["lang", "number"]).select("id", "lang", "m", "several", "number", share("n", "source_n + v").alias("p"), "p0")
    cells = durable(cells, folder, "cells")

    vectors = cells.where("several").groupBy("id", "lang", "m").agg(F.collect_list(F.struct("number", "p", "p0")).alias("cells"))
    both = vectors.mapInArrow(shared_sums, PAIR)

    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("number", "p0", "source")).alias("others"))  # the sources of a language
    counts = cells.groupBy("lang", "number", "p0", "p").agg(F.sum("m").alias("times"))
    single = counts.groupBy("lang", "number", "p0", F.pmod(F.xxhash64("p"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("p", "times")).alias("own"))
    either = single.join(peers, "lang").mapInArrow(single_sums, PAIR)

    all_pairs = groups.join(peers, "lang").select("lang", F.col("number").alias("a"), "source", "v", "p0", F.explode("others").alias("o")).where("a <> o.number")
    base = all_pairs.select("lang", "a", F.col("o.number").alias("b"), F.expr("v * (((p0 - o.p0) * (p0 - o.p0)) div o.p0)").alias("value"), "source", F.col("o.source").alias("item"))
    none = F.lit(None).cast("string")
    parts = base.unionByName(both.unionByName(either).withColumns({"source": none, "item": none}))
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.max("source").alias("source"), F.max("item").alias("item")).select("lang", "source", "item", "value")
