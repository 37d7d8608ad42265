"""Benchmark decontamination with suffix arrays of the training text.

Each shard of training text (a run of documents of about SHARD_BYTES in one
task) gets an array of its suffixes, ordered by as many first words as a window
has. Every test suffix that can begin a window is binary-searched in it, which
gives all places of the window at once. Where the words before a hit differ
from those before the test suffix, a match begins, and its length is read off
against the test text: so all longest verbatim matches are found, with their
places in the document and in the item.

The test set is a query set that every shard must see. It is dealt into blocks
of about BLOCK_BYTES, each broadcast by itself (that is its proven bound); a
task holds one shard and one block at a time, and a block that it isn't using
is on the executor's disk. The training text is read once and never shuffled,
however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import by_bytes, durable, set_aside, shared_dir

SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
PIECE_WORDS = 20_000
BITS = 21  # of a word's number; a block has fewer words
#: Lower-cases A-Z and makes each byte that isn't part of a word a blank: words are digits, a-z and all bytes from 0x80.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("doc_start", T.LongType()), T.StructField("n_words", T.LongType())])
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(MATCH)),
]
MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())]))
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Block:
    """Test text of one block: its words by number, its windows, and where in which item each begins."""

    def __init__(self, rows: list[tuple[str, int, list[bytes], int]], window: int):
        """rows: (item, number of its first word, words, words of the whole item)."""
        self.items = sorted({r[0] for r in rows})
        self.depth = 3 * -(-window // 3)  # words by which suffixes are ordered: three to a number
        number = {x: i for i, x in enumerate(self.items)}
        self.vocab: dict[bytes, int] = {}
        ids, item, place = [], [], []
        self.windows: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        begins: dict[int, dict[bytes, list[int]]] = {}
        at = 1
        for name, first, words, whole in rows:
            row = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int64)
            n = min(window, whole)
            for i in range(len(words) - n + 1):
                begins.setdefault(n, {}).setdefault(row[i : i + n].tobytes(), []).append(at + i)
            ids.append(np.append(0, row))
            item.append(np.full(len(words) + 1, number[name]))
            place.append(first - 1 + np.arange(len(words) + 1))
            at += len(words) + 1
        self.ids, self.item, self.place = (np.concatenate([*x, [0]]).astype(np.int64) for x in (ids, item, place))
        for n, found in begins.items():
            self.windows[n] = (np.array([np.frombuffer(k, np.int64) for k in found]), [np.array(v) for v in found.values()])


def keys(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For each place, the numbers of its first words in depth / 3 integers that order as the words do."""
    three = (ids[:-2] << 2 * BITS) | (ids[1:-1] << BITS) | ids[2:]
    return np.stack([three[at + 3 * i] for i in range(depth // 3)], axis=1)


def sortable(k: np.ndarray) -> np.ndarray:
    """Keys as strings of bytes that compare as the keys."""
    return np.ascontiguousarray(k.astype(">u8")).view(f"S{8 * k.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and the sorted keys; only places whose first `least` words are in the test vocabulary."""
    ok = ids[: len(ids) - depth - 2] > 0
    for i in range(1, least):
        ok = ok & (ids[i : len(ids) - depth - 2 + i] > 0)
    at = np.flatnonzero(ok)
    k = keys(ids, at, depth)
    order = np.lexsort(tuple(k[:, i] for i in reversed(range(k.shape[1]))))
    return at[order], sortable(k[order])


def search(order: np.ndarray, sorted_keys: np.ndarray, windows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, the range of the suffix array that begins with it."""
    m, n = windows.shape
    low, high = np.zeros((m, depth), np.int64), np.full((m, depth), (1 << BITS) - 1)
    low[:, :n] = high[:, :n] = windows
    pack = lambda w: np.stack([(w[:, 3 * i] << 2 * BITS) | (w[:, 3 * i + 1] << BITS) | w[:, 3 * i + 2] for i in range(depth // 3)], axis=1)
    return np.searchsorted(sorted_keys, sortable(pack(low)), "left"), np.searchsorted(sorted_keys, sortable(pack(high)), "right")


Found = tuple[list[tuple[int, int]], set[str], list[tuple[str, int, int, int]]]


def match_shard(texts: list[list[bytes]], block: Block) -> list[Found]:
    """Of each text's words: hit spans, items, and the matches (item, its first word there, first word here, words)."""
    get, gap = block.vocab.get, np.zeros(block.depth + 2, np.int64)
    ids = np.concatenate([x for words in texts for x in (gap, np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))] + [gap])
    starts = np.cumsum([len(gap), *(len(words) + len(gap) for words in texts)])[:-1]
    found: list[Found] = [([], set(), []) for _ in texts]
    if not block.windows or not texts:
        return found
    order, sorted_keys = suffix_array(ids, min(3, *block.windows), block.depth)
    cover = np.zeros(len(ids) + 1, np.int64)
    for n, (windows, begins) in block.windows.items():
        left, right = search(order, sorted_keys, windows, block.depth)
        for w in np.flatnonzero(right > left).tolist():
            at, there = order[left[w] : right[w]], begins[w]
            cover[at] += 1  # a place is in a suffix array once
            cover[at + n] -= 1
            docs = np.searchsorted(starts, at, "right") - 1
            for d in np.unique(docs).tolist():
                found[d][1].update(block.items[i] for i in np.unique(block.item[there]).tolist())
            for d, p in zip(docs.tolist(), at.tolist(), strict=True):
                for q in there[(block.ids[there - 1] != ids[p - 1]) | (ids[p - 1] == 0)].tolist():
                    found[d][2].append((block.items[block.item[q]], int(block.place[q]), p - int(starts[d]), longest(ids, p, block.ids, q)))
    hit = np.cumsum(cover)[:-1] > 0
    for a, b in np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2).tolist():
        d = int(np.searchsorted(starts, a, "right")) - 1
        found[d][0].append((a - int(starts[d]), b - int(starts[d])))
    return found


def longest(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Words that agree from a[i] and b[j] on."""
    step, n = 64, 0
    while True:
        x, y = a[i + n : i + n + step], b[j + n : j + n + step]
        m = min(len(x), len(y))
        bad = np.flatnonzero((x[:m] != y[:m]) | (x[:m] == 0))
        if len(bad) or m < step:
            return n + (int(bad[0]) if len(bad) else m)
        n += step
        step *= 2


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with those that touch or overlap merged."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def joined(matches: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Matches in the order of the document, those as one that meet at the edges of an item's pieces (which overlap)."""
    out: list[tuple[str, int, int, int]] = []
    for item, there, here, n in sorted(matches, key=lambda m: (m[0], m[2] - m[1], m[1])):
        if out and out[-1][0] == item and out[-1][2] - out[-1][1] == here - there and there <= out[-1][1] + out[-1][3]:
            out[-1] = (*out[-1][:3], max(out[-1][3], there + n - out[-1][1]))
        else:
            out.append((item, there, here, n))
    return sorted(out, key=lambda m: (m[2], m[0], m[1]))


def benchmark_blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[Block]:
    """The test set in blocks; long items in pieces that overlap by a window less one word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for i in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    rows.append((item, i, b" ".join(words[i : i + PIECE_WORDS + window - 1]), len(words)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["item", "first", "words", "whole"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = rows.mapInArrow(cut, "item string, first bigint, words binary, whole bigint").where(F.octet_length("words") > 0).distinct()
    pieces = durable(pieces, shared_dir(benchmark.sparkSession), "pieces")
    many = -(-int(pieces.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0) // BLOCK_BYTES)
    for b in range(many):
        part = pieces.where(F.pmod(F.xxhash64("item", "first"), F.lit(many)) == b).orderBy("item", "first", "words").collect()  # about BLOCK_BYTES
        yield Block([(r["item"], r["first"], bytes(r["words"]).split(), r["whole"]) for r in part], window)


def find_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Add to each document n_words, hit_spans (words inside a window that occurs), hit_items (sorted), and matches.

    A window is `window` consecutive words of an item, or all words of a
    shorter item. `matches` has every verbatim match of a window or more that
    can't be made longer at either end: item, its first word there, first word
    here, words.

    Null and empty texts have no words and no hits. Repeated documents are each
    judged; items that share an id count once in hit_items; a null item id is
    listed as "null". An empty table on either side gives no hits. Columns of
    docs that have the added names are replaced.
    """
    if window < 1:
        raise ValueError("window must be 1 or more")
    spark = docs.sparkSession
    kept = docs.drop(*(f.name for f in ADDED))
    names = kept.columns
    shared = [spark.sparkContext.broadcast(b) for b in benchmark_blocks(benchmark, window, item_col, item_text_col)]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, text_col):
            texts = [words_of(t.as_py()) for t in batch.column(text_col)]
            found: list[Found] = [([], set(), []) for _ in texts]
            for block in shared:
                for own, more in zip(found, match_shard(texts, block.value), strict=True):
                    own[0].extend(more[0])
                    own[1].update(more[1])
                    own[2].extend(more[2])
                if len(shared) > 1:  # the next block takes its place; it is read again from the executor's disk
                    del block._value
            columns = [
                pa.array(map(len, texts), pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in union(f[0])] for f in found], SPAN_ARROW),
                pa.array([sorted(f[1]) for f in found], pa.list_(pa.string())),
                pa.array([[dict(zip(MATCH.names, m, strict=True)) for m in joined(f[2])] for f in found], MATCH_ARROW),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, *(f.name for f in ADDED)])

    return kept.mapInArrow(match, T.StructType([*kept.schema.fields, *ADDED]))


def shards(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """The batches put together to shards of about SHARD_BYTES of text."""
    held, size = [], 0
    for batch in by_bytes(batches, text_col):
        held.append(batch)
        size += batch.column(text_col).nbytes
        if size >= SHARD_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no window of the test set occurs, with their own columns (whatever their names)."""
    rows, own = set_aside(docs, (f.name for f in ADDED))
    found = find_matches(rows, benchmark, text_col=text_col, **options)
    return own(found.where(F.size("hit_spans") == 0))
