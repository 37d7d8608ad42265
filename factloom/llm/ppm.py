"""Language-model scores by prediction with partial matching over bytes.

The model is a trie of byte contexts of up to ORDER bytes. A byte is predicted
in the longest context; if it was never seen there, an escape (estimated by
method C: as many escapes as distinct symbols) leads to the next shorter one,
where the symbols of the longer context are excluded, and in the end to equal
chances for what is left. As a shorter context has every symbol of the longer
one, what is excluded in a context depends only on the context that was
escaped from, so the code length of a symbol is fixed by its ORDER bytes of
context, and each (context, symbol) string, a gram, has one log probability.

The trie is never in one place. Each task deals its documents into chunks of
bounded size. Each chunk lists its distinct grams with their counts in training texts,
by hash groups; the groups add up the counts; the grams' log probabilities are
computed by groups of contexts that share their last two bytes, or three where
two are too common (orders below that come from small tables); and every chunk gets back the
values of the grams it listed, in the order it listed them. Word counts for
the base score go the same way. So memory is bounded by the chunk, whatever
the size of the corpus or of the trie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, chunks_for, durable, shared_dir, text_of

ORDER = 5
#: Bytes that UTF-8 lacks stand for what is before a text and for its end.
BEFORE, END = b"\xfe", b"\xff"
SYMBOLS = 255
#: Bytes that are sorted at a time, and documents among them (their number must fit in 16 bits).
BATCH, BATCH_DOCS = 2 << 20, 60_000
GROUP_GRAMS = 1_000_000
#: Text of a chunk; what a task holds is in proportion to it.
CHUNK_BYTES = 16 << 20
U = np.uint64


# --- grams and words of a chunk ---------------------------------------------


def segments(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Batches of (document numbers, bytes with ORDER bytes of context before them); long texts are cut, keeping their context."""
    docs, parts, size = [], [], 0
    for i, t in enumerate(texts):
        data = BEFORE * ORDER + t.encode("utf-8", "replace") + END
        for at in range(0, len(data) - ORDER, BATCH):
            part = data[at : at + BATCH + ORDER]
            if docs and (size + len(part) > BATCH + ORDER or len(docs) >= BATCH_DOCS):
                yield docs, parts
                docs, parts, size = [], [], 0
            docs.append(i)
            parts.append(part)
            size += len(part)
    if docs:
        yield docs, parts


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, number of its part) of every byte that has context: the context's last byte first, the byte itself last."""
    b = np.frombuffer(b"".join(parts), np.uint8).astype(U)
    n = len(b) - ORDER
    k = np.zeros(n, U)
    for j in range(1, ORDER + 1):
        k = (k << U(8)) | b[ORDER - j : ORDER - j + n]
    k = (k << U(8)) | b[ORDER:]
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    ok = np.ones(len(b), bool)
    for j in range(ORDER):
        ok[ends - sizes + j] = False
    return k[ok[ORDER:]], np.repeat(np.arange(len(parts)), sizes - ORDER)


def sorted_runs(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams in order, run number of each occurrence, part of each occurrence), by one sort."""
    k, part = grams(parts)
    both = np.sort((k << U(16)) | part.astype(U))
    k = both >> U(16)
    new = np.concatenate([[True], k[1:] != k[:-1]])
    return k[new], np.cumsum(new) - 1, (both & U(0xFFFF)).astype(np.int64)


def word_runs(texts: list[str], cache: dict[bytes, int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Batches of (document numbers, hashes of their words and ends, tokens of each). Words: lower-cased in A-Z, cut at ASCII white space."""
    import xxhash

    docs, out, sizes, total = [], [], [], 0
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "replace").lower().split()
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        docs.append(i)
        out.append(np.fromiter((*map(cache.__getitem__, words), END_TOKEN), U, len(words) + 1))
        sizes.append(len(words) + 1)
        total += len(words) + 1
        if total > BATCH // 4:
            yield docs, np.concatenate(out), np.array(sizes, np.int64)
            docs, out, sizes, total = [], [], [], 0
    if docs:
        yield docs, np.concatenate(out), np.array(sizes, np.int64)


#: The end's key; a hash of a byte string that is no word.
END_TOKEN = 0x9E3779B97F4A7C15


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64)
    keys, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], (np.add.reduceat(counts[order].astype(np.int64), new) if len(keys) else np.zeros(0, np.int64))


def distinct(found: Iterator[np.ndarray]) -> np.ndarray:
    """All keys once, in order."""
    held: list[np.ndarray] = []
    for k in found:
        held.append(k)
        if len(held) > 7:
            held = [_once(held)]
    return _once(held) if held else np.zeros(0, U)


def _once(held: list[np.ndarray]) -> np.ndarray:
    keys = np.concatenate(held)
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def listed(texts: list[str], train: list[bool]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(grams, training counts) and (words, training counts) of a chunk, keys distinct and in order."""
    train_ = np.array(train, np.int64)
    found = []
    for docs, parts in segments(texts):
        k, run, part = sorted_runs(parts)
        found.append((k, np.bincount(run, train_[np.array(docs)][part], len(k)).astype(np.int64)))
        if len(found) > 3:
            found = [merged(found)]
    grams_ = merged(found)
    found, cache = [], {}
    for docs, words, sizes in word_runs(texts, cache):
        found.append(merged([(words, np.repeat(train_[np.array(docs)], sizes))]))
        if len(found) > 3:
            found = [merged(found)]
    return grams_, merged(found)


def groups_of(keys: np.ndarray, many: int) -> np.ndarray:
    """Hash group of each key; `many` is a power of two."""
    return ((keys * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) & (many - 1)


def compressed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def restored(data: bytes, dtype: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


#: Kinds of rows: 0 grams, 1 words, and in a listing -1 documents of the chunk.
DOCS = -1
LISTING = "chunk bigint, kind int, g int, keys binary, counts binary, docs binary"
VALUES = "chunk bigint, kind int, g int, vals binary"
WORD_VALUES = VALUES + ", known bigint, tokens bigint"
LISTING_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])
VALUES_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("g", pa.int32()), ("vals", pa.binary())])
WORD_VALUES_ARROW = pa.schema([*VALUES_ARROW, ("known", pa.int64()), ("tokens", pa.int64())])


def list_chunks(many: int, chunk_bytes: int):
    """Deal a partition's documents (id, text, train) into chunks; of each, the documents as compressed Arrow pieces, and the keys listed by hash group."""

    def listing(chunk: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in LISTING_ARROW]
        texts, train = ([x for b in held for x in b.column(c).to_pylist()] for c in ("text", "train"))
        for kind, (keys, counts) in enumerate(listed(texts, train)):
            g = groups_of(keys, many)
            order = np.argsort(g, kind="stable")
            cuts = np.searchsorted(g[order], np.arange(many + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = order[cuts[i] : cuts[i + 1]]
                row = (chunk, kind, i, compressed(np.diff(keys[part], prepend=U(0))), compressed(counts[part].astype("<u4")), None)
                for column, x in zip(rows, row, strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, LISTING_ARROW, strict=True)], schema=LISTING_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in by_bytes(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((chunk, DOCS, None, None, None, packed(batch)), LISTING_ARROW, strict=True)], schema=LISTING_ARROW)
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= chunk_bytes:
                yield listing(chunk, held)
                chunk, held, size = chunk + 1, [], 0
        if held:
            yield listing(chunk, held)

    return run


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def keys_of(table: pa.Table) -> list[np.ndarray]:
    return [np.cumsum(restored(k, U), dtype=U) for k in table.column("keys").to_pylist()]


def added_up(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The rows' keys, and over all of them the distinct keys with their counts."""
    keys = keys_of(table)
    return keys, *merged([(k, restored(c, np.uint32)) for k, c in zip(keys, table.column("counts").to_pylist(), strict=True)])


def count_grams(table: pa.Table) -> pa.Table:
    _, k, c = added_up(table)
    return pa.table({"g": pa.array(np.full(len(k), table.column("g")[0].as_py(), np.int32)), "k": pa.array(k.view(np.int64)), "c": pa.array(c)})


def count_words(table: pa.Table) -> pa.Table:
    """Values for each chunk (the words' counts); the first row has how many words and tokens the group has, the others 0."""
    keys, k, c = added_up(table)
    values = [compressed(c[np.searchsorted(k, x)].astype("<u4")) for x in keys]
    sums = [[int(n), *[0] * (len(values) - 1)] for n in ((c > 0).sum(), c.sum())]
    found = (table.column("chunk"), [1] * len(values), table.column("g"), values, *sums)
    return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, f.type) for x, f in zip(found, WORD_VALUES_ARROW, strict=True)], schema=WORD_VALUES_ARROW)


def hand_back(model: pa.Table, table: pa.Table) -> pa.Table:
    """Values for each chunk: the log probabilities of the grams that it listed."""
    k, value = model.column("k").to_numpy().view(U), model.column("lp").to_numpy()
    order = np.argsort(k)
    k, value = k[order], value[order]
    values = [compressed(value[np.searchsorted(k, x)].astype("<f4")) for x in keys_of(table)]
    return pa.table([table.column("chunk"), pa.array([0] * len(values), pa.int32()), table.column("g"), pa.array(values, pa.binary())], schema=VALUES_ARROW)


# --- the model --------------------------------------------------------------


Table = tuple[np.ndarray, np.ndarray]


def log_probabilities(k: np.ndarray, c: np.ndarray, pairs: Table, split: Table) -> np.ndarray:
    """log10 of each gram's probability.

    k, c: distinct grams of whole groups of contexts with the same last two
    bytes (three where `split` has those two), and their training counts (0 for
    grams that are only asked about). pairs: all (last byte, symbol) cells of
    the training texts and their counts. split: all (last two bytes, symbol)
    cells of the contexts that are dealt by three bytes, and their counts.
    """
    order = np.argsort(k)
    k, c = k[order], c[order].astype(float)
    symbol, n = k & U(255), len(k)
    total, done = np.zeros(n), np.zeros(n, bool)
    above = None  # cells of the order above: (cell, its context, count), contexts of the grams
    for d in range(ORDER, -1, -1):
        if d:
            own = ((k >> U(8 * (ORDER - d + 1))) << U(8)) | symbol
            known, counts = handed_down(own, pairs if d == 1 else split if d == 2 else None)
            cells = np.unique(np.concatenate([own, known]))
            of_gram = np.searchsorted(cells, own)
            count = np.bincount(of_gram, c, len(cells))  # all grams of such a context are here, or else its cells are handed down
            count[np.isin(cells >> U(8), known >> U(8))] = 0
            count[np.searchsorted(cells, known)] = counts
        else:
            cells, of_gram = np.arange(256, dtype=U), symbol.astype(np.int64)
            count = np.bincount((pairs[0] & U(255)).astype(np.int64), pairs[1], 256)
        contexts, of_cell = np.unique(cells >> U(8), return_inverse=True)
        seen = np.bincount(of_cell, count, len(contexts))
        kinds = np.bincount(of_cell, count > 0, len(contexts))
        here = of_cell[of_gram]
        t, s = seen[here], kinds[here]
        if above is not None:  # leave out what the longer context has
            cell, of_cell_above, count_above, contexts_above, here_above = above
            shorter = ((cell >> U(16)) << U(8)) | (cell & U(255)) if d else cell & U(255)
            low = count[np.searchsorted(cells, shorter)] * (count_above > 0)
            t = t - np.bincount(of_cell_above, low, contexts_above)[here_above]
            s = s - np.bincount(of_cell_above, count_above > 0, contexts_above)[here_above]
        hit = (count[of_gram] > 0) & ~done
        total[hit] += np.log10(count[of_gram][hit] / (t + s)[hit])
        done |= hit
        miss = ~done & (s > 0)
        total[miss] += np.log10(s[miss] / (t + s)[miss])
        above = (cells, of_cell, count, len(contexts), here)
        if d == 0:
            total[~done] -= np.log10(max(1, SYMBOLS - int((count > 0).sum())))
    out = np.empty(n)
    out[order] = total
    return out


def handed_down(own: np.ndarray, table: Table | None) -> Table:
    """The table's cells, and their counts, of the contexts that `own` cells have."""
    if table is None:
        return np.zeros(0, U), np.zeros(0)
    here = np.isin(table[0] >> U(8), own >> U(8))
    return table[0][here], table[1][here]


def score_chunk(many: int, words: int, tokens: int):
    """Score a chunk's documents with the values that came back."""

    def values_of(table: pa.Table, kind: int, dtype: type, found: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's keys of a kind, listed once more and in order, and their values."""
        keys = distinct(found)
        by = {g: v for n, g, v in zip(*(table.column(c).to_pylist() for c in ("kind", "g", "vals")), strict=True) if n == kind}
        out = np.empty(len(keys))
        out[np.argsort(groups_of(keys, many), kind="stable")] = np.concatenate([np.zeros(0, dtype), *(restored(by[g], dtype) for g in sorted(by))])
        return keys, out

    def run(pieces: pa.Table, table: pa.Table) -> pa.Table:
        docs = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in pieces.column("docs").to_pylist())
        texts = docs.column("text").to_pylist()
        n = len(texts)
        scores, base, known, sizes_ = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        keys, lp = values_of(table, 0, np.float32, (sorted_runs(parts)[0] for _, parts in segments(texts)))
        for at, parts in segments(texts):
            k, run_, part = sorted_runs(parts)
            scores += np.bincount(np.array(at)[part], lp[np.searchsorted(keys, k)][run_], n)
        cache: dict[bytes, int] = {}
        keys, counts = values_of(table, 1, np.uint32, (hashes for _, hashes, _ in word_runs(texts, cache)))
        for at, hashes, sizes in word_runs(texts, cache):
            distinct, which = np.unique(hashes, return_inverse=True)
            count = counts[np.searchsorted(keys, distinct)][which]
            doc = np.repeat(np.array(at), sizes)
            base += np.bincount(doc, np.log10((count + 1) / (tokens + words + 1)), n)
            known += np.bincount(doc, count > 0, n).astype(np.int64)
            sizes_[at] = sizes
        return pa.table([docs.column("id"), docs.column("train"), pa.array(sizes_), pa.array(known), pa.array(np.full(n, tokens, np.int64)), pa.array(base), pa.array(scores)], names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def cells_of(grams: DataFrame, cell: Column) -> Table:
    """Cells that occur in training texts, in order, and their counts."""
    rows = grams.where("c > 0").groupBy(cell.alias("cell")).agg(F.sum("c").alias("c")).orderBy("cell").collect()
    return np.array([r["cell"] for r in rows], U), np.array([r["c"] for r in rows], float)


# --- operator -----------------------------------------------------------------


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of each row.

    `train` marks the rows that the model learns from; all rows are scored with
    what was learned from all of those. score is the log10 probability of the
    text's bytes and its end; base_score that of its words by their counts plus
    one.

    Null text counts as empty, of which only the end is scored. With no
    training rows every byte has the same chance. Repeated rows are each
    counted and scored. An empty table gives no rows. Other columns are not
    carried, so their names can't clash.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = chunks_for(rows, "text", chunk_bytes)
    many = max(64, 1 << (chunks - 1).bit_length())  # hash groups: at least as many as chunks, and enough for small inputs to be spread
    id_type = rows.schema["id"].dataType.simpleString()

    # The texts are read once; after that their compressed pieces stand in for them.
    listing = durable(rows.mapInArrow(list_chunks(many, chunk_bytes), LISTING), folder, "listing")
    of_kind = lambda k, *c: listing.where(F.col("kind") == k).select(*c)
    words = durable(of_kind(1, "chunk", "g", "keys", "counts").groupBy("g").applyInArrow(count_words, WORD_VALUES), folder, "words")
    sums = words.agg(F.sum("known"), F.sum("tokens")).first()
    known, tokens = (int(n or 0) for n in sums)

    counted = durable(of_kind(0, "g", "keys", "counts").groupBy("g").applyInArrow(count_grams, "g int, k bigint, c bigint"), folder, "grams")
    # Contexts are dealt by their last two bytes, and by their last three where the two have very many grams.
    two = F.shiftright("k", 8 * (ORDER - 1))
    hot = durable(counted.groupBy(two.alias("two")).agg(F.count("*").alias("n")).where(F.col("n") > GROUP_GRAMS // 4).select("two"), folder, "hot")  # at most 2 ** 16 rows
    dealt = counted.withColumn("two", two).join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "two", "left")
    symbol = F.col("k").bitwiseAND(F.lit(255))
    low = cells_of(counted, F.shiftright("k", 8 * ORDER) * 256 + symbol)  # at most 2 ** 16 rows
    split = cells_of(dealt.where("is_hot"), F.col("two") * 256 + symbol)  # at most 256 rows a hot context
    parts = max(1, math.ceil(counted.count() / GROUP_GRAMS))
    shared = spark.sparkContext.broadcast((low, split))

    def model(table: pa.Table) -> pa.Table:
        lp = log_probabilities(table.column("k").to_numpy().view(U), table.column("c").to_numpy(), *shared.value)
        return pa.table({"g": table.column("g"), "k": table.column("k"), "lp": pa.array(lp)})

    near = dealt.withColumn("part", F.pmod(F.xxhash64(F.when(F.col("is_hot"), F.shiftright("k", 8 * (ORDER - 2))).otherwise(F.col("two"))), F.lit(parts * 4))).select("g", "k", "c", "part")
    modelled = durable(near.groupBy("part").applyInArrow(model, "g int, k bigint, lp double"), folder, "model")
    back = modelled.groupBy("g").cogroup(of_kind(0, "g", "chunk", "keys").groupBy("g")).applyInArrow(hand_back, VALUES)
    values = back.union(words.select("chunk", "kind", "g", "vals"))
    done = of_kind(DOCS, "chunk", "docs").groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(score_chunk(many, known, tokens), f"id {id_type}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return done.withColumnRenamed("id", id_col)
