"""Mixture-controlled packing of token sequences by deficit round-robin.

Each source is a queue of documents. The packer serves the queues in rounds, a
round a window of about `window_tokens` tokens. In every round a queue's credit
grows by its share of the window; it is served whole documents from its head
while the credit covers them, and what is left of the credit is its deficit,
carried to the next window. The documents so ordered stand one behind the
other, and only the ends of the sequences cut them.

After k rounds a queue's credit in sum is its weight times one number V(k) that
all queues share, as all credits grow in step; so a document that ends at place
E of its queue is served in the first round in which weight * V reaches E. When
a queue runs dry its weight leaves and V grows faster: a new phase. There are
at most as many phases as sources with a target, and one more, since the
sources without a target share a weight by their tokens and run dry together.
So any task can tell any document's window from its place in its queue, and the
deficits carry over windows and partitions without one task walking all of them.

Jobs: tokenize into a table in the shared folder (one pass over the texts);
running totals of (partition, queue) give places in queues, and those windows;
running totals over windows, in blocks, give places in the output; one join
brings these to the token ids, which are moved once, and cuts the pieces.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, durable, shared_dir, text_of

#: Windows whose documents are put in order together (about a million tokens).
BLOCK_WINDOWS = 64
#: A credit that lacks less than this share of a round counts as reached: room for rounding.
EVEN = 1e-9


# --- tokens ---------------------------------------------------------------


class Encoder:
    """Token ids of a byte-level BPE vocabulary file (tokenizers JSON), as `tokenizers` gives them without adding special tokens.

    The merge ranks of such a file are its ids, so the faster tiktoken can use
    the same vocabulary. A text that holds a special token's string, and what
    tiktoken can't do (its pattern matcher can give up on a very long run),
    goes to `tokenizers` itself, which is loaded only then.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        letters = byte_letters()
        vocabulary = model["model"]["vocab"]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.special}
        largest = max([0, *vocabulary.values(), *(t["id"] for t in model.get("added_tokens", []))])
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = "<u2" if largest < 1 << 16 else "<u4"

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if any(t in text for t in self.special):
            return self.slow(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # of the matcher; it isn't an Exception and can't be imported
                raise
            return self.slow(text)


# Fixed value: the pre-tokenizer's pattern of the public byte-level BPE vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes themselves, the rest from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, source_col: str, end_id: int) -> DataFrame:
    """(row, id, queue, part, local_start, n_tokens, ids): a key, a document's ids with end_id after them, and its place in its queue within its partition."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(source_col).cast("string")).alias("queue"), text_of(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, served, row = encoder(tokenizer), TaskContext.get().partitionId(), {}, 0
        for batch in by_bytes(batches, "text"):
            starts, counts, blobs = [], [], []
            for q, text in zip(batch.column("queue").to_pylist(), batch.column("text"), strict=True):
                ids = ids_of(text.as_py())
                ids.append(end_id)
                starts.append(served.get(q, 0))
                counts.append(len(ids))
                served[q] = starts[-1] + len(ids)
                blobs.append(np.array(ids, dtype=ids_of.dtype).tobytes())
            keys = (part << 33) + row + np.arange(len(counts))
            row += len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column("id"), batch.column("queue"), pa.array([part] * len(counts), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                names=["row", "id", "queue", "part", "local_start", "n_tokens", "ids"],
            )

    return rows.mapInArrow(encode, f"row bigint, id {id_type}, queue string, part int, local_start bigint, n_tokens bigint, ids binary")


# --- schedule -------------------------------------------------------------


class Schedule:
    """The rounds in closed form, from the totals of the sources with a target and the total of all others.

    targets: shares of a window by source, 1 in sum at most; what they leave is
    shared by the other sources, which come last if nothing is left.
    """

    def __init__(self, totals: Mapping[str, int], targets: Mapping[str, float], others: int, window: int):
        if not all(0 <= share for share in targets.values()) or sum(targets.values()) > 1 + 1e-9:
            raise ValueError("targets are shares of a window: none below 0, and not above 1 in sum")
        self.weights = {q: float(targets[q]) for q, n in totals.items() if n > 0 and targets.get(q, 0) > 0}
        rest = 1 - sum(targets.values())
        self.rest = rest if rest > 1e-9 else 1.0
        late = rest <= 1e-9
        dry = sorted([(totals[q] / w, w) for q, w in self.weights.items()] + ([(others / self.rest, self.rest)] if others and not late else []))
        rounds, virtual, self.phases = 0, 0.0, []
        while dry:
            slope = window / sum(w for _, w in dry)
            self.phases.append((rounds, virtual, slope))
            n = max(1, math.ceil((dry[0][0] - virtual) / slope - EVEN))
            rounds, virtual = rounds + n, virtual + n * slope
            dry = [(at, w) for at, w in dry if at > virtual * (1 + EVEN)]
        self.rest_from = virtual if late else 0.0
        if others and late:
            self.phases.append((rounds, virtual, float(window)))

    def windows(self, virtual_end: np.ndarray) -> np.ndarray:
        """The window in which documents are served that end at these places in V."""
        rounds, starts, slopes = (np.array(x) for x in zip(*self.phases, strict=True))
        p = np.maximum(np.searchsorted(starts, virtual_end, "left") - 1, 0)
        return np.maximum(rounds[p] + np.ceil((virtual_end - starts[p]) / slopes[p] - EVEN).astype(np.int64) - 1, 0)


def served(places: DataFrame, plan: Schedule, others: int) -> DataFrame:
    """(row, queue, q, n_tokens, window_id) of (row, queue, q, n_tokens, total): which window a document of its queue's tokens [q, q + n_tokens) is in."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                end, total = (batch.column("q").to_numpy() + batch.column("n_tokens").to_numpy()).astype(float), batch.column("total").to_numpy()
                weight = np.array([plan.weights.get(q, 0.0) for q in batch.column("queue").to_pylist()])
                own = np.where(weight > 0, end / np.where(weight > 0, weight, 1), plan.rest_from + end / total * others / plan.rest)
                yield batch.select(["row", "queue", "q", "n_tokens"]).append_column("window_id", pa.array(plan.windows(own)))

    return places.mapInArrow(of, "row bigint, queue string, q bigint, n_tokens bigint, window_id bigint")


def before(sums: DataFrame, key: str, wide: int = 4096) -> DataFrame:
    """(key, base): the sum of n over all smaller keys, in two levels, so that no task has all keys."""
    sums = sums.withColumn("wide", F.floor(F.col(key) / wide))
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy("wide").agg(F.sum("n").alias("n")).select("wide", running(Window.orderBy("wide")).alias("top"))
    return sums.join(tops, "wide").select(key, (F.col("top") + running(Window.partitionBy("wide").orderBy(key))).alias("base"))


def tail_cuts(total: int, sequence: int) -> list[int]:
    """Where the sequences after the full ones begin and end: at powers of two, which need no padding."""
    cuts = [total // sequence * sequence]
    for bit in reversed(range(max(1, sequence).bit_length())):
        if (total - total // sequence * sequence) >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    return cuts


def pieces(place: np.ndarray, n: np.ndarray, sequence: int, tail: list[int]) -> tuple[np.ndarray, ...]:
    """(document number, start, length, sequence, offset) of the pieces of documents that have the places [place, place + n) of the output."""
    low, high = place // sequence + 1, (place + n - 1) // sequence
    many = np.maximum(0, high - low + 1)
    which = np.repeat(np.arange(len(place)), many)
    docs, begins = [np.arange(len(place)), which], [place, (low[which] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * sequence]
    for t in tail[1:-1]:
        docs.append(np.flatnonzero((place < t) & (place + n > t)))
        begins.append(np.full(len(docs[-1]), t))
    doc, begin = np.concatenate(docs), np.concatenate(begins)
    order = np.lexsort((begin, doc))
    doc, begin = doc[order], begin[order]
    last = np.append(doc[1:] != doc[:-1], True)
    length = np.where(last, (place + n)[doc], np.append(begin[1:], 0)) - begin
    number, offset = begin // sequence, begin % sequence
    late = begin >= tail[0]
    k = np.searchsorted(np.array(tail), begin[late], side="right") - 1
    number[late], offset[late] = tail[0] // sequence + k, begin[late] - np.array(tail)[k]
    return doc, begin - place[doc], length, number, offset


# --- operator -------------------------------------------------------------


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    sequence_tokens: int = 1024,
    window_sequences: int = 16,
    targets: Mapping[str, float] | None = None,
    end_id: int = 0,
) -> DataFrame:
    """Pack all documents into sequences of at most `sequence_tokens` tokens.

    One row a piece: the id column, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset, window_id, queue.
    A mixture window is worth `window_sequences` sequences. `targets` gives
    shares of a window by source; what they leave of 1 goes to the sources
    without a target by their own token shares (all of it by default), and if
    they leave nothing those come after the others. A source has its share of
    all windows so far to within one document, until a source runs dry, when
    the rest share the windows in proportion.

    Null text counts as empty: it has end_id alone. A null source is the queue
    "". Repeated rows are packed each. An empty table gives no rows. A target
    of a source that isn't there takes no room. Columns other than the three
    named are not carried, so their names can't clash.
    """
    spark, targets = docs.sparkSession, dict(targets or {})
    folder, window = shared_dir(spark), sequence_tokens * window_sequences
    tokens = durable(tokenize(docs, tokenizer, id_col, text_col, source_col, end_id), folder, "tokens")
    sums = durable(tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n")), folder, "sums")
    aimed = F.col("queue").isin(*(q for q, share in targets.items() if share > 0))
    totals = {r["queue"]: r["n"] for r in sums.where(aimed).groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most a row a target
    others = int(sums.where(~aimed).agg(F.sum("n")).first()[0] or 0)
    total = sum(totals.values()) + others
    plan, tail = Schedule(totals, targets, others, window), tail_cuts(total, sequence_tokens)

    queue = Window.partitionBy("queue")
    bases = sums.select("part", "queue", F.coalesce(F.sum("n").over(queue.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(queue).alias("total"))
    places = tokens.select("row", "queue", "part", "local_start", "n_tokens").join(bases, ["part", "queue"]).select("row", "queue", (F.col("base") + F.col("local_start")).alias("q"), "n_tokens", "total")
    windows = durable(served(places, plan, others).withColumn("block", F.floor(F.col("window_id") / BLOCK_WINDOWS)), folder, "windows")
    starts = before(windows.groupBy("block").agg(F.sum("n_tokens").alias("n")), "block")
    order = Window.partitionBy("block").orderBy("window_id", "queue", "q").rowsBetween(Window.unboundedPreceding, -1)
    placed = windows.withColumn("within", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(starts, "block").select("row", "window_id", (F.col("base") + F.col("within")).alias("place"))
    id_type = tokens.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "ids"):
            n = batch.column("n_tokens").to_numpy()
            doc, start, length, number, offset = pieces(batch.column("place").to_numpy(), n, sequence_tokens, tail)
            ids = batch.column("ids").cast(pa.large_binary())
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            width = (int(ends[-1]) - int(ends[0])) // int(n.sum())
            flat = np.frombuffer(ids.buffers()[2], f"<u{width}", int(n.sum()), int(ends[0])).astype("<u4")
            at = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(flat)])
            taken = [batch.column(c).take(pa.array(doc)) for c in ("id", "n_tokens", "window_id", "queue")]
            yield pa.RecordBatch.from_arrays(
                [taken[0], pa.array(start), pa.array(length), blobs, taken[1], pa.array(number), pa.array(offset), *taken[2:]],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window_id", "queue"],
            )

    out = tokens.select("row", "id", "queue", "n_tokens", "ids").join(placed, "row")
    out = out.mapInArrow(cut, f"id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, window_id bigint, queue string")
    return out.withColumnRenamed("id", id_col)
