"""Token counts by a unigram tokenizer's Viterbi, without tokens.

The rules are those of the `tokenizers` library's Unigram model behind a
Metaspace pre-tokenizer: spaces become "▁", which begins each word and the text;
a word's segmentation has the greatest sum of piece scores; of equal sums the
one whose last piece begins first wins; a character without a piece of its own
may be unknown at the lowest score less 10, and counts as its UTF-8 bytes (or,
where the vocabulary has no byte pieces, as one with the unknown ones beside it). An
Aho-Corasick automaton lists, for every end in a word, the pieces that end
there, the longest first, and one pass carries the best score and its number of
pieces. No segmentation is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, small_batches, widened

# The word mark, and what an unknown character costs below the lowest score.
MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a worker remembers; when full, it starts anew.
CACHE_WORDS = 250_000


def zipf_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces of a public sentencepiece file with log probabilities by Zipf's law over their ranks (its own scores are ranks)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    total = math.log(sum(1 / (i + 1) for i in range(n)))
    return [(sp.id_to_piece(i), -math.log(i + 1) - total) for i in range(n)]


class Counter:
    """Counts pieces of words of a unigram vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                scores[piece] = score
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.fallback = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.empty, self.cache = not scores, {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of one word."""
        n = len(word)
        best, count, strange = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        end, single = 0, True
        for last, (length, score) in () if self.empty else self.automaton.iter(word):
            while end <= last:  # all pieces that end at `end` have been seen
                if not single:
                    self._unknown(word, end, best, count, strange)
                end, single = end + 1, False
            start = end - length
            candidate = best[start] + score
            if candidate > best[end]:
                best[end], count[end], strange[end] = candidate, count[start] + 1, False
            single = single or length == 1
        while True:
            if not single:
                self._unknown(word, end, best, count, strange)
            if end == n:
                break
            end, single = end + 1, False
        return count[n], best[n]

    def _unknown(self, word: str, end: int, best: list[float], count: list[int], strange: list[bool]) -> None:
        """The last character as unknown: its bytes, or, without byte pieces, one piece with the unknown ones right before it."""
        candidate = best[end - 1] + self.unknown
        if candidate > best[end]:
            more = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.fallback else int(not strange[end - 1])
            best[end], count[end], strange[end] = candidate, count[end - 1] + more, True

    def text(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text."""
        if not text:
            return 0, 0.0
        words = text.split(" ")
        if MARK in text:
            words = text.replace(" ", MARK).split(MARK)
        if len(words) > 1 and not words[0]:  # the text brings its own first mark
            words = words[1:]
        cache, pieces, score = self.cache, 0, 0.0
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in words:
            found = cache.get(w)
            if found is None:
                found = cache[w] = self.word(MARK + w)
            pieces += found[0]
            score += found[1]
        return pieces, score


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], *, text_col: str = "text") -> DataFrame:
    """Add n_tokens and token_score (sum of the pieces' scores) to each row.

    Null and empty texts have no tokens and score 0. A text of one endless
    word is counted in time linear in its length. Repeated rows are each
    counted. An empty table stays empty. Columns of docs with the added names
    are replaced. The vocabulary (a tokenizer's, so of bounded size) is
    broadcast.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop("n_tokens", "token_score")
    shared, names = docs.sparkSession.sparkContext.broadcast(vocabulary), kept.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in by_bytes(batches, "__text"):
            found = [counter.text(t) for t in batch.column("__text").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, "n_tokens", "token_score"])

    rows = kept.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(count, widened(kept, ("n_tokens", "bigint"), ("token_score", "double")))
