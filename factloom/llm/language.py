"""Language identification by compression.

Each language has a raw-content zstandard dictionary, put together from a
bounded sample of labelled texts. A text's words (runs of letters, in lower
case) are cut into blocks, every block is compressed with each dictionary, and
the language whose blocks come out smallest in sum is chosen; a narrow margin
over the second is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, small_batches, widened

#: A word of ASCII letters; any word: letters (Unicode category L) with the marks (M) on them, such as vowel signs.
ASCII_WORD, WORD = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Labelled rows that a fit takes of each language at most, and code points up to which a text is taken whole.
ROWS, WHOLE = 48, 1 << 16
#: Blocks are so short that the dictionary, and not the text before, decides in each of them.
BLOCK = 64
LEVEL = 3
UNDECIDED = "und"


def plain(text: str) -> str:
    """The words of a text, in lower case, with one blank between them."""
    low = text.lower()
    return " ".join((ASCII_WORD if low.isascii() else WORD).findall(low))


def excerpt(text: Column, h: Column, size: int) -> Column:
    """A text of up to `size` code points whole; of a longer one, blocks from places all over it that a hash picks, `size` code points in sum."""
    many, last = max(1, size // BLOCK), F.length(text) - BLOCK
    block = lambda i: F.substring(text, (F.pmod(F.xxhash64(h, i), last + 1) + 1).cast("int"), F.lit(BLOCK))
    return F.when(F.length(text) <= size, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(many)), block), "\n"))


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> dict[str, bytes]:
    """A dictionary for every language in `train`, the commonest language first, from `rows` labelled rows of each.

    Taken are whole distinct texts, those whose hashes are smallest; texts above
    WHOLE code points only where a language has too few others, and then in
    blocks from all over them. Rows without text or language teach nothing, and
    copies of a text count once. `rows` is the fit's one bound: what reaches the
    driver is at most so many texts for each language that there is.
    """
    own = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"), (F.length(F.col(text_col)) > WHOLE).alias("long")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    smallest = Window.partitionBy("lang").orderBy("long", "h")  # ranks are cut within each task first
    hashes = own.select("lang", "long", "h").distinct().withColumn("rank", F.row_number().over(smallest)).where(F.col("rank") <= rows).select("lang", "h")
    picked = own.join(F.broadcast(hashes), ["lang", "h"]).groupBy("lang", "h").agg(F.min(excerpt(F.col("text"), F.col("h"), WHOLE)).alias("part"))
    parts: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "h").collect():
        parts.setdefault(r["lang"], []).append(plain(r["part"]))
    made = {lang: "\n".join(texts).encode("utf-8", "replace") for lang, texts in parts.items()}
    return {lang: made[lang] for lang in sorted(made, key=lambda x: (-counts[x], x))}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.languages, self.compressors = list(dictionaries), []
        for lang in self.languages:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin: how much smaller than the second, as a share of it)."""
        data = plain(text or "").encode("utf-8", "replace")
        if not self.languages or not data:
            return UNDECIDED, 0.0, 0.0
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted(((sum(len(c.compress(b)) for b in blocks), lang) for c, lang in zip(self.compressors, self.languages, strict=True)), key=lambda x: x[0])
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        margin = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], 1 - math.exp(-30 * margin), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", least_margin: float = 0.01) -> DataFrame:
    """Add lang_pred, score, margin and accepted to each row.

    A null text or one without a letter is "und" with score 0 and not accepted,
    and so is every text if no language was learned. Equal sizes go to the
    language that is commoner in training, with score 0. `accepted` says whether the margin
    reaches `least_margin`; the nearest language is reported either way.
    Repeated rows are each judged; columns of docs with the added names are
    replaced.
    """
    added = [("lang_pred", "string"), ("score", "double"), ("margin", "double"), ("accepted", "boolean")]
    kept = docs.drop(*(n for n, _ in added))
    small_batches(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(dictionaries), kept.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in by_bytes(batches, text_col):
            found = [classifier(t) for t in batch.column(text_col).to_pylist()]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            accepted = pa.array([f[0] != UNDECIDED and f[2] >= least_margin for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns, accepted], names=[*names, *(n for n, _ in added)])

    return kept.mapInArrow(judge, widened(kept, *added))
