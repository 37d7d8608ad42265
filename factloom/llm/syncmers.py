"""Document fingerprints from closed syncmers, with DataFrame functions only.

A k-mer of the text's UTF-8 bytes is a closed syncmer if the smallest hash of
its inner s-mers is that of its first or of its last one. Whether it is one
depends on the k-mer alone and not on what stands around it, so an edit
touches only the anchors that overlap it, and the others keep their distances.
A fingerprint is a sketch: the anchors with the smallest hashes, each with its
place. Two fingerprints are matched by hash and by place: of the anchors that
both have, those count that lie on the longest run whose places rise in both
texts. So what is put in, taken out or replaced costs its own share, and text
behind it still counts; text that is moved counts on one side of the move.

Texts are cut into pieces of PIECE bytes that overlap by k - 1, and each piece
is sketched by itself, so that a long text needs no long arrays; the anchors,
being free of context, are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import let, text_of

#: Bytes of an anchor and of its inner substrings (five to an anchor), anchors in a sketch, bytes of a piece.
K, S, SKETCH, PIECE = 16, 12, 64, 1 << 13
#: An anchor is one number: 31 bits of its hash above, its place below. No string of Spark's is longer than a place can say.
PLACE_BITS = 31
#: Documents are put in order within ranges of ids; so many ranges at most, of so many rows.
MAX_RANGES, RANGE_ROWS = 1 << 16, 2_000


def pairwise(a: Column, step: int) -> Column:
    """The smaller of each element and the one `step` after it; the last ones stand alone."""
    return F.zip_with(a, F.slice(a, F.lit(step + 1), F.greatest(F.size(a) - step, F.lit(0))), lambda x, y: F.least(x, y))


def packed(hash_: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hash_, PLACE_BITS + 2), PLACE_BITS).bitwiseOR(place.cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def by_piece(data: Column, each: Callable[[Column], Column]) -> Column:
    """each(the anchors of a piece, as packed numbers) for all pieces of binary data of K bytes or more, as an array."""

    def of_piece(first: Column, whole: Column) -> Column:
        return let(F.substring(whole, first, F.lit(PIECE + K - 1)), lambda piece: let(hashes(piece), lambda h: let(pairwise(h, 1), lambda two: let(pairwise(two, 2), lambda four: chosen(h, four, piece, first)))))

    def hashes(piece: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.octet_length(piece) - (S - 1)), lambda i: F.xxhash64(F.substring(piece, i, F.lit(S))))

    def chosen(h: Column, four: Column, piece: Column, first: Column) -> Column:
        # The k-mer at i has the s-mers i to i + 4; four[i] is the smallest of i to i + 3.
        at = F.filter(F.sequence(F.lit(0), F.size(h) - 5), lambda i: (F.get(h, i + 4) <= F.get(four, i)) | (F.get(h, i) <= F.get(four, i + 1)))
        return F.transform(at, lambda i: packed(F.xxhash64(F.substring(piece, i + 1, F.lit(K))), first - 1 + i))

    return let(data, lambda d: F.transform(F.sequence(F.lit(1), F.octet_length(d) - (K - 1), F.lit(PIECE)), lambda first: let(of_piece(first, d), each)))


def short_or(data: Column, many: Column) -> Column:
    """What data too short for a syncmer has: itself as its anchor, or nothing if it is empty; else `many`."""
    none = F.array().cast("array<bigint>")
    return F.when(F.octet_length(data) >= K, many).when(F.octet_length(data) > 0, F.array(packed(F.xxhash64(data), F.lit(0)))).otherwise(none)


def anchors(data: Column) -> Column:
    """All anchors of data; data too short for one is its own anchor, and empty data has none."""
    return short_or(data, F.flatten(by_piece(data, lambda found: found)))


def sketch_of(data: Column) -> Column:
    """The sketch of data, with a sketch of each piece in between and never all anchors at once."""
    return short_or(data, sketch(F.flatten(by_piece(data, sketch))))


def moved(x: Column, by: Column) -> Column:
    """An anchor, `by` bytes further on."""
    return F.shiftleft(F.shiftright(x, PLACE_BITS), PLACE_BITS).bitwiseOR((x + by).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def sketch(found: Column) -> Column:
    """The SKETCH anchors with the smallest hashes, each hash at its first place only."""
    return let(F.sort_array(found), lambda a: F.slice(F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, PLACE_BITS) != F.shiftright(F.get(a, i - 1), PLACE_BITS))), 1, SKETCH))


def as_text(sketched: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits an anchor."""
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common anchors, in common order, among all, from two sketches.

    Of the SKETCH smallest hashes of both together, those in both that lie on
    the longest run whose places rise on either side. Two empty sketches are
    alike (1), an empty and another are not (0).
    """
    bits = PLACE_BITS + 1  # place, and below it whose anchor it is
    key = lambda x: F.shiftright(x, bits)
    place = lambda x: F.shiftright(x, 1).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    both = F.sort_array(F.concat(F.transform(a, lambda x: F.shiftleft(x, 1)), F.transform(b, lambda x: F.shiftleft(x, 1) + 1)))

    def of(c: Column) -> Column:
        first = F.filter(c, lambda x, i: (i == 0) | (key(x) != key(F.get(c, i - 1))))
        last = F.filter(F.sequence(F.lit(1), F.size(c) - 1), lambda i: key(F.get(c, i)) == key(F.get(c, i - 1)))
        return let(F.slice(first, 1, SKETCH), lambda union: shared(c, last, union))

    def shared(c: Column, pairs: Column, union: Column) -> Column:
        most = key(F.element_at(union, -1))
        # Of the two anchors of a hash, that of a has 0 in its last bit.
        own = lambda i: F.when(F.get(c, i - 1).bitwiseAND(F.lit(1)) == 0, F.struct(place(F.get(c, i - 1)).alias("a"), place(F.get(c, i)).alias("b"))).otherwise(F.struct(place(F.get(c, i)).alias("a"), place(F.get(c, i - 1)).alias("b")))
        places = F.sort_array(F.transform(F.filter(pairs, lambda i: key(F.get(c, i)) <= most), own))
        return rising(F.transform(places, lambda x: x["b"])).cast("double") / F.size(union)

    empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(empty, F.lit(1.0)).when(F.size(F.concat(a, b)) < 2, F.lit(0.0)).otherwise(let(both, of))


def rising(values: Column) -> Column:
    """The length of the longest run of values, not necessarily side by side, of which each is greater than the one before.

    At place n of the state stands the least value that such a run of n + 1 values can end with.
    """
    none = F.array().cast("array<bigint>")

    def put(ends: Column, x: Column) -> Column:
        return let(F.size(F.filter(ends, lambda e: e < x)), lambda n: F.concat(F.slice(ends, F.lit(1), n), F.array(x), F.slice(ends, n + 2, F.greatest(F.size(ends) - n - 1, F.lit(0)))))

    return F.size(F.aggregate(values, none, put))


# --- order ----------------------------------------------------------------


def id_ranges(docs: DataFrame, id_col: str) -> Column:
    """The range that a row's id falls in, by approximate quantiles of the ids."""
    ids = docs.select(F.col(id_col).cast("double").alias("id")).where(F.col("id").isNotNull())
    n = ids.count()
    many = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    cuts = ids.approxQuantile("id", [i / many for i in range(1, many)], 1 / (4 * many)) if many > 1 else []
    cuts = sorted({int(c) for c in cuts})
    if not cuts:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(cuts[0] - 1))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= id_), at + step).otherwise(at))


def in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key, range, guest): the rows by ranges of ids, each range with the first row of the next one as its guest (the last: of the first).

    So what follows any row is in its own range, and no task needs them all.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("key", key)
    rows = rows.withColumn("range", id_ranges(rows, "id"))
    lows = sorted((r["range"], r["low"]) for r in rows.groupBy("range").agg(F.min("key").alias("low")).collect())  # at most MAX_RANGES rows
    hosts = spark.createDataFrame([(r, low, lows[i - 1][0]) for i, (r, low) in enumerate(lows)], "range int, key long, host int")
    first = rows.join(F.broadcast(hosts), ["range", "key"]).groupBy("host").agg(F.min("text").alias("text"), F.min("id").alias("id"), F.min("key").alias("key"))
    guests = first.select("id", "text", "key", F.col("host").alias("range"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests)


# --- operator -------------------------------------------------------------


def fingerprint(docs: DataFrame, *, text_col: str = "text", sketch_col: str = "sketch", fingerprint_col: str = "fingerprint") -> DataFrame:
    """Add the sketch (array of packed anchors) and the fingerprint (the same as text) to each row.

    Null counts as empty: no anchors, an empty fingerprint. A text shorter than
    K bytes is its own anchor. Equal texts have equal fingerprints. Repeated
    rows each get theirs; columns with the added names are replaced.
    """
    out = docs.withColumn(sketch_col, sketch_of(text_of(text_col).cast("binary")))
    return out.withColumn(fingerprint_col, as_text(F.col(sketch_col)))


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare the text's with the edited one's and with the next document's.

    Edited: the last floor(n/2) of the n code points are replaced by the first
    as many (or all) of the text of the next document, in ascending order of
    the (whole-number) id; after the last comes the first. Rows of one id are
    in the order of their texts, null ids come first. Null text counts as
    empty; a lone row follows itself; an empty table gives no rows.

    Anchors of the kept half are not computed again for the edited text: those
    that lie in it wholly are the same there. Only the last k - 1 kept bytes
    and the new half are searched.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.octet_length(F.substring("text", F.lit(1), F.length("text") - half))
    mask = F.lit((1 << PLACE_BITS) - 1)
    inside = lambda a, n: F.filter(a, lambda x: x.bitwiseAND(mask) + K <= n)
    ranged = in_ranges(docs, id_col, text_col)
    data = F.col("text").cast("binary")
    both = lambda a: F.struct(sketch(a).alias("all"), sketch(inside(a, F.col("kept"))).alias("kept"))
    merged = lambda pieces, n: sketch(F.flatten(F.transform(pieces, lambda x: x[n])))
    long_ = let(by_piece(data, both), lambda pieces: F.struct(merged(pieces, "all").alias("all"), merged(pieces, "kept").alias("kept")))
    own = short_or(data, F.array().cast("array<bigint>"))
    sketched = ranged.withColumn("kept", kept).withColumn("s", F.when(F.octet_length(data) >= K, long_).otherwise(let(own, both)))
    w = Window.partitionBy("range").orderBy("guest", "key", "text")
    rows = sketched.select("*", F.lead("text").over(w).alias("next_text"), F.lead("s.all").over(w).alias("next_sketch")).where(~F.col("guest"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), "kept", "s", "next_sketch", edited.alias("edited"))
    start = F.greatest(F.col("kept") - (K - 1), F.lit(0))
    rest = F.substring(F.col("edited").cast("binary"), start + 1, F.lit((1 << 31) - 1))
    none = F.array().cast("array<bigint>")
    new = F.when(F.octet_length(rest) >= K, F.transform(sketch(F.flatten(by_piece(rest, sketch))), lambda x: moved(x, start))).otherwise(none)
    whole = F.when(F.octet_length("edited") < K, anchors(F.col("edited").cast("binary"))).otherwise(F.concat("s.kept", new))
    rows = rows.withColumn("edited_sketch", sketch(whole))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("s.all")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("s.all"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("s.all"), F.col("next_sketch")).alias("near_next"),
    )
