"""Mixing sources to target weights, with DataFrame functions only.

Each source is one stream of words: its documents in the order of a hash. The
stream is cut into blocks of so many words, and a source's quota is how many
blocks its target comes to, the last one in part; a source that is wanted more
than once gives all its blocks again.

Which output shard gets how many blocks of each source is drawn by a splitting
tree. The root has all quotas; each node deals its shards into two halves and
draws how many blocks of each source the left half gets, as if it took them
blindly from an urn with all of the node's blocks (a multivariate
hypergeometric draw, source by source); the right half gets the rest. So every
shard is a fair sample of the mix, shards differ by one block at most, and the
sums over all shards are the quotas exactly. A source's blocks, permuted, then
go to the shards in turn, to each as many as it drew. No block is moved to find
this out: a document's blocks, their ranks and shards follow from its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import durable, let, shared_dir, text_of

#: Words of a block, shards of the output.
BLOCK_WORDS, SHARDS = 256, 64
#: Tries of a draw; each is taken with a chance of a fifth at least, so that all fail once in 10^12 draws (which then take the likeliest count).
TRIES = 128
#: Multipliers of the permutation, all prime: at least one doesn't divide the number of blocks.
MULTIPLIERS = (1_000_003, 999_983, 999_979, 999_961)
#: Bits of a hash that make the first bins of a source's rows; rows of a second bin.
COARSE_BITS, BIN_ROWS = 10, 512
WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space, with no list of them: each, with the blanks after it, becomes one letter."""
    return F.length(F.regexp_replace(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), WORD, "x")).cast("long")


# --- draws ------------------------------------------------------------------


def uniform(*key: Column) -> Column:
    """A number between 0 and 1 that depends on the key alone."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def log_factorial(n: Column) -> Column:
    """ln n!, exact below 21, by Stirling's series beyond (to 10^-12)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def hypergeometric(good: Column, bad: Column, sample: Column, key: list[Column]) -> Column:
    """How many of `sample` balls drawn from an urn of good and bad ones are good; `key` is what chance depends on.

    By rejection from a hat that is flat around the likeliest count and falls off
    exponentially, which covers any log-concave law.
    """
    urn = let(F.struct((good + bad).alias("all"), F.least(good, bad).alias("few"), F.least(sample, good + bad - sample).alias("drawn"), good.alias("good"), bad.alias("bad"), sample.alias("sample")), lambda u: drawn(u, key))
    return F.when((sample == 0) | (good == 0), F.lit(0).cast("long")).when(bad == 0, sample).when(sample == good + bad, good).otherwise(urn)


def drawn(u: Column, key: list[Column]) -> Column:
    """A draw of u.drawn balls, u.few of u.all being of the rarer kind; turned back to good balls in u.sample."""
    mode = F.floor((u["drawn"] + 1).cast("double") * (u["few"] + 1) / (u["all"] + 2)).cast("long")
    ways = lambda x: -log_factorial(x) - log_factorial(u["few"] - x) - log_factorial(u["drawn"] - x) - log_factorial(u["all"] - u["few"] - u["drawn"] + x)

    def tried(c: Column) -> Column:
        """c: mode, the log of its ways, its chance."""

        def attempt(state: Column, t: Column) -> Column:
            r = [uniform(*key, t, F.lit(i)) for i in range(4)]
            width = 1 + c["chance"] / 2
            far = F.when(r[0] <= width / (1 + width), r[1] * width / c["chance"]).otherwise((width - F.log(r[1])) / c["chance"])
            jump = lambda y: F.rint(y).cast("long") * F.when(r[2] < 0.5, -1).otherwise(1)

            def judged(x: Column) -> Column:
                hat = F.log(r[3]) + F.least(F.lit(0.0), width - c["chance"] * x["y"])
                inside = (x["at"] >= 0) & (x["at"] <= F.least(u["few"], u["drawn"])) & (x["at"] >= u["drawn"] + u["few"] - u["all"])
                return F.when(inside & (hat <= F.when(inside, ways(x["at"]) - c["ways"]).otherwise(F.lit(0.0))), x["at"]).otherwise(F.lit(-1).cast("long"))

            return F.when(state >= 0, state).otherwise(let(far, lambda y: let(F.struct(y.alias("y"), (c["mode"] + jump(y)).alias("at")), judged)))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(-1).cast("long"), attempt)
        return let(found, lambda x: F.when(x >= 0, x).otherwise(c["mode"]))

    def with_chance(m: Column) -> Column:
        whole = log_factorial(u["few"]) + log_factorial(u["all"] - u["few"]) + log_factorial(u["drawn"]) + log_factorial(u["all"] - u["drawn"]) - log_factorial(u["all"])
        return let(ways(m), lambda w: let(F.struct(m.alias("mode"), w.alias("ways"), F.exp(w + whole).alias("chance")), tried))

    few = let(mode, with_chance)
    good = lambda z: F.when(u["good"] <= u["bad"], z).otherwise(u["drawn"] - z)
    return let(few, lambda z: F.when(u["sample"] == u["drawn"], good(z)).otherwise(u["good"] - good(z)))


def left_share(quota: Column, sample: Column, node: Column, seed: int) -> Column:
    """Of a node's blocks of each source, those among `sample` that are drawn blindly."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.aggregate(quota, F.lit(0).cast("long"), lambda s, x: s + x).alias("rest"), sample.alias("sample"), none.alias("out"))

    def draw(state: Column, own: Column) -> Column:
        taken = hypergeometric(own, state["rest"] - own, state["sample"], [F.lit(seed), node, F.size(state["out"])])
        return let(taken, lambda t: F.struct((state["rest"] - own).alias("rest"), (state["sample"] - t).alias("sample"), F.concat(state["out"], F.array(t)).alias("out")))

    return F.aggregate(quota, start, draw, lambda s: s["out"])


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, quota): one row (quota: blocks of each source) split down to one row a shard."""
    total = F.aggregate("quota", F.lit(0).cast("long"), lambda s, x: s + x)
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), F.lit(0).alias("first"), F.lit(shards).alias("many"), total.alias("total"), "quota")
    before = lambda shard: F.expr(f"CAST(CAST(total AS DECIMAL(19,0)) * ({shard}) AS DECIMAL(38,0)) div {shards}")  # noqa: E731  blocks of the shards before this one
    for _ in range((shards - 1).bit_length()):
        sample = before("first + many div 2") - before("first")
        child = lambda node, first, many, quota: F.struct(node.alias("node"), first.cast("int").alias("first"), many.cast("int").alias("many"), F.col("total"), quota.alias("quota"))
        half = F.expr("many div 2")
        two = let(left_share(F.col("quota"), sample, F.col("node"), seed), lambda left: F.array(child(F.col("node") * 2, F.col("first"), half, left), child(F.col("node") * 2 + 1, F.col("first") + half, F.col("many") - half, F.zip_with("quota", left, lambda q, x: q - x))))
        leaf = F.array(child(F.col("node"), F.col("first"), F.col("many"), F.col("quota")))
        nodes = nodes.select(F.inline(F.when(F.col("many") > 1, two).otherwise(leaf)))
    return nodes.select(F.col("first").alias("shard"), "quota")


# --- targets ----------------------------------------------------------------


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row: sources, an array of (number, source, size, weight, target), in the order of their code points, null last.

    Weights repeat along the sources. A target is the source's share of all
    words by weight, `most` times its size at most; what is cut goes to the
    others by weight, so that each has the same number of words to a weight,
    unless it is at its limit. That level is found by walking the sources in
    the order in which they reach their limits.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "size")))
    weight = F.array(*map(F.lit, weights))
    rows = sizes.agg(ordered.alias("s")).select(F.transform("s", lambda x, i: F.struct(i.cast("int").alias("number"), x["source"].alias("source"), x["size"].alias("size"), F.get(weight, i % len(weights)).cast("double").alias("weight"))).alias("s"))
    limits = F.sort_array(F.transform("s", lambda x: F.struct((most * x["size"] / x["weight"]).alias("reached"), (most * x["size"]).cast("double").alias("limit"), x["weight"].alias("weight"))))
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["size"])
    weights_ = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["weight"])
    start = F.struct(total.alias("left"), weights_.alias("weight"), F.lit(None).cast("double").alias("level"))

    def walk(state: Column, x: Column) -> Column:
        level = state["left"] / state["weight"]
        stop = F.struct(state["left"].alias("left"), state["weight"].alias("weight"), level.alias("level"))
        on = F.struct((state["left"] - x["limit"]).alias("left"), (state["weight"] - x["weight"]).alias("weight"), F.lit(None).cast("double").alias("level"))
        return F.when(state["level"].isNotNull(), state).when(level <= x["reached"], stop).otherwise(on)

    level = F.aggregate(limits, start, walk, lambda s: s["level"])
    target = lambda x, at: F.when(at.isNull(), (most * x["size"]).cast("double")).otherwise(F.least((most * x["size"]).cast("double"), at * x["weight"]))
    return rows.select(let(level, lambda at: F.transform("s", lambda x: F.struct(x["number"], x["source"], x["size"], x["weight"], target(x, at).alias("target")))).alias("sources"))


def quotas_of(sizes: DataFrame, weights: tuple[int, ...], most: int, block: int, shards: int, seed: int, folder: str) -> DataFrame:
    """(number, source, source_size, target, words, blocks, rounds, rest, step, ends): a row for each source.

    words: what is taken; rounds: how often the whole source is; rest: words
    beyond that; step: the permutation's multiplier; ends: blocks taken by the
    end of each shard.
    """
    parts = source_targets(sizes, weights, most).select(F.inline("sources"))
    parts = parts.select("number", "source", F.col("size").alias("source_size"), "target", F.least(F.rint("target").cast("long"), most * F.col("size")).alias("words"))
    parts = parts.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    parts = parts.withColumns({"rounds": F.expr("coalesce(words div nullif(source_size, 0), 0)"), "rest": F.coalesce(F.col("words") % F.nullif(F.col("source_size"), F.lit(0)), F.lit(0)).cast("long")})
    full = F.greatest(F.col("blocks") - 1, F.lit(1))
    parts = parts.withColumn("step", F.coalesce(*(F.when(full % p != 0, F.lit(p)) for p in MULTIPLIERS)))
    parts = durable(parts.withColumn("quota", F.col("rounds") * F.col("blocks") + F.expr(f"(rest + {block - 1}) div {block}")), folder, "targets")
    urn = parts.agg(F.sort_array(F.collect_list(F.struct("number", "quota"))).alias("q")).select(F.col("q.quota").alias("quota"))
    dealt = split(urn, shards, seed).select("shard", F.posexplode("quota").alias("number", "n")).groupBy("number").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("n"))
    ends = F.transform("n", lambda x, i: F.aggregate(F.slice("n", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, y: s + y["n"]))
    return durable(parts.join(dealt.select("number", ends.alias("ends")), "number"), folder, "quotas")


# --- operator ---------------------------------------------------------------


def in_place(rows: DataFrame, many: int) -> DataFrame:
    """rows (number, h, id, size) with `start`: the words of their source before them, in the order of h.

    Sums by bins of h, in two levels, come first; a task orders one small bin at
    a time, however much one source has.
    """
    fine_bits = max(0, min(32, (many // (BIN_ROWS << COARSE_BITS)).bit_length()))
    binned = rows.withColumns({"coarse": F.shiftrightunsigned("h", 64 - COARSE_BITS).cast("int"), "fine": F.shiftrightunsigned("h", 64 - COARSE_BITS - fine_bits).bitwiseAND(F.lit((1 << fine_bits) - 1))})
    before = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = binned.groupBy("number", "coarse", "fine").agg(F.sum("size").alias("words"))
    coarse = fine.groupBy("number", "coarse").agg(F.sum("words").alias("words")).withColumn("coarse_base", before(Window.partitionBy("number").orderBy("coarse"))).drop("words")
    bases = fine.withColumn("fine_base", before(Window.partitionBy("number", "coarse").orderBy("fine"))).join(coarse, ["number", "coarse"])
    bases = bases.select("number", "coarse", "fine", (F.col("fine_base") + F.col("coarse_base")).alias("base"))
    running = F.sum("size").over(Window.partitionBy("number", "coarse", "fine").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return binned.withColumn("running", running).join(bases, ["number", "coarse", "fine"]).withColumn("start", F.col("base") + F.col("running"))


def pieces_of(block: int) -> Column:
    """The pieces of a document that the mix takes: (round, block, rank, shard, first, words), first in words of the document."""
    last = F.col("blocks") - 1  # the last block, which may be short, keeps its place at the end
    rank = lambda b: F.when(b == last, b).otherwise((b * F.col("step")) % F.greatest(last, F.lit(1)))
    begin = lambda b: F.greatest(F.col("start"), b * block)
    shard = lambda v: F.size(F.filter("ends", lambda e: e <= v))

    def of_block(b: Column) -> Column:
        def of_round(k: Column, r: Column) -> Column:
            whole = F.least(F.col("start") + F.col("size"), (b + 1) * block)
            part = F.least(whole, b * block + F.greatest(F.col("rest") - r * block, F.lit(0)))  # of the round in which not all is taken
            words = F.greatest(F.when(k < F.col("rounds"), whole).otherwise(part) - begin(b), F.lit(0))
            place = k * F.col("blocks") + r
            return F.struct(k.cast("int").alias("round"), b.alias("block"), place.alias("rank"), shard(place).alias("shard"), (begin(b) - F.col("start")).alias("first"), words.alias("words"))

        return let(rank(b), lambda r: F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("rounds")), lambda k: of_round(k, r)), lambda x: x["words"] > 0))

    ends = F.expr(f"(start + size - 1) div {block}")
    empty = F.array().cast("array<struct<round:int,block:bigint,rank:bigint,shard:int,first:bigint,words:bigint>>")
    return F.when(F.col("size") > 0, F.flatten(F.transform(F.sequence(F.expr(f"start div {block}"), ends), of_block))).otherwise(empty)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Decide what a mix of as many words as all documents have takes of each document, and where to.

    Sources, in the order of their code points with null last, weigh `weights`,
    repeating; no target is above `most` times its source's words. Returns the
    id column, source, size (words between ASCII white space), source_size,
    target, taken (words, repeats counted), and pieces: (round, block, rank,
    shard, first, words), in rounds from 0. A source gives its target, rounded
    to a word, exactly; a document gives `most` times its size at most. Reruns
    agree, whatever the partitions, as long as ids tell rows apart.

    Null and empty texts have size 0 and no pieces. Null is a source of its own.
    Rows of one id and text are given one after the other, in any order; each
    has a row of the result. A source without words has target 0; an empty table
    gives no rows. Other columns are not carried, so their names can't clash.
    The sources' numbers and quotas (not their rows) are held in one row.
    """
    if most < 1 or block_words < 1 or shards < 1 or min(weights, default=0) < 1:
        raise ValueError("weights, most, block_words and shards must be 1 or more")
    folder = shared_dir(docs.sparkSession)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"))
    rows = durable(rows, folder, "sizes")  # the texts are read once
    sizes = durable(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), folder, "sources")
    quotas = quotas_of(sizes.select("source", "size"), weights, most, block_words, shards, seed, folder)
    many = sizes.agg(F.sum("n")).first()[0] or 0
    known = rows.join(quotas.select("source", "number").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = in_place(known, many).join(quotas.drop("source"), "number").withColumn("pieces", pieces_of(block_words))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "pieces")


def write_mix(docs: DataFrame, mixed: DataFrame, path: str, *, seed: int = 12, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the pieces' words below `path`, a folder a shard, each shuffled by a hash; ids must be unique here."""
    pieces = mixed.select(id_col, "source", F.explode("pieces").alias("piece")).select(id_col, "source", "piece.*")
    words = F.regexp_extract_all(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    joined = pieces.join(docs.select(id_col, words.alias("all_words")), id_col)
    cut = F.array_join(F.slice("all_words", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    out = joined.select("shard", F.xxhash64(F.lit(seed), "shard", "source", "rank", id_col).alias("order"), id_col, "source", "rank", "first", cut.alias("text"))
    out.repartition("shard", F.shiftrightunsigned("order", 58)).sortWithinPartitions("shard", "order").write.partitionBy("shard").parquet(path)
