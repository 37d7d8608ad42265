"""Near-duplicate groups by HyperMinHash.

A document is the set of its word shingles, as 64-bit hashes. The set's
signature has REGISTERS registers; a register keeps, of the smallest hash that
falls in its bucket, the number of leading zeros and the next MANTISSA bits.
Bands of ROWS registers make candidates; a Jaccard estimate from the registers,
corrected for chance collisions, drops hopeless ones; links are confirmed on
the full sets. With 73 bands of 7 registers a pair at 0.8 is missed with a
probability of 3e-8, at 0.85 with 5e-13.

Pairs are never listed within a bucket. Equal sets are one class from the
start. Each class is first compared with the smallest class of each of its
buckets, and the confirmed links are joined to components. What can still be
missing is a link between two components that meet in a bucket. The members of
such buckets meet anew by the shingles that linked sets of their sizes must
share: of a set in order of rarity, the first few, and shingles of one component
come before all others, since no missing link has them. So texts that are near
each other but not linked don't meet for what they all have in common. Where
components still meet, pairs across them are compared in blocks of bounded size,
and those come out whose estimate, and for sets of up to SENT_SHINGLES what they
share, reaches the threshold. So groups of copies cost about as many comparisons
as they have members, and no link is lost. To confirm pairs, their sets are sent to units of bounded size that hold related
documents, once a unit and not once a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, durable, shared_dir, text_of

REGISTERS, MANTISSA, ROWS = 512, 10, 7
BANDS = REGISTERS // ROWS
#: Rows that meet by a shingle and are compared with each other in one piece of work.
BLOCK_ROWS = 256
#: Nodes whose ids are sent to all tasks (up to 24 bytes each) to pick their texts; more are joined.
SENT_NODES = 500_000
#: Shingles of a set up to which it goes along to where it is compared; of larger ones only the signature does.
SENT_SHINGLES = 4096
CACHE_WORDS = 150_000
U = np.uint64
#: Registers that an empty one looks at, in its own random order.
TRIES = 48
ORDER = np.random.default_rng(7).integers(0, REGISTERS, (REGISTERS, TRIES))


# --- sets and signatures ----------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, words: int):
        self.words, self.cache = words, {}

    def _hash(self, word: bytes) -> int:
        found = self.cache.get(word)
        if found is None:
            import xxhash

            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            found = self.cache[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of a text's shingles; of fewer words, the whole sequence is one."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, U)
        h = np.fromiter(map(self._hash, words), U, n)
        k = min(self.words, n)
        out = np.full(n - k + 1, U(k))
        for j in range(k):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j])
        return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Signature of sorted hashes: for each bucket 0 if empty, else (leading zeros + 1) and the mantissa of its smallest value."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        bits = REGISTERS.bit_length() - 1
        bucket = (hashes >> U(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        value = (hashes[first] << U(bits)) >> U(11)  # 53 bits, which a double holds exactly
        part, exponent = np.frexp(value.astype(np.float64))
        zeros = 53 - exponent
        out[bucket[first]] = ((zeros + 1) << MANTISSA) | np.where(value > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    return out


def densified(signatures: np.ndarray) -> np.ndarray:
    """Signatures whose empty registers take the value of another: the first filled one in a fixed random order of their own.

    A set with fewer elements than registers would else have bands of one or two values, which
    sets with little in common share.
    """
    out, filled = signatures.copy(), signatures > 0
    row, register = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for t in range(TRIES):
        if not len(row):
            break
        source = ORDER[register, t]
        hit = filled[row, source]
        out[row[hit], register[hit]] = signatures[row[hit], source[hit]]
        row, register = row[~hit], register[~hit]
    for r in np.unique(row):  # very small sets: the next filled register
        at = np.flatnonzero(filled[r])
        own = register[row == r]
        out[r, own] = signatures[r, at[np.searchsorted(at, own) % len(at)]]
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers in which sets of n and m elements agree though they share nothing."""
    a, b = np.asarray(n, float) / REGISTERS, np.asarray(m, float) / REGISTERS
    j = np.arange(54)
    top, width = 2.0**-j, 2.0 ** (-j - 1)
    both = np.maximum(a + b, 1e-300)[..., None]
    return ((a * b / both[..., 0])[..., None] * width / (1 << MANTISSA) * (np.exp(-both * width) - np.exp(-both * top))).sum(-1)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of signatures (rows of x and y) of sets of n and m elements, and the registers they rest on."""
    used = ((x > 0) | (y > 0)).sum(-1)
    same = ((x == y) & (x > 0)).sum(-1)
    lucky = np.minimum(chance(n, m) * REGISTERS, used * 0.5)
    return (same - lucky) / np.maximum(used - lucky, 1e-9), used


def hopeful(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may reach the threshold: by their sizes, and by an estimate not over five standard errors below it."""
    t = percent / 100
    used = ((x > 0) | (y > 0)).sum(-1)
    # Registers sample the united set without replacement: the fuller the sample, the smaller the error.
    left = np.maximum(0.05, 1 - used * (1 + t) / np.maximum(np.asarray(n) + m, 1))
    least = t - 0.01 - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1) * left)
    ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (((x == y) & (x > 0)).sum(-1) >= least * used)
    at = np.flatnonzero(ok)  # the correction only lowers an estimate
    if len(at):
        x, y, n, m = (np.broadcast_to(v, s)[at] for v, s in ((x, (len(ok), REGISTERS)), (y, (len(ok), REGISTERS)), (n, ok.shape), (m, ok.shape)))
        ok[at] = estimate(x, y, n, m)[0] >= least[at]
    return ok


def band_keys(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, key) of each band, of densified signatures in rows."""
    bands = signatures[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), bands.shape[:2])
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + bands[:, :, r])
    row, band = np.nonzero(bands.any(axis=2))
    return row, band, key[row, band].view(np.int64)


# --- steps ------------------------------------------------------------------


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(row, id, digest, n, signature) of (row, id, text); digest null for an empty set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for batch in by_bytes(batches, "text"):
            sets = [make(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("id"),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["row", "id", "digest", "n", "signature"],
            )

    return docs.mapInArrow(each, "row bigint, id bigint, digest binary, n bigint, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """(key, band, node) for each filled band of (node, signature)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                row, band, key = band_keys(densified(matrix(batch.column("signature"))))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(band.astype(np.int32)), batch.column("node").take(pa.array(row))], names=["key", "band", "node"])

    return classes.select("node", "signature").mapInArrow(each, "key bigint, band int, node bigint")


def matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate leaves hope."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = hopeful(matrix(batch.column("sa")), matrix(batch.column("sb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(each, "a bigint, b bigint").distinct()


def units(pairs: DataFrame, folder: str, name: str, unit_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The pairs with a unit (f, i, j) each, and the (uf, ui, uj, node) whose sets the units need.

    Pairs hang together in families. Small families share units by hash; a
    large one is dealt into blocks, and a unit holds the pairs of two blocks.
    """
    family = components(pairs, folder, f"{name}_family")
    sizes = family.groupBy("component").agg((F.count("*") + 1).alias("size"))
    large = durable(sizes.where(F.col("size") > unit_nodes), folder, f"{name}_large")
    shares = max(1, -(-(family.count()) // unit_nodes))
    home = pairs.join(family.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("component", "b").alias("component")).join(large, "component", "left")
    block = lambda x: F.pmod(F.xxhash64(x), F.ceil(F.col("size") / unit_nodes)).cast("int")
    small = F.col("size").isNull()
    home = home.select(
        "a", "b", F.when(small, F.pmod(F.xxhash64("component"), F.lit(shares)) - shares).otherwise(F.col("component")).alias("f"),
        F.when(small, -1).otherwise(F.least(block("a"), block("b"))).alias("i"), F.when(small, -1).otherwise(F.greatest(block("a"), block("b"))).alias("j"),
    )
    home = durable(home, folder, f"{name}_units")
    unit = [F.col("f").alias("uf"), F.col("i").alias("ui"), F.col("j").alias("uj")]
    return home, home.select(*unit, F.col("a").alias("node")).union(home.select(*unit, "b")).distinct()


def confirmed(pairs: DataFrame, rows: DataFrame, words: int, percent: int, folder: str, name: str, unit_nodes: int) -> DataFrame:
    """The pairs whose full sets are alike enough. Texts are shingled anew for the documents in question only."""
    pairs, needed = units(durable(pairs, folder, f"{name}_pairs"), folder, name, unit_nodes)
    wanted = durable(needed.select(F.col("node").alias("row")).distinct(), folder, f"{name}_wanted")
    if wanted.count() <= SENT_NODES:
        wanted = F.broadcast(wanted)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for batch in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([make(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["node", "shingles"])

    sets = rows.join(wanted, "row", "left_semi").select("row", "text").mapInArrow(shingle, "node bigint, shingles binary")

    def verify(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        of: dict[int, list[np.ndarray]] = {}
        for node, x in zip(rows.column("node").to_pylist(), rows.column("shingles").to_pylist(), strict=True):
            of.setdefault(node, []).append(np.frombuffer(x, U))
        ab = zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)
        ok = [any(alike(x, y, percent) for x in of.get(a, ()) for y in of.get(b, ())) for a, b in ab]
        return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sent = needed.join(sets, "node")
    links = pairs.groupBy("f", "i", "j").cogroup(sent.groupBy("uf", "ui", "uj")).applyInArrow(verify, "a bigint, b bigint")
    return durable(links, folder, f"{name}_links")


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p) or 100 * len(p) < percent * len(q):
        return False
    shared = common(p, q)
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def common(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two ascending sets share."""
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, component: smallest node reachable) of every node in links (a, b), by alternating large and small stars.

    The least neighbours are written before they are joined, so that Spark can
    split the edges of a node that has very many.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), folder, f"{name}_0")
    state, step = None, 0
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, step = now, step + 1
        ways = edges.union(edges.select("v", "u"))
        low = durable(ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), folder, f"{name}_{step}_low")
        large = durable(ways.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), folder, f"{name}_{step}_large")
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"{name}_{step}_lower")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).union(low.select("u", F.col("m").alias("v")))
        edges = durable(small.distinct(), folder, f"{name}_{step}")


def across(met: DataFrame, percent: int) -> DataFrame:
    """Hopeful pairs across components from rows (key, i, j, side, small, large, node, component, n, signature, shared), sorted by (key, i, j) within partitions.

    shared: the shingles that other components have too, ascending, or null; two components share no others.
    """

    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, node, part, n, s = (t.column("side").to_numpy(), t.column("node").to_numpy(), t.column("component").to_numpy(), t.column("n").to_numpy(), matrix(t.column("signature")))
        small, large = (t.column(c).to_numpy() for c in ("small", "large"))
        sets = [None if x is None else np.frombuffer(x, np.int64) for x in t.column("shared").to_pylist()]
        left = np.flatnonzero(side <= 0)
        right = np.flatnonzero(side >= 0)
        a, b = [], []
        for x in left:
            y = right[part[right] != part[x]]
            y = y[node[y] > node[x]] if side[x] == 0 else y
            y = y[(small[x] & large[y] & (n[x] <= n[y])) | (large[x] & small[y] & (n[y] <= n[x]))]
            if len(y):
                y = y[hopeful(s[x], s[y], n[x], n[y], percent)]
            if len(y) and sets[x] is not None:
                y = y[[sets[k] is None or (100 + percent) * common(sets[x], sets[k]) >= percent * (n[x] + n[k]) for k in y]]
            if len(y):
                a.append(np.minimum(node[x], node[y]))
                b.append(np.maximum(node[x], node[y]))
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            k = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            if rest and len(k):
                last = tuple(rest[-1].column(c)[-1].as_py() for c in ("key", "i", "j"))
                if tuple(k[0]) != last:
                    yield out(*pairs(pa.concat_tables(rest)))
                    rest = []
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rest.append(t.slice(lo, hi - lo))
                if hi < len(k):
                    yield out(*pairs(pa.concat_tables(rest)))
                    rest = []
        if rest:
            yield out(*pairs(pa.concat_tables(rest)))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.mapInArrow(each, "a bigint, b bigint")


def blocks(members: DataFrame, sizes: DataFrame, classes: DataFrame, block_rows: int) -> DataFrame:
    """Rows of those that meet by a key, each in all pairs (i, j) of blocks that have its block; side: -1 of i, 1 of j, 0 where i = j."""
    rows = members.join(sizes, "key").join(classes, "node")
    many = F.ceil(F.col("size") / block_rows).cast("int")
    rows = rows.withColumn("many", many).withColumn("own", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1)
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "small", "large", "node", "component", "n", "signature", "shared")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def prefix(n: int, shared: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, small, large) by which a set of n shingles meets those that may be linked with it in another component.

    shared: those of its shingles that other components have, rarest first; all
    others come before them. Sets of s <= n shingles that are linked have `o`
    in common, percent * (s + n) / (100 + percent) at least, and so, in one order
    of all shingles, one of the first s - o + 1 of the smaller set is among the
    first n - o + 1 of the larger. A key is a shingle and a range of sizes of the
    smaller set; small and large tell in which of these parts the set may have it.
    """
    least = max(1, -(-percent * n // 100))
    own = n - len(shared)
    at = np.arange(own, max(own, n - least + 1))
    most = np.minimum(n, (100 + percent) * (n - at) // percent - n)  # the largest s for which this place counts
    small = at <= n + (-2 * percent * n // (100 + percent))
    width = max(-np.log(percent / 100) / 5, 1e-3)
    span = lambda s: np.floor(np.log(np.maximum(s, 1)) / width).astype(np.int64)
    keys, smalls, larges = [], [], []
    for k in range(int(span(least)), int(span(n)) + 1):
        large, mine = (most >= least) & (span(most) >= k), small & (k == span(n))
        hit = large | mine
        keys.append(mix(shared[: len(at)][hit] * U(0x9E3779B97F4A7C15) + U(k)))
        smalls.append(mine[hit])
        larges.append(large[hit])
    return np.concatenate(keys), np.concatenate(smalls), np.concatenate(larges)


def meetings(nodes: DataFrame, rows: DataFrame, words: int, percent: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(key, small, large, node, component) of (node, component): what the nodes can be linked by across components; and (node, shared), as `across` takes them."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for batch in by_bytes(batches, "text"):
            sets = [make(t) for t in batch.column("text").to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("node").take(at), batch.column("component").take(at), pa.array(np.repeat(n, n))], names=["shingle", "node", "component", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, part, n, shared in zip(*(batch.column(c).to_pylist() for c in ("node", "component", "n")), batch.column("shared"), strict=True):
                key, small, large = prefix(n, shared.values.to_numpy().view(U), percent)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(small), pa.array(large), pa.array(np.full(len(key), node)), pa.array(np.full(len(key), part))], names=["key", "small", "large", "node", "component"])

    nodes = durable(nodes, folder, "nodes")
    if nodes.count() <= SENT_NODES:
        nodes = F.broadcast(nodes)
    texts = rows.select(F.col("row").alias("node"), "text").join(nodes, "node")
    sets = durable(texts.select("node", "component", "text").mapInArrow(shingle, "shingle bigint, node bigint, component bigint, n bigint"), folder, "elements")
    shared = sets.groupBy("shingle").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high"))
    shared = durable(shared.select("shingle", "many"), folder, "between")
    by = sets.join(shared, "shingle").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("many", "shingle"))).alias("shared"))
    enough = by.where(F.size("shared") * 100 >= F.col("n") * percent).withColumn("shared", F.transform("shared", lambda x: x["shingle"]))
    enough = durable(enough, folder, "enough")

    def ascending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(x.values.to_numpy()).tobytes() if x.is_valid else None for x in batch.column("shared")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shared"])

    sent = enough.select("node", F.when(F.col("n") <= SENT_SHINGLES, F.col("shared")).alias("shared"))
    return enough.mapInArrow(meet, "key bigint, small boolean, large boolean, node bigint, component bigint"), sent.mapInArrow(ascending, "node bigint, shared binary")


# --- operator ---------------------------------------------------------------


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: its group of documents that are linked, directly or through others.

    Texts are lower-cased in A-Z and cut at ASCII white space; documents with
    100 * shared >= percent * united shingles are linked. component_id is the
    smallest id of the group, and kept marks it. Ids are whole numbers, or
    text of such; other ids are an error.

    Null, empty and blank texts have no shingles and are linked with nothing: a
    group of their own. With fewer words than `words` all of them are one
    shingle. Rows that share an id are one document with all their texts. A row
    with a null id is a document of its own; its group is found as any other's,
    component_id is null if no row of it has an id, and it is not kept. An
    empty table gives no rows. Columns other than the two named are not carried.
    """
    folder = shared_dir(docs.sparkSession)
    rows = durable(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")), folder, "rows")
    found = grouped(rows, folder, words=words, percent=percent, block_rows=block_rows)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def grouped(rows: DataFrame, folder: str, *, words: int = 5, percent: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, id, n, component_id, first) of a written table (row, id, text) whose `row` is a key; as near_duplicates, and `first` marks one row of each group.

    That is the row of the smallest id, or of no id where the group has none;
    of several such rows, that with the smallest digest.
    """
    # Equal sets are a class, and so are rows of one id that have no shingles; its node is its smallest row.
    bare = F.concat(F.lit("row without shingles, "), F.coalesce(F.concat(F.lit("id "), F.col("id").cast("string")), F.concat(F.lit("row "), F.col("row").cast("string"))))
    signed = durable(sign(rows, words).withColumn("class", F.coalesce("digest", bare.cast("binary"))).drop("digest"), folder, "signed")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "class", "row"))
    groups = durable(signed.groupBy("class").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("signature").alias("signature"), best.alias("best")), folder, "classes")
    classes = groups.where(F.col("n") > 0).select("node", "n", "signature")

    several = durable(signed.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where(F.col("low") < F.col("high")).select("id", "low"), folder, "several")
    same = signed.join(several, "id").where(F.col("class") > F.col("low")).select("low", "class").distinct()
    same = same.join(groups.select(F.col("class").alias("low"), F.col("node").alias("a")), "low").join(groups.select("class", F.col("node").alias("b")), "class")
    same = durable(same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), folder, "same")

    banded = bands(classes).select("key", "node")
    leaders = durable(banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where(F.col("a") < F.col("z")).select("key", "a"), folder, "leaders")
    shared = durable(banded.join(leaders, "key"), folder, "shared")
    stars = shared.where(F.col("node") > F.col("a")).select("a", F.col("node").alias("b")).distinct()
    links = confirmed(plausible(stars, classes, percent), rows, words, percent, folder, "star", block_rows).union(same)
    found = components(links, folder, "first")

    members = shared.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    members = durable(members, folder, "members")
    several = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high")).select("key")
    several = durable(several, folder, "open")
    met, sent = meetings(members.join(several, "key").select("node", "component").distinct(), rows, words, percent, folder)
    met = durable(met, folder, "met")
    sizes = met.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("small").alias("small"), F.max("large").alias("large"))
    sizes = durable(sizes.where((F.col("low") < F.col("high")) & F.col("small") & F.col("large")).select("key", "size"), folder, "sizes")
    rest = across(blocks(met, sizes, classes.join(sent, "node"), block_rows), percent).distinct()
    more = confirmed(rest, rows, words, percent, folder, "rest", block_rows)
    if not more.isEmpty():
        found = components(links.union(more), folder, "second")

    named = durable(groups.select("class", "node", "best").join(found, "node", "left").select("class", "best", F.coalesce("component", "node").alias("group")), folder, "named")
    tops = durable(named.groupBy("group").agg(F.min("best").alias("top"), F.count("*").alias("size")).where("size > 1").select("group", "top"), folder, "tops")
    named = named.join(tops, "group", "left").select("class", F.coalesce("top", "best").alias("top"))
    named = durable(named.select("class", F.col("top.id").alias("component_id"), F.col("top.row").alias("stays")), folder, "groups")
    return signed.select("row", "id", "n", "class").join(named, "class").select("row", "id", "n", "component_id", (F.col("row") == F.col("stays")).alias("first"))
