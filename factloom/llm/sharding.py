"""Minimax contiguous sharding of atomic groups.

Groups (equal texts, here) stand in the order of a 64-bit digest of the text.
The smallest capacity with which a greedy walk over the groups fills no more
than the wanted number of shards is found by binary search over running sums.

The groups may be very many, so the search begins with bins of groups: those
that share a digest's first bits, 65,536 at most. With bins that are never cut
it gives a capacity that is enough; with bins that may be cut anywhere, one
that is the least conceivable. A bin in which no greedy walk between the two
can end is never looked into; the few others are opened into finer bins, down
to single groups, until both capacities are the same, which is then the
smallest for groups. What reaches the driver is the sums of those bins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import durable, shared_dir, text_of

#: Bits of the digest that make the first bins, and that each opening adds.
ATOM_BITS, MORE_BITS = 16, 6
#: Rows that are numbered together; a bin of more, such as a large group of copies, is numbered in parts.
PART_ROWS = 500


@dataclass(frozen=True)
class Atom:
    """Groups whose digests begin with the same `bits` bits, `prefix`; `single` if it is one group."""

    prefix: int
    bits: int
    size: int
    single: bool

    @property
    def end(self) -> int:
        """The first digest (unsigned) after it."""
        return (self.prefix + 1) << (64 - self.bits)


def greedy_cuts(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards (as counts of atoms) that a greedy walk makes, or None if an atom or the rest doesn't fit.

    prefix: running sums of the ordered atoms, from 0.
    """
    cuts, at, last = [], 0, len(prefix) - 1
    while at < last:
        if len(cuts) == shards:
            return None
        end = bisect_right(prefix, prefix[at] + capacity) - 1
        if end == at:
            return None
        cuts.append(end)
        at = end
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that is enough for `shards` contiguous shards, and the shards' ends, never more than `shards`."""
    prefix = [0, *accumulate(sizes)]
    low, high = max([0, *sizes]), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, even_cuts(prefix, low, shards)


def even_cuts(prefix: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity, each as near to an even share of the rest as lets the greedy walk still place what follows.

    The walk alone would fill the first shards to the brim and leave its whole slack to the last.
    """
    cuts, at, last = [], 0, len(prefix) - 1
    while at < last:
        left = shards - len(cuts)
        share = prefix[at] + (prefix[-1] - prefix[at]) / left
        brim = bisect_right(prefix, prefix[at] + capacity) - 1
        near = bisect_right(prefix, share) - 1
        ends = sorted({e for e in (near, near + 1) if at < e <= brim}, key=lambda e: abs(prefix[e] - share))
        end = next((e for e in ends if fits(prefix, e, capacity, left - 1)), brim)
        cuts.append(end)
        at = end
    return cuts


def fits(prefix: list[int], at: int, capacity: int, shards: int) -> bool:
    """Whether the greedy walk from atom `at` needs no more than `shards` shards."""
    last = len(prefix) - 1
    while at < last and shards > 0:
        at, shards = bisect_right(prefix, prefix[at] + capacity) - 1, shards - 1
    return at == last


def least_capacity(atoms: list[Atom], shards: int, enough: int) -> int:
    """The smallest capacity for `shards` shards if every atom of several groups could be cut anywhere; at most `enough`."""
    prefix = [0, *accumulate(a.size for a in atoms)]
    low, high = max([0, -(-prefix[-1] // shards), *(a.size for a in atoms if a.single)]), enough
    while low < high:
        mid = (low + high) // 2
        if reach(atoms, prefix, mid, shards)[-1] < prefix[-1]:
            low = mid + 1
        else:
            high = mid
    return low


def reach(atoms: list[Atom], prefix: list[int], capacity: int, shards: int) -> list[int]:
    """How far each shard of a greedy walk can come at most, as sums of sizes, atoms of several groups being cut anywhere."""
    out, at = [], 0
    for _ in range(shards):
        at += capacity
        i = bisect_right(prefix, at) - 1
        if i >= len(atoms):
            at = prefix[-1]
        elif atoms[i].single:
            at = prefix[i]
        out.append(at)
    return out


def open_atoms(atoms: list[Atom], shards: int, low: int, high: int) -> list[int]:
    """Numbers of the atoms of several groups in which a greedy walk with a capacity from low to high may end a shard."""
    prefix = [0, *accumulate(a.size for a in atoms)]
    at, found = 0, set()
    for far in reach(atoms, prefix, high, shards):
        at = prefix[bisect_right(prefix, at + low) - 1]  # at least so far: whole atoms only
        first, last = bisect_right(prefix, at) - 1, bisect_right(prefix, far) - 1
        found.update(i for i in range(first, min(last + 1, len(atoms))) if not atoms[i].single and prefix[i] < far)
    return sorted(found)


def exact_cuts(atoms: list[Atom], shards: int, opened: Callable[[list[Atom]], list[Atom]]) -> tuple[int, list[Atom], list[int]]:
    """The smallest capacity for whole groups, the atoms it was found with, and the shards' ends among them. `opened` gives the parts of some atoms."""
    while True:
        high, cuts = minimax_cuts([a.size for a in atoms], shards)
        low = least_capacity(atoms, shards, high)
        inside = open_atoms(atoms, shards, low, high) if low < high else []
        if not inside:
            return high, atoms, cuts
        closed = set(inside)
        atoms = sorted([a for i, a in enumerate(atoms) if i not in closed] + opened([atoms[i] for i in inside]), key=lambda a: a.end)


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, atom_bits: int = ATOM_BITS) -> DataFrame:
    """Put each row into one of `shards` shards; equal texts stay together and the largest shard is as small as whole groups in this order allow.

    Returns the id column, size (UTF-8 bytes plus `overhead`), text_crc32, shard
    and slot (from 0 without gaps in each shard). Within the capacity the cuts
    are as even as they can be. The search looks into about shards ** 2 bins.

    Null text counts as empty (size `overhead`) and is one group with the empty
    texts. Repeated rows get a slot each. An empty table gives no rows; with
    fewer groups than shards the last shards stay empty. Other columns are not
    carried, so their names can't clash.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = durable(rows, shared_dir(spark), "sizes")  # a few bytes a row; the texts are read once
    first = lambda bits: F.shiftrightunsigned("digest", 64 - bits)

    def atoms_of(some: DataFrame, bits: int) -> list[Atom]:
        single = (F.min("digest") == F.max("digest")).alias("single")
        return [Atom(r["prefix"] % (1 << bits), bits, r["size"], r["single"]) for r in some.groupBy(first(bits).alias("prefix")).agg(F.sum("size").alias("size"), single).collect()]

    def opened(some: list[Atom]) -> list[Atom]:
        out = []
        for bits in sorted({a.bits for a in some}):
            signed = [p - (1 << 64) if bits == 64 and p >= 1 << 63 else p for p in (a.prefix for a in some if a.bits == bits)]
            out += atoms_of(rows.where(first(bits).isin(signed)), min(64, bits + MORE_BITS))
        return out

    _, atoms, cuts = exact_cuts(sorted(atoms_of(rows, atom_bits), key=lambda a: a.end), shards, opened)
    flip = lambda x: x - (1 << 63)  # noqa: E731  unsigned order as signed numbers
    ends = [flip(atoms[c - 1].end) for c in cuts[:-1]]
    ordered = F.col("digest").bitwiseXOR(F.lit(-(1 << 63)))
    number = F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<bigint>"), lambda end: end <= ordered))
    placed = rows.withColumns({"shard": number, "atom": F.shiftrightunsigned("digest", 64 - ATOM_BITS).cast("int")})

    counts = placed.groupBy("shard", "atom").agg(F.count("*").alias("n"))  # at most a row a first bin and shard
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.ceil(F.col("n") / F.greatest(F.lit(PART_ROWS), F.sqrt("n"))).cast("int").alias("parts")
    bases = counts.select("shard", "atom", running(Window.partitionBy("shard").orderBy("atom")).alias("base"), parts)
    dealt = placed.join(F.broadcast(bases), ["shard", "atom"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    sums = dealt.where("parts > 1").groupBy("shard", "atom", "part").agg(F.count("*").alias("n"))  # at most the root of a large bin's rows
    sums = sums.select("shard", "atom", "part", running(Window.partitionBy("shard", "atom").orderBy("part")).alias("part_base"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("shard", "atom", "part").orderBy("row")) - 1).join(sums, ["shard", "atom", "part"], "left")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.coalesce("part_base", F.lit(0)) + F.col("at")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """Write the documents below `path`, one folder a shard, in slot order; ids must be unique here."""
    joined = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    joined.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
