"""Tables that can be merged into: files that never change, manifests that name them, and a pointer moved last.

    data/<batch>/part-*.parquet    rows; a file is never written to again
    manifests/<batch>/             a row for each file of a version: rows, smallest and largest key, a Bloom filter
    versions/<number>.json         which manifest is that version; the highest number holds

A merge reads only the files that may hold one of its keys (by range, then by
filter), writes their rows anew with the changes, then a manifest, then the next
version's file, which must not exist yet. Whoever stops in between has changed
nothing; of two writers one finds the number taken and starts again from the
version that was first. Readers of a version go on reading its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.tables import saved

#: Rows of a file, bits of a filter a row, bits of one bitmap of Spark's.
FILE_ROWS, ROW_BITS, BITMAP = 1_000_000, 16, 32_768
#: Keys in a file's range beyond which its filter isn't asked: one in 17 that aren't in the file hits it all the same.
SURE = 256
#: How rows meet: what of (old, new) a column takes where the key is in both.
RULES: dict[str, Callable[[Column, Column, T.DataType], Column]] = {
    "replace": lambda old, new, kind: new,
    "keep": lambda old, new, kind: old,
    "update": lambda old, new, kind: F.coalesce(F.nullif(new, F.lit("")) if isinstance(kind, T.StringType) else new, old),
    "add": lambda old, new, kind: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
}


class Conflict(Exception):
    """Another writer has made the next version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # --- files -------------------------------------------------------------

    def _hadoop(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._hadoop("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _publish(self, number: int, content: dict) -> None:
        """Write a version's file under another name, and give it its own if that is free."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        draft, final = self._hadoop(f"versions/.draft-{uuid.uuid4().hex}"), self._hadoop(f"versions/{number:012}.json")
        out = self._fs().create(draft)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without OVERWRITE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, none)
        except Exception as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {number} of {self.path} exists") from e
            raise

    def versions(self) -> list[int]:
        if not self._fs().exists(self._hadoop("versions")):
            return []
        return sorted(int(f.getPath().getName()[:12]) for f in self._fs().listStatus(self._hadoop("versions")) if f.getPath().getName().endswith(".json"))

    def head(self, version: int | None = None) -> dict:
        number = max(self.versions()) if version is None else version
        text = self.spark.read.text(f"{self.path}/versions/{number:012}.json", wholetext=True).first()[0]
        return json.loads(text) | {"version": number}

    # --- versions ------------------------------------------------------------

    def create(self, schema: T.StructType) -> None:
        """An empty version 0; a table that is there already stays as it is."""
        if not self.versions():
            empty = self.spark.createDataFrame([], schema)
            try:
                self._publish(0, {"manifest": self._manifest(self._described(empty, "none", 0)), "schema": schema.json(), "applied": {}})
            except Conflict:
                pass

    def schema(self, head: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(head["schema"]))

    def manifest(self, head: dict) -> DataFrame:
        kind = self.schema(head)[self.key].dataType
        return self.spark.read.schema(_files_schema(kind)).parquet(f"{self.path}/manifests/{head['manifest']}")

    def _manifest(self, files: DataFrame) -> str:
        name = uuid.uuid4().hex
        files.write.parquet(f"{self.path}/manifests/{name}")
        return name

    def read(self, version: int | None = None) -> DataFrame:
        head = self.head(version)
        return self._rows(head, [r["file"] for r in self.manifest(head).select("file").collect()])

    def _rows(self, head: dict, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema(head))
        return self.spark.read.schema(self.schema(head)).parquet(*(f"{self.path}/data/{f}" for f in files))

    def _described(self, rows: DataFrame, batch: str, many: int) -> DataFrame:
        """A row for each file of a batch: name, rows, range of keys, and filter."""
        kind = rows.schema[self.key].dataType
        if not many:
            return self.spark.createDataFrame([], _files_schema(kind))
        own = rows.select(F.col(self.key).alias("key"), F.col("_metadata.file_name").alias("file"))
        sizes = own.groupBy("file").agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).withColumn("bits", F.ceil(F.col("rows") * ROW_BITS / BITMAP) * BITMAP)
        at = F.pmod(F.xxhash64("key"), F.col("bits"))
        parts = own.join(F.broadcast(sizes.select("file", "bits")), "file").select("file", F.col("bits").cast("long"), at.cast("long").alias("at")).mapInArrow(_bitmaps, "file string, number long, bitmap binary")  # sizes: a row a file
        maps = parts.groupBy("file", "number").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        whole = sizes.join(maps.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("number", "bitmap"))).alias("filter")), "file")
        return whole.select(F.concat(F.lit(f"{batch}/"), "file").alias("file"), "rows", "low", "high", "bits", "filter")

    # --- merging ---------------------------------------------------------------

    def touched(self, head: dict, keys: DataFrame) -> list[str]:
        """Files that may hold one of the keys (a column `key`): by range, then by filter if few keys are in range, as many always hit it. Null keys are in none."""
        files = self.manifest(head)
        within = lambda some: keys.join(F.broadcast(some.select("file", "low", "high", "bits")), (F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")))  # noqa: E731  a row a file
        many = {r["file"]: r["n"] for r in within(files).groupBy("file").agg(F.count("*").alias("n")).collect()}
        sure, asked = [f for f, n in many.items() if n > SURE], [f for f, n in many.items() if n <= SURE]
        if not asked:
            return sure
        few = files.where(F.col("file").isin(asked))
        near = within(few).select("file", F.pmod(F.xxhash64("key"), F.col("bits")).alias("at")).distinct()  # SURE rows a file
        number, place = F.floor(F.col("at") / BITMAP), F.col("at") % BITMAP
        byte = F.conv(F.hex(F.substring(F.try_element_at("filter", number), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        hit = near.join(few.select("file", "filter"), "file").where(F.floor(byte / F.pow(F.lit(2), place % 8)).cast("long") % 2 == 1)
        return sure + [r["file"] for r in hit.select("file").distinct().collect()]

    def matching(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The table's rows whose key is among `keys` (a column `key`), from the files that may hold them."""
        head = self.head(version)
        keys = keys.select("key").distinct()
        return self._rows(head, self.touched(head, keys)).join(keys, F.col(self.key) == F.col("key"), "left_semi")

    def merge(self, updates: DataFrame, rule: str = "update", *, newer: str | None = None, gate: Column | None = None, batch: tuple[str, int] | None = None, tries: int = 5, before: Callable[[DataFrame, DataFrame], None] | None = None) -> int:
        """Merge rows into the table and return the version that has them.

        rule: "update" (a new value unless it is null or ''), "replace", "keep"
        (the old row stays) or "add" (numbers are summed). With `newer`, a row is
        passed over unless it is greater in that column than the old one. Rows
        with new keys are inserted, with `gate` only those that pass it. Of
        several updates with one key, the one that is greatest in `newer` and
        then in all columns counts (with "add" their sum); null keys are refused.

        `batch` names a writer and the number of its batch: a batch with a number
        not above the last one merged does nothing, so that a replay is safe.

        `before` is called with the rows of the files that go and of those that
        come instead, when these are written and the version isn't yet made.
        """
        columns = self.schema(self.head()).names
        others = [c for c in columns if c != self.key]
        rows = updates.select(*columns)
        if rule == "add":
            one = rows.groupBy(self.key).agg(*(F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in others))
        else:
            order = [newer, *(c for c in others if c != newer)] if newer else others
            one = rows.groupBy(self.key).agg(F.max(F.struct(*order)).alias("r")).select(self.key, *(F.col(f"r.{c}").alias(c) for c in others))
        one = saved(one)
        size, nulls = one.agg(F.count("*"), F.count_if(F.col(self.key).isNull())).first()
        if nulls:
            raise ValueError(f"{self.key} must not be null")
        for _ in range(tries):
            head = self.head()
            if batch and head["applied"].get(batch[0], -1) >= batch[1]:
                return head["version"]
            try:
                return self._merge_into(head, one, size, others, rule, newer, gate, batch, before)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: other writers came first {tries} times")

    def _merge_into(self, head: dict, one: DataFrame, size: int, others: list[str], rule: str, newer: str | None, gate: Column | None, batch: tuple[str, int] | None, before: Callable[[DataFrame, DataFrame], None] | None) -> int:
        files = self.touched(head, one.select(F.col(self.key).alias("key")))
        going = self._rows(head, files)
        old = going.select(self.key, F.struct(*others).alias("old"))
        new = one.select(self.key, F.struct(*others).alias("new"), (F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))).alias("__admitted"))
        sizes = self.manifest(head).where(F.col("file").isin(files)).agg(F.sum("rows")).first()[0] or 0
        many = max(1, -(-(int(sizes) + size) // FILE_ROWS))
        # Both sides are cut by ranges first, so that a key's rows meet where they are written: one exchange, and no join's to be cut anew.
        ranges = old.unionByName(new, allowMissingColumns=True).repartitionByRange(many, self.key)
        both = ranges.groupBy(self.key).agg(F.first("old", True).alias("old"), F.first("new", True).alias("new"), F.max("__admitted").alias("__admitted")).where(F.col("old").isNotNull() | F.col("__admitted"))
        met = F.col("old").isNotNull() & F.col("new").isNotNull()
        wins = met if newer is None else met & F.coalesce(F.col(f"new.{newer}") > F.col(f"old.{newer}"), F.col(f"old.{newer}").isNull() & F.col(f"new.{newer}").isNotNull())
        schema = self.schema(head)
        value = lambda c: F.when(wins, RULES[rule](F.col(f"old.{c}"), F.col(f"new.{c}"), schema[c].dataType)).when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).cast(schema[c].dataType)
        merged = both.select(self.key, *(value(c).alias(c) for c in others)).select(*schema.names)
        name = uuid.uuid4().hex
        merged.write.parquet(f"{self.path}/data/{name}")
        coming = self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}")
        made = self._described(coming, name, many)
        manifest = self._manifest(self.manifest(head).where(~F.col("file").isin(files)).unionByName(made) if files else self.manifest(head).unionByName(made))
        if before:
            before(going, coming)
        applied = head["applied"] | ({batch[0]: batch[1]} if batch else {})
        self._publish(head["version"] + 1, {"manifest": manifest, "schema": head["schema"], "applied": applied})
        return head["version"] + 1

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the last `keep` versions, and delete what none of these name. Not while a merge is under way."""
        kept = self.versions()[-keep:]
        heads = [self.head(v) for v in kept]
        batches = {r["b"] for h in heads for r in self.manifest(h).select(F.split("file", "/")[0].alias("b")).distinct().collect()}
        for folder, names in (("manifests", {h["manifest"] for h in heads}), ("data", batches), ("versions", {f"{v:012}.json" for v in kept})):
            if self._fs().exists(self._hadoop(folder)):
                for f in self._fs().listStatus(self._hadoop(folder)):
                    if f.getPath().getName() not in names:
                        self._fs().delete(f.getPath(), True)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, bits, at) to (file, number, bitmap): the bits that a task's rows of a file set. Rows come file by file, but needn't."""

    def made(file: str, flags: np.ndarray) -> pa.RecordBatch:
        maps = np.packbits(flags, bitorder="little").reshape(-1, BITMAP // 8)
        some = np.flatnonzero(maps.any(axis=1))
        return pa.RecordBatch.from_pydict({"file": [file] * len(some), "number": pa.array(some, pa.int64()), "bitmap": pa.array([maps[i].tobytes() for i in some], pa.binary())})

    file, flags = None, None
    for b in batches:
        names = b.column("file").dictionary_encode()
        which, bits, at = names.indices.to_numpy(), b.column("bits").to_numpy(), b.column("at").to_numpy()
        for i, name in enumerate(names.dictionary.to_pylist()):
            mine = at[which == i]
            if name != file:
                if file is not None:
                    yield made(file, flags)
                file, flags = name, np.zeros(bits[which == i][0], bool)
            flags[mine] = True
    if file is not None:
        yield made(file, flags)


def _files_schema(kind: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("file", T.StringType()), T.StructField("rows", long), T.StructField("low", kind), T.StructField("high", kind), T.StructField("bits", long), T.StructField("filter", T.MapType(long, T.BinaryType()))])
