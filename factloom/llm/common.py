"""What the operators of this subpackage share: shared-folder tables and column guards."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task's working set is planned for, and that Python takes at a time.
TARGET_BYTES, BATCH_BYTES = 24 << 20, 2 << 20
#: Spark's limit of an Arrow batch, its default, and what shared_dir() puts in the default's place: each core holds a batch on either side.
ARROW_BYTES, ARROW_DEFAULT, ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4194304b"


#: Folders that this process has asked for.
folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The name of a new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Where it is unset, a local master (as
    in tests) gets a local folder; on a cluster that is an error, since each
    machine would write to its own disk. What operators write there is needed
    until their result has been used; see sweep().
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    small_batches(spark)
    folders.append(f"{root.rstrip('/')}/factloom-{uuid.uuid4().hex}")
    return folders[-1]


def small_batches(spark: SparkSession) -> None:
    """Let texts travel to Python in small batches, unless the session has a limit of its own."""
    if spark.conf.get(ARROW_BYTES).rstrip("b") == str(ARROW_DEFAULT):
        spark.conf.set(ARROW_BYTES, ARROW_LIMIT)


def sweep(spark: SparkSession, done: list[str]) -> None:
    """Delete shared folders whose results have been used."""
    for folder in done:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        folders.remove(folder)


def durable(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only a reread, and what each row
    was (partition number, running sums) can't change on a retry.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def chunks_for(df: DataFrame, text_col: str, target: int = TARGET_BYTES) -> int:
    """How many chunks of about `target` bytes the texts of df fill; one number reaches the driver."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()["b"] or 0
    return max(1, -(-int(total) // target))


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to runs of rows whose texts come to about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return freed memory to the machine at the end of a task: Spark keeps Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library that has no such call
        pass


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns of these names under other ones, and what gives a result docs' columns back under their own."""
    taken, used = {n.lower() for n in names}, {c.lower() for c in docs.columns}
    aside = {}
    for c in docs.columns:
        if c.lower() in taken:
            new = f"{c}_aside"
            while new.lower() in used | taken:
                new += "_"
            aside[c] = new
            used.add(new.lower())
    return docs.withColumnsRenamed(aside), lambda out: out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def widened(df: DataFrame, *added: tuple[str, str]) -> T.StructType:
    """The schema of df with columns of (name, type) after its own."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in added)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_lists(text: bytes | None, table: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text as lists, each from about `piece` bytes, so that a very long text needs no long list.

    table: what makes each byte that isn't part of a word a blank (and lowers letters, if it is to); no word is cut.
    """
    data, rest = text or b"", b""
    for i in range(0, len(data), piece):
        part = rest + data[i : i + piece].translate(table)
        cut = part.rfind(b" ") + 1 if i + piece < len(data) else len(part)
        part, rest = part[:cut], part[cut:]
        if words := part.split():
            yield words


def texts_as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The texts of a batch as UTF-8, without a way through Python's strings."""
    return batch.column(column).cast(pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()).to_pylist()
