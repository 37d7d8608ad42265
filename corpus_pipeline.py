"""From raw documents to packed sequences, in five stages.

Each stage works on all that the one before kept, and its result is written to
the shared folder and read again, so a lost executor never costs more than one
stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common, decontamination, minhash, packing, quality, secrets
from factloom.llm.common import durable, set_aside, shared_dir, text_of
from factloom.llm.queries import MIXTURE, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which the factorisation machine holds label 0 the likelier."""
    rows, own = set_aside(docs, ["score", "predicted"])
    machine = quality.fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return own(quality.score(rows, machine, threshold=0.5).where(F.col("predicted") == 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates (five words, 0.8): that with the smallest id.

    Rows that share an id are one document, of which one row stays. A row
    without an id is a document of its own, and stays only where its group has
    no id.
    """
    folder = shared_dir(spark)
    keyed = durable(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), folder, "keyed")
    rows = keyed.select("row", F.col("doc.doc_id").cast("long").alias("id"), text_of("doc.text").alias("text"))
    gone = minhash.grouped(rows, folder).where(~F.col("first")).select("row")
    return keyed.join(gone, "row", "left_anti").select("doc.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which ten consecutive words of a benchmark item occur."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found in a text by a mark; no document goes."""
    rows, own = set_aside(docs, ["blob", "rule_version", "spans"])
    found = secrets.scan(rows, f"{shared_dir(spark)}/ledger")
    text = F.when(F.size("spans") > 0, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return own(out)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences of 1024 tokens, each window by the sources' shares."""
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), targets=MIXTURE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window_id", F.col("queue").alias("source"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("mixture packing", mixture_packing),
]

#: A learned classifier, signatures and a tokenizer can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table of documents to the packed pieces."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        before = len(common.folders)
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs, folder, f"stage{number}")
            common.sweep(spark, common.folders[before:])
    return docs
