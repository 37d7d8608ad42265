"""Reports that are kept up to date from changes: old rows out, new rows in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.rules import blank
from factloom.operators import coverage as C
from factloom.sources.versions import VersionedTable

#: Between the parts of a category's key.
_CUT = "\x1f"


class GapReport:
    """The need for evidence by category, from batches of changed records.

    Two versioned tables are kept: what each record counts for at present, and
    the counts of each category. A batch takes out of the counts what the files
    of records that it replaces counted for, and puts in what the new files count
    for, so that records and changes meet only once; only the files that have
    these records or categories are read. The counts are merged first, then the
    records, both under the batch's number: a stop in between is made good by the
    replay, which finds the counts done and the records not.
    """

    NUMBERS = ["total", "gold", "decision_grade", *(f"filled_{f}" for f in C.FIELDS)]

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.records = VersionedTable(spark, f"{path}/records", "id")
        self.counts = VersionedTable(spark, f"{path}/counts", "category")
        self.counts.create(spark.createDataFrame([], "category string, " + ", ".join(f"{n} long" for n in self.NUMBERS)).schema)

    def _counted(self, changes: DataFrame) -> DataFrame:
        """(id, seq, category, numbers): what each record counts for; a record that isn't published, or has no workflow, counts for nothing."""
        counts = (F.col("publication_status") == "published") & ~blank(F.col("workflow"))
        category = F.when(F.coalesce(counts, F.lit(False)), F.concat_ws(_CUT, "workflow", F.coalesce("business_function", F.lit(""))))
        flags = {"total": F.lit(True), "gold": F.col("tier") == "gold", "decision_grade": F.col("tier") == "decision_grade"} | {f"filled_{f}": ~blank(F.col(f)) for f in C.FIELDS}
        return changes.select("id", "seq", category.alias("category"), *(F.when(category.isNotNull(), F.coalesce(flags[n].cast("long"), F.lit(0))).otherwise(0).alias(n) for n in self.NUMBERS))

    def apply(self, changes: DataFrame, number: int) -> None:
        """Take in changed records (id, seq, workflow, business_function, publication_status, tier and the fields); `number` is the batch's, from 0 upwards.

        A change counts only if its seq is above the record's last one, so
        changes may come in any order; of several in one batch the last counts.
        A batch that has been taken in already changes nothing.
        """
        if self.counts.versions() and self.records.versions() and self.records.head()["applied"].get("changes", -1) >= number:
            return
        rows = self._counted(changes)
        self.records.create(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))

        def count(going: DataFrame, coming: DataFrame) -> None:
            if self.counts.head()["applied"].get("changes", -1) < number:
                out = going.select("category", *((-F.col(n)).alias(n) for n in self.NUMBERS))
                self.counts.merge(coming.select("category", *self.NUMBERS).unionByName(out).where("category IS NOT NULL"), "add", batch=("changes", number))

        self.records.merge(rows, "replace", newer="seq", batch=("changes", number), before=count)

    def on_batch(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch of a stream of changes."""
        self.apply(batch, number)

    def report(self, demand: Column) -> DataFrame:
        """The report as a full run over all records would give it; demand is an expression on the workflow."""
        parts = F.split("category", _CUT)
        rows = self.counts.read().where("total > 0").select(parts[0].alias("workflow"), parts[1].alias("business_function"), *self.NUMBERS)
        return C.gaps_of(rows, demand)
