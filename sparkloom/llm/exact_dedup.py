"""Exact duplicates by a persistent index of digests, bucketed and sorted by digest.

The index is a Parquet table of (digest, keep_id) in a folder: one row for each different text, ``buckets`` buckets by
digest, each file of a bucket sorted. New rows are first counted down to one row for each digest (added up before the
shuffle, so a group of copies with a third of all rows is one row of each task); these meet the index in a sort-merge
anti-join that reads the index bucket by bucket, without shuffling it, and those not found are appended as new sorted files.

What stays is looked up afterwards: a row stays if the index names its id. Adding the same rows again changes nothing, so
a batch whose job was lost half way is simply added again. One writer at a time. Within a batch the largest id stays;
across batches the row that came first does, so batches are added from the largest ids down where the largest must stay.

Defined cases: a null text is an empty one and equal to it. Rows without an id never stay where their text has a row with
one; where none has, they all stay. Rows that repeat id and text are one document: all count, and they stay or go together.
Texts are whole; texts of one digest (SHA-256) are equal. An empty table adds nothing. Extra columns, whatever
their names, are ignored by the index and kept by ``drop_known``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise
from sparkloom.operators.combine import weighed_join
from sparkloom.plans.storage import list_folder

#: Batches of a table that is indexed at once, from the largest ids down.
BATCHES = 4


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """An index in a folder that outlives the session; opened where it lies, or begun with ``buckets`` buckets (the session's shuffle partitions)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        held = [name for name in list_folder(spark, folder) if name.startswith("buckets-")]
        self.buckets = int(held[0].removeprefix("buckets-")) if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark, self.path = spark, f"{folder}/buckets-{self.buckets}"
        self.name = f"digests_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def entries(self) -> DataFrame:
        """digest, keep_id; one row for each text."""
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append the digests of rows (doc_id, digest) that the index does not hold yet."""
        firsts = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        fresh = firsts.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        fresh.write.insertInto(self.name)

    def forget(self) -> None:
        """Take the table's name out of the catalog; its files stay where they lie."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _downwards(rows: DataFrame, batches: int) -> list[DataFrame]:
    """rows in batches from the largest ids down, about as large; rows without an id come last."""
    bounds = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0]
    ids, out, below = F.col("doc_id"), [], F.lit(True)
    for bound in sorted(set(bounds or ()), reverse=True):
        out.append(rows.where(below & (ids >= bound)))
        below = ids < bound
    return [*out, rows.where(below | ids.isNull())]


def index_documents(docs: DataFrame, index: DigestIndex, batches: int = BATCHES) -> DataFrame:
    """Add all rows of docs (doc_id, text) to the index; doc_id and digest of each row, as written to the shared folder."""
    rows = materialise(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    for batch in _downwards(rows, batches):
        index.add(batch)
    return rows


def exact_duplicates(docs: DataFrame, index: DigestIndex, batches: int = BATCHES) -> DataFrame:
    """doc_id, keep_id (of the row that stays), group_size (rows of docs with that text), kept, digest; one row for each row of docs.

    The digests of hot groups are broadcast (500 at most), the others meet their rows in a shuffle.
    """
    rows = index_documents(docs, index, batches)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    verdicts = materialise(sizes.join(index.entries().hint("merge"), "digest"), "verdicts")
    told = weighed_join(rows, verdicts, ["digest"], "group_size")
    return told.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_known(docs: DataFrame, index: DigestIndex, batches: int = BATCHES) -> DataFrame:
    """The rows of docs that stay, with all their columns; their digests are in the index from now on."""
    rows = index_documents(docs, index, batches)
    stay = index.entries().join(rows, "digest", "left_semi").select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"))
    signed = docs.withColumn("__is", digest(F.col("text")))
    met = signed.join(stay, (F.col("__is") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__keep")), "left_semi")
    return met.select(docs.columns)
