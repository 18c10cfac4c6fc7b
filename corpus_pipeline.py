"""A corpus pipeline of five stages; each works on all rows that the one before kept.

Documents that the classifier rejects go; recurring lines go, and documents of which no word is left; one
document of each group of near-duplicates stays; documents that hold a benchmark item go; the rest are encoded.

Every stage's rows are written to the shared folder and read again by the next, whose own rows then take
their place. Defined cases, as the operators have them: a null or empty text has no lines, shingles or
tokens: the classifier gives it the score of texts without lines, line dedup leaves it as it is, it is no
one's duplicate and no leak, and it is encoded as no ids. Rows that share a doc_id are scored and encoded row
by row, lose their own recurring lines, and stay or go together as duplicates and leaks. Rows without a
doc_id are scored and encoded, keep their lines and are neither duplicates nor leaks. Very long texts are read
whole. Ties between copies go to the least doc_id. An empty table gives no rows. Extra columns of documents
stay up to the last stage, whatever their names; the last returns its own four columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontamination, line_crf, line_templates, near_duplicates
from sparkloom.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the cutoff, unchanged; without labels of both kinds all have 0.5 and stay."""
    return line_crf.keep_good(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their recurring lines (n_chars counted anew where lines went); those left without a word by it go."""
    done = line_templates.dedup_lines(docs, counts=("__lines", "__dropped"))
    left = done.where((F.col("__dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have the least doc_id of their component."""
    return near_duplicates.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and decoded_sha256, the digest of the decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    spoken = bpe.encode_decode(docs.select("doc_id", "text"), path)
    return spoken.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The classifier, the sketches and the encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name, instead_of=(docs,))
    return docs
