"""Quality rules: counts per text, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over ``buckets`` hashed byte 4-grams are counted: one over every raw document, one
over the trusted target. A document's ratio is the mean over its 4-grams of log p_target - log p_raw
(length-normalised); it is kept when the ratio reaches ``threshold``: a fixed rule without sampling,
so equal texts get equal verdicts.

Raw counts cover all documents. They leave each task already added up, so the shuffle and the table
on the driver are at most ``buckets`` rows whatever the corpus. The target is counted on every row
labelled good: documents meet the labels in a shuffled join on doc_id at every size, no ids are broadcast.

Defined cases: null and empty texts have no words, fail the base rule and have ratio 0; texts under
four bytes have ratio 0; an empty target or corpus gives ratio 0 everywhere; repeated ids are scored
row by row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_slices
from sparkloom.llm.textbatch import TextBatch, count_in, mix64, windows

BUCKETS = 1 << 14
THRESHOLD = -0.2
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

RULES_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double"


def grams(batch: TextBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte 4-gram inside one text, and the text it is in."""
    d = batch.data.astype(np.uint32)
    if len(d) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
    sizes = np.diff(batch.docs)
    owner = np.repeat(np.arange(batch.n), sizes)
    inside = owner[:-3] == owner[3:]
    bits = np.uint32(32 - int(buckets).bit_length() + 1)
    return ((code * np.uint32(2654435761)) >> bits)[inside].astype(np.int64), owner[:-3][inside]


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed 4-grams over all texts: added up per slice in the tasks, then by bucket."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.bincount(grams(TextBatch(batch.column("text")), buckets)[0], minlength=buckets)
        some = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["bucket", "n"])

    rows = map_slices(docs.select("text"), "text", "bucket long, n long", count).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets)
    for bucket, n in rows:  # at most `buckets` rows
        out[bucket] = n
    return out


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents labelled good."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id", "left_semi")


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw per bucket, with one added count each."""
    raw, target = gram_counts(docs, buckets) + 1, gram_counts(trusted, buckets) + 1
    if raw.sum() == buckets or target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def quality_rules(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept for every row of docs."""
    buckets = len(weights)

    def rules(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = TextBatch(batch.column("text"))
        n = t.n
        starts, ends = t.words()
        owner = t.owner(starts)
        points = t.code_points()
        n_words = np.bincount(owner, minlength=n)
        chars = np.bincount(owner, points[ends] - points[starts], minlength=n).astype(np.int64)
        symbols = count_in(SYMBOLS[t.data], t.docs[:-1], t.docs[1:])
        repeated = np.zeros(len(starts) + 2, np.int64)
        first, h = windows(t.hashes(starts, ends), owner, 3)
        h = mix64(h + owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        again = first[times[back] > 1]
        for j in range(3):
            repeated[again + j] = 1
        repeat_words = np.bincount(owner[repeated[: len(starts)] == 1], minlength=n)
        ls, le, lo = t.lines()
        holds = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        ls, le, lo = ls[holds], le[holds], lo[holds]
        key = mix64(t.hashes(ls, le) + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, firsts = np.unique(key, return_index=True)
        dup = np.ones(len(key), bool)
        dup[firsts] = False
        dup_lines = np.bincount(lo[dup], minlength=n)
        bucket, at = grams(t, buckets)
        total = np.bincount(at, weights[bucket], minlength=n)
        llr = total / np.maximum(np.bincount(at, minlength=n), 1)
        failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
        cols = [batch.column("doc_id"), *map(pa.array, (n_words, chars, symbols, dup_lines, repeat_words, failed, llr))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr"])

    scored = map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", RULES_SCHEMA, rules)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
