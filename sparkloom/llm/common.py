"""Helpers that several operators share: reading tables, checked broadcasts, slices of texts, sums along arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.llm.textbatch import slices
from sparkloom.plans.storage import delete_folder, materialise, release, shared_dir

__all__ = ["BROADCAST_ROWS", "delete_folder", "let", "map_slices", "materialise", "ragged", "release", "running_starts", "shared_dir", "small_side", "table"]

#: A side of a join is broadcast by hand only after its rows were counted and are at most this many (a few MB of ids).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def map_slices(df: DataFrame, text: str, schema: str | StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """mapInArrow that hands fn slices of bounded bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(text)):
                out = fn(batch.slice(lo, hi - lo))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running_before(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array, all entries before it folded by an associative merge with zero as its neutral value.

    Folded in blocks of about sqrt(n) entries, so n entries cost n * sqrt(n) merges and no list is copied per entry.
    """
    fold = lambda a: F.aggregate(a, zero, merge)

    def blocks(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / w).cast("int") - 1), lambda i: F.slice(a, i * w + 1, w)))

    def within(b: Column, first: Column) -> Column:
        return F.transform(b, lambda _, j: merge(first, fold(F.slice(b, F.lit(1), j))))

    def spread(parts: Column) -> Column:
        return let(F.transform(parts, fold), lambda sums: F.flatten(F.transform(parts, lambda b, i: let(fold(F.slice(sums, F.lit(1), i)), lambda first: within(b, first)))))

    return let(values, lambda a: F.coalesce(F.when(F.size(a) > 0, let(blocks(a), spread)), F.slice(a, F.lit(1), F.lit(0))))


def running_starts(sizes: Column) -> Column:
    """Where each of a list of neighbouring stretches begins: the sum of the sizes before it."""
    return running_before(sizes, F.lit(0), lambda a, b: a + b)
