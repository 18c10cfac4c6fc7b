"""Edits as a table: values laid over a dataset by key and column in one join, however many they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType, StringType

from sparkloom.plans.storage import materialise

#: Edited rows that are broadcast at most; they were counted.
BROADCAST_ROWS = 100_000


def parsed(text: Column, kind: DataType) -> Column:
    """A typed-in value: what can't be read is null, whole numbers are rounded, and an empty text is null but in text columns."""
    if isinstance(kind, StringType):
        return text
    filled = F.when(text != "", text)
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.coalesce(filled.try_cast(kind), F.floor(filled.try_cast("double") + 0.5).try_cast(kind))
    return filled.try_cast(kind)


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def edited(df: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """df with the cells of edits (key, column, value as text, at) in place of its own: of several for a cell the one with the largest ``at``.

    Edits are summed up to one row for each key before they meet df, so the plan has one join, whose size does not depend on
    how many there are. Unknown keys and columns are left alone, and so are rows without a key; a null value makes a cell null.
    """
    kind = df.schema[key].dataType
    known = [r[0] for r in edits.select("column").distinct().where(F.col("column").isin(df.columns)).collect()]  # at most the columns of df
    columns = [c for c in df.columns if c in known]
    if not columns:
        return df
    last = [F.max(F.when(F.col("column") == c, F.struct("at", "value"))).alias(f"__e{i}") for i, c in enumerate(columns)]
    wide = materialise(edits.where(F.col("column").isin(columns)).groupBy(F.col("key").try_cast(kind).alias("__key")).agg(*last), "edits")
    met = df.join(_side(wide), F.col(key) == F.col("__key"), "left")
    new = {c: F.when(F.col(f"__e{i}").isNotNull(), parsed(F.col(f"__e{i}.value"), df.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    return met.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in keys (key); rows without a key stay."""
    gone = materialise(keys.select(F.col("key").try_cast(df.schema[key].dataType).alias("__key")).where("__key is not null").distinct(), "gone")
    return df.join(_side(gone), F.col(key) == F.col("__key"), "left_anti")
