"""Row filters with the rules of grids, pivots and dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.values import all_of, any_of, blank, finite, number, text
from sparkloom.operators.order import exact_quantiles


def _word(df: DataFrame, column: str) -> Column:
    return F.coalesce(text(F.col(column), df.schema[column].dataType), F.lit("null"))


def category_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value, as text, is one of those; a null is the text null."""
    return df.where(_word(df, column).isin(*values))


def in_range(df: DataFrame, column: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Rows within inclusive ends, either open; nulls pass. The comparison stays on the bare column and reaches the scan."""
    c = F.col(column)
    ends = [c >= lo] if lo is not None else []
    ends += [c <= hi] if hi is not None else []
    return df.where(c.isNull() | all_of(ends)) if ends else df


def search(df: DataFrame, words: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any of the columns holds the words, whatever the case."""
    return df.where(any_of([F.lower(F.coalesce(text(F.col(c), df.schema[c].dataType), F.lit(""))).contains(words.lower()) for c in columns]))


def like_anyway(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """LIKE whatever the case; a null is the text null."""
    return df.where(_word(df, column).ilike(pattern))


def cross_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one dimension value, compared as text."""
    return df.where(text(F.col(column), df.schema[column].dataType) == value)


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(~blank(F.col(column)))


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """One row: lo and hi at k interquartile ranges beyond the exact quartiles."""
    v = number(F.col(column), df.schema[column].dataType)
    reach = k * (F.col("q3") - F.col("q1"))
    return exact_quantiles(df, (), [("q1", v, 0.25), ("q3", v, 0.75)]).select((F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))


def outlier_counts(df: DataFrame, measures: Sequence[str], k: float = 1.5) -> DataFrame:
    """One row: outliers_<measure>, the values beyond the bounds of each; the quartiles of all measures share their passes."""
    v = {c: number(F.col(c), df.schema[c].dataType) for c in measures}
    ranks = [(f"__q{p}_{i}", x, p / 4) for i, x in enumerate(v.values()) for p in (1, 3)]
    met = df.crossJoin(F.broadcast(exact_quantiles(df, (), ranks)))  # one row
    far = []
    for i, (c, x) in enumerate(v.items()):
        q1, q3 = F.col(f"__q1_{i}"), F.col(f"__q3_{i}")
        far.append(F.count_if((x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1))).alias(f"outliers_{c}"))
    return met.agg(*far)


def remove_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows within the bounds; nulls stay. The bounds are one row, which is broadcast."""
    bounds = F.broadcast(iqr_bounds(df, column).select(F.coalesce("lo", F.lit(0.0)).alias("__lo"), F.coalesce("hi", F.lit(0.0)).alias("__hi")))
    v = number(F.col(column), df.schema[column].dataType)
    return df.join(bounds).where(v.isNull() | v.between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def delete_rows(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key isn't among those of gone."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def in_bounds(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Points within (south, north, west, east)."""
    south, north, west, east = box
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def complete_cases(df: DataFrame, columns: Sequence[str], finite_only: bool = True) -> DataFrame:
    """Rows with a number in every column; finite_only leaves infinities out too."""
    value = lambda c: number(F.col(c), df.schema[c].dataType)
    return df.where(all_of([(finite(value(c)) if finite_only else value(c)).isNotNull() for c in columns]))
