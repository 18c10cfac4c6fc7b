"""Findings about a dataset by rule: shape, missing values, outliers, skewness, strong correlations, shares, growth."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.values import blank, group_text, number, safe_divide
from sparkloom.operators.aggregate import correlations, skew_kurtosis, year_growth
from sparkloom.operators.filters import outlier_counts


def findings(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """kind, subject and value: rows, missing cells, columns with |skewness| over 1.5, correlations over 0.35, by one pass; and the
    total of values beyond their measure's quartile bounds, if any, by the passes of the quartiles."""
    v = {c: number(F.col(c), df.schema[c].dataType) for c in measures}
    rows = [F.struct(F.lit("rows").alias("kind"), F.lit("").alias("subject"), F.count(F.lit(1)).cast("double").alias("value"))]
    rows += [F.struct(F.lit("missing").alias("kind"), F.lit(c).alias("subject"), F.count_if(blank(F.col(c))).cast("double").alias("value")) for c in df.columns]
    rows += [F.struct(F.lit("skewness").alias("kind"), F.lit(c).alias("subject"), skew_kurtosis(x)[0].alias("value")) for c, x in v.items()]
    rows += [F.struct(F.lit("correlation").alias("kind"), F.lit(f"{a}~{b}").alias("subject"), F.when((F.var_pop(v[a]) > 0) & (F.var_pop(v[b]) > 0), F.corr(v[a], v[b])).alias("value")) for a, b in itertools.combinations(list(measures)[:6], 2)]
    all_ = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    keep = (F.col("kind") == "rows") | ((F.col("kind") == "missing") & (F.col("value") > 0)) | ((F.col("kind") == "skewness") & (F.abs("value") > 1.5)) | ((F.col("kind") == "correlation") & (F.abs("value") > 0.35))
    found = all_.where(keep)
    if not measures:
        return found
    total = sum((F.col(f"outliers_{c}") for c in measures), F.lit(0)).cast("double")
    far = outlier_counts(df, measures).select(F.lit("outliers").alias("kind"), F.lit("").alias("subject"), total.alias("value"))
    return found.unionAll(far.where("value > 0"))


def shares(df: DataFrame, dim: str, value: str) -> DataFrame:
    """One row: the largest group, its share of the total, and the ratio of the best to the worst group mean."""
    v = number(F.col(value), df.schema[value].dataType)
    g = df.groupBy(group_text(F.col(dim), df.schema[dim].dataType).alias("g")).agg(F.sum(v).alias("s"), F.avg(v).alias("m"))
    return g.agg(F.max_by("g", F.struct("s", "g")).alias("top"), safe_divide(F.max("s"), F.sum("s")).alias("top_share"), safe_divide(F.max("m"), F.min("m")).alias("mean_ratio"))


def market(df: DataFrame, dim: str, measures: Sequence[str], date: str | None = None) -> DataFrame:
    """kind, subject and value in one call: the largest group's share of the first measure, the ratio of its best to its worst group mean, the values
    beyond its quartile bounds, its growth from the first to the last year, and the strongest correlation of measures from 0.3 on."""
    first = measures[0]
    part = shares(df, dim, first).select(F.inline(F.array(F.struct(F.lit("top_share").alias("kind"), F.col("top").alias("subject"), F.col("top_share").alias("value")), F.struct(F.lit("mean_ratio").alias("kind"), F.lit(dim).alias("subject"), F.col("mean_ratio").alias("value")))))
    far = outlier_counts(df, [first]).select(F.lit("outliers").alias("kind"), F.lit(first).alias("subject"), F.col(f"outliers_{first}").cast("double").alias("value"))
    out = part.unionAll(far)
    if date is not None:
        out = out.unionAll(year_growth(df, date, first).select(F.lit("growth").alias("kind"), F.lit(first).alias("subject"), F.col("growth").alias("value")))
    if len(measures) > 1:
        pairs = correlations(df, measures).where("a < b and abs(r) >= 0.3")
        best = pairs.agg(F.max_by(F.struct(F.concat_ws("~", "a", "b").alias("subject"), F.col("r").alias("value")), F.abs("r")).alias("s"))
        out = out.unionAll(best.where("s is not null").select(F.lit("correlation").alias("kind"), "s.subject", "s.value"))
    return out.where("value is not null")
