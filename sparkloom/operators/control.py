"""Process control charts and capability."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.values import safe_divide
from sparkloom.operators.order import numbered, running_sums, with_lags

#: The factors of control charts by subgroup size 2..10.
FACTORS = {
    "A2": [1.880, 1.023, 0.729, 0.577, 0.483, 0.419, 0.373, 0.337, 0.308],
    "A3": [2.659, 1.954, 1.628, 1.427, 1.287, 1.182, 1.099, 1.032, 0.975],
    "D3": [0, 0, 0, 0, 0, 0.076, 0.136, 0.184, 0.223],
    "D4": [3.267, 2.574, 2.282, 2.114, 2.004, 1.924, 1.864, 1.816, 1.777],
    "B3": [0, 0, 0, 0, 0.030, 0.118, 0.185, 0.239, 0.284],
    "B4": [3.267, 2.568, 2.266, 2.089, 1.970, 1.882, 1.815, 1.761, 1.716],
    "d2": [1.128, 1.693, 2.059, 2.326, 2.534, 2.704, 2.847, 2.970, 3.078],
    "c4": [0.7979, 0.8862, 0.9213, 0.9400, 0.9515, 0.9594, 0.9650, 0.9693, 0.9727],
}


def factor(name: str, n: int) -> float:
    return FACTORS[name][n - 2]


def individuals(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row: center, sigma (mean moving range / d2), limits, mean moving range and its upper limit."""
    held = df.where(F.col(value).isNotNull())
    mr = with_lags(held.select(value, order), value, [order], [1]).select(F.col(value).alias("v"), F.abs(F.col(value) - F.col("__lag1")).alias("mr"))
    row = mr.agg(F.avg("v").alias("center"), F.avg("mr").alias("mr_bar"))
    sigma = F.col("mr_bar") / factor("d2", 2)
    return row.select("center", sigma.alias("sigma"), (F.col("center") + 3 * sigma).alias("ucl"), (F.col("center") - 3 * sigma).alias("lcl"), "mr_bar", (F.col("mr_bar") * factor("D4", 2)).alias("mr_ucl"))


def subgroups(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"), F.stddev_samp(value).alias("sd"))


def _size(groups: DataFrame) -> int:
    lo, hi = groups.agg(F.min("n"), F.max("n")).first()
    if lo is None or lo != hi or not 2 <= lo <= 10:
        raise ValueError("subgroups must be of one size from 2 to 10")
    return lo


def xbar_r(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: center and limits of means, mean range and limits of ranges."""
    g = subgroups(df, value, group)
    n = _size(g)
    row = g.agg(F.avg("mean").alias("center"), F.avg("range").alias("r_bar"))
    reach = factor("A2", n) * F.col("r_bar")
    return row.select("center", (F.col("center") + reach).alias("ucl"), (F.col("center") - reach).alias("lcl"), "r_bar", (F.col("r_bar") * factor("D4", n)).alias("r_ucl"), (F.col("r_bar") * factor("D3", n)).alias("r_lcl"))


def xbar_s(df: DataFrame, value: str, group: str) -> DataFrame:
    g = subgroups(df, value, group)
    n = _size(g)
    row = g.agg(F.avg("mean").alias("center"), F.avg("sd").alias("s_bar"))
    reach = factor("A3", n) * F.col("s_bar")
    return row.select("center", (F.col("center") + reach).alias("ucl"), (F.col("center") - reach).alias("lcl"), "s_bar", (F.col("s_bar") * factor("B4", n)).alias("s_ucl"), (F.col("s_bar") * factor("B3", n)).alias("s_lcl"))


def p_chart(df: DataFrame, defects: str, size: str) -> DataFrame:
    """Rows with p, the mean share and each point's limits; a size of 0 or less has nulls."""
    bar = df.where(F.col(size) > 0).agg((F.sum(defects) / F.sum(size)).alias("p_bar"))
    reach = 3 * F.sqrt(F.when(F.col(size) > 0, F.col("p_bar") * (1 - F.col("p_bar")) / F.col(size)))
    return df.join(F.broadcast(bar)).withColumns({"p": F.when(F.col(size) > 0, F.col(defects) / F.col(size)), "ucl": F.least(F.lit(1.0), F.col("p_bar") + reach), "lcl": F.greatest(F.lit(0.0), F.col("p_bar") - reach)})


def c_chart(df: DataFrame, counts: str) -> DataFrame:
    row = df.agg(F.avg(counts).alias("center"))
    return row.select("center", (F.col("center") + 3 * F.sqrt("center")).alias("ucl"), F.greatest(F.lit(0.0), F.col("center") - 3 * F.sqrt("center")).alias("lcl"))


def u_chart(df: DataFrame, counts: str, size: str) -> DataFrame:
    bar = df.where(F.col(size) > 0).agg((F.sum(counts) / F.sum(size)).alias("u_bar"))
    reach = 3 * F.sqrt(F.when(F.col(size) > 0, F.col("u_bar") / F.col(size)))
    return df.join(F.broadcast(bar)).withColumns({"u": F.when(F.col(size) > 0, F.col(counts) / F.col(size)), "ucl": F.col("u_bar") + reach, "lcl": F.greatest(F.lit(0.0), F.col("u_bar") - reach)})


def capability(df: DataFrame, value: str, order: str, lsl: float | None = None, usl: float | None = None) -> DataFrame:
    """One row: mean, within and overall deviation, Cp, Cpk, Pp, Ppk; one limit alone gives the k figures, crossed limits nulls."""
    there = df.where(F.col(value).isNotNull()).select(value, order)
    held = with_lags(there, value, [order], [1]).select(F.col(value).alias("v"), F.abs(F.col(value) - F.col("__lag1")).alias("mr"))
    row = held.agg(F.avg("v").alias("mean"), (F.avg("mr") / factor("d2", 2)).alias("within"), F.stddev_samp("v").alias("overall"))
    null = F.lit(None).cast("double")
    if lsl is not None and usl is not None and lsl >= usl:
        return row.select("*", *[null.alias(n) for n in ("cp", "cpk", "pp", "ppk")])

    def both(s: Column) -> Column:
        return safe_divide(F.lit(float(usl - lsl)), 6 * s) if lsl is not None and usl is not None else null

    def near(s: Column) -> Column:
        sides = ([safe_divide(usl - F.col("mean"), 3 * s)] if usl is not None else []) + ([safe_divide(F.col("mean") - lsl, 3 * s)] if lsl is not None else [])
        return F.least(*sides) if len(sides) == 2 else sides[0] if sides else null

    return row.select("*", both(F.col("within")).alias("cp"), near(F.col("within")).alias("cpk"), both(F.col("overall")).alias("pp"), near(F.col("overall")).alias("ppk"))


def pareto(df: DataFrame, category: str, value: str) -> DataFrame:
    """Categories by descending total with percent and running percent; a total of 0 counts as 1."""
    sums = df.groupBy(category).agg(F.sum(value).alias("value"))
    total = F.broadcast(df.agg(F.coalesce(F.nullif(F.sum(value), F.lit(0)), F.lit(1.0)).alias("__all")))  # one row
    run = running_sums(sums, {"__upto": "value"}, [F.desc("value"), category]).crossJoin(total)
    return run.select(category, "value", (F.col("value") / F.col("__all") * 100).alias("pct"), (F.col("__upto") / F.col("__all") * 100).alias("cum_pct"))


def violations(df: DataFrame, value: str, order: str, ucl: float, lcl: float) -> DataFrame:
    """Rows beyond the limits with their place from 0."""
    placed = numbered(df, [order], "index").withColumn("index", (F.col("index") - 1).cast("int"))
    return placed.where((F.col(value) > ucl) | (F.col(value) < lcl))


def names() -> Sequence[str]:
    return tuple(FACTORS)


def normal_quantile(p: float) -> float:
    """The standard normal quantile by Newton steps on the error function."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    x = 0.0
    for _ in range(60):
        step = (0.5 * math.erfc(-x / math.sqrt(2)) - p) / max(math.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-12)
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x
