"""Distribution fits, normality and multivariate outliers, from moments that one pass over the rows gives."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.values import blank, finite, number
from sparkloom.operators.aggregate import describe, histogram
from sparkloom.operators.control import normal_quantile
from sparkloom.operators.order import numbered
from sparkloom.operators.stats import invert, moments

#: Coefficients of the rational approximation of the normal quantile (central, its divisor, tail, its divisor).
CENTRE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
CENTRE_BY = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BY = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
_EDGE = 0.02425
#: Coefficients of the rational approximation of the error function (error under 1.5e-7), and its scale.
ERROR = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0)
ERROR_SCALE = 0.3275911


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile_column(p: Column) -> Column:
    """The standard normal quantile as a column expression."""
    tail = lambda q: _poly(TAIL, F.sqrt(-2 * F.log(q))) / _poly(TAIL_BY, F.sqrt(-2 * F.log(q)))
    q = p - 0.5
    centre = _poly(CENTRE, q * q) * q / _poly(CENTRE_BY, q * q)
    return F.when((p <= 0) | (p >= 1), F.when(p <= 0, -math.inf).otherwise(math.inf)).when(p < _EDGE, tail(p)).when(p > 1 - _EDGE, -tail(1 - p)).otherwise(centre)


def normal_cdf_column(z: Column) -> Column:
    """The standard normal distribution function as a column expression."""
    a = F.abs(z) / math.sqrt(2)
    erf = F.signum(z) * (1 - _poly(ERROR, 1 / (1 + ERROR_SCALE * a)) * F.exp(-a * a))
    return 0.5 * (1 + erf)


def pp(df: DataFrame, value: str) -> DataFrame:
    """i, the share (i - 0.5) / n of a value and the fitted normal's probability of it, in the order of the values."""
    q = qq(df, value)
    placed = q.withColumn("theoretical", normal_cdf_column((F.col("sample") - F.col("intercept")) / F.col("slope")))
    n = F.broadcast(df.agg(F.count(finite(number(F.col(value), df.schema[value].dataType))).alias("__n")))  # one row
    return placed.where("slope > 0").crossJoin(n).select("i", ((F.col("i") - 0.5) / F.col("__n")).alias("share"), "theoretical")


def qq(df: DataFrame, value: str) -> DataFrame:
    """theoretical and sample quantiles at (i - 0.5) / n, and the line's slope (deviation) and intercept (mean)."""
    held = df.select(finite(number(F.col(value), df.schema[value].dataType)).alias("sample")).where("sample is not null")
    stats = F.broadcast(held.agg(F.count(F.lit(1)).alias("n"), F.avg("sample").alias("intercept"), F.stddev_samp("sample").alias("slope")))
    # a second key deals equal samples to several ranges; which of them comes first makes no difference
    apart = held.withColumn("__h", F.xxhash64(F.monotonically_increasing_id()))
    placed = numbered(apart, ["sample", "__h"], "i").withColumn("i", F.col("i").cast("int")).join(stats)
    return placed.select("i", normal_quantile_column((F.col("i") - 0.5) / F.col("n")).alias("theoretical"), "sample", "slope", "intercept")


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    """One row: n, jb and p = exp(-jb / 2); nulls under four values or without spread."""
    v = finite(number(F.col(value), df.schema[value].dataType))
    n = F.count(v)
    jb = n / 6 * (F.skewness(v) * F.skewness(v) + F.kurtosis(v) * F.kurtosis(v) / 4)
    return df.agg(n.alias("n"), F.when((n >= 4) & (F.var_pop(v) > 0), jb).alias("jb")).withColumn("p", F.exp(-F.col("jb") / 2))


def normal_density(df: DataFrame, value: str, steps: int = 60) -> DataFrame:
    """x and density of the fitted normal over the range of the values."""
    v = finite(number(F.col(value), df.schema[value].dataType))
    fit = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi")).where("s > 0")
    grid = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / steps)
    z = (F.col("x") - F.col("m")) / F.col("s")
    return grid.select("k", "x", (F.exp(-z * z / 2) / (F.col("s") * math.sqrt(2 * math.pi))).alias("density"))


def fits(df: DataFrame, value: str) -> DataFrame:
    """dist, params and aic of normal, exponential and lognormal, by aic; those that need positive values are left out without."""
    v = finite(number(F.col(value), df.schema[value].dataType))
    r = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2"), F.var_pop(v).alias("p2"), F.min(v).alias("lo"), F.avg(F.when(v > 0, F.log(v))).alias("lm"), F.var_samp(F.when(v > 0, F.log(v))).alias("ls2"), F.var_pop(F.when(v > 0, F.log(v))).alias("lp2"))
    n, tau = F.col("n"), math.log(2 * math.pi)
    normal = -n / 2 * (tau + F.log("s2")) - n * F.col("p2") / (2 * F.col("s2"))
    expo = -n * F.log("m") - n
    logn = -n / 2 * (tau + F.log("ls2")) - n * F.col("lp2") / (2 * F.col("ls2")) - n * F.col("lm")
    row = lambda name, ok, ll, k: F.when(ok, F.struct(F.lit(name).alias("dist"), (2 * k - 2 * ll).alias("aic")))
    rows = F.array(row("normal", F.col("s2") > 0, normal, 2), row("exponential", F.col("lo") > 0, expo, 1), row("lognormal", (F.col("lo") > 0) & (F.col("ls2") > 0), logn, 2))
    return r.select(F.inline(F.filter(rows, lambda x: x.isNotNull()))).orderBy("aic")


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    return k * (1 - 2 / (9 * k) + normal_quantile(p) * math.sqrt(2 / (9 * k))) ** 3


def mahalanobis(df: DataFrame, columns: Sequence[str], alpha: float = 0.975, top: int | None = None) -> DataFrame:
    """Complete rows with d2, the squared distance, and outlier; with ``top`` the farthest rows instead of a threshold.

    Raises ValueError for under two columns, too few rows or a singular covariance.
    """
    if len(columns) < 2:
        raise ValueError("two columns are needed at least")
    n, mean, cross = moments(df, columns)
    inverse = invert(cross / max(n - 1, 1)) if n > len(columns) else None
    if inverse is None:
        raise ValueError("too few rows" if n <= len(columns) else "singular covariance")
    v = [number(F.col(c), df.schema[c].dataType) - float(m) for c, m in zip(columns, mean)]
    d2 = sum((v[i] * v[j] * float(inverse[i, j]) for i in range(len(v)) for j in range(len(v))), F.lit(0.0))
    out = df.withColumn("d2", d2).where("d2 is not null")
    if top is not None:
        return out.orderBy(F.desc("d2")).limit(top).withColumn("outlier", F.lit(True))
    return out.withColumn("outlier", F.col("d2") > chi2_quantile(alpha, len(columns)))


def distribution_report(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """One row: the figures of ``describe``, missing, iqr (1 without spread), outliers (beyond 1.5 of it from the quartiles), and the histogram as an array of (lo, hi, n)."""
    v = number(F.col(value), df.schema[value].dataType)
    figures = describe(df, [value]).withColumn("iqr", F.when(F.col("q3") > F.col("q1"), F.col("q3") - F.col("q1")).otherwise(1.0))
    held = df.select(v.alias("__v"), blank(F.col(value)).alias("__blank")).crossJoin(F.broadcast(figures.select(F.col("q1").alias("__q1"), F.col("q3").alias("__q3"), F.col("iqr").alias("__iqr"))))  # one row
    far = (F.col("__v") < F.col("__q1") - 1.5 * F.col("__iqr")) | (F.col("__v") > F.col("__q3") + 1.5 * F.col("__iqr"))
    counts = held.agg(F.count_if(far).alias("outliers"), F.count_if("__blank").alias("missing"))
    drawn = histogram(df, value, bins).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "n"))), lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), b["n"].alias("n"))).alias("bins"))  # ``bins`` rows
    return figures.drop("column").crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(drawn))  # one row each
