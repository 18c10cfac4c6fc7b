"""Hypothesis tests and regression. Spark reduces the rows to group or moment tables; only those reach numpy."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.values import all_of, number, text


def fraction(parts: Iterable[tuple[float, float]]) -> float:
    """n1 / (d1 + n2 / (d2 + ...)) of pairs (n, d), to where a further pair changes nothing."""
    tiny = 1e-300
    value = above = tiny
    below = 0.0
    for n, d in parts:
        below = 1 / ((d + n * below) or tiny)
        above = (d + n / above) or tiny
        value *= above * below
        if abs(above * below - 1) < 1e-15:
            break
    return value


def inc_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1 - inc_beta(b, a, 1 - x)
    even = ((m, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))) for m in range(1, 200))
    odd = ((m, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))) for m in range(200))
    steps = (n for pair in zip(odd, even) for _, n in pair)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return scale * fraction((n, 1.0) for n in itertools.chain([1.0], steps))


def inc_gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: the power series of the lower one up to a + 1, a fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x > a + 1:
        return scale * fraction((-k * (k - a) if k else 1.0, x + 1 - a + 2 * k) for k in range(1000))
    terms = itertools.accumulate(range(1, 1000), lambda t, k: t * x / (a + k), initial=1 / a)
    return 1 - scale * math.fsum(terms)


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return 0.0 if math.isinf(t) else inc_beta(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else inc_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_p(x: float, df: float) -> float:
    return 1.0 if x <= 0 else inc_gamma_upper(df / 2, x / 2)


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """group (as text, null is null), n, mean, var of a numeric column."""
    v = number(F.col(value), df.schema[value].dataType)
    g = F.coalesce(text(F.col(group), df.schema[group].dataType), F.lit("null"))
    return df.select(g.alias("group"), v.alias("v")).where("v is not null").groupBy("group").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))


def welch(df: DataFrame, value: str, group: str, a: str, b: str) -> dict[str, float | None]:
    """Welch's t of two groups and Cohen's d of the pooled deviation; nulls where a group has under two values or neither has spread."""
    got = {r["group"]: r for r in group_moments(df, value, group).where(F.col("group").isin(a, b)).collect()}
    x, y = got.get(a), got.get(b)
    none = {"t": None, "df": None, "p": None, "d": None, "n1": x.n if x else 0, "n2": y.n if y else 0}
    if not x or not y or min(x.n, y.n) < 2 or x["var"] + y["var"] == 0:
        return none
    sx, sy = x["var"] / x.n, y["var"] / y.n
    t = (x["mean"] - y["mean"]) / math.sqrt(sx + sy)
    free = (sx + sy) ** 2 / (sx**2 / (x.n - 1) + sy**2 / (y.n - 1))
    pooled = math.sqrt(((x.n - 1) * x["var"] + (y.n - 1) * y["var"]) / (x.n + y.n - 2))
    return none | {"t": t, "df": free, "p": t_p(t, free), "d": (x["mean"] - y["mean"]) / pooled}


def anova_table(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, n, between and within sums of squares, F and eta squared, from group moments alone."""
    m = group_moments(df, value, group)
    grand = m.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__g"))
    parts = m.join(F.broadcast(grand)).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("__g")) * (F.col("mean") - F.col("__g"))).alias("ssb"),
        F.sum(F.coalesce("var", F.lit(0.0)) * (F.col("n") - 1)).alias("ssw"),
    )
    f = F.when((F.col("ssw") > 0) & (F.col("groups") > 1) & (F.col("n") > F.col("groups")), (F.col("ssb") / (F.col("groups") - 1)) / (F.col("ssw") / (F.col("n") - F.col("groups"))))
    return parts.select("groups", "n", "ssb", "ssw", f.alias("f"), F.when(F.col("ssb") + F.col("ssw") > 0, F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta2"))


def anova(df: DataFrame, value: str, group: str) -> dict[str, float | None]:
    r = anova_table(df, value, group).first().asDict()
    return r | {"p": None if r["f"] is None else f_p(r["f"], r["groups"] - 1, r["n"] - r["groups"])}


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, observed, expected for every pair of levels that occur; null is a level. Columns with more than LEVELS levels are refused."""
    for c in (a, b):
        if df.select(c).distinct().limit(LEVELS + 1).count() > LEVELS:
            raise ValueError(f"more than {LEVELS} levels")
    word = lambda c: F.coalesce(text(F.col(c), df.schema[c].dataType), F.lit("null"))
    cells = df.groupBy(word(a).alias("a"), word(b).alias("b")).agg(F.count(F.lit(1)).alias("observed"))
    rows, cols = cells.groupBy("a").agg(F.sum("observed").alias("ra")), cells.groupBy("b").agg(F.sum("observed").alias("cb"))
    total = cells.agg(F.sum("observed").alias("total"))
    grid = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(total))  # levels by levels, at most LEVELS squared
    met = grid.join(cells, ["a", "b"], "left")
    return met.select("a", "b", F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("ra") * F.col("cb") / F.col("total")).alias("expected"))


LEVELS = 50


def chi_square_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, chi2, degrees of freedom, Cramer's V. Columns with more than LEVELS levels are refused."""
    cells = contingency(df, a, b)
    d = F.col("observed") - F.col("expected")
    r = cells.agg(F.sum("observed").alias("n"), F.sum(d * d / F.col("expected")).alias("chi2"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    k = F.least("r", "c") - 1
    return r.select("n", "chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), F.when(k > 0, F.sqrt(F.col("chi2") / (F.col("n") * k))).alias("v"))


def chi_square(df: DataFrame, a: str, b: str) -> dict[str, float | None]:
    r = chi_square_table(df, a, b).first().asDict()
    return r | {"p": chi2_p(r["chi2"], r["df"]) if r["df"] else None}


def invert(m: np.ndarray, relative: float = 1e-12) -> np.ndarray | None:
    """The inverse by elimination with partial pivots; None where a pivot is under ``relative`` of the largest entry."""
    n, least = len(m), relative * max(np.abs(m).max(initial=0.0), 1e-300)
    work = np.hstack([m.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(work[k:, k]).argmax())
        if abs(work[p, k]) < least:
            return None
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        rest = np.arange(n) != k
        work[rest] -= np.outer(work[rest, k], work[k])
    return work[:, n:]


class CollinearError(ValueError):
    """Inputs of a regression that depend on each other."""


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and centred cross products of complete cases, all from one pass (k * (k + 1) / 2 covariances)."""
    v = {c: number(F.col(c), df.schema[c].dataType) for c in columns}
    held = df.select(*[x.alias(f"__{i}") for i, x in enumerate(v.values())]).where(all_of([F.col(f"__{i}").isNotNull() for i in range(len(columns))]))
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    row = held.agg(F.count(F.lit(1)), *[F.avg(f"__{i}") for i in range(len(columns))], *[F.covar_pop(f"__{i}", f"__{j}") for i, j in pairs]).first()
    n, k = row[0], len(columns)
    cross = np.zeros((k, k))
    for (i, j), x in zip(pairs, row[1 + k :]):
        cross[i, j] = cross[j, i] = (x or 0.0) * n
    return n, np.array([x or 0.0 for x in row[1 : 1 + k]]), cross


def ols(df: DataFrame, target: str, inputs: Sequence[str]) -> dict:
    """Least squares with an intercept: coefficients (intercept first), standard errors, t, p, R2, adjusted R2, F and its p."""
    n, mean, cross = moments(df, [*inputs, target])
    k = len(inputs)
    inverse = invert(cross[:k, :k])
    if inverse is None or n <= k + 1:
        raise CollinearError("collinear")
    b = inverse @ cross[:k, k]
    sst = cross[k, k]
    sse = max(sst - b @ cross[:k, k], 0.0)
    free = n - k - 1
    s2 = sse / free
    se = np.sqrt(np.concatenate([[s2 * (1 / n + mean[:k] @ inverse @ mean[:k])], s2 * np.diag(inverse)]))
    coef = np.concatenate([[mean[k] - b @ mean[:k]], b])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
    r2 = 1 - sse / sst if sst > 0 else 0.0
    f = (sst - sse) / k / s2 if s2 > 0 else math.inf
    return {
        "target": target, "names": ["intercept", *inputs], "coef": coef.tolist(), "se": se.tolist(), "t": t.tolist(), "p": [t_p(x, free) for x in t],
        "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / free, "f": f, "p_f": 0.0 if math.isinf(f) else f_p(f, k, free), "n": n, "rmse": math.sqrt(sse / n),
    }


def analyse(df: DataFrame, target: str, inputs: Sequence[str], kinds: dict[str, str]) -> dict:
    """The analysis that fits the logical types of the columns, as {"type", "result"}: a regression of a numeric target on its numeric inputs, else an
    analysis of variance by its first category; a chi-square test of two categories; unavailable where inputs depend on each other, else unsupported."""
    numeric = [c for c in inputs if kinds.get(c) in ("integer", "float")]
    groups = [c for c in inputs if kinds.get(c) == "category"]
    measured = kinds.get(target) in ("integer", "float")
    if measured and numeric:
        try:
            return {"type": "regression", "result": ols(df, target, numeric)}
        except CollinearError:
            return {"type": "unavailable", "result": None}
    if measured and groups:
        return {"type": "anova", "result": anova(df, target, groups[0])}
    if kinds.get(target) == "category" and groups:
        return {"type": "chi_square", "result": chi_square(df, target, groups[0])}
    return {"type": "unsupported", "result": None}


def stars(p: float | None) -> str:
    return "" if p is None else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "n.s."
