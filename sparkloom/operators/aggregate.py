"""Grouped aggregation, quantiles, modes, histograms and profiles by grouped passes; nothing is collected.

Medians and other quantiles are exact and have passes of their own (``order.exact_quantiles``), so that no task holds the
distinct values of a group; all other statistics of a call are one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sparkloom.functions.values import all_of, blank, group_text, number, safe_divide
from sparkloom.operators.order import exact_quantiles


def measure(df: DataFrame, column: str, how: str) -> Column:
    """The aggregate of a column: sum avg min max count countd std missing, median or ``q0.25``; sum where unknown.

    As a column, a quantile is Spark's, which holds a group's distinct values (windows of events use it); see ``summarise``.

    Sums of nothing are 0, counts count rows, distinct counts leave blanks out, everything else ignores what is no number.
    """
    kind = df.schema[column].dataType
    value = number(F.col(column), kind)
    if (p := quantile_of(how)) is not None:
        return F.percentile(value, p)
    return {
        "avg": lambda: F.avg(value),
        "mean": lambda: F.avg(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "count": lambda: F.count(F.lit(1)),
        "countd": lambda: F.count_distinct(F.when(~blank(F.col(column)), F.col(column))),
        "std": lambda: F.stddev_samp(value),
        "missing": lambda: F.count_if(blank(F.col(column))),
    }.get(how, lambda: F.coalesce(F.sum(value), F.lit(0.0)))()


def quantile_of(how: str) -> float | None:
    """The share that a measure of kind ``median`` or ``q0.25`` stands for; None for other measures."""
    if how == "median":
        return 0.5
    return float(how[1:]) if how.startswith("q") and how[1:].replace(".", "", 1).isdigit() else None


def summarise(df: DataFrame, keys: Sequence[str], measures: Sequence[tuple[str, str, str]]) -> DataFrame:
    """keys (nulls are keys), the measures (column, how, name; quantiles too) and __count, one row for each key tuple."""
    ranks = [(name, number(F.col(c), df.schema[c].dataType), quantile_of(how)) for c, how, name in measures if quantile_of(how) is not None]
    sets = [(name, F.when(~blank(F.col(c)), F.col(c))) for c, how, name in measures if how == "countd"]
    sets = sets if len({str(v) for _, v in sets}) > 1 else []  # distinct counts of a single column need no copies of rows
    apart = {name for name, *_ in (*ranks, *sets)}
    met = df.groupBy(*keys).agg(*[measure(df, c, how).alias(name) for c, how, name in measures if name not in apart], F.count(F.lit(1)).alias("__count"))
    for found in ([exact_quantiles(df, keys, ranks)] if ranks else []) + ([distinct_counts(df, keys, sets)] if sets else []):
        found = found.withColumnsRenamed({k: f"__q_{k}" for k in keys})
        met = met.join(found, all_of([F.col(k).eqNullSafe(F.col(f"__q_{k}")) for k in keys]), "left").drop(*[f"__q_{k}" for k in keys]) if keys else met.crossJoin(F.broadcast(found))  # without keys, one row
    return met.select(*keys, *[name for _, _, name in measures], "__count")


def distinct_counts(df: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row for each key tuple (nulls are keys) with the numbers of distinct values (name, value) that are not null.

    Each value has a scan of its own columns, which a columnar file reads once in all, and two sums that begin before the shuffle;
    rows are never copied once for each value.
    """
    ids, names = [F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], [f"__k{j}" for j in range(len(keys))]
    parts = None
    for i, (_, value) in enumerate(wanted):
        each = df.select(*ids, value.alias("__v")).distinct()
        part = each.groupBy(*names).agg(F.count("__v").alias("__n")).withColumn("__i", F.lit(i))
        parts = part if parts is None else parts.union(part)
    found = parts.groupBy(*names).agg(*[F.coalesce(F.max(F.when(F.col("__i") == i, F.col("__n"))), F.lit(0)).alias(name) for i, (name, _) in enumerate(wanted)])
    return found.withColumnsRenamed(dict(zip(names, keys)))


def group_by(df: DataFrame, keys: Sequence[str], measures: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row for each key tuple (as text), the measures (column, how, name), and __count."""
    texts = [group_text(F.col(k), df.schema[k].dataType).alias(k) for k in keys]
    asked = list(dict.fromkeys(c for c, _, _ in measures))
    held = df.select(*[F.col(c).alias(f"__m_{c}") for c in asked], *texts)
    grouped = summarise(held, keys, [(f"__m_{c}", how, name) for c, how, name in measures])
    return grouped if keys else grouped.where("__count > 0")


def mode(df: DataFrame, column: str, order: str) -> DataFrame:
    """The most frequent value; of ties the one that gets to that count first in the given order."""
    counts = df.where(~blank(F.col(column))).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("reached"))
    return counts.orderBy(F.desc("n"), F.asc("reached")).limit(1).select(F.col(column).alias("mode"), "n")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of complete pairs; null for under two pairs or without spread."""
    a, b = number(F.col(x), df.schema[x].dataType), number(F.col(y), df.schema[y].dataType)
    pairs = df.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    spread = (F.var_pop("a") > 0) & (F.var_pop("b") > 0)
    return pairs.agg(F.when((F.count(F.lit(1)) >= 2) & spread, F.corr("a", "b")).alias("r"), F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every ordered pair of columns, all in one pass over the rows."""
    cells = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            ok = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
            r = F.lit(1.0) if a == b else F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y))
            cells += [F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), r.alias("r")) for p, q in dict.fromkeys([(a, b), (b, a)])]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, lo, hi, n of equal widths; the last bin is closed; without spread the width is 1. Empty bins have 0."""
    value = number(F.col(column), df.schema[column].dataType)
    held = df.select(value.alias("v")).where("v is not null")
    ends = held.agg(F.min("v").alias("lo"), F.max("v").alias("top")).withColumn("w", (F.col("top") - F.col("lo")) / bins)
    ends = ends.withColumn("w", F.when(F.col("w") == 0, 1.0).otherwise(F.col("w"))).where("lo is not null")
    place = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    found = held.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends is one row
    grid = ends.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda k: F.col("lo") + F.col("w") * k
    return grid.join(found, "bin", "left").select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def value_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """The histogram, but with a single bin from the value to itself where all values are equal."""
    found = histogram(df, column, bins)
    ends = df.agg(F.min(number(F.col(column), df.schema[column].dataType)).alias("__a"), F.max(number(F.col(column), df.schema[column].dataType)).alias("__b"))
    met = found.crossJoin(F.broadcast(ends))  # ends is one row
    flat = F.col("__a") == F.col("__b")
    return met.where(~flat | (F.col("bin") == 0)).select("bin", "lo", F.when(flat, F.col("lo")).otherwise(F.col("hi")).alias("hi"), "n")


def skew_kurtosis(value: Column) -> tuple[Column, Column]:
    """Sample-corrected skewness and excess kurtosis: null under 3 and 4 values, 0 skewness without spread."""
    n = F.count(value).cast("double")
    skew = F.when(n >= 3, F.when(F.stddev_samp(value) < 1e-12, 0.0).otherwise(F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)))
    kurt = F.when((n >= 4) & (F.stddev_samp(value) >= 1e-12), ((n + 1) * F.kurtosis(value) + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return skew, kurt


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: n, mean, median, std, min, q1, q3, max, skewness, kurtosis; one pass for all columns, and those of the quantiles."""
    rows, ranks, value = [], [], {c: number(F.col(c), df.schema[c].dataType) for c in columns}
    for i, (c, v) in enumerate(value.items()):
        skew, kurt = skew_kurtosis(v)
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), skew.alias("skewness"), kurt.alias("kurtosis")))
        ranks += [(f"{name}_{i}", v, p) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    plain = df.agg(F.array(*rows).alias("rows"))
    sides = F.array(*[F.struct(*[F.col(f"{name}_{i}").alias(name) for name in ("q1", "median", "q3")]) for i in range(len(value))])
    both = plain.crossJoin(F.broadcast(exact_quantiles(df, (), ranks).select(sides.alias("sides"))))  # one row each
    found = both.select("sides", F.inline("rows"))
    return found.select("column", "n", "mean", F.get("sides", "i")["median"].alias("median"), "std", "min", F.get("sides", "i")["q1"].alias("q1"), F.get("sides", "i")["q3"].alias("q3"), "max", "skewness", "kurtosis")


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: rows, missing, missing_pct, distinct. One pass, and one of each column for its distinct values, which are counted exactly."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        n, lost = F.count(F.lit(1)), F.count_if(blank(F.col(f.name)))
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), n.alias("n_rows"), lost.alias("missing"), F.coalesce(safe_divide(lost * 100.0, n), F.lit(0.0)).alias("missing_pct")))
    sets = [(f"__d{i}", F.when(~blank(F.col(c)), F.col(c))) for i, c in enumerate(df.columns)]
    met = df.agg(F.array(*rows).alias("rows")).crossJoin(F.broadcast(distinct_counts(df, (), sets)))  # one row each
    return met.select(F.array(*[n for n, _ in sets]).alias("sets"), F.inline("rows")).select("column", "n_rows", "missing", "missing_pct", F.get("sets", "i").alias("distinct"))


def column_report(df: DataFrame, top: int = 10) -> DataFrame:
    """A row for each column: column, kind, the figures of ``profile``, mean and std (of numbers), least and largest value (as text), and its most frequent values with their counts.

    One pass over all columns, and one of each for its values, which are counted exactly; blanks are missing and no values.
    """
    rows, parts = [], None
    null = F.lit(None).cast("double")
    ahead = lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0)
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        held, numeric = F.when(~blank(c), c), isinstance(f.dataType, NumericType)
        n, lost = F.count(F.lit(1)), F.count_if(blank(c))
        figures = [n.alias("n_rows"), lost.alias("missing"), F.coalesce(safe_divide(lost * 100.0, n), F.lit(0.0)).alias("missing_pct"), (F.avg(c).cast("double") if numeric else null).alias("mean"), (F.stddev_samp(c) if numeric else null).alias("std"), F.min(held).cast("string").alias("least"), F.max(held).cast("string").alias("largest")]
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), F.lit(f.dataType.typeName()).alias("kind"), *figures))
        counts = df.select(held.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        listed = F.array_sort(F.collect_list(F.struct("n", "v")), ahead)  # of ``top`` rows at most
        most = counts.orderBy(F.desc("n"), "v").limit(top).agg(F.transform(listed, lambda t: F.struct(t["v"].cast("string").alias("value"), t["n"].alias("n"))).alias("top"))
        part = counts.agg(F.lit(i).alias("__i"), F.count(F.lit(1)).alias("distinct")).crossJoin(most)  # one row each
        parts = part if parts is None else parts.union(part)
    met = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).join(F.broadcast(parts), F.col("i") == F.col("__i"))  # a row for each column
    return met.select("column", "kind", "n_rows", "missing", "missing_pct", "distinct", "mean", "std", "least", "largest", "top")


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values with their counts, null among them."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(n)


def year_growth(df: DataFrame, date: str, value: str) -> DataFrame:
    """Mean of the first and the last year and the growth between them."""
    years = df.groupBy(F.substring(F.col(date).cast("string"), 1, 4).alias("year")).agg(F.avg(number(F.col(value), df.schema[value].dataType)).alias("m"))
    ends = years.agg(F.min_by("m", "year").alias("first_mean"), F.max_by("m", "year").alias("last_mean"))
    return ends.withColumn("growth", safe_divide(F.col("last_mean"), F.col("first_mean")) - 1)
