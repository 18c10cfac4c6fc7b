"""The cleaning pipeline: an immutable list of steps with a cursor, folded into one lazy plan.

A dataset needs an ordering column (``order``, unique) wherever a step depends on row order.
Steps that need statistics of a column take them from a one-row aggregate which is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.formula import compile_formula
from sparkloom.functions.values import blank, number, round_half_up, text
from sparkloom.operators import aggregate, filters
from sparkloom.operators.distributions import mahalanobis
from sparkloom.operators.order import exact_quantiles, numbered
from sparkloom.operators.overlay import edited, without


@dataclass(frozen=True)
class Step:
    op: str
    col: str | None = None
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    """Steps and the number of them that are active."""

    steps: tuple[Step, ...] = ()
    cursor: int = 0

    def add(self, step: Step) -> Pipeline:
        """Append a step; undone steps are forgotten."""
        kept = (*self.steps[: self.cursor], step)
        return Pipeline(kept, len(kept))

    def goto(self, cursor: int) -> Pipeline:
        return replace(self, cursor=max(0, min(cursor, len(self.steps))))

    def undo(self) -> Pipeline:
        return self.goto(self.cursor - 1)

    def redo(self) -> Pipeline:
        return self.goto(self.cursor + 1)

    def clear(self) -> Pipeline:
        return Pipeline()

    def apply(self, df: DataFrame, order: str) -> DataFrame:
        for step in self.steps[: self.cursor]:
            if step.op in STEPS:  # unknown steps are left out
                df = STEPS[step.op](df, step.col, step.params, order)
        return df


def _value(df: DataFrame, col: str) -> Column:
    return number(F.col(col), df.schema[col].dataType)


def _with_stats(df: DataFrame, stats: dict[str, Column], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """change(df with the one-row statistics joined) without them."""
    row = F.broadcast(df.agg(*[c.alias(f"__{k}") for k, c in stats.items()]))
    return change(df.join(row)).drop(*[f"__{k}" for k in stats])


def _fill(df: DataFrame, col: str, filler: Column) -> DataFrame:
    return df.withColumn(col, F.when(blank(F.col(col)), filler).otherwise(F.col(col)))


def fill_mean(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    """Blanks become the mean to one decimal, 0 if there is none."""
    return _with_stats(df, {"m": F.avg(_value(df, col))}, lambda d: _fill(d, col, F.coalesce(round_half_up(F.col("__m"), 1), F.lit(0.0))))


def fill_median(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    middle = F.broadcast(exact_quantiles(df, (), [("__m", _value(df, col), 0.5)]))  # one row
    return _fill(df.join(middle), col, F.col("__m")).drop("__m")


def fill_mode(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    top = F.broadcast(aggregate.mode(df, col, order).agg(F.max("mode").alias("__m")))
    return _fill(df.join(top), col, F.col("__m")).drop("__m")


def drop_duplicates(df: DataFrame, col: str | None, params: dict, order: str) -> DataFrame:
    """The first of equal rows, the ordering column left out of the comparison."""
    same = [c for c in df.columns if c != order]
    first = df.groupBy(*same).agg(F.min(order).alias(order))
    return first.select(*df.columns)


def rename(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    return df if params["to"] in df.columns else df.withColumnRenamed(col, params["to"])


def replace_value(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    """Values whose text equals ``from`` become ``to``; a numeric column stays numeric if ``to`` is a number, else turns into text."""
    kind = df.schema[col].dataType
    hit = text(F.col(col), kind) == params["from"]
    try:
        return df.withColumn(col, F.when(hit, F.lit(float(params["to"])).cast(kind)).otherwise(F.col(col))) if kind.simpleString() != "string" else df.withColumn(col, F.when(hit, params["to"]).otherwise(F.col(col)))
    except (TypeError, ValueError):
        return df.withColumn(col, F.when(hit, params["to"]).otherwise(text(F.col(col), kind)))


def label_encode(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    """Codes 0..k-1 of the distinct values in text order, blanks null."""
    name = params.get("new", f"{col}_enc")
    word = text(F.col(col), df.schema[col].dataType)
    levels = df.where(~blank(F.col(col))).select(word.alias("__w")).distinct()
    codes = numbered(levels, ["__w"], name).withColumn(name, (F.col(name) - 1).cast("int"))
    return df.withColumn("__w", word).join(codes, "__w", "left").drop("__w")


def dummy_encode(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    """A 0/1 column for each level; levels are columns, so at most ``max_levels`` (default 50) may exist."""
    most = params.get("max_levels", 50)
    word = text(F.col(col), df.schema[col].dataType)
    levels = [r[0] for r in df.where(~blank(F.col(col))).select(word).distinct().orderBy(word).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{col} has more than {most} levels")
    out = {re.sub(r"\s+", "_", f"{col}_{v}")[:40]: F.when(word == v, 1).otherwise(0) for v in levels}
    return df.withColumns(out) if out else df


def standardize(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    v = _value(df, col)
    scaled = F.when(F.col("__sd") > 0, round_half_up((v - F.col("__m")) / F.col("__sd"), 4)).otherwise(v)
    return _with_stats(df, {"m": F.avg(v), "sd": F.stddev_samp(v)}, lambda d: d.withColumn(col, scaled))


def normalize(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    v = _value(df, col)
    scaled = F.when(F.col("__hi") > F.col("__lo"), round_half_up((v - F.col("__lo")) / (F.col("__hi") - F.col("__lo")), 4)).otherwise(v)
    return _with_stats(df, {"lo": F.min(v), "hi": F.max(v)}, lambda d: d.withColumn(col, scaled))


def log_transform(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    v = _value(df, col)
    return df.withColumn(col, F.when(v > -1, round_half_up(F.log1p(v), 4)).otherwise(v))


def rank_transform(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    """1..n over the whole column, nulls first, ties in order: rows are dealt to ranges of the order and numbered inside them."""
    return numbered(df, [F.col(col).asc_nulls_first(), order], "__rank").withColumn(col, F.col("__rank").cast("int")).drop("__rank").select(df.columns)


def winsorize(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    p, v = params.get("p", 5) / 100, _value(df, col)
    ends = F.broadcast(exact_quantiles(df, (), [("__lo", v, p), ("__hi", v, 1 - p)]))  # one row
    return df.join(ends).withColumn(col, F.when(v.isNotNull(), F.greatest(F.least(v, F.col("__hi")), F.col("__lo")))).drop("__lo", "__hi")


def binning(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    """Equal widths, labelled [lo, hi) with two decimals at most; the top value is in the last bin."""
    n, v = params.get("n", 5), _value(df, col)
    name = params.get("new", f"{col}_bin")
    width = (F.col("__hi") - F.col("__lo")) / n
    k = F.least(F.floor(F.when(width > 0, (v - F.col("__lo")) / width).otherwise(0)), F.lit(n - 1))
    edge = lambda i: text(round_half_up(F.col("__lo") + width * i, 2), df.select(F.lit(1.0)).schema[0].dataType)
    label = F.when(v.isNotNull(), F.concat(F.lit("["), edge(k), F.lit(", "), edge(k + 1), F.lit(")")))
    return _with_stats(df, {"lo": F.min(v), "hi": F.max(v)}, lambda d: d.withColumn(name, label))


def formula(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    """A new column; a formula that doesn't compile leaves the data as it is."""
    try:
        made = compile_formula(params["formula"], df.schema)
    except ValueError:
        return df
    return df.withColumn(params.get("new", col), made)


def set_cells(df: DataFrame, col: str | None, params: dict, order: str) -> DataFrame:
    """params["cells"]: (order value, column, value) of the caller's, the last for a cell counts; numbers that don't parse become null, whole columns round."""
    cells = [(str(key), column, None if value is None else str(value), i) for i, (key, column, value) in enumerate(params["cells"])]
    return edited(df, df.sparkSession.createDataFrame(cells, "key string, column string, value string, at long"), order) if cells else df


def drop_rows(df: DataFrame, col: str | None, params: dict, order: str) -> DataFrame:
    return without(df, df.sparkSession.createDataFrame([(str(k),) for k in params["keys"]], "key string"), order) if params["keys"] else df


def add_row(df: DataFrame, col: str | None, params: dict, order: str) -> DataFrame:
    row = params["row"]
    one = df.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(one)


def add_column(df: DataFrame, col: str, params: dict, order: str) -> DataFrame:
    if col not in df.columns:
        names, at = list(df.columns), params.get("at", len(df.columns))
        df = df.withColumn(col, F.lit(params.get("default")).cast(params.get("type", "string"))).select(*names[:at], col, *names[at:])
    return df


def reorder(df: DataFrame, col: str | None, params: dict, order: str) -> DataFrame:
    first = [c for c in params["columns"] if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


STEPS: dict[str, Callable[[DataFrame, str, dict, str], DataFrame]] = {
    "drop_missing": lambda df, col, params, order: filters.drop_missing(df, col),
    "fill_mean": fill_mean,
    "fill_median": fill_median,
    "fill_mode": fill_mode,
    "drop_duplicates": drop_duplicates,
    "remove_outliers": lambda df, col, params, order: filters.remove_outliers(df, col),
    "rename": rename,
    "replace": replace_value,
    "change_type": lambda df, col, params, order: df.withMetadata(col, {**df.schema[col].metadata, "type": params["type"], "role": "measure" if params["type"] in ("integer", "float") else "dimension"}),
    "label_encode": label_encode,
    "dummy_encode": dummy_encode,
    "drop_col": lambda df, col, params, order: df.drop(col),
    "standardize": standardize,
    "normalize": normalize,
    "log_transform": log_transform,
    "rank_transform": rank_transform,
    "winsorize": winsorize,
    "binning": binning,
    "formula": formula,
    "set_cell": lambda df, col, params, order: set_cells(df, None, {"cells": [(params["key"], col, params["value"])]}, order),
    "set_cells": set_cells,
    "drop_rows": drop_rows,
    "add_row": add_row,
    "add_col": add_column,
    "reorder_cols": reorder,
}


def issues(df: DataFrame, measures: list[str]) -> DataFrame:
    """One row: rows, missing cells, duplicate rows, and for each measure the values beyond its quartile bounds."""
    lost = sum((F.count_if(blank(F.col(c))) for c in df.columns), F.lit(0))
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), lost.alias("missing_cells"))
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    out = base.join(distinct).select("n_rows", "missing_cells", (F.col("n_rows") - F.col("n_distinct")).alias("duplicate_rows"))
    return out.join(filters.outlier_counts(df, measures)) if measures else out  # one row each


def joint_outliers(df: DataFrame, measures: list[str]) -> tuple[DataFrame | None, str | None]:
    """The complete rows that lie far from the rest over all measures together, which a cleaning step may drop by key; or the reason why there are none to find."""
    try:
        return mahalanobis(df, measures).where("outlier"), None
    except ValueError as why:
        return None, str(why)


def free_name(taken: list[str], name: str = "new_col") -> str:
    """The name, or the first of name_2, name_3, ... that no column has."""
    k, unique = 2, name
    while unique in taken:
        unique, k = f"{name}_{k}", k + 1
    return unique
