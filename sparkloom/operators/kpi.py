"""KPI formulas over whole tables and over groups, many at a time, with errors as values.

The formulas are taken apart into the aggregates that they name, each once however many formulas name it. Sums, means,
extremes and counts are one grouped pass; all medians are selected together (``order.exact_quantiles``) and distinct
counts are made column by column (``aggregate.distinct_counts``), so that no task holds the values of a group. The
answers are put back into the formulas as columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.formula import FormulaError, Kpi, compile_kpi
from sparkloom.functions.values import blank
from sparkloom.operators.aggregate import summarise


def _leaves(df: DataFrame, leaves: Mapping[tuple[str, str], str], keys: Sequence[str]) -> DataFrame:
    """keys and a column for each leaf."""
    fields = dict.fromkeys(field for how, field in leaves if how != "rows")
    names = {field: f"__f{i}" for i, field in enumerate(fields)}
    held = df.select(*keys, *[F.col(f"`{field}`").alias(name) for field, name in names.items()], *[F.when(~blank(F.col(f"`{field}`")), 1).alias(f"{name}n") for field, name in names.items() if ("filled", field) in leaves])
    asked = [(f"{names[field]}n", "sum", name) if how == "filled" else (names[field], how, name) for (how, field), name in leaves.items() if how != "rows"]
    return summarise(held, keys, asked).withColumnsRenamed({"__count": leaves.get(("rows", ""), "__count")})


def kpi(df: DataFrame, source: str, name: str = "value", keys: Sequence[str] = (), error: str | None = None) -> DataFrame:
    """keys and the value of a KPI formula, one row for each key tuple (nulls are keys); its error too, if that is given a name."""
    plan = compile_kpi(source, df.schema)
    return _leaves(df, plan.leaves, keys).select(*keys, plan.value.alias(name), *([plan.error.alias(error)] if error else []))


def report(df: DataFrame, formulas: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, kpi, value and error: a row for each key tuple and formula, by name; a formula that can't be read or names no such column is a row with what is wrong."""
    leaves: dict[tuple[str, str], str] = {}
    plans: dict[str, Kpi | str] = {}
    for name, source in formulas.items():
        try:
            plans[name] = compile_kpi(source, df.schema, leaves)
        except FormulaError as wrong:
            plans[name] = str(wrong)
    null, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    sides: dict[str, tuple[Column, Column]] = {n: (p.value, p.error) if isinstance(p, Kpi) else (null, F.coalesce(text, F.lit(p))) for n, p in plans.items()}
    rows = [F.struct(F.lit(n).alias("kpi"), value.alias("value"), error.alias("error")) for n, (value, error) in sides.items()]
    return _leaves(df, leaves, keys).select(*keys, F.inline(F.array(*rows)))
