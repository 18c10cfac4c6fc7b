"""Cross tables. One grouping-sets pass gives cells, row totals, column totals and the grand total from the source rows; quantiles have passes of their own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.values import all_of, group_text
from sparkloom.operators.aggregate import measure, quantile_of, summarise
from sparkloom.operators.order import numbered

#: Aggregates whose empty cell is 0; those of all others is null.
ZERO = ("sum", "count", "countd")


@dataclass(frozen=True)
class PivotSpec:
    rows: tuple[str, ...]
    columns: tuple[str, ...]
    values: tuple[tuple[str, str], ...]

    def __post_init__(self) -> None:
        if not self.values:
            raise ValueError("a pivot needs one value at least")


def default_agg(role: str) -> str:
    return "sum" if role == "measure" else "countd"


def long_form(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """One row for each cell and total: row keys, column keys, level (cell, row, column, grand), and a column value__agg for each value.

    Keys are texts, null and the empty text one bucket; a total's missing keys are null.
    """
    dims = [*spec.rows, *spec.columns]
    keys = [f"__d{i}" for i in range(len(dims))]
    held = df.select("*", *[group_text(F.col(d), df.schema[d].dataType).alias(k) for d, k in zip(dims, keys)])
    r, c = keys[: len(spec.rows)], keys[len(spec.rows) :]
    sets = list(dict.fromkeys([tuple(keys), tuple(r), tuple(c), ()]))
    aggs = [measure(df, v, how).alias(f"{v}__{how}") for v, how in spec.values if quantile_of(how) is None] or [F.count(F.lit(1)).alias("__n")]
    out = held.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("__g"), *aggs)
    ranks = [(v, how, f"{v}__{how}") for v, how in spec.values if quantile_of(how) is not None]
    mask = lambda s: sum(0 if k in s else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys))
    if ranks:  # every row once for each grouping set, as the plain pass expands it too
        cases = [F.struct(F.lit(mask(s)).cast("long").alias("__g"), *[(F.col(k) if k in s else F.lit(None).cast("string")).alias(f"__s{k}") for k in keys]) for s in sets]
        spread = held.select(*dict.fromkeys(v for v, _, _ in ranks), F.inline(F.array(*cases)))
        same = [F.col("__g") == F.col("__h"), *[F.col(k).eqNullSafe(F.col(f"__s{k}")) for k in keys]]
        out = out.join(summarise(spread, ["__g", *[f"__s{k}" for k in keys]], ranks).drop("__count").withColumnRenamed("__g", "__h"), all_of(same), "left")
    bits = lambda s: sum(0 if k in s else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys))
    level = F.when(F.col("__g") == bits(keys), "cell").when(F.col("__g") == bits(()), "grand").when(F.col("__g") == bits(r), "row").otherwise("column")
    return out.select(*[F.col(k).alias(d) for k, d in zip(keys, dims)], level.alias("level"), *[f"{v}__{how}" for v, how in spec.values])


def tuples(df: DataFrame, dims: Sequence[str], locale: str = "UNICODE") -> DataFrame:
    """The distinct tuples of dims (as text) with their place 1, 2, ... in a locale's order, blanks first: the order of an axis."""
    found = df.select(*[group_text(F.col(d), df.schema[d].dataType).alias(d) for d in dims]).distinct()
    keys = [k for d in dims for k in (F.collate(F.coalesce(d, F.lit("")), locale).asc(), F.coalesce(d, F.lit("")).asc())]
    return numbered(found, keys, "place")


def wide(df: DataFrame, spec: PivotSpec, max_columns: int = 500, locale: str = "UNICODE") -> DataFrame:
    """One row for each row tuple (and a grand total row, whose keys are null), a column for each column tuple and value in a locale's order, and totals.

    Column tuples become columns, so there may be ``max_columns`` of them at most; more raise an error.
    """
    cells = long_form(df, spec)
    if not spec.columns:
        return cells.where(F.col("level").isin("cell", "row", "grand")).select(*spec.rows, *[F.col(f"{v}__{h}").alias(f"total__{v}__{h}") for v, h in spec.values])
    label = F.concat_ws("¦", *spec.columns)
    marked = cells.withColumn("__c", F.when(F.col("level").isin("cell", "column"), label))
    names = [x[0] for x in marked.where(F.col("__c").isNotNull()).select("__c").distinct().orderBy(F.collate("__c", locale), "__c").limit(max_columns + 1).collect()]
    if len(names) > max_columns:
        raise ValueError(f"a pivot with more than {max_columns} columns")
    aggs = []
    for v, h in spec.values:
        value = f"{v}__{h}"
        for n in names:
            cell = F.max(F.when(F.col("__c") == n, F.col(value)))
            aggs.append((F.coalesce(cell, F.lit(0)) if h in ZERO else cell).alias(f"{n}¦{value}"))
        aggs.append(F.max(F.when(F.col("level").isin("row", "grand"), F.col(value))).alias(f"total__{value}"))
    grand = F.col("level").isin("column", "grand")
    return marked.groupBy(grand.alias("__grand"), *spec.rows).agg(*aggs).drop("__grand")
