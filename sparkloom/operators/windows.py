"""Ordered transforms. A series is named by its partition columns (any number of series run side by side) and its order.

Without partition columns all rows are one series, which no task holds: ranks, samples and running totals go by ranges of
the order, frames by blocks that overlap by the frame's reach.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sparkloom.functions.values import all_of
from sparkloom.operators.order import in_blocks, numbered, running_sum
from sparkloom.plans.storage import materialise


def _over(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def _framed(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Callable[[WindowSpec], dict[str, Column]], back: int) -> DataFrame:
    return df.withColumns(columns(_over(by, order))) if by else in_blocks(df, order, columns, back)


def ordinal_rank(df: DataFrame, column: str, order: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1..n, nulls first, ties in the given order."""
    if not by:
        return numbered(df, [F.col(column).asc_nulls_first(), order], name).withColumn(name, F.col(name).cast("int"))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(column).asc_nulls_first(), order)))


def moving_average(df: DataFrame, value: str, order: Sequence[str], width: int, by: Sequence[str] = (), name: str = "ma") -> DataFrame:
    """Trailing mean; null until the window is full or if any value in it is missing."""
    last = lambda w: w.rowsBetween(-(width - 1), 0)
    return _framed(df, by, order, lambda w: {name: F.when(F.count(value).over(last(w)) == width, F.avg(value).over(last(w)))}, width - 1)


def weighted_average(df: DataFrame, value: str, order: Sequence[str], weights: Sequence[float], by: Sequence[str] = (), name: str = "wma") -> DataFrame:
    """Trailing weighted mean, weights from the oldest value to the newest."""
    k = len(weights)

    def mean(w: WindowSpec) -> dict[str, Column]:
        parts = [F.lag(value, k - 1 - i).over(w) * float(x) for i, x in enumerate(weights)]
        return {name: sum(parts[1:], parts[0]) / float(sum(weights))}

    return _framed(df, by, order, mean, k - 1)


def difference(df: DataFrame, value: str, order: Sequence[str], lag: int = 1, by: Sequence[str] = (), name: str = "diff") -> DataFrame:
    return _framed(df, by, order, lambda w: {name: F.col(value) - F.lag(value, lag).over(w)}, lag)


def rolling_std(df: DataFrame, value: str, order: Sequence[str], width: int, by: Sequence[str] = (), name: str = "rstd") -> DataFrame:
    last = lambda w: w.rowsBetween(-(width - 1), 0)
    return _framed(df, by, order, lambda w: {name: F.when(F.count(value).over(last(w)) == width, F.stddev_samp(value).over(last(w)))}, width - 1)


def centered_average(df: DataFrame, value: str, order: Sequence[str], period: int, by: Sequence[str] = (), name: str = "trend", place: str | None = None) -> DataFrame:
    """Centred mean; for even periods the two ends count half. Null where the window isn't full. With ``place`` also the row's place 1..n in its series."""
    h = period // 2

    def mean(w: WindowSpec) -> dict[str, Column]:
        span = w.rowsBetween(-h, h)
        full = F.count(value).over(span) == 2 * h + 1
        total = F.sum(value).over(span)
        if period % 2 == 0:
            total = total - (F.lag(value, h).over(w) + F.lead(value, h).over(w)) / 2
        return {name: F.when(full, total / period)}

    if not by:
        return in_blocks(df, order, mean, h, h, place)
    w = _over(by, order)
    return df.withColumns(mean(w) | ({place: F.row_number().over(w)} if place else {}))


def running_total(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "running") -> DataFrame:
    if not by:
        return running_sum(df, value, order, name)
    return df.withColumn(name, F.sum(value).over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def first_ratio(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "cum_return") -> DataFrame:
    """Percent over the first value, two decimals."""
    ratio = lambda first: F.when(first != 0, F.floor((F.col(value) / first - 1) * 10000 + 0.5) / 100)
    if not by:
        start = F.broadcast(df.agg(F.min_by(value, F.struct(*order)).alias("__first")))  # one row
        return df.crossJoin(start).withColumn(name, ratio(F.col("__first"))).drop("__first")
    return df.withColumn(name, ratio(F.first(value).over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0))))


def moving_range(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "mr") -> DataFrame:
    """|x - previous x| over the values that aren't missing."""
    return _framed(df.where(F.col(value).isNotNull()), by, order, lambda w: {name: F.abs(F.col(value) - F.lag(value).over(w))}, 1)


def systematic_sample(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """Every k-th row in order, with k so that at most ``most`` rows are left."""
    n = df.count()
    step = max(1, -(-n // most))
    return numbered(df, order).where((F.col("__n") - 1) % step == 0).drop("__n")


def spearman(df: DataFrame, x: str, y: str, order: str) -> DataFrame:
    """Correlation of ordinal ranks (ties in the given order) over complete pairs."""
    held = df.where(all_of([F.col(x).isNotNull(), F.col(y).isNotNull()]))
    ranked = ordinal_rank(ordinal_rank(held, x, order, name="__rx"), y, order, name="__ry")
    return ranked.agg(F.corr("__rx", "__ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_matrix(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """(a, b, rho, n) for every ordered pair of columns; each pair is ranked over its own complete rows, and once for both its orders."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i:]:
            names = [(a, b)] if a == b else [(a, b), (b, a)]
            found = df.where(F.col(a).isNotNull()).agg(F.lit(1.0).alias("rho"), F.count(F.lit(1)).alias("n")) if a == b else spearman(df, a, b, order)
            cells = found.select(F.inline(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col("rho"), F.col("n")) for x, y in names])))
            out = cells if out is None else out.unionAll(cells)
    return out


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time; of right rows at one time the greatest values.

    A null key or time matches nothing. Both sides are united and dealt to ranges of key and time, so a hot key spans
    several ranges; values are carried forward inside a range, and each range's last right row (one row for each
    partition) goes on to those that follow.
    """
    l = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType))
    keep = [c for c in left.columns]
    met = right.where(all_of([F.col(c).isNotNull() for c in [*on, right_time]]))
    r = met.select(*[F.col(c) for c in on], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    both = l.unionByName(r, allowMissingColumns=True)
    dealt = materialise(both.repartitionByRange(*on, "__t").withColumn("__range", F.spark_partition_id()), "ranges")
    ends = dealt.where("__side = 0").groupBy("__range").agg(F.max(F.struct(*on, "__t", "__v")).alias("__end"))
    past = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    every = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size")).join(ends, "__range", "left")
    carried = every.select("__range", F.last("__end", ignorenulls=True).over(past).alias("__past"))  # one row for each partition
    w = Window.partitionBy("__range", *on).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").join(F.broadcast(carried), "__range")
    same = all_of([F.col(c) == F.col(f"__past.{c}") for c in on] + [F.col("__t").isNotNull()])
    v = F.coalesce("__v", F.when(same, F.col("__past.__v")))
    return filled.withColumn("__v", v).select(*keep, *[F.col(f"__v.{c}").alias(c) for c in values])
