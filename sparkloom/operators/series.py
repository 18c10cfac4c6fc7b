"""Time series: smoothing, autocorrelation and seasonal decomposition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.order import with_lags
from sparkloom.operators.windows import centered_average
from sparkloom.plans.storage import materialise


State = tuple[float, ...]


class Smoothing:
    """A recurrence that is linear in its state and the value, once its first ``warm_up`` values have set the state."""

    names: tuple[str, ...]
    warm_up: int

    def begin(self, first: Sequence[float]) -> State:
        """The state before the last of the first values is taken in, which leads to the right one after it."""
        raise NotImplementedError

    def next(self, state: State, x: float) -> State:
        raise NotImplementedError

    def shown(self, state: State | None, first: Sequence[float], before: State | None, x: float | None) -> State | tuple[None, ...]:
        """The row's columns, from the state after it (None in the warm-up), the first values so far and the state before it."""
        raise NotImplementedError


class _Level(Smoothing):
    names, warm_up = ("smooth",), 1

    def __init__(self, alpha: float):
        self.alpha = alpha

    def begin(self, first):
        return (first[0],)

    def next(self, state, x):
        return (self.alpha * x + (1 - self.alpha) * state[0],)

    def shown(self, state, first, before, x):
        return state or (None,)


class _Trend(Smoothing):
    names, warm_up = ("level", "trend", "fitted"), 2

    def __init__(self, alpha: float, beta: float):
        self.alpha, self.beta = alpha, beta

    def begin(self, first):
        return first[0], first[1] - first[0]

    def next(self, state, x):
        fitted = state[0] + state[1]
        level = self.alpha * x + (1 - self.alpha) * fitted
        return level, self.beta * (level - state[0]) + (1 - self.beta) * state[1]

    def shown(self, state, first, before, x):
        if x is None:
            return None, None, None
        return (first[0], None, first[0]) if state is None else (*state, before[0] + before[1])


def _smooth(keys: list, values: list, how: Smoothing, start: dict, carried: tuple) -> tuple[list, tuple]:
    """The columns of rows that are in order of key and time; ``carried`` is (key, first values, state) of the row before."""
    now, first, state = carried
    out = []
    for key, x in zip(keys, values):
        if key != now:
            now, (first, state) = key, start.get(key, ((), None))
        x, before = (None if x is None or x != x else x), state
        if x is not None and state is None:
            first = (*first, x)
            before = how.begin(first) if len(first) == how.warm_up else None
        if x is not None and before is not None:
            state = how.next(before, x)
        out.append(how.shown(state, first, before, x))
    return out, (now, first, state)


def _smoothed(df: DataFrame, value: str, order: str, by: Sequence[str], how: Smoothing) -> DataFrame:
    """A recurrence over each series, in batches with the state carried from one to the next. ``order`` is unique in a series.

    A single series is dealt to ranges of the order. Each range becomes one linear map of the state (a row for each
    partition); these are chained, and then every range is smoothed from the state with which it begins.
    """
    held = df.select(*by, order, F.col(value).cast("double").alias(value))
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in held.schema.fields)
    start: dict = {}
    if by:
        keys, sorted_ = list(by), held.repartition(*by).sortWithinPartitions(*by, order)
    else:
        keys, dealt = ["__range"], materialise(held.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")
        schema += ", __range int"
        start = _starts(dealt, value, order, how)
        sorted_ = dealt.repartition("__range").sortWithinPartitions("__range", order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = (None, (), None)
        for part in parts:
            named = part[keys].astype(object).where(part[keys].notna(), None)  # a missing key is one key
            rows, carried = _smooth(list(named.itertuples(index=False, name=None)), part[value].tolist(), how, start, carried)
            yield part.assign(**{n: [r[i] for r in rows] for i, n in enumerate(how.names)})

    found = sorted_.mapInPandas(run, f"{schema}, " + ", ".join(f"{n} double" for n in how.names))
    return found if by else found.drop("__range")


def _starts(dealt: DataFrame, value: str, order: str, how: Smoothing) -> dict[tuple, tuple]:
    """(first values, state) with which each range begins; what reaches the driver is a row for each partition."""
    there = dealt.where(F.col(value).isNotNull() & ~F.isnan(value))
    warm = there.orderBy(order).limit(how.warm_up).collect()
    ranges = sorted(r[0] for r in dealt.select("__range").distinct().collect())
    first = tuple(r[value] for r in warm)
    begun = {(k,): (tuple(x for x, r in zip(first, warm) if r["__range"] < k), None) for k in ranges}
    if len(warm) < how.warm_up:
        return begun
    width = len(how.begin(first))
    units = [tuple(float(i == j) for j in range(width)) for i in range(width)]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, shift, turned = None, None, None
        for part in parts:
            for key, x in zip(part["__range"].tolist(), part[value].tolist()):
                if key != now:
                    if now is not None:
                        yield pd.DataFrame({"range": [now], "shift": [shift], "turned": [[t for u in turned for t in u]]})
                    now, shift, turned = key, (0.0,) * width, units
                shift, turned = how.next(shift, x), [how.next(u, 0.0) for u in turned]
        if now is not None:
            yield pd.DataFrame({"range": [now], "shift": [shift], "turned": [[t for u in turned for t in u]]})

    after = there.where(F.col(order) > F.lit(warm[-1][order])).select("__range", order, value)
    maps = after.repartition("__range").sortWithinPartitions("__range", order).mapInPandas(fold, "range int, shift array<double>, turned array<double>")
    by_range = {r.range: (np.array(r.shift), np.array(r.turned).reshape(width, width)) for r in maps.collect()}
    state = np.array(how.next(how.begin(first), first[-1]))
    for k in ranges:
        if k > warm[-1]["__range"]:
            begun[(k,)] = (first, tuple(state.tolist()))
        if k in by_range:
            shift, turned = by_range[k]
            state = shift + state @ turned
    return begun


def exponential(df: DataFrame, value: str, order: str, alpha: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """s0 = x0, then alpha x + (1 - alpha) s; a missing value carries the level on, leading ones wait for the first value."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be over 0 and at most 1")
    return _smoothed(df, value, order, by, _Level(alpha))


def holt(df: DataFrame, value: str, order: str, alpha: float = 0.3, beta: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Holt's linear trend: the second value sets the trend; fitted is the level plus trend before the value. Missing values have no row's worth and change nothing."""
    return _smoothed(df, value, order, by, _Trend(alpha, beta))


def acf(df: DataFrame, value: str, order: str, max_lag: int = 20) -> DataFrame:
    """lag, r: sums of products over the pairs that are both there, by place, over the sum of squares; without spread 0."""
    mean = df.agg(F.avg(value).alias("__m"))
    held = df.join(F.broadcast(mean)).withColumn("__d", F.col(value) - F.col("__m"))
    lags = with_lags(held.select("__d", order), "__d", [order], range(1, max_lag + 1))
    cells = [F.struct(F.lit(0).alias("lag"), F.sum(F.col("__d") * F.col("__d")).alias("s"))]
    cells += [F.struct(F.lit(k).alias("lag"), F.sum(F.col("__d") * F.col(f"__lag{k}")).alias("s")) for k in range(1, max_lag + 1)]
    row = lags.agg(F.array(*cells).alias("c"))
    zero = F.col("c")[0]["s"]
    return row.select(zero.alias("__z"), F.inline("c")).select("lag", F.when(F.col("lag") == 0, 1.0).when(F.coalesce("__z", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("s", F.lit(0.0)) / F.col("__z")).alias("r"))


def pacf(r: Sequence[float]) -> list[float]:
    """Partial autocorrelations by the Durbin-Levinson recursion on r[0..k]."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        past = np.array(r[1:k])
        top = r[k] - phi @ past[::-1]
        bottom = 1 - phi @ past
        last = top / bottom if abs(bottom) > 1e-12 else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return out


def decompose(df: DataFrame, value: str, order: str, period: int, kind: str = "additive", by: Sequence[str] = ()) -> DataFrame:
    """trend, seasonal and residual columns. The seasonal indices are means by place in the period, normalised."""
    if period < 2:
        raise ValueError("a period is 2 at least")
    add = kind == "additive"
    t = centered_average(df, value, [order], period, by, place="__k").withColumn("__k", (F.col("__k") - 1) % period)
    apart = (F.col(value) - F.col("trend")) if add else F.when(F.col("trend") != 0, F.col(value) / F.col("trend"))
    raw = t.groupBy(*by, "__k").agg(F.avg(apart).alias("__raw"))
    level = F.avg("__raw").over(Window.partitionBy(*by))  # at most `period` rows for each series
    index = raw.withColumn("seasonal", F.col("__raw") - level if add else F.col("__raw") / level).select(*by, "__k", "seasonal")
    out = t.join(index, [*by, "__k"])
    rest = F.col(value) - F.col("trend") - F.col("seasonal") if add else F.when(F.col("trend") * F.col("seasonal") != 0, F.col(value) / (F.col("trend") * F.col("seasonal")))
    return out.withColumn("residual", rest).drop("__k")
