"""One global order without one task: row numbers, neighbours, frames, running sums and exact quantiles over any number of rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sparkloom.plans.storage import materialise

#: Rows of one block when neighbours are looked up by place.
BLOCK_ROWS = 100_000
#: Rank error of a quantile sketch is at most n / ACCURACY; it gives STEPS + 1 cuts.
ACCURACY = 10_000
STEPS = 1000
#: Rows of a group and quantile that are put in order by one task, at most (or all, if they have one value).
RANK_ROWS = 10_000


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "__n") -> DataFrame:
    """df with its place 1..n in a total order.

    Rows are dealt to ranges of the order and written with the number of their range; the ranges' sizes (one row for each
    partition) give the offsets, and rows are numbered inside their range. End the order with a unique column, or equal
    rows fall into one range and get their numbers in no fixed order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = materialise(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return dealt.withColumn(name, inside).join(F.broadcast(offsets), "__range").withColumn(name, F.col(name) + F.col("__offset")).drop("__range", "__offset")


def hash_rank(df: DataFrame, key: str, seed: int, name: str = "__n") -> DataFrame:
    """df with its place 1..n in the order of the hashed key (then of the key): 2^16 ranges of the hash, which are of like size."""
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__range", F.shiftright("__h", 48))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))  # at most 65,536 rows
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__h", key))
    return hashed.withColumn(name, inside).join(F.broadcast(offsets), "__range").withColumn(name, F.col(name) + F.col("__offset")).drop("__h", "__range", "__offset")


def in_blocks(df: DataFrame, order: Sequence[str | Column], columns: Callable[[WindowSpec], dict[str, Column]], back: int = 0, ahead: int = 0, place: str | None = None) -> DataFrame:
    """df with columns over one order of all rows, and its place 1..n if that is given a name; ``columns`` makes them from a window, and they look at most ``back`` rows back and ``ahead`` rows on.

    Rows are numbered and cut into blocks by place; the last rows of a block go to the next one too, as its past, and the
    first ones to the block before, as its future.
    """
    size = max(BLOCK_ROWS, back, ahead)
    at = (F.col("__n") - 1) % size
    block = F.floor((F.col("__n") - 1) / size)
    copies = F.array(block, F.when(at >= size - back, block + 1), F.when((at < ahead) & (block > 0), block - 1))
    spread = numbered(df, order).withColumn("__own", block).withColumn("__block", F.explode(F.array_compact(copies)))
    found = spread.withColumns(columns(Window.partitionBy("__block").orderBy("__n")))
    own = found.where("__own = __block").drop("__own", "__block")
    return own.withColumnRenamed("__n", place) if place else own.drop("__n")


def with_lags(df: DataFrame, value: str, order: Sequence[str | Column], lags: Sequence[int]) -> DataFrame:
    """df with the values of 1, 2, ... places before in columns __lag1, __lag2, ... as named by lags."""
    return in_blocks(df, order, lambda w: {f"__lag{k}": F.lag(value, k).over(w) for k in lags}, max(lags))


def running_sums(df: DataFrame, sums: Mapping[str, str], order: Sequence[str | Column]) -> DataFrame:
    """df with the sums of all values of columns up to a row in one order (sums: new name to column); null before the first value. Sums inside a range of the order, and of the ranges before."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = materialise(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])  # one row for each partition
    past = parts.select("__range", *[F.sum(f"__sum_{n}").over(before).alias(f"__past_{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(past), "__range")
    return met.withColumns({n: F.coalesce(F.col(n) + F.col(f"__past_{n}"), n, f"__past_{n}") for n in sums}).drop("__range", *[f"__past_{n}" for n in sums])


def running_sum(df: DataFrame, value: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """df with one running sum, as ``running_sums`` makes it."""
    return running_sums(df, {name: value}, order)


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """One row for each key tuple (nulls are keys) with the quantiles (name, value, p), interpolated between the two nearest values.

    Rank selection by repeated narrowing: a sketch cuts what lies between two bounds, and the cuts on both sides of the
    wanted ranks are tried as the next ones. A grouped pass counts what lies below, on and between them. If a wanted rank is
    on a bound, the answer is known; else the search goes on strictly between them, where about 1 / 250 of the rows are left, however
    many equal values there are. It ends when each quantile of each group is known or has at most ``RANK_ROWS`` rows left; only
    these are put in order. So 10^11 rows take three rounds and no task gets more of a group than ``RANK_ROWS`` rows. Bounds
    that a sketch got wrong are seen by the counts and not used. The state, a row for each key tuple, is written to the shared
    folder between rounds.
    """
    values: dict[str, tuple[str, Column]] = {}  # quantiles of one value share a column, and the first sketch
    of = [values.setdefault(str(v), (f"__v{len(values)}", v))[0] for _, v, _ in wanted]
    names, every = [f"__k{j}" for j in range(len(keys))], range(len(wanted))
    held = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[v.cast("double").alias(n) for n, v in values.values()])
    shares = F.lit(np.arange(STEPS + 1) / STEPS)

    def met(rows: DataFrame, sides: DataFrame) -> DataFrame:
        sides = sides.withColumnsRenamed({n: f"__s{n}" for n in names})
        return rows.join(sides, F.expr(" and ".join(f"{n} <=> __s{n}" for n in names))) if names else rows.crossJoin(F.broadcast(sides))  # without keys, one row

    # expressions are written as SQL: a column object for each of their nodes would cost seconds of planning
    ranks = [(f"floor((__q{i}.c - 1) * {p!r}D)", f"ceil((__q{i}.c - 1) * {p!r}D)") for i, (_, _, p) in enumerate(wanted)]

    def tried(i: int) -> Column:
        """The cuts around the wanted ranks, one further on each side than the sketch can be wrong."""
        q = f"__q{i}"
        lo, hi = (f"({rank} - {q}.below) / greatest({q}.inside, 1) * {STEPS}" for rank in ranks[i])
        cut = lambda at: f"get(__u{i}, cast({at} as int))"
        return F.expr(f"case when not {q}.settled then named_struct('lo', {cut(f'greatest(floor({lo}) - 1, 0)')}, 'hi', {cut(f'least(ceil({hi}) + 1, {STEPS})')}) end").alias(f"__t{i}")

    def judged(i: int) -> Column:
        """The state after a pass: q before it, t the bounds tried, n what was counted."""
        q, t, n, (low, high) = f"__q{i}", f"__t{i}", f"__n{i}", ranks[i]
        upto, before = f"({n}.below + {n}.on_lo)", f"({n}.below + {n}.on_lo + {n}.mid)"
        sound = f"{n}.below <= {low} and {high} < {before} + {n}.on_hi"
        on_lo, on_hi = f"{low} < {upto}", f"{high} >= {before}"
        first = f"case when {on_lo} then {t}.lo when {on_hi} then case when {low} >= {before} then {t}.hi else {n}.last end end"
        second = f"case when {on_lo} then case when {high} < {upto} then {t}.lo else coalesce({n}.first, {t}.hi) end when {on_hi} then {t}.hi end"
        new = f"named_struct('c', {q}.c, 'lo', {t}.lo, 'hi', {t}.hi, 'below', {upto}, 'inside', {n}.mid, 'low', {first}, 'high', {second}, 'settled', {on_lo} or {on_hi} or {n}.mid <= {RANK_ROWS})"
        old = f"named_struct('c', {q}.c, 'lo', {q}.lo, 'hi', {q}.hi, 'below', {q}.below, 'inside', {q}.inside, 'low', {q}.low, 'high', {q}.high, 'settled', true)"
        return F.expr(f"case when {q}.settled then {q} when {sound} then {new} else {old} end").alias(f"__q{i}")

    null = "cast(null as double)"
    begin = lambda v: f"named_struct('c', {v}.c, 'lo', {null}, 'hi', {null}, 'below', 0L, 'inside', {v}.c, 'low', {null}, 'high', {null}, 'settled', {v}.c <= {RANK_ROWS})"
    first = held.groupBy(*names).agg(*[F.struct(F.count(n).alias("c"), F.percentile_approx(n, shares, ACCURACY).alias("cuts")).alias(n) for n, _ in values.values()])
    states, cuts = [f"__q{i}" for i in every], [f"__u{i}" for i in every]
    now = materialise(first.select(*names, *[F.expr(begin(of[i])).alias(f"__q{i}") for i in every], *[F.col(f"{of[i]}.cuts").alias(f"__u{i}") for i in every]), "ranks")
    while now.where("not (" + " and ".join(f"{q}.settled" for q in states) + ")").limit(1).count():
        if cuts[0] not in now.columns:  # a sketch of what lies between the bounds
            between = [f"case when not __q{i}.settled and {of[i]} > __q{i}.lo and {of[i]} < __q{i}.hi then {of[i]} end" for i in every]
            sketch = met(held, now).groupBy(*names).agg(*[F.percentile_approx(F.expr(x), shares, ACCURACY).alias(u) for x, u in zip(between, cuts)])
            now = materialise(met(sketch, now).select(*names, *states, *cuts), "ranks", instead_of=(now,))
        bounds, passed = now.select(*names, *[tried(i) for i in every]), []
        for i in every:
            v, t = of[i], f"__t{i}"
            mid = f"case when {v} > {t}.lo and {v} < {t}.hi then {v} end"
            passed.append(F.expr(f"named_struct('below', count_if({v} < {t}.lo), 'on_lo', count_if({v} = {t}.lo), 'mid', count({mid}), 'on_hi', count_if({v} = {t}.hi), 'first', min({mid}), 'last', max({mid}))").alias(f"__n{i}"))
        counted = met(met(held, bounds).groupBy(*names).agg(*passed), now.select(*names, *states, *[tried(i) for i in every]))
        now = materialise(counted.select(*names, *[judged(i) for i in every]), "ranks", instead_of=(now,))
    sides = now.select(*names, *states)
    part = lambda i: f"named_struct('i', {i}, 'v', {of[i]}, 'in', {of[i]} is not null and __q{i}.low is null and coalesce({of[i]} > __q{i}.lo, true) and coalesce({of[i]} < __q{i}.hi, true))"
    left = met(held, sides).select(*names, F.expr(f"inline(array({', '.join(map(part, every))}))")).where("in").groupBy(*names, "i", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*names, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ends = [F.expr(f"min(case when i = {i} and __q{i}.below + upto > {rank} then v end)").alias(f"__{end}{i}") for i in every for end, rank in zip("lh", ranks[i])]
    found = met(left.withColumn("upto", upto), sides).groupBy(*names).agg(*ends).withColumnsRenamed({n: f"__f{n}" for n in names})
    back = sides.join(found, F.expr(" and ".join(f"{n} <=> __f{n}" for n in names)), "left") if names else sides.crossJoin(F.broadcast(found))  # one row each

    def answer(i: int, p: float) -> Column:
        low, high = f"coalesce(__q{i}.low, __l{i})", f"coalesce(__q{i}.high, __h{i})"
        rest = f"((__q{i}.c - 1) * {p!r}D - {ranks[i][0]})"
        return F.expr(f"case when {low} = {high} then {low} else {low} * (1 - {rest}) + {high} * {rest} end")

    return back.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *[answer(i, p).alias(name) for i, (name, _, p) in enumerate(wanted)])
