"""Global order without one task, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import order, series, windows
from sparkloom.operators.order import exact_quantiles, hash_rank, numbered, with_lags


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.5, 2.5, float("inf")])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(7)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = sorted(numbered(df, [F.col("v").asc_nulls_first(), "id"], "n").collect(), key=lambda r: r.n)
    assert [(r.id, r.v) for r in got] == want and [r.n for r in got] == list(range(1, 501))
    assert numbered(df.limit(0), ["id"]).count() == 0


def test_hash_rank(spark):
    got = sorted(r["__n"] for r in hash_rank(spark.range(1000), "id", 7).collect())
    assert got == list(range(1, 1001)) and hash_rank(spark.range(0), "id", 7).count() == 0


@pytest.mark.parametrize("block", [5, 100_000])
def test_with_lags(spark, monkeypatch, block):
    monkeypatch.setattr(order, "BLOCK_ROWS", block)
    df = spark.range(23).select("id", (F.col("id") * F.col("id")).alias("v"))
    for r in with_lags(df, "v", ["id"], [1, 2, 3]).collect():
        assert [r["__lag1"], r["__lag2"], r["__lag3"]] == [(r.id - k) ** 2 if r.id >= k else None for k in (1, 2, 3)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 40_000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    rows = [(None if i % 3 == 0 else "a" if i % 3 == 1 else "b", float(x), None if i % 5 else float(y)) for i, (x, y) in enumerate(zip(rng.normal(size=n).round(3), rng.integers(0, 4, n)))]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    wanted = [(f"{c}{p}", F.col(c), p) for c in "xy" for p in (0.0, 0.25, 0.5, 0.95, 1.0)]
    for keys in ([], ["k"]):
        got = exact_quantiles(df, keys, wanted).collect()
        groups = {}
        for k, x, y in rows:
            groups.setdefault(k if keys else "all", []).append((x, y))
        assert len(got) == len(groups)
        for r in got:
            mine = groups[r.k if keys else "all"]
            for name, _, p in wanted:
                v = [m["xy".index(name[0])] for m in mine if m["xy".index(name[0])] is not None]
                assert r[name] == (pytest.approx(float(np.quantile(v, p)), abs=1e-12) if v else None)


def test_exact_quantiles_in_rounds(spark, monkeypatch):
    """Many distinct values in one group, heavy tails, ties and infinities: few rows are put in order, whatever the group's size."""
    df = spark.range(400_000).selectExpr("id % 2 as k", "cast(id * 7919 % 1000003 as double) as x", "pow(2.0, id % 4001 - 2000) as y", "if(id % 3 = 0, double('infinity'), 5.0) as z", "if(id < 10, cast(id as double), null) as few", "case when id % 1000 < 499 then 0.0 when id % 1000 < 501 then 0.5 + id / 1e9 else 2.0 end as ends")
    monkeypatch.setattr(order, "RANK_ROWS", 500)
    seen, keep = [], order.materialise
    monkeypatch.setattr(order, "materialise", lambda d, *a, **b: seen.append(out := keep(d, *a, **b)) or out)
    wanted = [(f"{c}{i}", F.col(c), p) for c in ("x", "y", "z", "few", "ends") for i, p in enumerate((0.0, 0.25, 0.5, 0.999, 1.0))]
    got = {r.k: r for r in exact_quantiles(df, ["k"], wanted).collect()}
    assert len(seen) >= 3  # rounds
    last = seen[-1].collect()
    assert all(q.settled and (q.inside <= 500 or q.low is not None) for r in last for q in r[1:])
    held = df.toPandas()
    for k, part in held.groupby("k"):
        for name, _, p in wanted:
            v = sorted(part[name.rstrip("0123456789")].dropna())
            at = (len(v) - 1) * p
            low, high, rest = v[int(at)], v[math.ceil(at)], at - int(at)
            assert got[k][name] == (low if low == high else pytest.approx(low * (1 - rest) + high * rest, rel=1e-12))


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert exact_quantiles(df, ["k"], [("m", F.col("x"), 0.5)]).count() == 0
    assert [tuple(r) for r in exact_quantiles(df, [], [("m", F.col("x"), 0.5)]).collect()] == [(None,)]


@pytest.fixture
def many_ranges(spark, monkeypatch):
    """Every range of an order stays a partition of its own, and blocks are small."""
    monkeypatch.setattr(order, "BLOCK_ROWS", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def gappy_series(spark, n=200, lost=7, late=0):
    rng = random.Random(n + lost + late)
    return spark.createDataFrame([(i, None if i < late or i % lost == 0 else rng.uniform(-50, 50)) for i in range(1, n)], "t int, v double").withColumn("one", F.lit(1))


@pytest.mark.parametrize("frame", [
    lambda df, by: windows.moving_average(df, "v", ["t"], 5, by, "x"),
    lambda df, by: windows.weighted_average(df, "v", ["t"], [1, 2, 3], by, "x"),
    lambda df, by: windows.difference(df, "v", ["t"], 20, by, "x"),
    lambda df, by: windows.rolling_std(df, "v", ["t"], 4, by, "x"),
    lambda df, by: windows.centered_average(df, "v", ["t"], 6, by, "x"),
    lambda df, by: windows.centered_average(df, "v", ["t"], 41, by, "x"),
    lambda df, by: windows.running_total(df, "v", ["t"], by, "x"),
    lambda df, by: windows.first_ratio(df.where("v is not null"), "v", ["t"], by, "x"),
    lambda df, by: windows.moving_range(df, "v", ["t"], by, "x"),
    lambda df, by: series.exponential(df, "v", "t", 0.3, by).withColumnRenamed("smooth", "x"),
    lambda df, by: series.holt(df, "v", "t", 0.4, 0.2, by).withColumnRenamed("level", "x"),
    lambda df, by: series.holt(df, "v", "t", 1.0, 0.2, by).withColumnRenamed("trend", "x"),
    lambda df, by: series.holt(df, "v", "t", 0.4, 1.0, by).withColumnRenamed("fitted", "x"),
    lambda df, by: series.decompose(df, "v", "t", 6, "additive", by).withColumnRenamed("residual", "x"),
])
@pytest.mark.parametrize("late", [0, 120])
def test_one_series_as_many_ranges(spark, many_ranges, frame, late):
    """Without partition columns the result is that of one series with a partition column, which is worked in order."""
    df = gappy_series(spark, lost=50, late=late)
    got, want = ({r.t: r.x for r in frame(df, by).collect()} for by in ([], ["one"]))
    assert got.keys() == want.keys()
    assert all(got[t] == pytest.approx(want[t], rel=1e-9, abs=1e-9) if want[t] is not None else got[t] is None for t in want)


def test_smoothing_by_hand(spark, many_ranges):
    df = gappy_series(spark)
    level, trend, want = None, None, {}
    for r in sorted(df.collect()):
        if r.v is not None:
            if level is None:
                level, want[r.t] = r.v, (r.v, None, r.v)
                continue
            trend = r.v - level if trend is None else trend
            fitted = level + trend
            new = 0.3 * r.v + 0.7 * fitted
            trend, level = 0.1 * (new - level) + 0.9 * trend, new
            want[r.t] = (level, trend, fitted)
    got = {r.t: (r.level, r.trend, r.fitted) for r in series.holt(df, "v", "t").collect() if r.level is not None}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)


def test_series_of_few_or_no_values(spark, many_ranges):
    few = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "t int, v double")
    assert [tuple(r) for r in series.holt(few, "v", "t").orderBy("t").select("level", "trend", "fitted").collect()] == [(None, None, None), (5.0, None, 5.0), (None, None, None)]
    assert [r.smooth for r in series.exponential(few, "v", "t").orderBy("t").collect()] == [None, 5.0, 5.0]
    assert series.exponential(few.where("false"), "v", "t").count() == series.holt(few.where("false"), "v", "t").count() == 0
    assert windows.running_total(few, "v", ["t"]).orderBy("t").select("running").collect()[0][0] is None
    null_key = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), (4, 1, 7.0)], "k int, t int, v double")
    assert {(r.k, r.t): r.smooth for r in series.exponential(null_key, "v", "t", 0.5, ["k"]).collect()} == {(None, 1): 1.0, (None, 2): 2.0, (4, 1): 7.0}
