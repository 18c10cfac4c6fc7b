"""Exact search of neighbours, clusters of dense cells and splits by histogram, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import combine, density, learn, neighbours, overlay, stats


def square(x, y):
    """Added in order; Python's own sum of floats is compensated."""
    total = 0.0
    for a, b in zip(x, y):
        total += (a - b) * (a - b)
    return total


def brute(points, queries, k):
    out = {}
    for q, *x in queries:
        d = [(square(x, y), key) for key, *y in points]
        out[q] = sorted(d)[:k]
    return out


def frames(spark, points, queries, dims):
    at = ", ".join(f"x{i} double" for i in range(dims))
    return spark.createDataFrame(points, f"key long, {at}").repartition(3), spark.createDataFrame(queries, f"query long, {at}").repartition(2)


@pytest.mark.parametrize("dims, k", [(1, 1), (2, 5), (3, 4)])
def test_k_nearest_equals_brute_force(spark, monkeypatch, dims, k):
    monkeypatch.setattr(neighbours, "BOX_ROWS", 16)
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(dims)
    made = np.vstack([rng.normal(size=(300, dims)), rng.normal(size=(200, dims)) * 0.01 + 5, np.round(rng.normal(size=(200, dims)), 0), np.full((250, dims), 7.0)])  # crowds, ties, one point many times
    points = [(int(i), *map(float, x)) for i, x in zip(rng.permutation(len(made)), made)]
    asked = np.vstack([made[::9], rng.normal(size=(40, dims)) * 4, np.full((30, dims), 7.0)])
    queries = [(i, *map(float, x)) for i, x in enumerate(asked)]
    p, q = frames(spark, points, queries, dims)
    got = {r.query: [tuple(x) for x in r.near] for r in neighbours.k_nearest(p, q, dims, k).collect()}
    assert got == brute(points, queries, k)


def test_k_nearest_of_few(spark):
    p, q = frames(spark, [(1, 0.0), (2, 1.0)], [(5, 0.4), (6, 9.0)], 1)
    got = {r.query: [x.key for x in r.near] for r in neighbours.k_nearest(p, q, 1, 5).collect()}
    assert got == {5: [1, 2], 6: [2, 1]}
    assert [r.near for r in neighbours.k_nearest(p.limit(0), q, 1, 2).collect()] == [[], []] and neighbours.k_nearest(p, q.limit(0), 1, 2).count() == 0


def test_k_nearest_works_out_few_pairs(spark):
    """Of 20,000 points and 2,000 queries under a tenth of the pairs are compared, also with a third of either at one place."""
    n, m = 20_000, 2_000
    spot = lambda c: F.when(F.col("id") % 3 == 0, 1.0).otherwise(c)
    p = spark.range(n).select(F.col("id").alias("key"), spot(F.randn(1)).alias("x0"), spot(F.randn(2)).alias("x1"))
    q = spark.range(m).select(spot(F.randn(3)).alias("x0"), spot(F.randn(4)).alias("x1"))
    found = neighbours.search(p, q, 2, 5)
    pairs, asked = found.agg(F.sum("n_pairs"), F.count("*")).first()
    assert asked == q.distinct().count() and 0 < pairs < n * m / 10


def test_k_nearest_shuffles_no_row_for_each_box(spark, monkeypatch):
    """Where a query meets nearly all of 128 boxes, what is shuffled stays a few times the input; the answers are those of brute force."""
    monkeypatch.setattr(neighbours, "BOX_ROWS", 16)
    monkeypatch.setattr(neighbours, "GROUP", 16 * 300)
    rng = np.random.default_rng(3)
    points, queries = ([(i, *map(float, x)) for i, x in enumerate(rng.normal(size=(n, 16)))] for n in (2000, 600))
    p, q = frames(spark, points, queries, 16)

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    before = shuffled()
    found = neighbours.k_nearest(p, q, 16, 3)
    assert shuffled() - before < 8 * (2000 + 600) * 17 * 8
    got = {r.query: [tuple(x) for x in r.near] for r in found.collect()}
    assert {i: got[i] for i in range(0, 600, 20)} == brute(points, queries[::20], 3) and len(got) == 600


# ---- DBSCAN


def brute_dbscan(points, eps, least):
    """id -> cluster: components of core points by their least id, border points go to the least cluster near."""
    near = {i: [j for j, *y in points if square(x, y) <= eps * eps] for i, *x in points}
    core = {i for i in near if len(near[i]) >= least}
    root = {}
    for i in sorted(core):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j in core and j not in root:
                    root[j] = i
                    todo += near[j]
    number = {r: k for k, r in enumerate(sorted(set(root.values())))}
    return {i: number[root[i]] if i in core else min((number[root[j]] for j in near[i] if j in core), default=-1) for i in near}


@pytest.mark.parametrize("dims, eps, least", [(1, 0.3, 3), (2, 0.5, 4), (2, 1.0, 3), (3, 0.8, 5)])
def test_dbscan_equals_brute_force(spark, dims, eps, least):
    rng = np.random.default_rng(dims + least)
    blobs = [rng.normal(size=(40, dims)) * 0.3 + c for c in (0, 2, 5)] + [np.round(rng.normal(size=(30, dims)) * 2), rng.uniform(-3, 8, size=(30, dims)), np.full((40, dims), 2.5)]
    points = [(int(i), *map(float, x)) for i, x in zip(rng.permutation(220), np.vstack(blobs))]
    at = [f"x{i}" for i in range(dims)]
    df = spark.createDataFrame(points, f"id long, {', '.join(c + ' double' for c in at)}").repartition(3)
    assert {r.id: r.cluster for r in density.dbscan(df, at, "id", eps, least).collect()} == brute_dbscan(points, eps, least)


def test_dbscan_of_a_crowd_emits_no_pairs(spark):
    """A third of all rows in one cell, half of them at one place: no point of it is paired with another."""
    n = 30_000
    crowd = F.col("id") % 3 == 0
    spot = lambda seed: F.when(crowd, F.when(F.col("id") % 6 == 0, 0.5).otherwise(0.5 + F.rand(seed) / 100)).otherwise(F.rand(seed + 9) * 1000)
    df = spark.range(n).select("id", spot(1).alias("x"), spot(2).alias("y"))
    steps = density.Steps(df.select("id", F.col("x").alias("z0"), F.col("y").alias("z1")), 2, 1.0, 4)
    assert steps.pairs(steps.sparse()).count() < n
    got = density.dbscan(df, ["x", "y"], "id", 1.0, 4).groupBy("cluster").count().orderBy(F.desc("count")).first()
    assert got["count"] >= n // 3


# ---- trees, intervals, edits


def brute_split(rows, inputs):
    """(input, threshold) of the best first split by gini, of ties the first input and the least value."""
    best = None
    total = {}
    for *_, y in rows:
        total[y] = total.get(y, 0) + 1
    for f in range(inputs):
        xs = sorted({r[f] for r in rows})
        for x, following in zip(xs, xs[1:]):
            left = {}
            for r in rows:
                if r[f] <= x:
                    left[r[-1]] = left.get(r[-1], 0) + 1
            n = sum(left.values())
            sq = lambda c: sum(v * v for v in c.values())
            right = {k: v - left.get(k, 0) for k, v in total.items()}
            gain = (sq(left) / n + sq(right) / (len(rows) - n) - sq(total) / len(rows)) / len(rows)
            if best is None or round(gain, 12) > best[0]:
                best = (round(gain, 12), f, (x + following) / 2)
    return best[1:]


def test_tree_split_over_many_ranges(spark):
    """Values dealt to several ranges give the split that one sorted list gives; no window holds an input's values."""
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), "xyz"[int(a * 2 + b > 1.3) + int(b > 2)]) for a, b in rng.normal(size=(400, 2)).round(2)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tree = learn.decision_tree(df, "y", ["a", "b"], 1)
        f, t = brute_split(rows, 2)
        sides = df.select(F.col("ab"[f]).alias("x"), tree.alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    said = {x <= t: {r.p for r in sides if (r.x <= t) == (x <= t)} for x in (t, t + 1)}
    assert all(len(v) == 1 for v in said.values())
    for side, (p,) in ((k, tuple(v)) for k, v in said.items()):
        counts = {y: sum((r[f] <= t) == side and r[2] == y for r in rows) for y in "xyz"}
        assert p == min(counts, key=lambda y: (-counts[y], y))
    with pytest.raises(ValueError):
        learn.decision_tree(spark.range(300).selectExpr("id * 1.0 as a", "id as y"), "y", ["a"])


def test_interval_join_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    lengths = [0.0, 0.0, 1e-6, 0.5, 1.0, 2.0, 3.0, 64.0, 1e5]
    make = lambda n: [(i, float(s), float(s + rng.choice(lengths))) for i, s in enumerate(rng.choice([rng.uniform(-50, 50), rng.integers(-9, 9), 4.0], n))]
    a, b = make(150) + [(900, None, 1.0), (901, 5.0, 4.0), (902, 1e300, 2e300)], make(120) + [(903, 3.0, None), (904, -1e300, 1e308)]
    left, right = spark.createDataFrame(a, "id long, s double, e double"), spark.createDataFrame(b, "id long, s double, e double")
    joined = combine.interval_join(left, right, ("s", "e"), ("s", "e"))
    assert joined.columns == ["id", "s", "e", "right__id", "right__s", "right__e"]
    ok = lambda r: r[1] is not None and r[2] is not None and r[1] <= r[2]
    want = sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] <= y[2] and y[1] <= x[2])
    assert sorted((r.id, r.right__id) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert combine.interval_join(left.limit(0), right, ("s", "e"), ("s", "e")).count() == 0
    times = spark.sql("select timestamp'2020-01-01 00:00:00' as s, timestamp'2020-01-01 01:00:00' as e")
    assert combine.interval_join(times, times, ("s", "e"), ("e", "e")).count() == 1


@pytest.mark.parametrize("n_left, n_right", [(300, 2000), (2000, 300), (20, 3000), (1, 3000)])
def test_interval_join_of_one_bucket_is_many_tasks(spark, monkeypatch, n_left, n_right):
    """All rows meet in a few buckets: no task has more than a quarter of the pairs (or its share, where that is more), none is lost or made twice."""
    for name, n in (("PAIRS", 2**10), ("PIECE", 2**10), ("SIDE", 2**5), ("LONG", 2**8)):
        monkeypatch.setattr(combine, name, n, raising=False)
    left = spark.range(0, n_left, 1, 1).select("id", (F.col("id") % 7 / 10).alias("s"), (F.col("id") % 7 / 10 + 3 + F.col("id") % 5 / 10).alias("e"))
    right = spark.range(0, n_right, 1, 1).select("id", (F.col("id") % 41 / 10).alias("at"))
    joined = combine.interval_join(left, right, ("s", "e"), ("at", "at"))
    rows = joined.select("id", "right__id", F.spark_partition_id().alias("task")).collect()
    l, r = ([tuple(x) for x in df.collect()] for df in (left, right))
    assert sorted((x.id, x.right__id) for x in rows) == sorted((i, j) for i, s, e in l for j, at in r if s <= at <= e)
    tasks = [x.task for x in rows]
    assert max(map(tasks.count, set(tasks))) <= max(len(rows) / 4, combine.PAIRS)


def test_edits_as_a_table(spark, monkeypatch):
    """10,000 edits make a plan of the size of one; the last edit of a cell wins; the same without a broadcast."""
    df = spark.range(12_000).selectExpr("id", "id as whole", "cast(id as double) as x", "concat('t', id) as name").union(spark.sql("select null, 7, 7.0, 'no key'"))
    at = spark.range(10_000).selectExpr("cast(id % 5000 as string) as key", "if(id % 2 = 0, 'whole', 'name') as column", "cast(id + 0.5 as string) as value", "id as at")
    more = spark.createDataFrame([("3", "x", None, 1), ("3", "x", "bad", 0), ("4", "x", "", 1), ("5", "whole", "bad", 99_999), ("6", "name", "", 99_999), ("x7", "name", "lost", 1), ("8", "nope", "lost", 1)], "key string, column string, value string, at long")
    edits = at.union(more)
    want = {}
    for r in sorted(edits.collect(), key=lambda r: r["at"]):
        want[r.key, r.column] = r.value
    parse = {"whole": lambda v: None if v == "bad" else int(float(v) + 0.5), "x": lambda v: None, "name": lambda v: v}
    out = overlay.edited(df, edits, "id")
    one = overlay.edited(df, edits.where("at = 10 or at = 11"), "id")
    size = lambda d: d._jdf.queryExecution().analyzed().toString().count("\n")
    assert size(out) <= size(one) + 2 and out.dtypes == df.dtypes
    for limit in (overlay.BROADCAST_ROWS, 0):
        monkeypatch.setattr(overlay, "BROADCAST_ROWS", limit)
        for r in overlay.edited(df, edits, "id").collect():
            for c, own in (("whole", r.id), ("x", None if r.id is None else float(r.id)), ("name", f"t{r.id}")):
                if r.id is not None:
                    assert r[c] == (parse[c](want[str(r.id), c]) if (str(r.id), c) in want else own)
    assert overlay.without(df, edits, "id").count() == 12_001 - 5_000


def test_cross_validation_of_classifiers(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(x), float(y), "p" if x + y > 0 else "n") for i, (x, y) in enumerate(rng.normal(size=(90, 2)) + np.where(rng.random((90, 1)) < 0.5, 3, -3))]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string")
    for score in (learn.tree_score("c", ["x", "y"], 3), learn.logistic_score("c", "p", ["x", "y"], 0.01), learn.neighbours_score("c", ["x", "y"], "id", 3)):
        assert learn.cross_validate(df, "id", 3, score)["mean"] > 0.9


def test_contingency_refuses_many_levels(spark):
    df = spark.range(120).selectExpr("id % 51 as a", "id % 2 as b")
    for fn in (stats.contingency, stats.chi_square_table):
        with pytest.raises(ValueError):
            fn(df, "a", "b")
    assert stats.contingency(df.where("a < 50"), "a", "b").count() == 100
