"""Models. Fitting is Spark aggregation; numpy sees moments, class tables and centroids only, never rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.values import all_of, number, round_half_up
from sparkloom.operators import density
from sparkloom.operators.neighbours import k_nearest
from sparkloom.operators.order import hash_rank, running_sums
from sparkloom.operators.stats import CollinearError, moments, ols
from sparkloom.plans.storage import materialise, release


def holdout(df: DataFrame, key: str, share: float = 0.3, seed: int = 7) -> DataFrame:
    """df with test: true for the share of rows that comes last by hashed key; the same rows every time, an exact count."""
    n = df.count()
    placed = hash_rank(df, key, seed)
    return placed.withColumn("test", F.col("__n") > math.floor(n * (1 - share))).drop("__n")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 7) -> DataFrame:
    """df with fold 0..k-1, contiguous in hashed order and of equal size but for one row."""
    n = df.count()
    size, more = n // k, n % k  # the first `more` folds have one row more
    at = F.col("__n") - 1
    fold = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(size, 1)))
    return hash_rank(df, key, seed).withColumn("fold", fold.cast("int")).drop("__n")


def linear_predict(model: dict, name: str = "prediction") -> Column:
    return sum((F.col(c) * w for c, w in zip(model["names"][1:], model["coef"][1:])), F.lit(model["coef"][0])).alias(name)


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    total = F.var_pop(actual) * F.count(actual)
    return df.agg(F.when(total > 0, 1 - F.sum(e * e) / total).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(actual).alias("n"))


def linear_regression(df: DataFrame, target: str, inputs: Sequence[str], key: str, share: float = 0.3) -> tuple[dict, DataFrame]:
    """A model on the training rows and its metrics on the test rows."""
    parts = holdout(df, key, share)
    model = ols(parts.where("not test"), target, inputs)
    return model, regression_metrics(parts.where("test").select("*", linear_predict(model)), target, "prediction")


def importance(df: DataFrame, model: dict) -> DataFrame:
    """input, coef and importance (|coef| times the input's deviation over the target's) of a linear model fitted on df, largest first; one pass."""
    target, inputs = model["target"], model["names"][1:]
    # the same complete rows as in the fit
    v = {c: number(F.col(c), df.schema[c].dataType) for c in [*inputs, target]}
    held = df.where(all_of([x.isNotNull() for x in v.values()]))
    share = lambda c, w: F.when(F.stddev_samp(v[target]) > 0, F.abs(w * F.stddev_samp(v[c])) / F.stddev_samp(v[target]))
    cells = [F.struct(F.lit(c).alias("input"), F.lit(w).alias("coef"), share(c, F.lit(w)).alias("importance")) for c, w in zip(inputs, model["coef"][1:])]
    return held.agg(F.array(*cells).alias("r")).select(F.inline("r")).orderBy(F.desc("importance"), "input")


def residuals(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """df with residual, the target less its prediction."""
    return df.withColumn("residual", F.col(target) - F.col(prediction))


def scaled(df: DataFrame, columns: Sequence[str], sample: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Complete rows with the z-score of each column as z0, z1, ...; means and deviations (population unless sample)."""
    v = [number(F.col(c), df.schema[c].dataType) for c in columns]
    held = df.where(all_of([x.isNotNull() for x in v]))
    row = held.agg(*[F.avg(x) for x in v], *[(F.stddev_samp if sample else F.stddev_pop)(x) for x in v]).first()
    mean, sd = (np.array([x or 0.0 for x in part]) for part in (row[: len(v)], row[len(v) :]))
    sd[sd == 0] = 1.0
    return held.withColumns({f"z{i}": (x - float(m)) / float(s) for i, (x, m, s) in enumerate(zip(v, mean, sd))}), mean, sd


def _majority(found: DataFrame, classes: DataFrame) -> DataFrame:
    """query and predicted: the most frequent class of its near points, of ties that of the nearest."""
    each = found.select("query", F.posexplode("near").alias("i", "x")).select("query", "i", F.col("x.key").alias("key"))
    votes = each.join(classes, "key").groupBy("query", "class").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"))
    return votes.groupBy("query").agg(F.min_by("class", F.struct(-F.col("n"), F.col("i"))).alias("predicted"))


def nearest_neighbours(df: DataFrame, target: str, inputs: Sequence[str], key: str, k: int = 5, share: float = 0.3, seed: int = 11) -> DataFrame:
    """key, actual and predicted class of the test rows: the majority of the k nearest training rows, of ties the nearest.

    The test rows are the query set; the search is exact (``neighbours.k_nearest``). Training rows without a class have no vote.
    """
    z, _, _ = scaled(df, inputs)
    parts = materialise(holdout(z, key, share, seed).select(F.col(key).alias("key"), F.col(target).cast("string").alias("class"), "test", *[F.col(f"z{i}").alias(f"x{i}") for i in range(len(inputs))]), "parts")
    at = [f"x{i}" for i in range(len(inputs))]
    found = k_nearest(parts.where("not test").select("key", *at), parts.where("test").select(F.col("key").alias("query"), *at), len(inputs), k)
    said = _majority(found, parts.where("not test").select("key", "class"))
    return parts.where("test").select(F.col("key").alias("query"), F.col("class").alias("actual")).join(said, "query").select(F.col("query").alias(key), "actual", "predicted")


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """class, precision, recall, f1, support of every class that occurs as either."""
    c = confusion(df, actual, predicted)
    hit = c.where(F.col(actual) == F.col(predicted)).select(F.col(actual).alias("class"), F.col("n").alias("tp"))
    a = c.groupBy(F.col(actual).alias("class")).agg(F.sum("n").alias("support"))
    p = c.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("said"))
    m = a.join(p, "class", "full").join(hit, "class", "left").fillna(0, ["tp", "support", "said"])
    ratio = lambda b: F.when(F.col(b) > 0, F.col("tp") / F.col(b)).otherwise(0.0)
    m = m.withColumns({"precision": ratio("said"), "recall": ratio("support")})
    both = F.col("precision") + F.col("recall")
    return m.select("class", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"), "support")


def class_summary(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: n, accuracy, and macro_f1, the mean of the classes' f1."""
    total = confusion(df, actual, predicted).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return total.crossJoin(F.broadcast(class_metrics(df, actual, predicted).agg(F.avg("f1").alias("macro_f1"))))  # one row each


def binary_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row of two columns of 0 and 1 (anything else is 0): tp, fp, tn, fn, accuracy, precision, recall, f1; ratios of nothing are 0."""
    yes = [F.coalesce(F.col(c) == 1, F.lit(False)) for c in (actual, predicted)]
    cell = lambda a, p: F.count_if((yes[0] == a) & (yes[1] == p))
    counts = df.agg(cell(True, True).alias("tp"), cell(False, True).alias("fp"), cell(False, False).alias("tn"), cell(True, False).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.select("*", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def naive_bayes_model(df: DataFrame, target: str, inputs: Sequence[str]) -> DataFrame:
    """class, prior, and mean and variance (floor 1e-9) of each input."""
    v = {c: number(F.col(c), df.schema[c].dataType) for c in inputs}
    held = df.where(all_of([x.isNotNull() for x in v.values()]) & F.col(target).isNotNull())
    aggs = [F.avg(x).alias(f"m_{c}") for c, x in v.items()] + [F.greatest(F.coalesce(F.var_samp(x), F.lit(0.0)), F.lit(1e-9)).alias(f"v_{c}") for c, x in v.items()]
    g = held.groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"), *aggs)
    total = F.sum("n").over(Window.partitionBy())  # one row for each class
    return g.withColumn("prior", F.col("n") / total)


def naive_bayes_predict(df: DataFrame, model: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """df with predicted: the class of the highest log score. The classes (at most CLASSES) become literals of one expression; inputs that are missing are skipped."""
    rows = model.orderBy("class").limit(CLASSES + 1).collect()
    if len(rows) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    scores = []
    for r in rows:
        s = F.lit(math.log(r["prior"]))
        for c in inputs:
            x = number(F.col(c), df.schema[c].dataType)
            m, v = r[f"m_{c}"], r[f"v_{c}"]
            s = s + F.coalesce(-0.5 * math.log(2 * math.pi * v) - (x - m) * (x - m) / (2 * v), F.lit(0.0))
        scores.append(F.struct((-s).alias("s"), F.lit(r["class"]).alias("c")))
    return df.withColumn("predicted", F.array_min(F.array(*scores))["c"])


CLASSES = 20


def logistic(df: DataFrame, target: str, positive: str, inputs: Sequence[str], l2: float = 0.0, rounds: int = 25) -> dict:
    """Weights of a two-class model by Newton steps; each step is one aggregate of k * k sums over the rows."""
    z, mean, sd = scaled(df, inputs)
    k = len(inputs) + 1
    x = [F.lit(1.0), *[F.col(f"z{i}") for i in range(k - 1)]]
    held = z.where(F.col(target).isNotNull()).withColumn("__y", (F.col(target).cast("string") == positive).cast("double"))
    w = np.zeros(k)
    ridge = np.diag([1e-9] + [l2 + 1e-9] * (k - 1))
    pairs = list(itertools.combinations_with_replacement(range(k), 2))
    n = 0
    for _ in range(rounds):
        p = F.lit(1.0) / (1 + F.exp(-sum((c * float(a) for c, a in zip(x, w)), F.lit(0.0))))
        scored = held.withColumn("__p", p).withColumn("__s", F.col("__p") * (1 - F.col("__p")))
        row = scored.agg(F.count(F.lit(1)), *[F.sum((F.col("__y") - F.col("__p")) * c) for c in x], *[F.sum(F.col("__s") * x[i] * x[j]) for i, j in pairs]).first()
        n = row[0]
        if not n:
            break
        g = np.array(row[1 : 1 + k], float) / n - ridge @ w
        h = np.zeros((k, k))
        for (i, j), s in zip(pairs, row[1 + k :]):
            h[i, j] = h[j, i] = s / n
        step = np.linalg.solve(h + ridge, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(g).max() < 1e-8:
            break
    raw = w[1:] / sd
    return {"inputs": list(inputs), "coef": raw.tolist(), "intercept": float(w[0] - raw @ mean), "standardised": w.tolist(), "n": n}


def logistic_predict(model: dict) -> Column:
    return F.lit(1.0) / (1 + F.exp(-sum((F.col(c) * w for c, w in zip(model["inputs"], model["coef"])), F.lit(model["intercept"]))))


def _curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, p and q (rows with and without the label), p_upto and q_upto (from the highest score down) of each score, and the totals p_all and q_all."""
    yes = F.col(label).cast("long")
    g = df.groupBy(F.col(score).alias("score")).agg(F.sum(yes).alias("p"), F.sum(1 - yes).alias("q"))
    total = df.agg(F.sum(yes).alias("p_all"), F.sum(1 - yes).alias("q_all"))
    return running_sums(g, {"p_upto": "p", "q_upto": "q"}, [F.desc("score")]).crossJoin(F.broadcast(total))  # one row


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, fpr and tpr at every distinct score, high first."""
    return _curve(df, label, score).select("score", (F.col("q_upto") / F.col("q_all")).alias("fpr"), (F.col("p_upto") / F.col("p_all")).alias("tpr"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the area under the curve; tied scores share a step."""
    return _curve(df, label, score).agg((F.sum(F.col("q") * (2 * F.col("p_upto") - F.col("p"))) / 2 / F.max("p_all") / F.max("q_all")).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    return _curve(df, label, score).agg((F.sum(F.col("p_upto") / (F.col("p_upto") + F.col("q_upto")) * F.col("p")) / F.max("p_all")).alias("ap"))


def k_means(df: DataFrame, inputs: Sequence[str], key: str, k: int = 3, rounds: int = 18, seed: int = 5) -> tuple[DataFrame, np.ndarray, float]:
    """Rows with cluster, the centroids in the original scale, and the inertia over z-scores.

    Starts from the first k rows in hashed order; each round is one assignment expression and one grouped mean. An empty cluster keeps its centroid.
    """
    z, mean, sd = scaled(df, inputs)
    cols = [f"z{i}" for i in range(len(inputs))]
    z = materialise(z, "scaled")
    centres = np.array([list(r) for r in z.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).select(*cols).limit(k).collect()], float)

    def nearest(at: np.ndarray) -> Column:
        d = lambda c: sum(((F.col(x) - float(m)) * (F.col(x) - float(m)) for x, m in zip(cols, c)), F.lit(0.0))
        return F.array_min(F.array(*[F.struct(d(c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(at)]))

    for _ in range(rounds):
        new = centres.copy()
        for r in z.withColumn("__n", nearest(centres)).groupBy(F.col("__n.c").alias("c")).agg(*[F.avg(x) for x in cols]).collect():
            new[r[0]] = r[1:]
        if np.array_equal(new, centres):
            break
        centres = new
    placed = z.withColumn("__n", nearest(centres))
    inertia = placed.agg(F.sum("__n.d")).first()[0] or 0.0
    return placed.withColumn("cluster", F.col("__n.c")).drop("__n", *cols), centres * sd + mean, inertia


def pca(df: DataFrame, inputs: Sequence[str], correlation: bool = True) -> dict:
    """Eigenvalues, components (rows; the largest loading is positive), shares, means and scales, from one pass of moments."""
    n, mean, cross = moments(df, inputs)
    cov = cross / max(n - 1, 1)
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1.0
    m = cov / np.outer(sd, sd) if correlation else cov
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order].T
    for v in vectors:
        if v[np.abs(v).argmax()] < 0:
            v *= -1
    return {"inputs": list(inputs), "values": values, "components": vectors, "shares": values / max(values.sum(), 1e-300), "mean": mean, "scale": sd if correlation else np.ones_like(sd), "n": n}


def pca_scores(df: DataFrame, model: dict, k: int = 2) -> DataFrame:
    """df with pc1..pck."""
    z = [(number(F.col(c), df.schema[c].dataType) - float(m)) / float(s) for c, m, s in zip(model["inputs"], model["mean"], model["scale"])]
    return df.withColumns({f"pc{i + 1}": sum((x * float(w) for x, w in zip(z, model["components"][i])), F.lit(0.0)) for i in range(k)})


#: Classes of a tree at most.
TREE_CLASSES = 200


def decision_tree(df: DataFrame, target: str, inputs: Sequence[str], max_depth: int = 6, min_rows: int = 2) -> Column:
    """A gini tree as one expression of the inputs: numeric thresholds halfway between values, <= goes left; at most TREE_CLASSES classes.

    Level by level: rows carry their node, class counts by (node, input, value) are summed before the shuffle and dealt to
    ranges of (node, input, value); a range's sums (a row for each partition, node and input) go ahead of the next ones, so running
    counts need no task that holds an input's values. Only each node's best split (at most 2 ** depth) reaches the driver.
    """
    v = {c: number(F.col(c), df.schema[c].dataType) for c in inputs}
    y = F.col(target).cast("string")
    held = df.where(all_of([x.isNotNull() for x in v.values()]) & y.isNotNull()).select(*[x.alias(f"x{i}") for i, x in enumerate(v.values())], y.alias("y"))
    held = materialise(held, "tree")
    classes = [r.y for r in held.select("y").distinct().orderBy("y").limit(TREE_CLASSES + 1).collect()]
    if len(classes) > TREE_CLASSES:
        raise ValueError(f"more than {TREE_CLASSES} classes")
    c = range(len(classes))
    splits: dict[int, tuple[int, float]] = {}

    def node() -> Column:
        def below(i: int) -> Column:
            if i not in splits:
                return F.lit(i)
            f, t = splits[i]
            return F.when(F.col(f"x{f}") <= t, below(2 * i)).otherwise(below(2 * i + 1))

        return below(1)

    for depth in range(max_depth):
        placed = held.withColumn("node", node()).where(F.col("node") >= 2**depth)
        each = placed.select("node", "y", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(len(inputs))])).alias("f", "x"))
        counts = each.groupBy("node", "f", "x").agg(*[F.count_if(F.col("y") == k).alias(f"c{i}") for i, k in enumerate(classes)])
        dealt = materialise(counts.repartitionByRange("node", "f", "x").withColumn("__range", F.spark_partition_id()), "values")
        by = ["__range", "node", "f"]
        whole = Window.partitionBy("node", "f")
        along = whole.orderBy("__range")
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        sums = dealt.groupBy(*by).agg(*[F.sum(f"c{i}").alias(f"s{i}") for i in c], F.min("x").alias("first"))  # a row for each partition, node and input
        sums = sums.select(*by, F.lead("first").over(along).alias("after"), *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in c], *[F.sum(f"s{i}").over(whole).alias(f"a{i}") for i in c])
        inside = Window.partitionBy(*by).orderBy("x")
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        run = dealt.select(*by, "x", F.lead("x").over(inside).alias("following"), *[F.sum(f"c{i}").over(upto).alias(f"r{i}") for i in c]).join(F.broadcast(sums), by)
        left, every = [F.col(f"r{i}") + F.col(f"b{i}") for i in c], [F.col(f"a{i}") for i in c]
        add = lambda terms: sum(terms, F.lit(0))
        scored = run.select("node", "f", "x", F.coalesce("following", "after").alias("next"), add(left).alias("nl"), add(every).alias("total"), add([x * x for x in left]).alias("sl"), add([(a - x) * (a - x) for a, x in zip(every, left)]).alias("sr"), add([a * a for a in every]).alias("sa"))
        nr = F.col("total") - F.col("nl")
        gain = (F.col("sl") / F.col("nl") + F.col("sr") / nr - F.col("sa") / F.col("total")) / F.col("total")
        ok = scored.where(F.col("next").isNotNull() & (F.col("total") >= min_rows)).withColumn("gain", round_half_up(gain, 12)).where("gain > 0")
        best = ok.groupBy("node").agg(F.min_by(F.struct("f", ((F.col("x") + F.col("next")) / 2).alias("t")), F.struct(-F.col("gain"), F.col("f"), F.col("x"))).alias("s")).collect()
        release(dealt)
        if not best:
            break
        splits |= {r.node: (r.s.f, r.s.t) for r in best}
    leaves = held.groupBy(node().alias("node"), "y").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("y")).collect()
    said = {r.node: r.y for r in leaves}

    def expression(i: int) -> Column:
        if i not in splits:
            return F.lit(said.get(i))
        f, t = splits[i]
        return F.when(v[inputs[f]] <= t, expression(2 * i)).otherwise(expression(2 * i + 1))

    return expression(1)


def cross_validate(df: DataFrame, key: str, k: int, fit_score: Callable[[DataFrame, DataFrame], float | None], seed: int = 7) -> dict:
    """Mean and population deviation of the scores of k folds; folds without a score are left out."""
    parts = folds(df, key, k, seed)
    got = [fit_score(parts.where(F.col("fold") != i).drop("fold"), parts.where(F.col("fold") == i).drop("fold")) for i in range(k)]
    some = [x for x in got if x is not None and not math.isnan(x)]
    return {"scores": got, "mean": float(np.mean(some)) if some else None, "std": float(np.std(some)) if some else None}


def linear_score(target: str, inputs: Sequence[str]) -> Callable[[DataFrame, DataFrame], float | None]:
    """R2 on the held-out rows of a linear model, for ``cross_validate``; None where the inputs depend on each other."""

    def score(train: DataFrame, test: DataFrame) -> float | None:
        try:
            model = ols(train, target, inputs)
        except CollinearError:
            return None
        return regression_metrics(test.select("*", linear_predict(model)), target, "prediction").first().r2

    return score


def bayes_score(target: str, inputs: Sequence[str]) -> Callable[[DataFrame, DataFrame], float | None]:
    """Accuracy on the held-out rows of a naive Bayes model, for ``cross_validate``."""

    def score(train: DataFrame, test: DataFrame) -> float | None:
        said = naive_bayes_predict(test, naive_bayes_model(train, target, inputs), inputs)
        return said.agg(F.avg((F.col("predicted") == F.col(target).cast("string")).cast("double")).alias("a")).first().a

    return score


def _accuracy(said: DataFrame, target: str) -> float | None:
    return said.agg(F.avg((F.col("predicted") == F.col(target).cast("string")).cast("double")).alias("a")).first().a


def tree_score(target: str, inputs: Sequence[str], max_depth: int = 6) -> Callable[[DataFrame, DataFrame], float | None]:
    """Accuracy on the held-out rows of a tree, for ``cross_validate``."""
    return lambda train, test: _accuracy(test.withColumn("predicted", decision_tree(train, target, inputs, max_depth)), target)


def logistic_score(target: str, positive: str, inputs: Sequence[str], l2: float = 0.0) -> Callable[[DataFrame, DataFrame], float | None]:
    """Accuracy on the held-out rows of a logistic model that says yes from one half on, for ``cross_validate``."""

    def score(train: DataFrame, test: DataFrame) -> float | None:
        p = logistic_predict(logistic(train, target, positive, inputs, l2))
        return test.agg(F.avg(((p >= 0.5) == (F.col(target).cast("string") == positive)).cast("double")).alias("a")).first().a

    return score


def neighbours_score(target: str, inputs: Sequence[str], key: str, k: int = 5) -> Callable[[DataFrame, DataFrame], float | None]:
    """Accuracy on the held-out rows of the k nearest training rows' majority, at the training rows' scale, for ``cross_validate``."""

    def score(train: DataFrame, test: DataFrame) -> float | None:
        at = [f"x{i}" for i in range(len(inputs))]
        held, mean, sd = scaled(train, inputs)
        points = held.select(F.col(key).alias("key"), F.col(target).cast("string").alias("class"), *[F.col(f"z{i}").alias(x) for i, x in enumerate(at)])
        v = [number(F.col(c), test.schema[c].dataType) for c in inputs]
        asked = test.where(all_of([x.isNotNull() for x in v])).select(F.col(key).alias("query"), F.col(target).alias(target), *[((x - float(m)) / float(s)).alias(a) for x, m, s, a in zip(v, mean, sd, at)])
        said = _majority(k_nearest(points.select("key", *at), asked.select("query", *at), len(inputs), k), points.select("key", "class"))
        return _accuracy(asked.join(said, "query"), target)

    return score


def eligible_targets(df: DataFrame, columns: Sequence[str], most: int = 20) -> DataFrame:
    """column and classes of those with 2 to ``most`` classes, fewest first."""
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("classes")) for c in columns]).alias("r"))
    return row.select(F.inline("r")).where(F.col("classes").between(2, most)).orderBy("classes", "column")


def dbscan(df: DataFrame, inputs: Sequence[str], key: str, eps: float = 0.8, min_points: int = 4, scale: bool = True) -> DataFrame:
    """key and cluster: components of core points within eps, -1 for noise; a border point joins the least cluster near it. Rows without all inputs are left out.

    Dense cells make no pairs (``density``).
    """
    v = [number(F.col(c), df.schema[c].dataType) for c in inputs]
    z = scaled(df, inputs, sample=True)[0] if scale else df.where(all_of([x.isNotNull() for x in v])).withColumns({f"z{i}": x for i, x in enumerate(v)})
    return density.dbscan(z, [f"z{i}" for i in range(len(inputs))], key, eps, min_points)
