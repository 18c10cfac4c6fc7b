"""Rules that turn results into sentences, and words into chart specs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.charts import ChartSpec

#: What the words of a question ask for, in the order they are tried.
INTENTS = (
    ("outlier", r"outlier|이상치|anomal"),
    ("correlation", r"correlation|상관"),
    ("regression", r"regress|회귀"),
    ("distribution", r"distribut|분포|histogram|boxplot"),
    ("ml", r"ml|machine|learn|분류|classif|cluster|군집"),
    ("last", r"last|recent|previous|summary|방금|마지막|결과 요약"),
    ("trend", r"trend|추세|시계열|over time|시간|월별|연도"),
    ("top", r"top|상위|rank|순위"),
    ("mix", r"mix|비율|proportion|share|구성|비중|pie|도넛"),
)


def intent(question: str) -> str:
    """What a question asks for; bars of means where no word says."""
    return next((name for name, words in INTENTS if re.search(words, question.lower())), "bar")


def mentioned(question: str, columns: Sequence[str]) -> list[str]:
    """Columns whose name stands in the question, longest names first."""
    low = question.lower()
    return [c for c in sorted(columns, key=lambda c: (-len(c), c)) if c.lower() in low]


def chart_for(question: str, dims: Sequence[str], measures: Sequence[str], dates: Sequence[str] = ()) -> ChartSpec | None:
    """A pie of eight for shares, ten bars for rankings, a line for trends, else bars of means; columns named in the question first."""
    what = intent(question)
    if what not in ("trend", "top", "mix", "bar") or not measures:
        return None
    m = (mentioned(question, measures) or list(measures))[0]
    d = (mentioned(question, dims) or list(dims) or list(dates))[0]
    if what == "trend" and dates:
        return ChartSpec("line", (dates[0],), ((m, "sum", "value"),))
    return {"mix": ChartSpec("pie", (d,), ((m, "sum", "value"),), top=8), "top": ChartSpec("hbar", (d,), ((m, "sum", "value"),), top=10)}.get(what, ChartSpec("bar", (d,), ((m, "avg", "value"),)))


def small_dimensions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and values of those with 2 to 50 distinct values (null is one), fewest first; one pass."""
    count = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), count(c).alias("values")) for c in columns]).alias("r"))
    return row.select(F.inline("r")).where(F.col("values").between(2, 50)).orderBy("values", "column")


def grouping(df: DataFrame, dims: Sequence[str]) -> str | None:
    """The dimension to group by where a question names none: of 2 to 50 values, the fewest; else the first."""
    small = small_dimensions(df, dims).first() if dims else None
    return small.column if small else next(iter(dims), None)


def suggestions(df: DataFrame, dims: Sequence[str], measures: Sequence[str], dates: Sequence[str] = ()) -> list[tuple[str, str | None, str | None]]:
    """Up to six questions that the columns can answer, as (intent, measure, dimension)."""
    d, m = grouping(df, dims), next(iter(measures), None)
    offered = [("bar", m, d, m and d), ("top", m, d, m and d), ("mix", None, d, d), ("outlier", m, None, m), ("trend", m, next(iter(dates), None), m and dates), ("correlation", None, None, len(measures) > 1), ("last", None, None, True)]
    return [(what, measure, dim) for what, measure, dim, fits in offered if fits][:6]


def next_step(last: str | None, r2: float | None = None) -> str:
    """What to do after the last analysis: correlation, regression, means (t-test, anova), distribution, builder or none yet."""
    if last == "regression":
        return "clean" if r2 is not None and r2 < 0.5 else "models"  # a poor fit: look for outliers first
    return {"correlation": "regression", "ttest": "regression", "anova": "regression", "distribution": "clean", "builder": "models"}.get(last or "", "correlation")


def class_lines(metrics: DataFrame, most: int = 5) -> DataFrame:
    """class and line, its precision and recall in whole percent, of ``learn.class_metrics``; no rows for more than ``most`` classes."""
    percent = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    few = metrics.limit(most + 1).agg((F.count(F.lit(1)) <= most).alias("__few"))
    lines = metrics.select("class", F.concat(F.lit("P="), percent("precision"), F.lit("/R="), percent("recall")).alias("line"))
    return lines.crossJoin(F.broadcast(few)).where("__few").drop("__few")  # one row


def regression_summary(model: dict) -> str:
    r2 = model["r2"]
    word = "strong" if r2 >= 0.8 else "good" if r2 >= 0.6 else "moderate" if r2 >= 0.4 else "weak"
    terms = [n for n, p in zip(model["names"][1:], model["p"][1:]) if p < 0.05]
    return f"A {word} fit (R2 {r2:.3f}); significant: {', '.join(terms) or 'none'}."


def correlation_summary(pairs: DataFrame) -> DataFrame:
    """One row: the strongest pair of columns and how many pairs are beyond 0.5."""
    half = pairs.where("a < b and r is not null")
    return half.agg(F.max_by(F.concat_ws("~", "a", "b"), F.abs("r")).alias("strongest"), F.max(F.abs("r")).alias("strength"), F.count_if(F.abs("r") > 0.5).alias("strong_pairs"))


def classification_summary(accuracy: float) -> str:
    return "excellent" if accuracy >= 0.9 else "good" if accuracy >= 0.75 else "fair" if accuracy >= 0.6 else "poor"


def clustering_summary(clusters: DataFrame, name: str = "cluster") -> DataFrame:
    """One row: clusters, the share of the largest, and whether it is over 0.6."""
    g = clusters.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("clusters"), (F.max("n") / F.sum("n")).alias("largest_share")).withColumn("imbalanced", F.col("largest_share") > 0.6)
