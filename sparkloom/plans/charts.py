"""The data behind charts, dashboard widgets and maps: each is one lazy DataFrame."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.values import collated, group_text, number, text
from sparkloom.operators.aggregate import group_by, summarise
from sparkloom.operators.filters import category_in, in_range
from sparkloom.operators.kpi import kpi


@dataclass(frozen=True)
class ChartSpec:
    """What a chart shows: dimensions, (column, aggregate, name) measures, a colour dimension, order and number of marks.

    filters: (column, texts that pass) or (column, (least, largest)) of numbers, either of which may be None; all must hold.
    """

    kind: str
    dims: tuple[str, ...]
    measures: tuple[tuple[str, str, str], ...]
    color: str | None = None
    descending: bool = True
    top: int | None = None
    filters: tuple[tuple[str, tuple], ...] = ()


#: Fields each chart needs at least: (dimensions, measures).
NEEDS = {"bar": (1, 1), "hbar": (1, 1), "line": (1, 1), "area": (1, 1), "pie": (1, 1), "scatter": (0, 2), "treemap": (1, 1), "heatmap": (2, 1), "bubble": (0, 3), "waterfall": (1, 1), "funnel": (1, 1), "radar": (1, 1), "boxplot": (1, 1), "violin": (1, 1), "sankey": (2, 1), "sunburst": (2, 1), "facet": (2, 1)}


def missing_fields(spec: ChartSpec) -> tuple[int, int]:
    d, m = NEEDS[spec.kind]
    return max(0, d - len(spec.dims)), max(0, m - len(spec.measures))


def filtered(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """The rows that a chart is drawn from."""
    for column, values in spec.filters:
        texts = all(isinstance(v, str) for v in values)
        df = category_in(df, column, values) if texts else in_range(df, column, *values)
    return df


def ranked(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """Bar, line, pie, funnel, treemap: one row for each key, sorted by the first measure, then by key."""
    out = group_by(filtered(df, spec), spec.dims, spec.measures)
    first = spec.measures[0][2]
    order = F.col(first).desc_nulls_last() if spec.descending else F.col(first).asc_nulls_last()
    out = out.orderBy(order, *spec.dims)
    return out.limit(spec.top) if spec.top else out


def colored(df: DataFrame, spec: ChartSpec, most: int = 16) -> DataFrame:
    """A series for each of the ``most`` most frequent colours; cells without rows are 0."""
    df = filtered(df, spec)
    c = group_text(F.col(spec.color), df.schema[spec.color].dataType)
    colors = [r[0] for r in df.groupBy(c.alias("c")).count().orderBy(F.desc("count"), "c").limit(most).collect()]
    column, how, name = spec.measures[0]
    key = group_text(F.col(spec.dims[0]), df.schema[spec.dims[0]].dataType)
    held = df.withColumns({"__c": c, "__key": key}).where(F.col("__c").isin(*colors))
    cells = summarise(held, ["__key", "__c"], [(column, how, name)]).withColumnRenamed("__key", spec.dims[0])
    return cells.groupBy(spec.dims[0]).pivot("__c", colors).agg(F.first(name)).fillna(0.0)


def heatmap(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """A row for each pair of dimension values that occurs: x and y, their places xi and yi by name from 0, and the value (missing ones are 0).

    Places are numbered over the aggregated names, of which a chart has few.
    """
    df = filtered(df, spec)
    column, how, _ = spec.measures[0]
    x, y = spec.dims[0], spec.color if spec.color and spec.color != spec.dims[0] else spec.dims[1]
    cells = group_by(df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(column).alias("value")), ["x", "y"], [("value", how, "value")])
    place = lambda c: (F.dense_rank().over(Window.orderBy(c)) - 1).alias(f"{c}i")
    return cells.select("x", "y", place("x"), place("y"), F.coalesce("value", F.lit(0)).alias("value"))


def radar(df: DataFrame, spec: ChartSpec, most: int = 12) -> DataFrame:
    """A row for each of the first ``most`` keys by name and each measure: key, axis, value, and top, the axis' end: 1.15 times the largest value of all keys, 1 at least."""
    df = filtered(df, spec)
    if len(spec.measures) < 2:
        raise ValueError("a radar chart needs two measures")
    names = [name for _, _, name in spec.measures]
    cells = group_by(df, spec.dims[:1], spec.measures).select(F.col(spec.dims[0]).alias("key"), *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in names])
    ends = F.broadcast(cells.agg(*[(F.greatest(F.max(n), F.lit(1.0)) * 1.15).alias(f"__top_{n}") for n in names]))  # one row
    chosen = cells.orderBy("key").limit(min(most, spec.top) if spec.top else most)
    axes = F.array(*[F.struct(F.lit(n).alias("axis"), F.col(n).alias("value"), F.col(f"__top_{n}").alias("top")) for n in names])
    return chosen.crossJoin(ends).select("key", F.inline(axes))


def series_table(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """What a slide's chart holds: category, series and value, one row for each cell; the colours of a coloured chart are its series, else its measures are."""
    df = filtered(df, spec)
    if spec.color:
        wide = colored(df, spec)
        names = wide.columns[1:]
    else:
        wide, names = group_by(df, spec.dims[:1], spec.measures), [name for _, _, name in spec.measures]
    cells = F.array(*[F.struct(F.lit(n).alias("series"), F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias("value")) for n in names])
    return wide.select(F.col(spec.dims[0]).alias("category"), F.inline(cells))


def scatter_colored(df: DataFrame, x: str, y: str, color: str, most: int = 12) -> DataFrame:
    """x, y and group for the rows of the ``most`` most frequent groups, of ties the first by name; missing groups are one group."""
    g = group_text(F.col(color), df.schema[color].dataType)
    held = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), g.alias("group"))
    chosen = held.groupBy("group").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "group").limit(most).select(F.col("group").alias("__g"))
    return held.join(F.broadcast(chosen), F.col("group").eqNullSafe(F.col("__g"))).where("x is not null and y is not null").drop("__g")  # at most `most` rows


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")


def bubble(df: DataFrame, x: str, y: str, size: str) -> DataFrame:
    """x, y, size and radius: the square root of the share of the largest, times 52, at least 6."""
    top = F.broadcast(df.agg(F.max(F.abs(F.col(size).cast("double"))).alias("__t")))
    share = F.when(F.col("__t") > 0, F.abs(F.col(size)) / F.col("__t")).otherwise(0.0)
    return df.join(top).select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(size).alias("size"), F.greatest(F.lit(6.0), F.sqrt(share) * 52).alias("radius"))


def waterfall(df: DataFrame, dim: str, value: str) -> DataFrame:
    """Steps by descending value with the running total and the base each step starts from."""
    sums = group_by(df, [dim], [(value, "sum", "value")])
    w = Window.orderBy(F.desc("value"), dim).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("value").over(w)
    return sums.select(dim, "value", run.alias("running"), F.least(run, run - F.col("value")).alias("base"))


def boxplot(df: DataFrame, dim: str, value: str) -> DataFrame:
    """Five numbers of each group, the whisker bounds, and how many values lie beyond."""
    v = number(F.col(value), df.schema[value].dataType)
    g = group_text(F.col(dim), df.schema[dim].dataType)
    held = df.select(g.alias(dim), v.alias("v")).where("v is not null")
    box = summarise(held, [dim], [("v", "min", "lo"), ("v", "q0.25", "q1"), ("v", "median", "median"), ("v", "q0.75", "q3"), ("v", "max", "hi")])
    box = box.select(dim, F.col("__count").alias("n"), "lo", "q1", "median", "q3", "hi")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    far = held.join(box, dim).where((F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach)).groupBy(dim).agg(F.count(F.lit(1)).alias("outliers"))
    return box.join(far, dim, "left").fillna(0, ["outliers"])


def violin(df: DataFrame, dim: str, value: str, points: int = 40) -> DataFrame:
    """Gaussian kernel density of each group at ``points`` places; equal values are counted first, so a kernel is summed once for each distinct value."""
    v = number(F.col(value), df.schema[value].dataType)
    g = group_text(F.col(dim), df.schema[dim].dataType)
    counts = df.select(g.alias(dim), v.alias("v")).where("v is not null").groupBy(dim, "v").agg(F.count(F.lit(1)).alias("c"))
    s = counts.groupBy(dim).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("m"), (F.sum(F.col("c") * F.col("v") * F.col("v")) / F.sum("c")).alias("m2"))
    sigma = F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)))
    s = s.withColumn("bw", F.greatest(1.06 * sigma * F.pow("n", F.lit(-0.2)), (F.col("hi") - F.col("lo")) * 0.05)).where("bw > 0")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(k.alias("k"), (F.col("lo") + (F.col("hi") - F.col("lo")) * k / (points - 1)).alias("x"))))
    met = counts.join(s, dim).select(dim, "v", "c", "n", "bw", grid.alias("p"))
    z = (F.col("p.x") - F.col("v")) / F.col("bw")
    kernel = F.sum(F.col("c") * F.exp(-z * z / 2)) / (F.max("n") * F.max("bw") * math.sqrt(2 * math.pi))
    return met.groupBy(dim, F.col("p.k").alias("k")).agg(F.max("p.x").alias("x"), kernel.alias("density"))


def links(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """Sankey: totals over 0 between two dimensions."""
    return group_by(df, [source, target], [(value, "sum", "value")]).where("value > 0").select(source, target, "value")


def sunburst(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Two levels: each outer key with its total and its inner keys, largest first."""
    cells = group_by(df, [outer, inner], [(value, "sum", "value")])
    children = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("order"), F.col(inner).alias("name"), F.col("value").alias("value"))))
    return cells.groupBy(outer).agg(F.sum("value").alias("value"), F.transform(children, lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"))).alias("children"))


def candles(df: DataFrame, date: str) -> DataFrame:
    """The rows with an opening price, by date."""
    return df.where("open is not null").select(date, "open", "close", "low", "high").orderBy(date)


def candles_volume(df: DataFrame, date: str) -> DataFrame:
    """The same with volume, and up: whether the price closed at its opening or above."""
    return df.where("open is not null").select(date, "open", "close", "low", "high", "volume", (F.col("close") >= F.col("open")).alias("up")).orderBy(date)


def bars_of(df: DataFrame, time: str, price: str, amount: str, unit: str = "day") -> DataFrame:
    """Single trades rolled up to open, close, low, high and volume of each unit of time; trades at one time count by price."""
    at = F.struct(F.col(time), F.col(price))
    day = df.groupBy(F.date_trunc(unit, time).alias("date"))
    return day.agg(F.min_by(price, at).alias("open"), F.max_by(price, at).alias("close"), F.min(price).alias("low"), F.max(price).alias("high"), F.sum(amount).alias("volume"))


def facets(df: DataFrame, facet: str, dim: str, value: str, panels: int = 12, bars: int = 8) -> DataFrame:
    """The first ``panels`` facet values by name, each with its ``bars`` smallest sums."""
    cells = group_by(df, [facet, dim], [(value, "sum", "value")])
    names = F.dense_rank().over(Window.orderBy(facet))
    chosen = cells.select(facet).distinct().withColumn("__p", names).where(F.col("__p") <= panels).select(facet)
    place = F.row_number().over(Window.partitionBy(facet).orderBy(F.asc_nulls_last("value"), dim))
    return cells.join(F.broadcast(chosen), facet).withColumn("place", place).where(F.col("place") <= bars).select(facet, dim, "value", "place")


def recommend(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> str:
    """A chart kind for the chosen fields."""
    if len(dims) >= 2 and measures:
        return "heatmap"
    if not dims:
        return "bubble" if len(measures) >= 3 else "scatter" if len(measures) == 2 else "histogram"
    if df.schema[dims[0]].dataType.typeName() in ("timestamp", "date"):
        return "line"
    return "pie" if df.select(dims[0]).distinct().limit(7).count() <= 6 and len(measures) == 1 else "bar"


def kpi_widget(df: DataFrame, value: tuple[str, str] | str, cross: tuple[str, str] | None = None) -> DataFrame:
    """value over the cross-filtered rows, whole over all rows, and the percentage between them (100 where the whole is 0); a formula has its error beside them."""
    inside = F.lit(True) if cross is None else F.coalesce(text(F.col(cross[0]), df.schema[cross[0]].dataType) == cross[1], F.lit(False))
    held = df.withColumns({f"__{c}": F.when(inside, F.col(c)) for c in df.columns})
    if isinstance(value, str):
        part = kpi(df.where(inside), value, error="error")
        return part.crossJoin(F.broadcast(kpi(df, value, "whole"))).withColumn("pct", _percent()).select("value", "whole", "pct", "error")  # one row each
    column, how = value
    if how == "count":
        return held.agg(F.count_if(inside).alias("value"), F.count(F.lit(1)).alias("whole")).withColumn("pct", _percent())
    return summarise(held, (), [(f"__{column}", how, "value"), (column, how, "whole")]).drop("__count").withColumn("pct", _percent())


def _percent() -> Column:
    return F.when(F.col("whole") == 0, 100.0).otherwise(F.col("value") / F.col("whole") * 100)


def table_widget(df: DataFrame, dim: str, value: str, how: str = "sum", limit: int = 30) -> DataFrame:
    """rank, key, value and its share of the largest; a top-n report."""
    top = group_by(df, [dim], [(value, how, "value")]).orderBy(F.col("value").desc_nulls_last(), dim).limit(limit)
    w = Window.orderBy(F.col("value").desc_nulls_last(), dim)
    largest = F.max("value").over(Window.partitionBy())
    return top.select(F.row_number().over(w).alias("rank"), dim, "value", F.when(largest != 0, F.col("value") / largest).alias("bar"))


def default_widgets(dims: Sequence[str], measures: Sequence[str], dates: Sequence[str]) -> list[dict]:
    """A first dashboard from the roles of the columns."""
    out = [{"type": "kpi", "value": ("*", "count")}, *({"type": "kpi", "value": (m, how)} for m in measures[:1] for how in ("sum", "avg"))]
    if dims and measures:
        out.append({"type": "chart", "spec": ChartSpec("bar", (dims[0],), ((measures[0], "sum", "value"),), top=20)})
        out.append({"type": "chart", "spec": ChartSpec("line" if dates else "pie", ((dates or dims)[0],), ((measures[0], "sum", "value"),), top=None if dates else 8)})
        out += [{"type": "table", "dim": dims[0], "value": measures[0]}, {"type": "chart", "spec": ChartSpec("treemap", (dims[0],), ((measures[0], "sum", "value"),))}]
    return out


def stale(widget_columns: Sequence[str], df: DataFrame) -> list[str]:
    return [c for c in widget_columns if c != "*" and c not in df.columns]


def sorted_page(df: DataFrame, column: str, tie: str, page: int, size: int = 100, descending: bool = False, locale: str | None = None) -> DataFrame:
    """One page of rows in the order of a column, nulls last either way; ties by another column. Texts go by code points, or by a locale's rules (``ko``, ``UNICODE``)."""
    key = collated(F.col(column), df.schema[column].dataType, locale)
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.orderBy(order, tie).offset(page * size).limit(size)


#: Other names of a region and the name it is matched by.
REGION_ALIASES = {
    "seoul": "서울", "서울특별시": "서울", "서울시": "서울",
    "busan": "부산", "부산광역시": "부산",
    "daegu": "대구", "대구광역시": "대구",
    "incheon": "인천", "인천광역시": "인천",
    "gwangju": "광주", "광주광역시": "광주",
    "daejeon": "대전", "대전광역시": "대전",
    "ulsan": "울산", "울산광역시": "울산",
    "sejong": "세종", "세종특별자치시": "세종",
    "gyeonggi": "경기", "경기도": "경기",
    "gangwon": "강원", "강원도": "강원", "강원특별자치도": "강원",
    "north chungcheong": "충북", "충청북도": "충북",
    "south chungcheong": "충남", "충청남도": "충남",
    "north jeolla": "전북", "전라북도": "전북", "전북특별자치도": "전북",
    "south jeolla": "전남", "전라남도": "전남",
    "north gyeongsang": "경북", "경상북도": "경북",
    "south gyeongsang": "경남", "경상남도": "경남",
    "jeju": "제주", "제주도": "제주", "제주특별자치도": "제주",
    "대한민국": "south korea", "한국": "south korea", "korea": "south korea", "republic of korea": "south korea",
    "미국": "united states", "usa": "united states", "us": "united states", "united states of america": "united states",
    "일본": "japan", "중국": "china", "영국": "united kingdom", "uk": "united kingdom",
    "독일": "germany", "프랑스": "france", "이탈리아": "italy", "스페인": "spain",
    "캐나다": "canada", "호주": "australia", "인도": "india", "브라질": "brazil",
    "러시아": "russia", "멕시코": "mexico", "인도네시아": "indonesia",
}
#: Endings of Korean administrative names; the short ones go only if two characters are left.
REGION_ENDINGS = ("(특별자치도|특별자치시|특별시|광역시|자치구|자치시|자치도)$", "(특별시|광역시|도|시|군|구)$")


def region_name(c: Column) -> Column:
    """What a label is matched by: its alias; a Korean name without its administrative ending and spaces; else lower case, points, hyphens and spaces one space."""
    plain = F.trim(c)
    small = F.lower(plain)
    aliases = F.create_map(*[F.lit(x) for kv in REGION_ALIASES.items() for x in kv])
    known = lambda x: F.try_element_at(aliases, x)
    long = F.regexp_replace(plain, REGION_ENDINGS[0], "")
    short = F.regexp_replace(long, REGION_ENDINGS[1], "")
    stem = F.regexp_replace(F.when(F.length(short) >= 2, short).otherwise(long), r"\s+", "")
    latin = F.trim(F.regexp_replace(F.regexp_replace(small, r"[.\-_]", " "), r"\s+", " "))
    return F.coalesce(known(small), F.when(plain.rlike("[가-힣]"), F.coalesce(known(stem), stem)), latin)


def region_totals(df: DataFrame, label: str, regions: DataFrame, name: str, value: str | None = None) -> DataFrame:
    """Each region with the sum of a value (or the number of rows) of the labels that match it."""
    sums = df.groupBy(F.col(label).alias("__l")).agg((F.coalesce(F.sum(number(F.col(value), df.schema[value].dataType)), F.lit(0.0)) if value else F.count(F.lit(1))).alias("value"))
    known = regions.select(F.col(name).alias("region"), region_name(F.col(name)).alias("__k")).groupBy("__k").agg(F.min("region").alias("region"))
    return sums.withColumn("__k", region_name(F.col("__l"))).join(known, "__k").groupBy("region").agg(F.sum("value").alias("value"))


def unmatched(df: DataFrame, label: str, regions: DataFrame, name: str) -> DataFrame:
    """The distinct labels that match no region."""
    known = regions.select(region_name(F.col(name)).alias("__k")).distinct()
    return df.select(F.col(label).alias("label")).where("label is not null").distinct().withColumn("__k", region_name(F.col("label"))).join(known, "__k", "left_anti").select("label")


def match_rate(df: DataFrame, label: str, regions: DataFrame, name: str) -> DataFrame:
    """One row: distinct labels, those that match a region, and their share."""
    known = regions.select(region_name(F.col(name)).alias("__k")).distinct().withColumn("hit", F.lit(1))
    d = df.select(F.col(label).alias("l")).where("l is not null").distinct().withColumn("__k", region_name(F.col("l"))).join(known, "__k", "left")
    return d.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched")).withColumn("rate", F.when(F.col("total") > 0, F.col("matched") / F.col("total")))
