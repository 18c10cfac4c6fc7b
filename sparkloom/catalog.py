"""All registered queries of the library, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.formats import compact, plain_text
from sparkloom.functions.formula import compile_formula
from sparkloom.functions.values import blank, number
from sparkloom.operators import aggregate as agg
from sparkloom.operators import combine, control, distributions, filters, learn, series, stats, windows
from sparkloom.operators.clean import Pipeline, Step, issues, joint_outliers
from sparkloom.operators.kpi import kpi, report
from sparkloom.operators.neighbours import k_nearest
from sparkloom.operators.overlay import edited
from sparkloom.operators.pivot import PivotSpec, long_form, tuples, wide
from sparkloom.plans import assistant, charts, geo, insights
from sparkloom.sources import readers
from sparkloom.sources.registry import Registry
from sparkloom.streaming import event_windows

FLAGSHIP = "pvt_totals"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        _QUERIES[name] = (fn, sql)
        return fn

    return keep


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items() if s}


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with missing discounts: those of line 3."""
    return load(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_discount")))


def days(spark: SparkSession, d: str) -> DataFrame:
    """A daily series: order value and number of orders by day."""
    return load(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.sum("o_totalprice").alias("value"), F.count(F.lit(1)).alias("n"))


GAPPY = "(select * replace (case when l_linenumber <> 3 then l_discount end as l_discount) from lineitem)"
DAYS = "(select strftime(o_orderdate, '%Y-%m-%d') as day, sum(o_totalprice) as value, count(*) as n from orders group by 1)"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Fractions rounded, so that sums in another order compare equal."""
    return df.select(*[(F.round(f.name, digits) if f.dataType.typeName() == "double" else F.col(f.name)).alias(f.name) for f in df.schema.fields])


# ---- aggregation


@register("agg_group_by", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as qty, round(avg(l_extendedprice), 4) as price, min(l_quantity) as lo, max(l_quantity) as hi,
  round(median(l_extendedprice), 4) as mid, count(*) as n, count(distinct l_partkey) as parts, round(stddev_samp(l_quantity), 4) as sd, round(quantile_cont(l_extendedprice, 0.9), 4) as q9, count(*) as "__count"
from lineitem group by all""")
def _(spark, d):
    how = [("l_quantity", "sum", "qty"), ("l_extendedprice", "avg", "price"), ("l_quantity", "min", "lo"), ("l_quantity", "max", "hi"), ("l_extendedprice", "median", "mid"), ("l_quantity", "count", "n"), ("l_partkey", "countd", "parts"), ("l_quantity", "std", "sd"), ("l_extendedprice", "q0.9", "q9")]
    return rounded(agg.group_by(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], how))


@register("agg_missing", f"select l_returnflag, count(*) filter (l_discount is null) as lost, round(coalesce(sum(l_discount), 0), 4) as total, count(*) as \"__count\" from {GAPPY} group by 1")
def _(spark, d):
    return rounded(agg.group_by(gappy(spark, d), ["l_returnflag"], [("l_discount", "missing", "lost"), ("l_discount", "sum", "total")]))


@register("agg_global", "select round(sum(o_totalprice), 2) as total, count(*) as \"__count\" from orders")
def _(spark, d):
    return rounded(agg.group_by(load(spark, d, "orders"), [], [("o_totalprice", "sum", "total")]), 2)


@register("agg_mode", """
with c as (select p_brand as mode, count(*) as n, max(p_partkey) as reached from part group by 1) select mode, n from c order by n desc, reached limit 1""")
def _(spark, d):
    return agg.mode(load(spark, d, "part"), "p_brand", "p_partkey")


@register("agg_pearson", f"select round(corr(l_discount, l_extendedprice), 8) as r, count(*) as n from {GAPPY} where l_discount is not null")
def _(spark, d):
    return rounded(agg.pearson(gappy(spark, d), "l_discount", "l_extendedprice"), 8)


@register("agg_correlations", """
with p as (select unnest([['l_quantity','l_quantity'],['l_quantity','l_extendedprice'],['l_quantity','l_tax'],['l_extendedprice','l_quantity'],['l_extendedprice','l_extendedprice'],['l_extendedprice','l_tax'],['l_tax','l_quantity'],['l_tax','l_extendedprice'],['l_tax','l_tax']]) as p),
c as (select corr(l_quantity, l_extendedprice) as qe, corr(l_quantity, l_tax) as qt, corr(l_extendedprice, l_tax) as et from lineitem)
select p[1] as a, p[2] as b, round(case when p[1] = p[2] then 1.0 when 'l_tax' not in (p[1], p[2]) then qe when 'l_quantity' in (p[1], p[2]) then qt else et end, 8)::double as r from p, c""")
def _(spark, d):
    return rounded(agg.correlations(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 8)


@register("agg_spearman_matrix", """
with r as (select row_number() over (order by c_acctbal, c_custkey) as x, row_number() over (order by c_nationkey, c_custkey) as y, row_number() over (order by c_mktsegment, c_custkey) as z from customer),
c as (select corr(x, y) as xy, corr(x, z) as xz, corr(y, z) as yz, count(*) as n from r),
p as (select unnest(['c_acctbal', 'c_nationkey', 'c_mktsegment']) as a), q as (select a as b from p)
select a, b, case when a = b then 1.0 when 'c_mktsegment' not in (a, b) then round(xy, 8) when 'c_acctbal' in (a, b) then round(xz, 8) else round(yz, 8) end::double as rho, n from p, q, c""")
def _(spark, d):
    return rounded(windows.spearman_matrix(load(spark, d, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment"], "c_custkey"), 8)


@register("agg_value_histogram", """
with e as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 8 as w from orders),
h as (select least(floor((o_totalprice - lo) / w), 7)::int as bin, count(*) as n from orders, e group by 1)
select 'price' as what, b.bin::int as bin, round(lo + w * b.bin, 4) as lo, round(lo + w * (b.bin + 1), 4) as hi, coalesce(n, 0)::bigint as n from e, range(8) b(bin) left join h on h.bin = b.bin
union all select 'constant', 0, 7.0, 7.0, count(*) from orders""")
def _(spark, d):
    o = load(spark, d, "orders")
    both = [agg.value_histogram(df, "o_totalprice", 8).select(F.lit(w).alias("what"), "*") for w, df in (("price", o), ("constant", o.withColumn("o_totalprice", F.lit(7.0))))]
    return rounded(both[0].unionAll(both[1]))


@register("agg_histogram", """
with e as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 20 as w from orders),
h as (select least(floor((o_totalprice - lo) / w), 19)::int as bin, count(*) as n from orders, e group by 1)
select b.bin::int as bin, round(lo + w * b.bin, 4) as lo, round(lo + w * (b.bin + 1), 4) as hi, coalesce(n, 0)::bigint as n from e, range(20) b(bin) left join h on h.bin = b.bin""")
def _(spark, d):
    return rounded(agg.histogram(load(spark, d, "orders"), "o_totalprice", 20))


@register("agg_top_values", "select p_type as value, count(*) as n from part group by 1 order by n desc, value limit 4")
def _(spark, d):
    return agg.top_values(load(spark, d, "part"), "p_type", 4)


@register("agg_year_growth", """
with y as (select strftime(o_orderdate, '%Y') as y, avg(o_totalprice) as m from orders group by 1)
select round(arg_min(m, y), 4) as first_mean, round(arg_max(m, y), 4) as last_mean, round(arg_max(m, y) / arg_min(m, y) - 1, 4) as growth from y""")
def _(spark, d):
    return rounded(agg.year_growth(load(spark, d, "orders"), "o_orderdate", "o_totalprice"))


@register("agg_kpi", "select round(sum(l_extendedprice) / count(distinct l_orderkey) + median(l_quantity) * 2 - count(*) / 10, 4) as value from lineitem")
def _(spark, d):
    return rounded(kpi(load(spark, d, "lineitem"), "SUM(l_extendedprice) / COUNTD(l_orderkey) + MEDIAN(l_quantity) * 2 - COUNT(*) / 10"))


@register("agg_kpi_missing", f"select round(count(l_discount) / count(*) * 100, 6) as value from {GAPPY}")
def _(spark, d):
    return rounded(kpi(gappy(spark, d), "COUNT(l_discount) / COUNT(*) * 100"), 6)


@register("agg_kpi_zero", "select case when z <> 0 then s / z end as value, case when z = 0 then 'Division by zero' end as error from (select sum(r_regionkey)::double as s, min(r_regionkey) - min(r_regionkey) as z from region)")
def _(spark, d):
    return kpi(load(spark, d, "region"), "SUM(r_regionkey) / (MIN(r_regionkey) - MIN(r_regionkey))", error="error")


#: Formulas of one report: two share a median, one divides by a count that is 0 in some groups, one names no column.
KPIS = {"spread": "MAX(l_extendedprice) - MEDIAN(l_extendedprice)", "half": "MEDIAN(l_extendedprice) / 2", "per_late": "SUM(l_quantity) / (COUNT(l_discount) - COUNT(*))", "orders": "COUNTD(l_orderkey) * 100 / COUNTD(l_partkey)", "wrong": "SUM(nope)"}


@register("agg_kpi_report", f"""
with t as (
  select l_returnflag, l_linenumber, max(l_extendedprice) as top, median(l_extendedprice) as mid, sum(l_quantity) as q, count(l_discount) - count(*) as z, count(distinct l_orderkey) as o, count(distinct l_partkey) as p from {GAPPY} group by 1, 2
), r as (
  select l_returnflag, l_linenumber, unnest([
    struct_pack(kpi := 'spread', value := top - mid, error := null), struct_pack(kpi := 'half', value := mid / 2, error := null), struct_pack(kpi := 'per_late', value := case when z <> 0 then q / z end, error := case when z = 0 then 'Division by zero' end),
    struct_pack(kpi := 'orders', value := o * 100 / p, error := null), struct_pack(kpi := 'wrong', value := null, error := 'Unknown field: nope')]) as s from t
)
select l_returnflag, l_linenumber, s.kpi as kpi, round(s.value, 4)::double as value, s.error as error from r""")
def _(spark, d):
    return rounded(report(gappy(spark, d), KPIS, ["l_returnflag", "l_linenumber"]))


# ---- profile


@register("dsc_describe", "".join(f"""{' union all ' if i else ''}select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, round(median({c}), 4) as median, round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min,
round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3, round(max({c}), 4) as max, round(skewness({c}), 4) as skewness, round(kurtosis({c}), 4) as kurtosis from {GAPPY}""" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount"))))
def _(spark, d):
    return rounded(agg.describe(gappy(spark, d), ["l_quantity", "l_extendedprice", "l_discount"]))


@register("dsc_profile", " union all ".join(f"""select '{c}' as "column", count(*) as n_rows, count(*) filter ({c} is null) as missing, round(count(*) filter ({c} is null) * 100.0 / count(*), 4)::double as missing_pct, count(distinct {c}) as "distinct" from {GAPPY}""" for c in ("l_orderkey", "l_discount", "l_returnflag")))
def _(spark, d):
    return rounded(agg.profile(gappy(spark, d).select("l_orderkey", "l_discount", "l_returnflag")))


def _column_sql(c: str, kind: str) -> str:
    numbers = f"round(avg({c}), 4)::double as mean, round(stddev_samp({c}), 4) as std" if kind in ("long", "double") else "null::double as mean, null::double as std"
    most = f"(select list(struct_pack(value := v, n := n) order by n desc, v) from (select {c} as v, count(*) as n from orders where {c} is not null group by 1 order by n desc, v limit 10))"
    return f"""select '{c}' as "column", '{kind}' as kind, count(*) as n_rows, count(*) filter ({c} is null) as missing, 0.0::double as missing_pct, count(distinct {c}) as "distinct", {numbers}, min({c})::varchar as least, max({c})::varchar as largest,
array_to_string(list_transform({most}, lambda s: s.v || ':' || s.n), ' ') as top from orders""".replace("struct_pack(value := v, n := n)", "struct_pack(v := v, n := n)")


@register("dsc_columns", " union all ".join(_column_sql(c, kind) for c, kind in (("o_custkey", "long"), ("o_orderstatus", "string"), ("o_orderpriority", "string"))))
def _(spark, d):
    found = rounded(agg.column_report(load(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")))
    return found.withColumn("top", F.array_join(F.transform("top", lambda t: F.concat_ws(":", t["value"], t["n"])), " "))


@register("dsc_distribution", """
with f as (select count(*) as n, round(avg(o_totalprice), 4) as mean, round(median(o_totalprice), 4) as median, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as min, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3, max(o_totalprice) as max, round(skewness(o_totalprice), 4) as skewness, round(kurtosis(o_totalprice), 4) as kurtosis from orders),
b as (select least(floor((o_totalprice - min) / ((max - min) / 8)), 7)::int as bin, count(*) as n from orders, f group by 1)
select n, mean, median, std, round(min, 4) as min, round(q1, 4) as q1, round(q3, 4) as q3, round(max, 4) as max, skewness, kurtosis, round(q3 - q1, 4) as iqr, (select count(*) from orders, f where o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1)) as outliers, 0::bigint as missing,
(select string_agg(coalesce(b.n, 0)::varchar, ' ' order by k) from range(8) r(k) left join b on b.bin = k) as bins from f""")
def _(spark, d):
    found = rounded(distributions.distribution_report(load(spark, d, "orders"), "o_totalprice", 8))
    return found.withColumn("bins", F.array_join(F.transform("bins", lambda b: b["n"].cast("string")), " "))


@register("dsc_findings", """
with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.75) as b, quantile_cont(o_custkey, 0.25) as c, quantile_cont(o_custkey, 0.75) as d from orders)
select 'rows' as kind, '' as subject, count(*)::double as value from orders
union all select 'outliers', '', (count(*) filter (abs(o_totalprice - (a + b) / 2) > 2 * (b - a)) + count(*) filter (abs(o_custkey - (c + d) / 2) > 2 * (d - c)))::double as far from orders, q having far > 0
union all select 'correlation', 'o_totalprice~o_custkey', round(corr(o_totalprice, o_custkey), 4) as v from orders having abs(v) > 0.35""")
def _(spark, d):
    return rounded(insights.findings(load(spark, d, "orders"), ["o_totalprice", "o_custkey"]))


@register("dsc_findings_events", """
with e as (select * replace (case when event_type <> 'purchase' then props end as props) from events),
q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, quantile_cont(user_id, 0.25) as c, quantile_cont(user_id, 0.75) as d from events)
select 'rows' as kind, '' as subject, count(*)::double as value from e
union all select 'missing', 'props', count(*)::double from e where props is null
union all select 'skewness', 'value', round(skewness(value), 4) as s from e having abs(s) > 1.5
union all select 'outliers', '', (count(*) filter (abs(value - (a + b) / 2) > 2 * (b - a)) + count(*) filter (abs(user_id - (c + d) / 2) > 2 * (d - c)))::double from e, q""")
def _(spark, d):
    e = load(spark, d, "events").withColumn("props", F.when(F.col("event_type") != "purchase", F.col("props")))
    return rounded(insights.findings(e, ["value", "user_id"]))


@register("ins_market", """
with g as (select l_shipmode as g, sum(v) as s, avg(v) as m from (select l_linestatus as l_shipmode, l_extendedprice as v from lineitem) group by 1), q as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem),
y as (select year(l_shipdate) as y, avg(l_extendedprice) as m from lineitem group by 1)
select 'top_share' as kind, arg_max(g, s) as subject, round(max(s) / sum(s), 4) as value from g union all select 'mean_ratio', 'l_linestatus', round(max(m) / min(m), 4) from g
union all select 'outliers', 'l_extendedprice', (count(*) filter (l_extendedprice < a - 1.5 * (b - a) or l_extendedprice > b + 1.5 * (b - a)))::double from lineitem, q
union all select 'growth', 'l_extendedprice', round(arg_max(m, y) / arg_min(m, y) - 1, 4) from y
union all select 'correlation', 'l_extendedprice~l_quantity', round(corr(l_extendedprice, l_quantity), 4) as r from lineitem having abs(r) >= 0.3""")
def _(spark, d):
    return rounded(insights.market(load(spark, d, "lineitem"), "l_linestatus", ["l_extendedprice", "l_quantity", "l_tax"], "l_shipdate"))


@register("dsc_shares", """
with g as (select o_orderpriority as g, sum(o_totalprice) as s, avg(o_totalprice) as m from orders group by 1)
select arg_max(g, s) as top, round(max(s) / sum(s), 6) as top_share, round(max(m) / min(m), 6) as mean_ratio from g""")
def _(spark, d):
    return rounded(insights.shares(load(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 6)


# ---- filters, sorting, pages


@register("flt_category", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def _(spark, d):
    return filters.category_in(load(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey")


@register("flt_range", f"select l_orderkey, l_linenumber, count(*) as n from {GAPPY} where l_discount is null or l_discount between 0.02 and 0.05 group by all")
def _(spark, d):
    return filters.in_range(gappy(spark, d), "l_discount", 0.02, 0.05).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@register("flt_search", "select p_partkey from part where lower(p_name) like '%1%' or lower(p_brand) like '%1%'")
def _(spark, d):
    return filters.search(load(spark, d, "part"), "1", ["p_name", "p_brand"]).select("p_partkey")


@register("flt_like", "select p_partkey from part where p_type ilike '%e%'")
def _(spark, d):
    return filters.like_anyway(load(spark, d, "part"), "p_type", "%E%").select("p_partkey")


@register("flt_cross", "select event_id from events where user_id = 7")
def _(spark, d):
    return filters.cross_filter(load(spark, d, "events"), "user_id", "7").select("event_id")


@register("flt_outliers", """
with q as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem)
select count(*) as n, round(sum(l_extendedprice), 2) as s from lineitem, q where l_extendedprice between a - 1.5 * (b - a) and b + 1.5 * (b - a)""")
def _(spark, d):
    return rounded(filters.remove_outliers(load(spark, d, "lineitem"), "l_extendedprice").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s")), 2)


@register("flt_delete_rows", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def _(spark, d):
    return filters.delete_rows(load(spark, d, "customer"), "c_custkey", load(spark, d, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")).select("c_custkey")


@register("flt_complete", f"select count(*) as n from {GAPPY} where l_discount is not null and l_tax is not null")
def _(spark, d):
    return filters.complete_cases(gappy(spark, d), ["l_discount", "l_tax"]).agg(F.count(F.lit(1)).alias("n"))


@register("srt_page", "select c_custkey, c_acctbal from customer order by c_acctbal desc nulls last, c_custkey limit 50 offset 100")
def _(spark, d):
    return charts.sorted_page(load(spark, d, "customer"), "c_acctbal", "c_custkey", 2, 50, True).select("c_custkey", "c_acctbal")


#: Segments in capitals, small letters and Hangul by turns.
MIXED = "case c_custkey % 3 when 0 then c_mktsegment when 1 then lower(c_mktsegment) else '가나 ' || lower(c_mktsegment) end"


@register("srt_page_ko", f"select c_custkey, name from (select c_custkey, {MIXED} as name from customer) order by name collate ko desc nulls last, c_custkey limit 400 offset 400")
def _(spark, d):
    named = load(spark, d, "customer").select("c_custkey", F.expr(MIXED).alias("name"))
    return charts.sorted_page(named, "name", "c_custkey", 1, 400, True, locale="ko")


@register("pvt_tuples_ko", f"select name, c_nationkey, row_number() over (order by name collate ko, name, c_nationkey collate ko)::int as place from (select distinct {MIXED} as name, c_nationkey::varchar as c_nationkey from customer)")
def _(spark, d):
    return tuples(load(spark, d, "customer").select(F.expr(MIXED).alias("name"), "c_nationkey"), ["name", "c_nationkey"], "ko")


# ---- windows


@register("win_rank", "select c_custkey, row_number() over (order by c_acctbal nulls first, c_custkey)::int as rank from customer")
def _(spark, d):
    return windows.ordinal_rank(load(spark, d, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "rank")


@register("win_moving_average", f"select day, round(case when count(value) over w = 5 then avg(value) over w end, 4) as ma from {DAYS} window w as (order by day rows 4 preceding)")
def _(spark, d):
    return rounded(windows.moving_average(days(spark, d), "value", ["day"], 5).select("day", "ma"))


@register("win_weighted_average", f"select day, round((lag(value, 2) over w * 1 + lag(value, 1) over w * 2 + value * 3) / 6, 4) as wma from {DAYS} window w as (order by day)")
def _(spark, d):
    return rounded(windows.weighted_average(days(spark, d), "value", ["day"], [1, 2, 3]).select("day", "wma"))


@register("win_difference", f"select day, round(value - lag(value, 7) over (order by day), 4) as diff from {DAYS}")
def _(spark, d):
    return rounded(windows.difference(days(spark, d), "value", ["day"], 7).select("day", "diff"))


@register("win_rolling_std", f"select day, round(case when count(value) over w = 5 then stddev_samp(value) over w end, 2) as rstd from {DAYS} window w as (order by day rows 4 preceding)")
def _(spark, d):
    return rounded(windows.rolling_std(days(spark, d), "value", ["day"], 5).select("day", "rstd"), 2)


@register("win_centered_average", f"select day, round(case when count(value) over w = 13 then (sum(value) over w - (lag(value, 6) over o + lead(value, 6) over o) / 2) / 12 end, 4) as trend from {DAYS} window w as (order by day rows between 6 preceding and 6 following), o as (order by day)")
def _(spark, d):
    return rounded(windows.centered_average(days(spark, d), "value", ["day"], 12).select("day", "trend"))


@register("win_running_total", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows unbounded preceding), 2) as running from orders")
def _(spark, d):
    return rounded(windows.running_total(load(spark, d, "orders"), "o_totalprice", ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "running"), 2)


@register("win_first_ratio", "select o_orderkey, floor((o_totalprice / first_value(o_totalprice) over (partition by o_custkey order by o_orderkey) - 1) * 10000 + 0.5) / 100 as cum_return from orders")
def _(spark, d):
    return windows.first_ratio(load(spark, d, "orders"), "o_totalprice", ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "cum_return")


@register("win_moving_range", "select event_id, round(abs(value - lag(value) over (partition by user_id order by event_id)), 6) as mr from events where value is not null")
def _(spark, d):
    return rounded(windows.moving_range(load(spark, d, "events"), "value", ["event_id"], ["user_id"]).select("event_id", "mr"), 6)


@register("win_spearman", """
with r as (select row_number() over (order by c_acctbal, c_custkey) as a, row_number() over (order by c_nationkey, c_custkey) as b from customer) select round(corr(a, b), 8) as rho, count(*) as n from r""")
def _(spark, d):
    return rounded(windows.spearman(load(spark, d, "customer"), "c_acctbal", "c_nationkey", "c_custkey"), 8)


@register("jn_as_of", """
with r as (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by all)
select e.event_id, r.event_id as last_purchase from events e asof left join r on e.user_id = r.user_id and e.ts >= r.ts""")
def _(spark, d):
    e = load(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return windows.as_of_join(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


@register("jn_as_of_one_key", """
with r as (select ts, max(event_id) as event_id from events where event_type = 'purchase' group by 1)
select e.event_id, r.event_id as last_purchase from events e asof left join r on e.ts >= r.ts""")
def _(spark, d):
    """All rows of both sides have one key: no task holds it whole, and ties go to the greatest value."""
    e = load(spark, d, "events").withColumn("key", F.lit(1))
    bought = e.where("event_type = 'purchase'").select("key", "ts", F.col("event_id").alias("last_purchase"))
    return windows.as_of_join(e.select("event_id", "key", "ts"), bought, ["key"], "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


# ---- set operations and joins


@register("set_union", """
select c_custkey as id, c_acctbal as balance, nullif(trim(c_mktsegment), '') as segment, 'customer' as __source from customer
union all select s_suppkey, s_acctbal, null, 'supplier' from supplier""")
def _(spark, d):
    c = load(spark, d, "customer").selectExpr("c_custkey as id", "c_acctbal as balance", "c_mktsegment as segment")
    return combine.union([("customer", c), ("supplier", load(spark, d, "supplier").selectExpr("s_suppkey as id", "s_acctbal as balance"))])


@register("set_source_counts", "select 'c' as __source, count(*) as n from customer union all select 's', count(*) from supplier")
def _(spark, d):
    return combine.source_counts(combine.union([("c", load(spark, d, "customer")), ("s", load(spark, d, "supplier"))]))


@register("set_duplicates", "select count(*) as n from (select distinct l_orderkey, l_linenumber from lineitem)")
def _(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().agg(F.count(F.lit(1)).alias("n"))


_NAMES = {"inner": "inner join", "left": "left join", "right": "right join", "full": "full join"}


def _join(how: str) -> None:
    @register(f"jn_{how}", f"""
with o as (select o_orderkey, o_custkey from orders where o_totalprice > 200000), c as (select c_custkey, c_name, c_nationkey as o_orderkey from customer where c_acctbal > 0)
select o.o_orderkey, {'coalesce(o_custkey, c_custkey)' if how in ('right', 'full') else 'o_custkey'} as o_custkey, c_name, c.o_orderkey as c__o_orderkey from o {_NAMES[how]} c on o_custkey = c_custkey""")
    def _(spark, d):
        o = load(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey")
        c = load(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", F.col("c_nationkey").alias("o_orderkey"))
        return combine.join(o, c, [("o_custkey", "c_custkey")], how, "c")


for _how in _NAMES:
    _join(_how)


@register("jn_text_key", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def _(spark, d):
    c = load(spark, d, "customer").select(F.concat(F.lit(" 0"), F.col("c_custkey").cast("string")).alias("k"), "c_name")
    return combine.join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), c, [("o_custkey", "k")]).select("o_orderkey", "c_name")


@register("jn_time_key", """
with e as (select event_id, ts, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') as k from events)
select a.event_id as event_id, b.event_id as other, a.event_type as event_type from events a join e b on strftime(date_trunc('millisecond', a.ts), '%Y-%m-%d %H:%M:%S.%g') = b.k""")
def _(spark, d):
    """Times against texts of times: equal to the millisecond, not to the second."""
    e = load(spark, d, "events")
    texts = e.select(F.col("event_id").alias("other"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("k"))
    return combine.join(e.select("event_id", "ts", "event_type"), texts, [("ts", "k")]).select("event_id", "other", "event_type")


@register("jn_big_key", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def _(spark, d):
    """Whole numbers beyond 2^53 against texts: digit by digit, so neighbours don't meet."""
    big = lambda c: F.col(c) + F.lit(9007199254740992)
    c = load(spark, d, "customer").select(F.concat(F.lit("+0"), big("c_custkey").cast("string")).alias("k"), "c_name")
    return combine.join(load(spark, d, "orders").select("o_orderkey", big("o_custkey").alias("big")), c, [("big", "k")]).select("o_orderkey", "c_name")


@register("jn_interval", "select s_suppkey, c_custkey from supplier join customer on c_acctbal between s_acctbal - s_nationkey and s_acctbal + s_nationkey")
def _(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") - F.col("s_nationkey")).alias("lo"), (F.col("s_acctbal") + F.col("s_nationkey")).alias("hi"))
    c = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("at"))
    return combine.interval_join(s, c, ("lo", "hi"), ("at", "at")).select("s_suppkey", "c_custkey")


@register("jn_diagnostics", """
with o as (select o_custkey as k, count(*) as nl from orders group by 1), c as (select c_custkey as k, count(*) as nr from customer where c_acctbal > 0 group by 1), m as (select coalesce(nl, 0) as nl, coalesce(nr, 0) as nr from o full join c using (k))
select sum(nl * nr)::bigint as inner_rows, coalesce(sum(nl) filter (nr = 0), 0)::bigint as left_unmatched, coalesce(sum(nr) filter (nl = 0), 0)::bigint as right_unmatched, bool_or(nl > 1 and nr > 1) as many_to_many from m""")
def _(spark, d):
    return combine.diagnostics(load(spark, d, "orders"), load(spark, d, "customer").where("c_acctbal > 0"), [("o_custkey", "c_custkey")])


# ---- pivots


@register("pvt_totals", """
select o_orderstatus, o_orderpriority, case grouping(o_orderstatus, o_orderpriority) when 0 then 'cell' when 1 then 'row' when 2 then 'column' else 'grand' end as level,
  round(sum(o_totalprice), 4) as o_totalprice__sum, round(median(o_totalprice), 4) as o_totalprice__median, count(distinct o_custkey) as o_custkey__countd
from orders group by cube (o_orderstatus, o_orderpriority)""")
def _(spark, d):
    spec = PivotSpec(("o_orderstatus",), ("o_orderpriority",), (("o_totalprice", "sum"), ("o_totalprice", "median"), ("o_custkey", "countd")))
    return rounded(long_form(load(spark, d, "orders"), spec))


@register("pvt_wide", """
select l_returnflag, round(coalesce(sum(l_quantity) filter (l_linestatus = 'F'), 0), 2) as "F¦l_quantity__sum", round(coalesce(sum(l_quantity) filter (l_linestatus = 'O'), 0), 2) as "O¦l_quantity__sum", round(sum(l_quantity), 2) as total__l_quantity__sum
from lineitem group by grouping sets ((l_returnflag), ())""")
def _(spark, d):
    return rounded(wide(load(spark, d, "lineitem"), PivotSpec(("l_returnflag",), ("l_linestatus",), (("l_quantity", "sum"),))), 2)


@register("pvt_rows_only", "select c_mktsegment, round(avg(c_acctbal), 4) as total__c_acctbal__avg from customer group by grouping sets ((c_mktsegment), ())")
def _(spark, d):
    return rounded(wide(load(spark, d, "customer"), PivotSpec(("c_mktsegment",), (), (("c_acctbal", "avg"),))))


# ---- cleaning


def cleaned(spark: SparkSession, d: str, *steps: Step) -> DataFrame:
    """events with missing values (values under 10) through a pipeline."""
    df = load(spark, d, "events").select("event_id", "user_id", "event_type", F.when(F.col("value") >= 10, F.col("value")).alias("value"))
    p = Pipeline()
    for s in steps:
        p = p.add(s)
    return p.apply(df, "event_id")


EV = "(select event_id, user_id, event_type, case when value >= 10 then value end as value from events)"


@register("cln_fill_mean", f"select event_id, coalesce(value, (select floor(avg(value) * 10 + 0.5) / 10 from {EV})) as value from {EV}")
def _(spark, d):
    return cleaned(spark, d, Step("fill_mean", "value")).select("event_id", "value")


@register("cln_fill_median", f"select event_id, coalesce(value, (select median(value) from {EV})) as value from {EV}")
def _(spark, d):
    return cleaned(spark, d, Step("fill_median", "value")).select("event_id", "value")


@register("cln_fill_mode", f"with m as (select value as mode, count(*) as n, max(event_id) as reached from {EV} where value is not null group by 1 order by n desc, reached limit 1) select event_id, coalesce(value, mode) as value from {EV}, m")
def _(spark, d):
    return cleaned(spark, d, Step("fill_mode", "value")).select("event_id", "value")


@register("cln_drop_missing", f"select event_id from {EV} where value is not null")
def _(spark, d):
    return cleaned(spark, d, Step("drop_missing", "value")).select("event_id")


@register("cln_drop_duplicates", f"select min(event_id) as event_id, user_id, event_type from {EV} group by user_id, event_type")
def _(spark, d):
    return cleaned(spark, d, Step("drop_col", "value"), Step("drop_duplicates"))


@register("cln_standardize", f"select event_id, floor((value - m) / s * 10000 + 0.5) / 10000 as value from {EV}, (select avg(value) as m, stddev_samp(value) as s from {EV})")
def _(spark, d):
    return cleaned(spark, d, Step("standardize", "value")).select("event_id", "value")


@register("cln_normalize", f"select event_id, floor((value - lo) / (hi - lo) * 10000 + 0.5) / 10000 as value from {EV}, (select min(value) as lo, max(value) as hi from {EV})")
def _(spark, d):
    return cleaned(spark, d, Step("normalize", "value")).select("event_id", "value")


@register("cln_log", f"select event_id, floor(ln(1 + value) * 10000 + 0.5) / 10000 as value from {EV}")
def _(spark, d):
    return cleaned(spark, d, Step("log_transform", "value")).select("event_id", "value")


@register("cln_rank", f"select event_id, row_number() over (order by value nulls first, event_id)::int as value from {EV}")
def _(spark, d):
    return cleaned(spark, d, Step("rank_transform", "value")).select("event_id", "value")


@register("cln_winsorize", f"select event_id, case when value is not null then greatest(least(value, b), a) end as value from {EV}, (select quantile_cont(value, 0.05) as a, quantile_cont(value, 0.95) as b from {EV})")
def _(spark, d):
    return rounded(cleaned(spark, d, Step("winsorize", "value")).select("event_id", "value"), 9)


@register("cln_label_encode", "select event_id, (dense_rank() over (order by event_type) - 1)::int as event_type_enc from events")
def _(spark, d):
    return cleaned(spark, d, Step("label_encode", "event_type")).select("event_id", "event_type_enc")


@register("cln_dummy_encode", "select event_id, (event_type = 'purchase')::int as event_type_purchase from events")
def _(spark, d):
    return cleaned(spark, d, Step("dummy_encode", "event_type")).select("event_id", "event_type_purchase")


@register("cln_replace", "select event_id, case when event_type = 'purchase' then 'buy' else event_type end as event_type from events")
def _(spark, d):
    return cleaned(spark, d, Step("replace", "event_type", {"from": "purchase", "to": "buy"})).select("event_id", "event_type")


@register("cln_binning", """
with e as (select min(l_quantity) as lo, (max(l_quantity) - min(l_quantity)) / 7 as w from lineitem), b as (select least(floor((l_quantity - lo) / w), 6) as k, lo, w from lineitem, e)
select '[' || (floor((lo + w * k) * 100 + 0.5) / 100)::varchar.regexp_replace('\\.0$', '') || ', ' || (floor((lo + w * (k + 1)) * 100 + 0.5) / 100)::varchar.regexp_replace('\\.0$', '') || ')' as bin, count(*) as n from b group by 1""")
def _(spark, d):
    df = Pipeline().add(Step("binning", "l_quantity", {"n": 7, "new": "bin"})).apply(load(spark, d, "lineitem"), "l_orderkey")
    return df.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@register("cln_undo_redo", f"select event_id as id from {EV} where value is not null")
def _(spark, d):
    df = load(spark, d, "events").select("event_id", F.when(F.col("value") >= 10, F.col("value")).alias("value"))
    p = Pipeline().add(Step("drop_missing", "value")).add(Step("rename", "event_id", {"to": "id"})).add(Step("drop_col", "value")).undo().undo().redo().add(Step("drop_col", "value"))
    return p.apply(df, "id").select("id")


#: Two edits for every seventh event, of which the later one counts, and a null for every third of these.
@register("cln_overlay", """
select event_id, case when event_id % 7 = 0 then case when event_id % 3 = 0 then null else user_id + 0.5 end else value end as value, case when event_id % 7 = 0 then 'edited ' || user_id else event_type end as event_type from events""")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    some = e.where("event_id % 7 = 0").select(F.col("event_id").cast("string").alias("key"), "event_id", "user_id")
    cells = [F.struct(F.lit("value").alias("column"), F.lit("1").alias("value"), F.lit(1).alias("at")), F.struct(F.lit("value").alias("column"), F.when(F.col("event_id") % 3 != 0, (F.col("user_id") + 0.5).cast("string")).alias("value"), F.lit(2).alias("at")), F.struct(F.lit("event_type").alias("column"), F.concat(F.lit("edited "), "user_id").alias("value"), F.lit(1).alias("at")), F.struct(F.lit("nope").alias("column"), F.lit("x").alias("value"), F.lit(1).alias("at"))]
    return edited(e, some.select("key", F.inline(F.array(*cells))), "event_id").drop("user_id")


@register("cln_edit", "select event_id, case when event_id = 3 then 99.5 else value end as value from events where event_id not in (1, 2) union all select -1, null")
def _(spark, d):
    df = load(spark, d, "events").select("event_id", "value")
    p = Pipeline().add(Step("set_cell", "value", {"key": 3, "value": "99.5"})).add(Step("drop_rows", None, {"keys": [1, 2]})).add(Step("add_row", None, {"row": {"event_id": -1}}))
    return p.apply(df, "event_id")


@register("cln_issues", f"select count(*) as n_rows, count(*) filter (value is null) as missing_cells, 0::bigint as duplicate_rows, count(*) filter (value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)) as outliers_value from {EV}, (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from {EV})")
def _(spark, d):
    return issues(cleaned(spark, d), ["value"])


@register("cln_joint_outliers", """
with m as (select avg(value) as a, avg(user_id) as b, var_samp(value) as aa, var_samp(user_id) as bb, covar_samp(value, user_id) as ab from events)
select event_id from events, m where (power(value - a, 2) * bb - 2 * (value - a) * (user_id - b) * ab + power(user_id - b, 2) * aa) / (aa * bb - ab * ab) <= 2 * power(1 - 2 / 18.0 + 1.959963984540054 * sqrt(2 / 18.0), 3)""")
def _(spark, d):
    e = load(spark, d, "events")
    far, _why = joint_outliers(e, ["value", "user_id"])
    return filters.delete_rows(e, "event_id", far).select("event_id")


# ---- formulas


@register("fml_arithmetic", "select l_orderkey, l_linenumber, count(*) as n, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) as charge from lineitem group by all")
def _(spark, d):
    df = load(spark, d, "lineitem")
    made = df.withColumn("x", compile_formula("row.l_extendedprice * (1 - row.l_discount) * (1 + row['l_tax'])", df.schema))
    return rounded(made.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("charge")), 6)


@register("fml_logic", "select c_custkey, case when c_acctbal > 5000 and c_mktsegment <> 'BUILDING' then 'rich' else c_mktsegment || '!' end as x from customer")
def _(spark, d):
    df = load(spark, d, "customer")
    return df.select("c_custkey", compile_formula("row.c_acctbal > 5000 && row.c_mktsegment !== 'BUILDING' ? 'rich' : row.c_mktsegment + '!'", df.schema).alias("x"))


@register("fml_math", "select p_partkey, round(sqrt(p_retailprice) + ln(p_size) + floor(p_retailprice / 7) - power(p_size, 2) % 5, 6) as x from part")
def _(spark, d):
    df = load(spark, d, "part")
    return rounded(df.select("p_partkey", compile_formula("Math.sqrt(row.p_retailprice) + Math.log(row.p_size) + Math.floor(row.p_retailprice / 7) - row.p_size ** 2 % 5", df.schema).alias("x")), 6)


@register("fml_division", "select n_nationkey, case when n_regionkey = 0 then case when n_nationkey = 0 then 'nan' else 'inf' end else 'number' end as x from nation")
def _(spark, d):
    df = load(spark, d, "nation")
    x = compile_formula("row.n_nationkey / row.n_regionkey", df.schema)
    return df.select("n_nationkey", F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").otherwise("number").alias("x"))


# ---- tests and regression


@register("tst_group_moments", 'select o_orderstatus as "group", count(*) as n, round(avg(o_totalprice), 4) as mean, round(var_samp(o_totalprice), 2) as var from orders group by 1')
def _(spark, d):
    return stats.group_moments(load(spark, d, "orders"), "o_totalprice", "o_orderstatus").select("group", "n", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))


@register("tst_welch", """
with g as (select o_orderstatus as g, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1), a as (select * from g where g = 'F'), b as (select * from g where g = 'O')
select round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) as t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 4) as df from a, b""")
def _(spark, d):
    r = stats.welch(load(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return rounded(spark.createDataFrame([(round(r["t"], 6), round(r["df"], 4))], "t double, df double"), 6)


@register("tst_anova", """
with g as (select c_mktsegment, count(*) as n, avg(c_acctbal) as m, var_samp(c_acctbal) as v from customer group by 1), t as (select avg(c_acctbal) as gm from customer), s as (select count(*) as groups, sum(n)::bigint as n, sum(n * power(m - gm, 2)) as ssb, sum((n - 1) * v) as ssw from g, t)
select groups, n, round(ssb, 2) as ssb, round(ssw, 2) as ssw, round((ssb / (groups - 1)) / (ssw / (n - groups)), 6) as f, round(ssb / (ssb + ssw), 8) as eta2 from s""")
def _(spark, d):
    r = stats.anova_table(load(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return r.select("groups", "n", F.round("ssb", 2).alias("ssb"), F.round("ssw", 2).alias("ssw"), F.round("f", 6).alias("f"), F.round("eta2", 8).alias("eta2"))


@register("tst_chi_square", """
with c as (select o_orderstatus as a, o_orderpriority as b, count(*) as o from orders group by all), m as (select a, b, o, sum(o) over (partition by a) * sum(o) over (partition by b) / sum(o) over () as e from c)
select sum(o)::bigint as n, round(sum((o - e) * (o - e) / e), 6) as chi2, (count(distinct a) - 1) * (count(distinct b) - 1) as df, round(sqrt(sum((o - e) * (o - e) / e) / (sum(o) * (least(count(distinct a), count(distinct b)) - 1))), 8) as v from m""")
def _(spark, d):
    r = stats.chi_square_table(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return r.select("n", F.round("chi2", 6).alias("chi2"), "df", F.round("v", 8).alias("v"))


@register("tst_ols", "select round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_r2(l_extendedprice, l_quantity), 8) as r2, count(*) as n from lineitem")
def _(spark, d):
    m = stats.ols(load(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(m["coef"][0], 4), round(m["coef"][1], 6), round(float(m["r2"]), 8), m["n"])], "intercept double, slope double, r2 double, n long")


_TWO = """with m as (select count(*) as n, avg(l_quantity) as m1, avg(l_discount) as m2, avg(l_extendedprice) as my, var_pop(l_quantity) * count(*) as s11, var_pop(l_discount) * count(*) as s22, covar_pop(l_quantity, l_discount) * count(*) as s12,
  covar_pop(l_quantity, l_extendedprice) * count(*) as s1y, covar_pop(l_discount, l_extendedprice) * count(*) as s2y, var_pop(l_extendedprice) * count(*) as syy from lineitem),
b as (select *, s11 * s22 - s12 * s12 as det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from m),
e as (select *, my - b1 * m1 - b2 * m2 as b0, syy - b1 * s1y - b2 * s2y as sse, (syy - b1 * s1y - b2 * s2y) / (n - 3) as s2 from b),
f as (select *, sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) as e0, sqrt(s2 * s22 / det) as e1, sqrt(s2 * s11 / det) as e2 from e)
"""


@register("tst_ols_two", _TWO + """
select name, round(coef, 4) as coef, round(se, 4) as se, round(coef / se, 4) as t, round(1 - sse / syy, 8) as r2, round(1 - sse / syy * (n - 1) / (n - 3), 8) as adj_r2, round((syy - sse) / 2 / s2, 4) as f, n
from f, lateral (select unnest(['intercept', 'l_quantity', 'l_discount']) as name, unnest([b0, b1, b2]) as coef, unnest([e0, e1, e2]) as se)""")
def _(spark, d):
    m = stats.ols(load(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    rows = [(name, round(c, 4), round(se, 4), round(t, 4), round(float(m["r2"]), 8), round(float(m["adj_r2"]), 8), round(float(m["f"]), 4), m["n"]) for name, c, se, t in zip(m["names"], m["coef"], m["se"], m["t"])]
    return spark.createDataFrame(rows, "name string, coef double, se double, t double, r2 double, adj_r2 double, f double, n long")


@register("ml_importance", _TWO + """
select input, round(coef, 4) as coef, round(abs(coef * sqrt(s / syy)), 8) as importance from f, lateral (select unnest(['l_quantity', 'l_discount']) as input, unnest([b1, b2]) as coef, unnest([s11, s22]) as s)""")
def _(spark, d):
    df = load(spark, d, "lineitem")
    r = learn.importance(df, stats.ols(df, "l_extendedprice", ["l_quantity", "l_discount"]))
    return r.select("input", F.round("coef", 4).alias("coef"), F.round("importance", 8).alias("importance"))


@register("ml_residuals", _TWO + """
select l_linenumber, count(*) as n, round(avg(abs(l_extendedprice - b0 - b1 * l_quantity - b2 * l_discount)), 4) as size, round(max(l_extendedprice - b0 - b1 * l_quantity - b2 * l_discount), 4) as most from lineitem, f group by 1""")
def _(spark, d):
    df = load(spark, d, "lineitem")
    model = stats.ols(df, "l_extendedprice", ["l_quantity", "l_discount"])
    r = learn.residuals(df.select("*", learn.linear_predict(model)), "l_extendedprice")
    return rounded(r.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("residual")).alias("size"), F.max("residual").alias("most")))


# ---- distributions and outliers


@register("dst_jarque_bera", """
with m as (select avg(o_totalprice) as m, count(*) as n from orders), c as (select n, avg(power(o_totalprice - m, 2)) as m2, avg(power(o_totalprice - m, 3)) as m3, avg(power(o_totalprice - m, 4)) as m4 from orders, m group by n), j as (select n, n / 6 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4) as jb from c)
select n, round(jb, 4) as jb, round(exp(-jb / 2), 8) as p from j""")
def _(spark, d):
    r = distributions.jarque_bera(load(spark, d, "orders"), "o_totalprice")
    return r.select("n", F.round("jb", 4).alias("jb"), F.round("p", 8).alias("p"))


@register("dst_fits", """
with s as (select count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as s2, var_pop(o_totalprice) as p2, avg(ln(o_totalprice)) as lm, var_samp(ln(o_totalprice)) as ls2, var_pop(ln(o_totalprice)) as lp2 from orders)
select 'normal' as dist, round(4 - 2 * (-n / 2 * (ln(2 * pi()) + ln(s2)) - n * p2 / (2 * s2)), 2) as aic from s
union all select 'exponential', round(2 - 2 * (-n * ln(m) - n), 2) from s
union all select 'lognormal', round(4 - 2 * (-n / 2 * (ln(2 * pi()) + ln(ls2)) - n * lp2 / (2 * ls2) - n * lm), 2) from s""")
def _(spark, d):
    return rounded(distributions.fits(load(spark, d, "orders"), "o_totalprice"), 2)


def _poly(coefficients, x: str) -> str:
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * {x} + ({c})"
    return f"({out})"


_TAIL_OF = lambda p: f"{_poly(distributions.TAIL, f'sqrt(-2 * ln({p}))')} / {_poly(distributions.TAIL_BY, f'sqrt(-2 * ln({p}))')}"


@register("dst_qq", f"""
with f as (select count(*) as n, avg(c_acctbal) as m, stddev_samp(c_acctbal) as s from customer), p as (select row_number() over (order by c_acctbal) as i, c_acctbal as x from customer), q as (select i, x, m, s, (i - 0.5) / n as p, (i - 0.5) / n - 0.5 as d from p, f)
select i, round(case when p < 0.02425 then {_TAIL_OF('p')} when p > 1 - 0.02425 then -({_TAIL_OF('(1 - p)')}) else {_poly(distributions.CENTRE, '(d * d)')} * d / {_poly(distributions.CENTRE_BY, '(d * d)')} end, 6) as theoretical, round(x, 6) as sample, round(s, 6) as slope, round(m, 6) as intercept from q""")
def _(spark, d):
    return rounded(distributions.qq(load(spark, d, "customer"), "c_acctbal"), 6)


@register("dst_density", """
with f as (select avg(c_acctbal) as m, stddev_samp(c_acctbal) as s, min(c_acctbal) as lo, max(c_acctbal) as hi from customer)
select k::int as k, round(lo + (hi - lo) * k / 60, 4) as x, round(exp(-power((lo + (hi - lo) * k / 60 - m) / s, 2) / 2) / (s * sqrt(2 * pi())), 10) as density from f, range(61) r(k)""")
def _(spark, d):
    r = distributions.normal_density(load(spark, d, "customer"), "c_acctbal")
    return r.select("k", F.round("x", 4).alias("x"), F.round("density", 10).alias("density"))


@register("dst_pp", """
with f as (select avg(c_acctbal) as m, stddev_samp(c_acctbal) as s, count(*) as n from customer),
z as (select row_number() over (order by c_acctbal)::int as i, n, (c_acctbal - m) / s as z from customer, f),
t as (select *, abs(z) / sqrt(2) as a, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) as t from z)
select i, round((i - 0.5) / n, 9) as share, round(0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-a * a))), 9) as theoretical from t""")
def _(spark, d):
    return rounded(distributions.pp(load(spark, d, "customer"), "c_acctbal"), 9)


@register("out_mahalanobis", """
with m as (select avg(l_quantity) as a, avg(l_extendedprice) as b, var_samp(l_quantity) as aa, var_samp(l_extendedprice) as bb, covar_samp(l_quantity, l_extendedprice) as ab from lineitem),
x as (select (power(l_quantity - a, 2) * bb - 2 * (l_quantity - a) * (l_extendedprice - b) * ab + power(l_extendedprice - b, 2) * aa) / (aa * bb - ab * ab) as d2 from lineitem, m)
select count(*) filter (d2 > 2 * power(1 - 2 / 18.0 + 1.959963984540054 * sqrt(2 / 18.0), 3)) as outliers, round(sum(d2), 4) as total from x""")
def _(spark, d):
    r = distributions.mahalanobis(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(r.agg(F.count_if("outlier").alias("outliers"), F.sum("d2").alias("total")))


# ---- series


@register("tsr_exponential", f"""
with recursive s as (select day, value, row_number() over (order by day) as k from {DAYS}), e as (select k, day, value as smooth from s where k = 1 union all select s.k, s.day, 0.3 * s.value + 0.7 * e.smooth from e join s on s.k = e.k + 1)
select day, round(smooth, 4) as smooth from e""")
def _(spark, d):
    return rounded(series.exponential(days(spark, d), "value", "day").select("day", "smooth"))


@register("tsr_holt", f"""
with recursive s as (select day, value, row_number() over (order by day) as k from {DAYS}), e as (
  select k, day, value, value as level, null::double as trend, value as fitted from s where k = 1
  union all
  select k, day, value, 0.3 * value + 0.7 * f as level, 0.1 * (0.3 * value + 0.7 * f - before) + 0.9 * t as trend, f as fitted from (
    select s.k, s.day, s.value, e.level as before, coalesce(e.trend, s.value - e.level) as t, e.level + coalesce(e.trend, s.value - e.level) as f from e join s on s.k = e.k + 1))
select day, round(value, 4) as value, round(level, 4) as level, round(trend, 4) as trend, round(fitted, 4) as fitted from e""")
def _(spark, d):
    return rounded(series.holt(days(spark, d), "value", "day"))


@register("tsr_acf", f"""
with s as (select row_number() over (order by day) as k, value - avg(value) over () as x from {DAYS}), z as (select sum(x * x) as z from s)
select l.lag::int as lag, round(sum(a.x * b.x) / any_value(z), 8) as r from range(21) l(lag), s a, s b, z where a.k = b.k + l.lag group by l.lag""")
def _(spark, d):
    return rounded(series.acf(days(spark, d), "value", "day"), 8)


@register("tsr_decompose", f"""
with s as (select day, value, (row_number() over (order by day) - 1) % 7 as k, case when count(value) over w = 7 then avg(value) over w end as trend from {DAYS} window w as (order by day rows between 3 preceding and 3 following)),
i as (select k, avg(value - trend) as raw from s group by k), j as (select k, raw - avg(raw) over () as seasonal from i)
select day, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(value - trend - seasonal, 4) as residual from s join j using (k)""")
def _(spark, d):
    return rounded(series.decompose(days(spark, d), "value", "day", 7).select("day", "trend", "seasonal", "residual"))


# ---- process control


@register("spc_individuals", f"""
with m as (select value, abs(value - lag(value) over (order by day)) as mr from {DAYS}), a as (select avg(value) as c, avg(mr) as r from m)
select round(c, 4) as center, round(r / 1.128, 4) as sigma, round(c + 3 * r / 1.128, 4) as ucl, round(c - 3 * r / 1.128, 4) as lcl, round(r, 4) as mr_bar, round(r * 3.267, 4) as mr_ucl from a""")
def _(spark, d):
    return rounded(control.individuals(days(spark, d), "value", "day"))


SUB = "(select o_orderkey // 5 as g, o_totalprice as v from orders where o_orderkey // 5 in (select o_orderkey // 5 from orders group by 1 having count(*) = 5))"


def _subgroups(spark: SparkSession, d: str) -> DataFrame:
    """Orders in full groups of five neighbouring keys."""
    o = load(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 5).alias("g"), F.col("o_totalprice").alias("v"))
    return o.join(o.groupBy("g").count().where("count = 5").select("g"), "g")


@register("spc_xbar_r", f"""
with g as (select avg(v) as m, max(v) - min(v) as r from {SUB} group by g), a as (select avg(m) as c, avg(r) as r from g)
select round(c, 4) as center, round(c + 0.577 * r, 4) as ucl, round(c - 0.577 * r, 4) as lcl, round(r, 4) as r_bar, round(r * 2.114, 4) as r_ucl, round(r * 0, 4) as r_lcl from a""")
def _(spark, d):
    return rounded(control.xbar_r(_subgroups(spark, d), "v", "g"))


@register("spc_xbar_s", f"""
with g as (select avg(v) as m, stddev_samp(v) as s from {SUB} group by g), a as (select avg(m) as c, avg(s) as s from g)
select round(c, 4) as center, round(c + 1.427 * s, 4) as ucl, round(c - 1.427 * s, 4) as lcl, round(s, 4) as s_bar, round(s * 2.089, 4) as s_ucl, round(s * 0, 4) as s_lcl from a""")
def _(spark, d):
    return rounded(control.xbar_s(_subgroups(spark, d), "v", "g"))


DEF = "(select strftime(o_orderdate, '%Y-%m') as month, count(*) filter (o_orderstatus = 'F') as bad, count(*) as n from orders group by 1)"


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("bad"), F.count(F.lit(1)).alias("n"))


@register("spc_p_chart", f"select month, round(bad / n, 8) as p, round(least(1, b + 3 * sqrt(b * (1 - b) / n)), 8) as ucl, round(greatest(0, b - 3 * sqrt(b * (1 - b) / n)), 8) as lcl from {DEF}, (select sum(bad) / sum(n) as b from {DEF})")
def _(spark, d):
    return rounded(control.p_chart(_defects(spark, d), "bad", "n").select("month", "p", "ucl", "lcl"), 8)


@register("spc_c_chart", f"select round(avg(bad), 6) as center, round(avg(bad) + 3 * sqrt(avg(bad)), 6) as ucl, round(greatest(0, avg(bad) - 3 * sqrt(avg(bad))), 6) as lcl from {DEF}")
def _(spark, d):
    return rounded(control.c_chart(_defects(spark, d), "bad"), 6)


@register("spc_u_chart", f"select month, round(bad / n, 8) as u, round(b + 3 * sqrt(b / n), 8) as ucl, round(greatest(0, b - 3 * sqrt(b / n)), 8) as lcl from {DEF}, (select sum(bad) / sum(n) as b from {DEF})")
def _(spark, d):
    return rounded(control.u_chart(_defects(spark, d), "bad", "n").select("month", "u", "ucl", "lcl"), 8)


@register("spc_capability", f"""
with m as (select value as v, abs(value - lag(value) over (order by day)) as mr from {DAYS}), a as (select avg(v) as m, avg(mr) / 1.128 as w, stddev_samp(v) as o from m)
select round(m, 4) as mean, round(w, 4) as within, round(o, 4) as overall, round(1000000 / (6 * w), 6) as cp, round(least((1000000 - m) / (3 * w), m / (3 * w)), 6) as cpk, round(1000000 / (6 * o), 6) as pp, round(least((1000000 - m) / (3 * o), m / (3 * o)), 6) as ppk from a""")
def _(spark, d):
    r = control.capability(days(spark, d), "value", "day", 0.0, 1000000.0)
    return r.select(*[F.round(c, 4 if c in ("mean", "within", "overall") else 6).alias(c) for c in r.columns])


@register("spc_pareto", """
with s as (select o_orderpriority, sum(o_totalprice) as v from orders group by 1)
select o_orderpriority, round(v, 2) as value, round(v / sum(v) over () * 100, 2) as pct, round(sum(v) over (order by v desc, o_orderpriority rows unbounded preceding) / sum(v) over () * 100, 2) as cum_pct from s""")
def _(spark, d):
    return rounded(control.pareto(load(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 2)


@register("spc_violations", f"select day, (k - 1)::int as index from (select day, value, row_number() over (order by day) as k from {DAYS}) where value > 1000000 or value < 100000")
def _(spark, d):
    return control.violations(days(spark, d), "value", "day", 1000000.0, 100000.0).select("day", "index")


# ---- models


@register("ml_linear")
def _(spark, d):
    m, got = learn.linear_regression(load(spark, d, "part"), "p_retailprice", ["p_size"], "p_partkey")
    return rounded(got)


@register("ml_neighbours")
def _(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return learn.nearest_neighbours(e, "label", [f"e{i}" for i in range(64)], "vec_id")


@register("ml_naive_bayes", """
with g as (select o_orderstatus as class, count(*) as n, avg(o_totalprice) as m, greatest(var_samp(o_totalprice), 1e-9) as v from orders group by 1), t as (select *, n / sum(n) over () as prior from g)
select class, n, round(m, 4) as m_o_totalprice, round(v, 2) as v_o_totalprice, round(prior, 8) as prior from t""")
def _(spark, d):
    m = learn.naive_bayes_model(load(spark, d, "orders"), "o_orderstatus", ["o_totalprice"])
    return m.select("class", "n", F.round("m_o_totalprice", 4).alias("m_o_totalprice"), F.round("v_o_totalprice", 2).alias("v_o_totalprice"), F.round("prior", 8).alias("prior"))


@register("ml_naive_bayes_predict", """
with g as (select c_mktsegment as class, count(*) as n, avg(c_acctbal) as m, greatest(var_samp(c_acctbal), 1e-9) as v from customer group by 1), t as (select *, n / sum(n) over () as prior from g),
s as (select c_custkey, class, ln(prior) - 0.5 * ln(2 * pi() * v) - power(c_acctbal - m, 2) / (2 * v) as s from customer, t)
select c_custkey, arg_max(class, s) as predicted from s group by 1""")
def _(spark, d):
    c = load(spark, d, "customer")
    return learn.naive_bayes_predict(c, learn.naive_bayes_model(c, "c_mktsegment", ["c_acctbal"]), ["c_acctbal"]).select("c_custkey", "predicted")


@register("ml_logistic")
def _(spark, d):
    o = load(spark, d, "lineitem").withColumn("big", (F.col("l_extendedprice") > 30000).cast("string"))
    m = learn.logistic(o, "big", "true", ["l_quantity", "l_discount"], l2=0.001)
    return rounded(o.groupBy("big").agg(F.avg(learn.logistic_predict(m)).alias("mean_score")), 3)


@register("ml_roc", """
with g as (select l_quantity as score, count(*) filter (l_returnflag = 'R') as p, count(*) filter (l_returnflag <> 'R') as q from lineitem group by 1)
select score, round(sum(q) over w / sum(q) over (), 8) as fpr, round(sum(p) over w / sum(p) over (), 8) as tpr from g window w as (order by score desc rows unbounded preceding)""")
def _(spark, d):
    df = load(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), "l_quantity")
    return rounded(learn.roc(df, "y", "l_quantity"), 8)


@register("ml_auc", """
with g as (select l_quantity as s, count(*) filter (l_returnflag = 'R') as p, count(*) filter (l_returnflag <> 'R') as q from lineitem group by 1),
w as (select p, q, sum(q) over (order by s rows unbounded preceding) - q as below from g) select round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 8) as auc from w""")
def _(spark, d):
    df = load(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), "l_quantity")
    return rounded(learn.auc(df, "y", "l_quantity"), 8)


@register("ml_average_precision", """
with g as (select l_quantity as s, count(*) filter (l_returnflag = 'R') as p, count(*) as n from lineitem group by 1), w as (select p, sum(p) over o / sum(n) over o as prec from g window o as (order by s desc rows unbounded preceding))
select round(sum(prec * p) / sum(p), 8) as ap from w""")
def _(spark, d):
    df = load(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), "l_quantity")
    return rounded(learn.average_precision(df, "y", "l_quantity"), 8)


@register("ml_class_metrics", """
with c as (select l_returnflag as a, case when l_quantity > 25 then 'R' else 'N' end as p from lineitem), k as (select a as k from c union select p from c),
m as (select k as class, (select count(*) from c where a = k and p = k) as tp, (select count(*) from c where a = k) as support, (select count(*) from c where p = k) as said from k)
select class, round(coalesce(tp / nullif(said, 0), 0), 8) as precision, round(coalesce(tp / nullif(support, 0), 0), 8) as recall, round(coalesce(2 * tp / nullif(said + support, 0), 0), 8) as f1, support from m""")
def _(spark, d):
    df = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("actual"), F.when(F.col("l_quantity") > 25, "R").otherwise("N").alias("predicted"))
    return rounded(learn.class_metrics(df), 8)


_SAID = "(select l_returnflag as a, case when l_quantity > 25 then 'R' else 'N' end as p from lineitem)"


def said(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_returnflag").alias("actual"), F.when(F.col("l_quantity") > 25, "R").otherwise("N").alias("predicted"))


@register("ml_class_summary", f"""
with c as {_SAID}, k as (select a as k from c union select p from c),
m as (select 2 * (select count(*) from c where a = k and p = k) / ((select count(*) from c where a = k) + (select count(*) from c where p = k)) as f1 from k)
select count(*) as n, round(avg((a = p)::int), 8) as accuracy, round((select avg(f1) from m), 8) as macro_f1 from c""")
def _(spark, d):
    return rounded(learn.class_summary(said(spark, d)), 8)


@register("ml_binary_metrics", f"""
with c as (select count(*) filter (a = 'R' and p = 'R') as tp, count(*) filter (a <> 'R' and p = 'R') as fp, count(*) filter (a <> 'R' and p <> 'R') as tn, count(*) filter (a = 'R' and p <> 'R') as fn, count(*) as n from {_SAID})
select tp, fp, tn, fn, round((tp + tn) / n, 8) as accuracy, round(tp / (tp + fp), 8) as precision, round(tp / (tp + fn), 8) as recall, round(2 * tp / (2 * tp + fp + fn), 8) as f1 from c""")
def _(spark, d):
    r = said(spark, d)
    return rounded(learn.binary_metrics(r.select(*[(F.col(c) == "R").cast("int").alias(c) for c in r.columns])), 8)


@register("ml_k_means")
def _(spark, d):
    placed, _, _ = learn.k_means(load(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey")
    return placed.select("c_custkey", "cluster")


@register("ml_dbscan", """
with recursive v as (select s_suppkey as id, s_acctbal as a, s_nationkey::double as b from supplier), m as (select avg(a) as ma, stddev_samp(a) as sa, avg(b) as mb, stddev_samp(b) as sb from v),
z as (select id, (a - ma) / sa as x, (b - mb) / sb as y from v, m),
p as (select u.id, w.id as other from z u join z w on (u.x - w.x) * (u.x - w.x) + (u.y - w.y) * (u.y - w.y) <= 0.16),
core as (select id from p group by 1 having count(*) >= 4), e as (select p.id, other from p join core using (id) where other in (select id from core)),
reach(id, here) as (select id, id from core union select r.id, e.other from reach r join e on e.id = r.here), root as (select id, min(here) as root from reach group by 1),
numbers as (select root, (row_number() over (order by root) - 1)::int as cluster from (select distinct root from root)), said as (select id, cluster from root join numbers using (root))
select v.id as s_suppkey, coalesce(own.cluster, near.cluster, -1) as cluster from v left join said own on own.id = v.id
left join (select p.id, min(cluster) as cluster from p join said on said.id = other group by 1) near on near.id = v.id""")
def _(spark, d):
    df = load(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))
    return learn.dbscan(df, ["s_acctbal", "nation"], "s_suppkey", 0.4)


@register("ml_decision_tree")
def _(spark, d):
    df = load(spark, d, "part").withColumn("y", F.when((F.col("p_size") > 25) & (F.col("p_partkey") % 3 > 0), "a").otherwise("b"))
    tree = learn.decision_tree(df, "y", ["p_size", "p_retailprice"], 4)
    return df.select("p_partkey", F.col("y").alias("actual"), tree.alias("predicted"))


@register("ml_tree_split", """
with p as (select p_partkey, p_size::double as a, p_retailprice as b, case when p_size > 25 and p_partkey % 3 > 0 then 'a' else 'b' end as y from part), e as (select 0 as f, a as x, y from p union all select 1, b, y from p),
v as (select f, x, (count(*) filter (y = 'a'))::double as ca, (count(*) filter (y = 'b'))::double as cb from e group by 1, 2),
r as (select f, x, lead(x) over (partition by f order by x) as nx, sum(ca) over w as la, sum(cb) over w as lb, sum(ca) over (partition by f) as ta, sum(cb) over (partition by f) as tb from v window w as (partition by f order by x)),
s as (select *, round(((la * la + lb * lb) / (la + lb) + ((ta - la) * (ta - la) + (tb - lb) * (tb - lb)) / (ta + tb - la - lb) - (ta * ta + tb * tb) / (ta + tb)) / (ta + tb), 12) as gain from r where nx is not null),
best as (select f, (x + nx) / 2 as t from s where gain > 0 order by gain desc, f, x limit 1), placed as (select p.*, case f when 0 then a else b end <= t as l from p, best),
said as (select l, y as predicted from (select l, y, count(*) as n from placed group by 1, 2) qualify row_number() over (partition by l order by n desc, y) = 1)
select p_partkey, y as actual, predicted from placed join said using (l)""")
def _(spark, d):
    df = load(spark, d, "part").withColumn("y", F.when((F.col("p_size") > 25) & (F.col("p_partkey") % 3 > 0), "a").otherwise("b"))
    return df.select("p_partkey", F.col("y").alias("actual"), learn.decision_tree(df, "y", ["p_size", "p_retailprice"], 1).alias("predicted"))


#: Every twentieth order is asked for the five orders nearest in price (in hundreds) and day.
@register("ml_nearest", """
with z as (select o_orderkey as k, o_totalprice / 100 as x, datediff('day', date '1990-01-01', o_orderdate::date)::double as y from orders)
select q.k as query, p.k as key, row_number() over (partition by q.k order by (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), p.k)::int as place, round((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), 4) as d
from z q join z p on q.k % 20 = 0 qualify place <= 5""")
def _(spark, d):
    z = load(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("x0"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double").alias("x1"))
    found = k_nearest(z.withColumnRenamed("o_orderkey", "key"), z.where("o_orderkey % 20 = 0").withColumnRenamed("o_orderkey", "query"), 2, 5)
    near = found.select("query", F.posexplode("near").alias("i", "x"))
    return near.select("query", "x.key", (F.col("i") + 1).alias("place"), F.round("x.d", 4).alias("d"))


@register("ml_pca")
def _(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    names = [f"e{i}" for i in range(8)]
    return rounded(learn.pca_scores(e, learn.pca(e, names)).select("vec_id", "pc1", "pc2"), 6)


@register("ml_pca_two", """
with m as (select avg(p_retailprice) as ma, avg(p_size) as mb, var_samp(p_retailprice) as p, var_samp(p_size) as s, covar_samp(p_retailprice, p_size) as q from part),
e as (select *, (p - s) / 2 + sqrt((p - s) * (p - s) / 4 + q * q) as u from m), w as (select *, sqrt(u * u + q * q) * sign(case when abs(u) > abs(q) then u else q end) as w1, sqrt(u * u + q * q) * sign(case when abs(u) > abs(q) then u else -q end) as w2 from e)
select p_partkey, round(((p_retailprice - ma) * u + (p_size - mb) * q) / w1, 6) as pc1, round(((p_size - mb) * u - (p_retailprice - ma) * q) / w2, 6) as pc2 from part, w""")
def _(spark, d):
    """Two columns by covariance: the axes have a closed form."""
    df = load(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return rounded(learn.pca_scores(df, learn.pca(df, ["p_retailprice", "p_size"], correlation=False)).select("p_partkey", "pc1", "pc2"), 6)


@register("ml_eligible", "select * from (select 'o_orderstatus' as \"column\", count(distinct o_orderstatus) as classes from orders union all select 'o_orderpriority', count(distinct o_orderpriority) from orders union all select 'o_custkey', count(distinct o_custkey) from orders) where classes between 2 and 20")
def _(spark, d):
    return learn.eligible_targets(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


# ---- charts, dashboards, maps


@register("viz_bar", "select p_brand, round(sum(p_retailprice), 2) as value, count(*) as \"__count\" from part group by 1 order by value desc, p_brand limit 10")
def _(spark, d):
    return rounded(charts.ranked(load(spark, d, "part"), charts.ChartSpec("bar", ("p_brand",), (("p_retailprice", "sum", "value"),), top=10)), 2)


@register("viz_filtered", "select p_brand, round(sum(p_retailprice), 2) as value, count(*) as \"__count\" from part where p_size between 5 and 20 and p_brand in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') group by 1")
def _(spark, d):
    """A chart with filters of its own: some brands, some sizes."""
    spec = charts.ChartSpec("bar", ("p_brand",), (("p_retailprice", "sum", "value"),), filters=(("p_size", (5, 20)), ("p_brand", ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"))))
    return rounded(charts.ranked(load(spark, d, "part"), spec), 2)


@register("ins_class_lines", """
with c as (select o_orderpriority as class, o_orderpriority in ('1-URGENT', '2-HIGH') as y, o_totalprice > 250000 as p from orders), g as (select (y::int)::varchar as a, (p::int)::varchar as b, count(*) as n from c group by 1, 2),
s as (select k as class, sum(n) filter (a = k and b = k) as tp, sum(n) filter (b = k) as said, sum(n) filter (a = k) as real from g, (values ('0'), ('1')) v(k) group by 1)
select class, printf('P=%.0f%%/R=%.0f%%', tp / said * 100, tp / real * 100) as line from s""")
def _(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").cast("string").alias("actual"), (F.col("o_totalprice") > 250000).cast("int").cast("string").alias("predicted"))
    return assistant.class_lines(learn.class_metrics(o))


@register("viz_colored", "select l_returnflag, round(coalesce(sum(l_quantity) filter (l_linestatus = 'F'), 0), 2) as \"F\", round(coalesce(sum(l_quantity) filter (l_linestatus = 'O'), 0), 2) as \"O\" from lineitem group by 1")
def _(spark, d):
    return rounded(charts.colored(load(spark, d, "lineitem"), charts.ChartSpec("bar", ("l_returnflag",), (("l_quantity", "sum", "v"),), color="l_linestatus")), 2)


@register("viz_scatter", "select p_size::double as x, p_retailprice as y from part")
def _(spark, d):
    return charts.scatter(load(spark, d, "part"), "p_size", "p_retailprice")


@register("viz_scatter_colored", """
with g as (select p_brand as g, count(*) as n from part group by 1 order by n desc, g limit 12) select p_size::double as x, p_retailprice as y, p_brand as "group" from part join g on p_brand = g""")
def _(spark, d):
    return charts.scatter_colored(load(spark, d, "part"), "p_size", "p_retailprice", "p_brand")


@register("viz_heatmap", """
with c as (select o_orderstatus as x, o_orderpriority as y, round(sum(o_totalprice), 2) as value from orders group by all)
select x, y, (dense_rank() over (order by x) - 1)::int as xi, (dense_rank() over (order by y) - 1)::int as yi, value from c""")
def _(spark, d):
    spec = charts.ChartSpec("heatmap", ("o_orderstatus", "o_orderpriority"), (("o_totalprice", "sum", "value"),))
    return rounded(charts.heatmap(load(spark, d, "orders"), spec), 2)


@register("viz_radar", """
with c as (select c_mktsegment as key, avg(c_acctbal) as balance, count(*)::double as n from customer group by 1), t as (select 1.15 * greatest(max(balance), 1) as tb, 1.15 * greatest(max(n), 1) as tn from c)
select key, 'balance' as axis, round(balance, 4) as value, round(tb, 4) as top from c, t union all select key, 'n', n, round(tn, 4) from c, t""")
def _(spark, d):
    spec = charts.ChartSpec("radar", ("c_mktsegment",), (("c_acctbal", "avg", "balance"), ("c_custkey", "count", "n")))
    return rounded(charts.radar(load(spark, d, "customer"), spec))


_BARS = "(select date_trunc('month', o_orderdate)::date as date, first(o_totalprice order by o_orderdate, o_totalprice) as open, last(o_totalprice order by o_orderdate, o_totalprice) as close, min(o_totalprice) as low, max(o_totalprice) as high, count(*) as volume from orders group by 1)"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").withColumn("one", F.lit(1).cast("long"))
    return charts.bars_of(o, "o_orderdate", "o_totalprice", "one", "month").withColumn("date", F.to_date("date"))


@register("viz_candles", f"select date, open, close, low, high from {_BARS}")
def _(spark, d):
    return charts.candles(monthly(spark, d), "date")


@register("viz_candles_volume", f"select date, open, close, low, high, volume, close >= open as up from {_BARS}")
def _(spark, d):
    return charts.candles_volume(monthly(spark, d), "date")


@register("viz_series_table", """
with c as (select o_orderpriority as category, o_orderstatus as series, round(sum(o_totalprice), 2) as value from orders group by all)
select a.category, b.series, coalesce(value, 0) as value from (select distinct category from c) a cross join (select distinct series from c) b left join c on c.category = a.category and c.series = b.series""")
def _(spark, d):
    spec = charts.ChartSpec("bar", ("o_orderpriority",), (("o_totalprice", "sum", "value"),), color="o_orderstatus")
    return rounded(charts.series_table(load(spark, d, "orders"), spec), 2)


@register("viz_bubble", "select p_partkey as x, p_size as y, p_retailprice as size, round(greatest(6, sqrt(p_retailprice / (select max(p_retailprice) from part)) * 52), 6) as radius from part")
def _(spark, d):
    return rounded(charts.bubble(load(spark, d, "part"), "p_partkey", "p_size", "p_retailprice"), 6)


@register("viz_waterfall", """
with s as (select o_orderpriority, sum(o_totalprice) as v from orders group by 1), r as (select *, sum(v) over (order by v desc, o_orderpriority rows unbounded preceding) as run from s)
select o_orderpriority, round(v, 2) as value, round(run, 2) as running, round(least(run, run - v), 2) as base from r""")
def _(spark, d):
    return rounded(charts.waterfall(load(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 2)


@register("viz_boxplot", """
with b as (select o_orderpriority, count(*) as n, min(o_totalprice) as lo, quantile_cont(o_totalprice, 0.25) as q1, median(o_totalprice) as median, quantile_cont(o_totalprice, 0.75) as q3, max(o_totalprice) as hi from orders group by 1)
select o_orderpriority, n, round(lo, 4) as lo, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, round(hi, 4) as hi, (select count(*) from orders o where o.o_orderpriority = b.o_orderpriority and (o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1))) as outliers from b""")
def _(spark, d):
    return rounded(charts.boxplot(load(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


@register("viz_violin", """
with s as (select l_returnflag as g, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi, greatest(1.06 * stddev_pop(l_quantity) * power(count(*), -0.2), (max(l_quantity) - min(l_quantity)) * 0.05) as bw from lineitem group by 1), c as (select l_returnflag as g, l_quantity as v, count(*) as c from lineitem group by all)
select s.g as l_returnflag, k::int as k, round(any_value(lo + (hi - lo) * k / 39), 6) as x, round(sum(c * exp(-power((lo + (hi - lo) * k / 39 - v) / bw, 2) / 2)) / any_value(n * bw * sqrt(2 * pi())), 8) as density from s join c on s.g = c.g, range(40) r(k) group by s.g, k""")
def _(spark, d):
    r = charts.violin(load(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return r.select("l_returnflag", "k", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@register("viz_sankey", "select o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) as value from orders group by all having sum(o_totalprice) > 0")
def _(spark, d):
    return rounded(charts.links(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice"), 2)


@register("viz_sunburst", "select o_orderstatus, round(sum(o_totalprice), 2) as value, count(distinct o_orderpriority) as parts from orders group by 1")
def _(spark, d):
    r = charts.sunburst(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    return r.select("o_orderstatus", F.round("value", 2).alias("value"), F.size("children").cast("long").alias("parts"))


@register("viz_facets", """
with c as (select o_orderstatus, o_orderpriority, sum(o_totalprice) as value from orders group by all), p as (select *, row_number() over (partition by o_orderstatus order by value, o_orderpriority) as place from c)
select o_orderstatus, o_orderpriority, round(value, 2) as value, place::int as place from p where place <= 3""")
def _(spark, d):
    return rounded(charts.facets(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", 12, 3), 2)


@register("dsh_kpi", "select round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as value, round(sum(o_totalprice), 2) as whole, round(sum(o_totalprice) filter (o_orderstatus = 'F') / sum(o_totalprice) * 100, 2) as pct from orders")
def _(spark, d):
    return rounded(charts.kpi_widget(load(spark, d, "orders"), ("o_totalprice", "sum"), ("o_orderstatus", "F")), 2)


@register("dsh_table", """
with t as (select c_nationkey::varchar as c_nationkey, sum(c_acctbal) as v from customer group by 1 order by v desc, c_nationkey limit 30)
select row_number() over (order by v desc, c_nationkey)::int as rank, c_nationkey, round(v, 2) as value, round(v / max(v) over (), 2) as bar from t""")
def _(spark, d):
    return rounded(charts.table_widget(load(spark, d, "customer"), "c_nationkey", "c_acctbal"), 2)


@register("geo_totals", "select n_name as region, round(sum(c_acctbal), 2) as value from customer join nation on c_nationkey = n_nationkey group by 1")
def _(spark, d):
    n = load(spark, d, "nation")
    c = load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(". ")).alias("label"), "c_acctbal")
    return rounded(charts.region_totals(c, "label", n, "n_name", "c_acctbal"), 2)


@register("geo_unmatched", "select r_name as label from region where r_name not in (select n_name from nation)")
def _(spark, d):
    return charts.unmatched(load(spark, d, "region"), "r_name", load(spark, d, "nation"), "n_name")


@register("geo_match", "select count(*) as total, count(*) filter (r_name in (select n_name from nation)) as matched, (count(*) filter (r_name in (select n_name from nation)) / count(*))::double as rate from region")
def _(spark, d):
    return charts.match_rate(load(spark, d, "region"), "r_name", load(spark, d, "nation"), "n_name")


# ---- sources


@register("src_infer_types", "select * from (values ('o_orderkey', 'integer'), ('o_totalprice', 'float'), ('o_orderstatus', 'category'), ('o_orderdate', 'datetime'), ('flag', 'boolean'), ('nothing', 'string')) t(\"column\", type)")
def _(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderstatus", F.col("o_orderdate").cast("string"), F.when(F.col("o_totalprice") > 1000, "Yes").otherwise("false").alias("flag"), F.lit(" ").alias("nothing"))
    return readers.infer_types(o)


@register("src_typed", "select o_orderkey, o_totalprice, o_totalprice > 1000 as flag from orders")
def _(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), F.col("o_totalprice").cast("string")).alias("o_totalprice"), F.when(F.col("o_totalprice") > 1000, "Yes").otherwise("no").alias("flag"))
    return readers.typed(o, {"o_orderkey": "integer", "o_totalprice": "float", "flag": "boolean"})


@register("scl_number", f"select l_linenumber, count(l_discount) as numbers, count(*) filter (l_discount is null) as blanks from {GAPPY} group by 1")
def _(spark, d):
    g = gappy(spark, d).withColumn("t", F.coalesce(F.col("l_discount").cast("string"), F.lit("")))
    return g.groupBy("l_linenumber").agg(F.count(number(F.col("t"), g.schema["t"].dataType)).alias("numbers"), F.count_if(blank(F.col("t"))).alias("blanks"))


# ---- SQL of every kind over the registered views


def _sql(name: str, query: str, oracle: str | None = None) -> None:
    """The same text runs on both sides unless the dialects differ; here over the views of a registry, after a step and its undoing."""

    @register(name, oracle or query)
    def _(spark, d):
        held = Registry(spark)
        for t in sorted(set(re.findall(r"\b(?:from|join)\s+([a-z]+)", query)) & TABLES):
            key = held.add(t, load(spark, d, t), load(spark, d, t).columns[0])
            held.step(key, Step("drop_col", held.view(key).columns[-1]))
            held.move(key, -1)
        found = held.sql(query)
        held.close()
        return found


@register("sql_changed_view", """
with s as (select s_suppkey, upper(s_name) as label, round((s_acctbal - (select min(s_acctbal) from supplier)) / (select max(s_acctbal) - min(s_acctbal) from supplier), 4) as s_acctbal, s_nationkey from supplier where s_suppkey not in (3, 4))
select n_name, count(*) as n, round(sum(s_acctbal), 4) as total, min(label) as first from s join nation on s_nationkey = n_nationkey group by n_name""")
def _(spark, d):
    """SQL over a view whose steps stay, but for the last, which was taken back."""
    held = Registry(spark)
    key = held.add("supplier", load(spark, d, "supplier"), "s_suppkey")
    for step in (Step("normalize", "s_acctbal"), Step("rename", "s_name", {"to": "label"}), Step("drop_rows", None, {"keys": [3, 4]}), Step("drop_col", "label")):
        held.step(key, step)
    held.move(key, -1)
    held.add("nation", load(spark, d, "nation"), "n_nationkey")
    found = held.sql("select n_name, count(*) as n, round(sum(s_acctbal), 4) as total, min(upper(label)) as first from supplier join nation on s_nationkey = n_nationkey group by n_name")
    held.close()
    return found


TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "embeddings"}

_sql("sql_semi", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_totalprice > 400000)")
_sql("sql_anti", "select p_partkey from part p where not exists (select 1 from lineitem l where l.l_partkey = p.p_partkey and l_quantity > 48)")
_sql("sql_theta", "select n_name, count(*) as n from nation join supplier on s_nationkey < n_nationkey group by n_name")
_sql("sql_cube", "select c_mktsegment, c_nationkey, count(*) as n from customer group by cube (c_mktsegment, c_nationkey)")
_sql("sql_having", "select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by o_custkey having count(*) > 12")
_sql("sql_filter_agg", "select l_shipdate is null as none, count(*) filter (where l_returnflag = 'R') as r, count(*) filter (where l_tax > 0.04) as t from lineitem group by 1")
_sql("sql_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
_sql("sql_except", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 9000")
_sql("sql_join_window", "with r as (select n_name, c_custkey, c_acctbal, row_number() over (partition by n_name order by c_acctbal desc, c_custkey) as place from customer join nation on c_nationkey = n_nationkey) select n_name, c_custkey, c_acctbal, cast(place as int) as place from r where place <= 3")
_sql("sql_rollup", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
_sql("sql_cte", "with big as (select o_custkey, sum(o_totalprice) as s from orders group by o_custkey), m as (select max(s) as m from big) select o_custkey, round(s, 2) as s from big, m where s > 0.9 * m")
_sql("sql_subquery", "select o_orderkey from orders o where o_totalprice > (select avg(o_totalprice) * 1.8 from orders i where i.o_custkey = o.o_custkey)")
_sql("sql_frames", "select event_id, count(*) over (partition by user_id order by event_id rows between 3 preceding and current row) as n, first_value(event_type) over (partition by user_id order by event_id) as first_type from events")
_sql("sql_ntile", "select c_custkey, cast(ntile(10) over (order by c_acctbal, c_custkey) as int) as bucket, cast(rank() over (order by c_nationkey) as int) as place from customer")
_sql("sql_case_strings", "select p_partkey, upper(p_name) as u, length(p_brand) as n, substring(p_type, 1, 3) as t, replace(p_name, ' ', '_') as r, case when p_size > 25 then 'big' when p_size > 10 then 'mid' else 'small' end as k, concat(p_brand, '-', p_type) as c from part", "select p_partkey, upper(p_name) as u, length(p_brand)::int as n, substring(p_type, 1, 3) as t, replace(p_name, ' ', '_') as r, case when p_size > 25 then 'big' when p_size > 10 then 'mid' else 'small' end as k, concat(p_brand, '-', p_type) as c from part")
_sql("sql_dates", "select date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') as month, count(*) as n, round(sum(o_totalprice), 2) as s from orders group by 1", "select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month, count(*) as n, round(sum(o_totalprice), 2) as s from orders group by 1")
_sql("sql_json", "select event_id, cast(get_json_object(props, '$.k') as int) as k from events", "select event_id, (props->>'$.k')::int as k from events")
_sql("sql_arrays", "select vec_id, size(embedding) as n, round(aggregate(embedding, cast(0 as double), (a, x) -> a + x * x), 4) as norm from embeddings", "select vec_id, len(embedding)::int as n, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as norm from embeddings")
_sql("sql_range_join", "select e.event_type, count(*) as n from events e join orders o on o.o_custkey = e.user_id and o.o_totalprice between e.value * 1000 and e.value * 1500 group by e.event_type")
_sql("sql_union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier")
_sql("sql_topk", "select l_orderkey, l_extendedprice, l_partkey from lineitem order by l_extendedprice desc, l_orderkey, l_partkey, l_suppkey limit 25")


# ---- events in time


@register("str_tumbling", "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(spark, d):
    return rounded(event_windows.windowed(load(spark, d, "events"), "ts", "1 hour", [("value", "count", "n"), ("value", "sum", "total")], ["event_type"]))


@register("str_sliding", "select time_bucket(interval '30 minutes', ts) - b.k * interval '30 minutes' as window_start, count(*) as n from events, range(2) b(k) group by 1")
def _(spark, d):
    return event_windows.windowed(load(spark, d, "events"), "ts", "1 hour", [("value", "count", "n")], slide="30 minutes")


@register("str_sessions", """
with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, k""")
def _(spark, d):
    return event_windows.sessions(load(spark, d, "events"), "ts", "30 minutes", ["user_id"], [("value", "count", "n")])


# ---- formats, places, sentences


@register("scl_compact", "select o_orderkey, case when o_totalprice >= 1e4 then regexp_replace((floor(o_totalprice / 1e4 * 10 + 0.5) / 10)::varchar, '\\.0$', '') || '만' when o_totalprice >= 1e3 then regexp_replace((floor(o_totalprice / 1e3 * 10 + 0.5) / 10)::varchar, '\\.0$', '') || 'k' else regexp_replace(o_totalprice::varchar, '\\.0$', '') end as x from orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", compact(F.col("o_totalprice")).alias("x"))


@register("scl_plain_text", "select page_id, trim(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), ' ') as x from pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", plain_text(F.col("html")).alias("x"))


@register("geo_bubbles", "select c_custkey, round(6 + 30 * (c_acctbal - lo) / (hi - lo), 6) as size from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)")
def _(spark, d):
    return rounded(geo.bubble_size(load(spark, d, "customer"), "c_acctbal").select("c_custkey", "size"), 6)


@register("geo_projection", """
with p as (
  select c_custkey, radians(33 + c_custkey % 60 / 10) as phi, radians(124 + c_nationkey / 4 - 129) as dl, 6378137.0 as a, 1 / 298.257223563 as f from customer
), q as (select *, f * (2 - f) as e2, f * (2 - f) / (1 - f * (2 - f)) as ep, pow(tan(phi), 2) as t2 from p
), r as (select *, ep * pow(cos(phi), 2) as c2, a / sqrt(1 - e2 * pow(sin(phi), 2)) as n, dl * cos(phi) as x,
  a * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * pow(e2, 3) / 256) * phi - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * phi) + (15 * e2 * e2 / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * phi) - 35 * pow(e2, 3) / 3072 * sin(6 * phi)) as m from q)
select c_custkey, round(500000 + 0.9996 * n * (x + (1 - t2 + c2) * pow(x, 3) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * ep) * pow(x, 5) / 120), 2) as east,
  round(0.9996 * (m + n * tan(phi) * (x * x / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * pow(x, 4) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * ep) * pow(x, 6) / 720)), 2) as north from r""")
def _(spark, d):
    n = load(spark, d, "customer").withColumns({"lat": 33 + F.pmod("c_custkey", F.lit(60)) / 10, "lon": 124 + F.col("c_nationkey") / 4})
    east, north = geo.transverse_mercator(F.col("lat"), F.col("lon"))
    return rounded(n.select("c_custkey", east.alias("east"), north.alias("north")), 2)


@register("ins_small_dimensions", "select * from (select 'o_orderstatus' as \"column\", count(distinct o_orderstatus) as \"values\" from orders union all select 'o_orderpriority', count(distinct o_orderpriority) from orders union all select 'o_custkey', count(distinct o_custkey) from orders) where \"values\" between 2 and 50")
def _(spark, d):
    return assistant.small_dimensions(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@register("ins_correlation", "select 'l_extendedprice~l_quantity' as strongest, round(abs(corr(l_quantity, l_extendedprice)), 8) as strength, (abs(corr(l_quantity, l_extendedprice)) > 0.5)::int::bigint as strong_pairs from lineitem having strength >= 0")
def _(spark, d):
    return rounded(assistant.correlation_summary(agg.correlations(load(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])), 8)


@register("ins_chart", "select o_orderpriority, round(sum(o_totalprice), 2) as value, count(*) as \"__count\" from orders group by 1 order by value desc, o_orderpriority limit 8")
def _(spark, d):
    spec = assistant.chart_for("what is the share of o_totalprice in each o_orderpriority", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])
    return rounded(charts.ranked(load(spark, d, "orders"), spec), 2)
