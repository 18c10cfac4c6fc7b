"""Small cases with known results."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.formula import FormulaError, compile_formula, compile_kpi
from sparkloom.operators import aggregate, combine, control, distributions, learn, series, stats, windows
from sparkloom.operators.clean import Pipeline, Step
from sparkloom.operators.kpi import kpi, report
from sparkloom.operators.pivot import PivotSpec, long_form
from sparkloom.plans import charts
from sparkloom.sources import readers
from sparkloom.sources.registry import Registry, json_quoted_lines, read_share_link, share_link


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def ints(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, x double")


def test_moving_average(spark):
    got = rows(windows.moving_average(ints(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), "x", ["i"], 3), "i")
    assert [r[2] for r in got] == [None, None, 2, 3, 4]


def test_weighted_average(spark):
    got = rows(windows.weighted_average(ints(spark, [2.0, 4.0, 6.0]), "x", ["i"], [1, 3]), "i")
    assert [r[2] for r in got] == [None, 3.5, 5.5]


def test_exponential_and_difference(spark):
    assert [r[2] for r in rows(series.exponential(ints(spark, [1.0, 2.0, 3.0]), "x", "i", 0.5), "i")] == [1, 1.5, 2.25]
    assert [r[2] for r in rows(windows.difference(ints(spark, [1.0, 3.0, 6.0, 10.0]), "x", ["i"], 2), "i")] == [None, None, 5, 7]


def test_exponential_gaps_and_series(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 1.0), ("a", 2, None), ("b", 0, 5.0)], "k string, i int, x double")
    assert [r[3] for r in rows(series.exponential(df, "x", "i", 0.5, ["k"]), "k", "i")] == [None, 1, 1, 5]


def test_acf(spark):
    got = rows(series.acf(ints(spark, [1.0, -1.0] * 6), "x", "i", 1), "lag")
    assert got[1][1] == pytest.approx(-11 / 12)


def test_decompose(spark):
    pattern = [10.0, -5.0, 3.0, -8.0]
    df = ints(spark, [100 + 2 * i + pattern[i % 4] for i in range(40)])
    got = series.decompose(df, "x", "i", 4).collect()
    assert all(abs(r.seasonal - pattern[r.i % 4]) < 1e-9 for r in got)
    assert all(r.residual is None or abs(r.residual) < 1e-9 for r in got)


def test_control_charts(spark):
    r = control.individuals(ints(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), "x", "i").first()
    assert (r.center, r.mr_ucl) == (3, 3.267) and r.sigma == pytest.approx(1 / 1.128)
    g = spark.createDataFrame([(0, 2.0), (0, 4.0), (1, 4.0), (1, 6.0)], "g int, v double")
    r = control.xbar_r(g, "v", "g").first()
    assert [round(x, 3) for x in (r.center, r.ucl, r.lcl, r.r_ucl)] == [4, 7.76, 0.24, 6.534]
    c = control.capability(ints(spark, [9.0, 11.0, 10.0, 12.0, 8.0]), "x", "i", 4, 16).first()
    assert c["mean"] == 10 and c.within == pytest.approx(2.25 / 1.128)
    with pytest.raises(ValueError):
        control.xbar_r(g.limit(3), "v", "g")


def test_capability_without_limits(spark):
    assert control.capability(ints(spark, [1.0, 2.0]), "x", "i", 5, 4).first().cp is None


def test_inverse():
    assert np.allclose(stats.invert(np.array([[4.0, 7.0], [2.0, 6.0]])), [[0.6, -0.7], [-0.2, 0.4]])
    assert stats.invert(np.array([[1.0, 2.0], [2.0, 4.0]])) is None


def test_probabilities():
    assert stats.t_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.f_p(3.0, 2, 12) == pytest.approx(0.08779150, abs=1e-7)
    assert stats.chi2_p(5.0, 2) == pytest.approx(math.exp(-2.5))
    assert stats.t_p(math.inf, 5) == 0 and stats.f_p(-1, 2, 3) == 1 and stats.chi2_p(0, 3) == 1


def test_ols_collinear(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i)) for i in range(9)], "a double, b double, y double")
    with pytest.raises(stats.CollinearError):
        stats.ols(df, "y", ["a", "b"])


def test_roc_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert learn.auc(df, "y", "s").first().auc == 0.75


def test_logistic_separates(spark):
    df = spark.createDataFrame([(float(i), "p" if i + (i % 3) > 10 else "n") for i in range(20)], "x double, y string")
    m = learn.logistic(df, "y", "p", ["x"], l2=0.01)
    assert m["coef"][0] > 0


def test_dbscan(spark):
    pts = [(i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (10.0, 10.0), (10.0, 11.0), (11.0, 10.0), (100.0, 100.0)])]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = [r[1] for r in rows(learn.dbscan(df, ["x", "y"], "id", 1.5, 2, scale=False), "id")]
    assert got == [0, 0, 0, 1, 1, 1, -1]


def test_decision_tree(spark):
    pts = [(x, y, "A" if x < 2 else "B") for x in (0.1, 0.2, 0.3, 5.0, 5.2) for y in (0.1, 0.4)]
    df = spark.createDataFrame(pts, "x double, y double, label string")
    got = df.select("label", learn.decision_tree(df, "label", ["x", "y"]).alias("p")).collect()
    assert all(r.label == r.p for r in got)


def test_k_means_and_pca(spark):
    df = spark.createDataFrame([(i, float(i % 2 * 100 + i), float(i)) for i in range(20)], "id int, x double, y double")
    placed, centres, _ = learn.k_means(df, ["x"], "id", 2)
    assert placed.groupBy("cluster").count().count() == 2 and len(centres) == 2
    p = learn.pca(df, ["x", "y"])
    assert p["shares"].sum() == pytest.approx(1)


def test_neighbours_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(i, *map(float, rng.normal(size=2)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(pts, "id int, x double, y double, c string")
    got = {r.id: r.predicted for r in learn.nearest_neighbours(df, "c", ["x", "y"], "id", 3).collect()}
    z = np.array([p[1:3] for p in pts])
    z = (z - z.mean(0)) / z.std(0)
    train = [p[0] for p in pts if p[0] not in got]
    for i, said in got.items():
        near = sorted(train, key=lambda t: (((z[t] - z[i]) ** 2).sum(), t))[:3]
        votes = [pts[t][3] for t in near]
        assert said == max(set(votes), key=lambda c: (votes.count(c), -votes.index(c)))


def test_mahalanobis(spark):
    pts = [(i, float(i % 6), float(i // 6)) for i in range(30)] + [(30, 50.0, -50.0)]
    got = distributions.mahalanobis(spark.createDataFrame(pts, "id int, x double, y double"), ["x", "y"])
    assert [r.id for r in got.where("outlier").collect()] == [30]
    with pytest.raises(ValueError):
        distributions.mahalanobis(spark.createDataFrame(pts, "id int, x double, y double"), ["x"])


def test_pivot(spark):
    df = spark.createDataFrame([("A", "Q1", 10.0), ("A", "Q1", 20.0), ("A", "Q2", 30.0), ("B", "Q1", 100.0)], "r string, q string, x double")
    got = {(r.r, r.q): r.x__sum for r in long_form(df, PivotSpec(("r",), ("q",), (("x", "sum"),))).collect()}
    assert got[("A", None)] == 60 and got[("B", None)] == 100 and got[(None, None)] == 160
    df = spark.createDataFrame([(None, 5.0), ("N", 10.0), ("", 3.0)], "r string, x double")
    got = {r.r: r.x__sum for r in long_form(df, PivotSpec(("r",), (), (("x", "sum"),))).collect()}
    assert got[""] == 8 and got[None] == 18
    with pytest.raises(ValueError):
        PivotSpec(("r",), (), ())


def test_union(spark):
    a, b = spark.createDataFrame([(1, 5)], "id int, amount int"), spark.createDataFrame([(2, 1.5, " ")], "id int, amount double, note string")
    u = combine.union([("a", a), ("b", b)])
    assert u.columns == ["id", "amount", "note", "__source"] and u.schema["amount"].dataType.simpleString() == "double"
    assert [r.note for r in u.collect()] == [None, None]
    with pytest.raises(ValueError):
        combine.union([("a", a)])


def test_join(spark):
    o = spark.createDataFrame([(1, 100), (2, 50)], "cust int, amount int")
    c = spark.createDataFrame([("01", 999, "Kim"), (None, 1, "x")], "cust string, amount int, name string")
    got = combine.join(o, c, [("cust", "cust")], "inner", "cust")
    assert got.columns == ["cust", "amount", "cust__amount", "name"] and rows(got, "cust") == [(1, 100, 999, "Kim")]
    d = combine.diagnostics(o, c, [("cust", "cust")]).first()
    assert (d.inner_rows, d.left_unmatched, d.right_unmatched, d.many_to_many) == (1, 1, 1, False)
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    assert combine.join(twice, twice, [("k", "k")]).count() == 4 and combine.diagnostics(twice, twice, [("k", "k")]).first().many_to_many
    with pytest.raises(ValueError):
        combine.join(o, c, [])


def test_kpi(spark):
    df = spark.createDataFrame([(100.0, 30.0, "a"), (200.0, 40.0, "b"), (300.0, None, "a")], "revenue double, profit double, region string")
    assert round(kpi(df, "SUM(profit)/SUM(revenue)*100").first()[0], 2) == 11.67
    assert kpi(df, "1/(SUM(profit)-70)").first()[0] is None
    for bad in ("SUM(nope)", "FOO(revenue)", "SUM(*)", "revenue", "SUM(revenue) +"):
        with pytest.raises(FormulaError):
            compile_kpi(bad, df.schema)
    r = kpi(df, "1 / (SUM(profit) - 70)", error="error").first()
    assert (r.value, r.error) == (None, "Division by zero")
    for source, want in (("COUNT(*)", 3), ("COUNT(profit)", 2), ("COUNTD(region)", 2), ("(SUM(revenue) - SUM(profit)) / 2", 265), ("-MIN(revenue)", -100), ("MEDIAN(revenue)", 200), ("1 + 2", 3), ("MEDIAN(profit) / COUNTD(profit) / COUNTD(region)", 8.75)):
        assert kpi(df, source).first()[0] == want
    empty = df.limit(0)
    assert tuple(kpi(empty, "SUM(revenue) / COUNT(*)", error="e").first()) == (None, "Division by zero") and tuple(kpi(empty, "MEDIAN(revenue) / 0", error="e").first()) == (None, None)


def test_kpi_report(spark):
    df = spark.createDataFrame([(100.0, 30.0, "a"), (200.0, 40.0, "b"), (300.0, None, "a"), (5.0, None, None)], "revenue double, profit double, region string")
    got = {(r.region, r.kpi): (r.value, r.error) for r in report(df, {"m": "MEDIAN(revenue) + 1", "z": "1 / COUNT(profit) + 1 / 0", "bad": "revenue + 1", "d": "COUNTD(revenue) - COUNTD(profit)"}, ["region"]).collect()}
    assert len(got) == 12 and got["a", "m"] == (201.0, None) and got[None, "z"] == got["a", "z"] == (None, "Division by zero") and got["a", "d"] == (1.0, None) and got[None, "d"] == (1.0, None)
    assert got["b", "bad"][0] is None and "not allowed" in got["b", "bad"][1]
    plan = report(df, {"m": "MEDIAN(revenue) / COUNTD(profit) / COUNTD(region)"})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median" not in plan and "Expand" not in plan


def test_distinct_counts_and_column_report(spark):
    rows = [(1, "x", None), (2, "x", "2020-01-01"), (None, "", "2021-01-01"), (2, None, "2020-01-01")]
    df = spark.createDataFrame(rows, "k int, s string, d string").withColumn("d", F.col("d").cast("date"))
    assert [tuple(r) for r in aggregate.profile(df).collect()] == [("k", 4, 1, 25.0, 2), ("s", 4, 2, 50.0, 1), ("d", 4, 1, 25.0, 2)]
    assert "Expand" not in aggregate.profile(df)._jdf.queryExecution().optimizedPlan().toString()
    got = {r.column: r for r in aggregate.column_report(df, 1).collect()}
    assert (got["d"].kind, got["d"].least, got["d"].largest, [tuple(t) for t in got["d"].top]) == ("date", "2020-01-01", "2021-01-01", [("2020-01-01", 2)])
    assert got["k"].mean == pytest.approx(5 / 3) and got["s"].mean is None and got["s"].distinct == 1
    assert {r.column: (r.n_rows, r.distinct, r.top) for r in aggregate.column_report(df.limit(0)).collect()} == {c: (0, 0, []) for c in "ksd"}
    assert aggregate.distinct_counts(df, ["s"], [("a", F.col("k")), ("b", F.col("d"))]).count() == 3


@pytest.mark.parametrize("source, want", [("-2 ** 2", -4), ("1 / 0", math.inf), ("5 % 3", 2), ("true ? 1 : 2", 1), ("0 ? 1 : 0 ? 2 : 3", 3), ("row.x + 'a'", "1a"), ("row.nope + 1", 1), ("!row.x", False), ("row.s == 'q?:' && row.x > 0", True), ("Math.max(1, 4, 2)", 4), ("Math.PI > 3", True)])
def test_formula(spark, source, want):
    df = spark.createDataFrame([(1.0, "q?:")], "x double, s string")
    assert df.select(compile_formula(source, df.schema)).first()[0] == want


@pytest.mark.parametrize("source", ["__import__('os')", "row.x = 1", "Math.random()", "x", "row.x.y", "1 ? 2"])
def test_formula_refused(spark, source):
    with pytest.raises(FormulaError):
        compile_formula(source, spark.createDataFrame([(1.0,)], "x double").schema)


def test_pipeline_history():
    p = Pipeline().add(Step("a")).add(Step("b")).undo()
    assert p.cursor == 1 and p.redo().cursor == 2 and p.redo().redo().cursor == 2
    assert [s.op for s in p.add(Step("c")).steps] == ["a", "c"] and p.clear().steps == ()


def test_infer_and_read(spark, tmp_path):
    path = tmp_path / "x.csv"
    body = "code,qty,amount,flag,date,group,note\n" + "".join(f"00{i},{i + 1},{i}.5,{'yes' if i % 2 else 'no'},2026-07-0{i + 1},{'AB'[i % 2]},line {i}\n" for i in range(9)) + "009,10,9.5,yes,2026-07-09,A,line 9\n"
    path.write_text(body)
    raw = readers.read_delimited(spark, str(path))
    kinds = {r["column"]: r["type"] for r in readers.infer_types(raw).collect()}
    assert kinds == {"code": "string", "qty": "integer", "amount": "float", "flag": "boolean", "date": "datetime", "group": "category", "note": "string"}
    df = readers.read_any(spark, str(path))
    assert df.first().code == "000" and df.first().flag is False
    with pytest.raises(ValueError):
        readers.typed(raw, {"note": "integer"})
    (tmp_path / "q.csv").write_text('name,name,memo,empty\nAlice,A,"hello, ""world""\nnext",\n')
    got = readers.read_delimited(spark, str(tmp_path / "q.csv"))
    assert got.columns == ["name", "name_2", "memo", "empty"] and tuple(got.first()) == ("Alice", "A", 'hello, "world"\nnext', None)


def test_read_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>a</t></si><si><t>b</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read_xlsx(spark, str(tmp_path / "b.xlsx")).collect()] == [("1.5", None)]


def test_registry(spark, tmp_path):
    r = Registry(spark)
    key = r.add("My Set", spark.createDataFrame([(1, 2.0), (2, None)], "id int, x double"), "id")
    r.step(key, Step("drop_missing", "x"))
    assert r.sql(f"select count(*) from {key}").first()[0] == 1
    r.move(key, -1)
    assert r.sql(f"select count(*) from {key}").first()[0] == 2
    r.move(key, 1)
    r.save(f"file://{tmp_path}/p")
    assert Registry.load(spark, f"file://{tmp_path}/p").view(key).count() == 1
    again = Registry.load(spark, f"file://{tmp_path}/p")  # load, step, save over itself, load: nothing is lost
    before = again.view(key).collect()
    again.step(key, Step("add_col", "note", {"default": "x"}))
    again.save(f"file://{tmp_path}/p")
    assert "note" in again.view(key).columns and again.view(key).count() == len(before)
    last = Registry.load(spark, f"file://{tmp_path}/p")
    assert last.view(key).drop("note").collect() == before and last.move(key, -1).collect() == before
    last.sets["other"] = last.sets[key]
    last.remove("other")
    last.save(f"file://{tmp_path}/p")
    assert Registry.load(spark, f"file://{tmp_path}/p").view(key).collect() == before
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.name.startswith("manifest")) == ["manifest"] and sum(1 for x in (tmp_path / "p").iterdir()) == 2
    (tmp_path / "p" / "manifest").rename(tmp_path / "p" / "manifest.old")  # a save that broke off between the two renames
    assert Registry.load(spark, f"file://{tmp_path}/p").view(key).collect() == before
    with pytest.raises(ValueError):
        r.remove(key)
    with pytest.raises(ValueError):
        Registry.load(spark, f"file://{tmp_path}/none")


def test_join_keys_of_times_and_large_numbers(spark):
    key = lambda kind, *xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "k string").select(combine.join_key(F.col("k").cast(kind), spark.sql(f"select cast(null as {kind}) as k").schema[0].dataType)).collect()]
    a, b = key("timestamp", "2024-01-01 00:00:00.100", "2024-01-01 00:00:00.900")
    assert a != b and key("string", "2024-01-01T00:00:00.100", "2024-01-01 00:00:00.9") == [a, b]
    assert key("date", "2024-01-01") == key("timestamp", "2024-01-01 00:00:00") == key("string", "2024-01-01")
    assert key("bigint", "9007199254740993") == key("string", "+09007199254740993") == key("decimal(20,2)", "9007199254740993") == ["n:9007199254740993"]
    assert key("string", "9007199254740992") == ["n:9007199254740992"]
    assert key("string", "5", "5.0", " 5 ", "-0", "1.50", "", "0010", "a1") == ["n:5", "n:5", "n:5", "n:0", "n:1.5", None, "n:10", "s:a1"]
    assert key("double", "5", "1.5") == key("decimal(5,3)", "5", "1.5") == ["n:5", "n:1.5"]


def test_share_link():
    assert read_share_link(share_link({"a": [1, "é"]})) == {"a": [1, "é"]}
    with pytest.raises(ValueError):
        share_link({"a": [hash(str(i)) for i in range(9000)]})


def test_json_quoted(spark):
    df = spark.createDataFrame([("a\"b\n", 1), (None, None)], "s string, n int")
    assert [r.line for r in json_quoted_lines(df).collect()] == ['"a\\"b\\n",1', ","]


def test_regions(spark):
    df = spark.createDataFrame([("USA",), (" United   States ",)], "r string")
    assert {r[0] for r in df.select(charts.region_name(F.col("r"))).collect()} == {"united states"}


def test_group_text_merges_blanks(spark):
    df = spark.createDataFrame([(None, 1.0), ("", 2.0)], "k string, x double")
    assert rows(aggregate.group_by(df, ["k"], [("x", "sum", "s")]), "k") == [("", 3.0, 2)]
