"""Streams, maps, formats and sentences."""

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.formats import compact, plain_text, won
from sparkloom.functions.formula import FormulaError, compile_formula
from sparkloom.operators import clean, distributions, learn, series, stats, windows
from sparkloom.operators.components import connected_components
from sparkloom.plans import assistant, charts, geo, insights
from sparkloom.sources import readers
from sparkloom.streaming import event_windows


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.parquet(f"file://{tmp_path}/in", mode="overwrite")
    live = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    how = [("value", "count", "n"), ("value", "max", "top")]
    out = event_windows.windowed(live, "ts", "1 hour", how, ["event_type"])
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    want = event_windows.windowed(batch, "ts", "1 hour", how, ["event_type"])
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, want.collect()))


def test_projection(spark):
    """Seoul City Hall lies near 322 km east and 4,161 km north in zone 52."""
    df = spark.createDataFrame([(37.5665, 126.9780), (0.0, 129.0)], "lat double, lon double")
    east, north = geo.transverse_mercator(F.col("lat"), F.col("lon"))
    got = [tuple(r) for r in df.select(east, north).collect()]
    assert got[0] == pytest.approx((321_400, 4_159_500), rel=2e-3) and got[1] == pytest.approx((500_000, 0), abs=1e-6)


def test_distance(spark):
    df = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert df.first()[0] == pytest.approx(10007.557, rel=1e-4)


def test_places(spark):
    assert geo.coordinate_columns(["name", "LAT", "경도"]) == ("LAT", "경도")
    pts = spark.createDataFrame([(37.5, 127.0), (10.0, 10.0), (None, 1.0)], "lat double, lon double")
    assert geo.points(pts, "lat", "lon", "seoul").count() == 1 and geo.points(pts, "lat", "lon").count() == 2
    regions = spark.createDataFrame([("United States", 1), ("Korea", 2)], "name string, pos int")
    df = spark.createDataFrame([("USA", "x"), ("South Korea", "y"), ("Mars", "z")], "a string, b string")
    assert geo.best_region_column(df, ["b", "a"], regions, "name") == "a"
    assert {(r.key, r.region) for r in geo.region_index(regions, "name", "pos").collect()} == {("united states", "United States"), ("south korea", "Korea")}
    centres = spark.createDataFrame([("Jung", "Seoul", 1.0, 2.0), ("Jung", "Busan", 3.0, 4.0), ("Solo", "Seoul", 5.0, 6.0)], "name string, province string, lat double, lon double")
    asked = spark.createDataFrame([("Jung", "Busan"), ("Solo", "?"), ("Jung", "?")], "m string, p string")
    got = {(r.m, r.p): r.lat for r in geo.centroids(asked, "m", "p", centres).collect()}
    assert got == {("Jung", "Busan"): 3.0, ("Solo", "?"): 5.0, ("Jung", "?"): None}


def test_formats(spark):
    df = spark.createDataFrame([(123456789.0,), (25000.0,), (1500.0,), (12.5,)], "x double")
    assert [r[0] for r in df.select(compact(F.col("x"))).collect()] == ["1.2억", "2.5만", "1.5k", "12.5"]
    assert [r[0] for r in df.limit(2).select(won(F.col("x"))).collect()] == ["12345.7억", "2.5억"]
    assert spark.range(1).select(plain_text(F.lit("<b>a</b>&nbsp;b"))).first()[0] == "a b"


def test_questions():
    assert assistant.intent("show me the trend of sales") == "trend" and assistant.intent("이상치 보여줘") == "outlier" and assistant.intent("?") == "bar"
    assert [assistant.intent(q) for q in ("cluster the rows", "결과 요약", "Top outliers", "월별 매출", "비중", "sum by region")] == ["ml", "last", "outlier", "trend", "mix", "bar"]
    spec = assistant.chart_for("top region by sales", ["region", "kind"], ["cost", "sales"])
    assert (spec.kind, spec.dims, spec.measures[0][0], spec.top) == ("hbar", ("region",), "sales", 10)
    assert assistant.chart_for("outliers", ["a"], ["b"]) is None
    assert assistant.regression_summary({"r2": 0.85, "names": ["intercept", "x", "z"], "p": [0, 0.01, 0.5]}) == "A strong fit (R2 0.850); significant: x."
    assert assistant.classification_summary(0.8) == "good"
    assert [assistant.next_step(*x) for x in ((None,), ("correlation",), ("regression", 0.4), ("regression", 0.9), ("anova",), ("distribution",), ("builder",))] == ["correlation", "regression", "clean", "models", "regression", "clean", "models"]


def test_findings(spark):
    df = spark.createDataFrame([(float(i), float(i * i), None if i == 3 else i) for i in range(20)], "a double, b double, c int")
    got = {(r.kind, r.subject) for r in insights.findings(df, ["a", "b"]).collect()}
    assert got == {("rows", ""), ("missing", "c"), ("correlation", "a~b")}


def test_charts_specs(spark):
    assert charts.missing_fields(charts.ChartSpec("heatmap", ("a",), ())) == (1, 1)
    assert charts.stale(["a", "*", "gone"], spark.createDataFrame([(1,)], "a int")) == ["gone"]
    df = spark.createDataFrame([("x", 1.0), ("y", 0.0)], "k string, v double")
    r = charts.kpi_widget(df, "SUM(v) / COUNT(*)", ("k", "x")).first()
    assert (r.value, r.whole, r.pct) == (1.0, 0.5, 200.0)
    assert len(charts.default_widgets(["k"], ["v"], [])) == 7 or charts.default_widgets(["k"], ["v"], [])


def test_pacf():
    r = [1.0, 0.5, 0.25, 0.125]
    assert series.pacf(r) == pytest.approx([1.0, 0.5, 0.0, 0.0])


def test_cross_validation(spark):
    df = spark.createDataFrame([(i, float(i), 3.0 * i + 1) for i in range(40)], "id int, x double, y double")

    def score(train, test):
        m = stats.ols(train, "y", ["x"])
        return learn.regression_metrics(test.select("*", learn.linear_predict(m)), "y", "prediction").first().r2

    got = learn.cross_validate(df, "id", 4, score)
    assert len(got["scores"]) == 4 and got["mean"] == pytest.approx(1) and got["std"] == pytest.approx(0, abs=1e-9)


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "z")], "u string, v string")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "z": "z"}


def test_workbook_dates_and_sheet_names(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda at, v, s=0: f'<c r="{at}" s="{s}"><v>{v}</v></c>'
    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = lambda *rows: f"<worksheet {main}><sheetData>" + "".join(f'<row r="{i}">{r}</row>' for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    path = str(tmp_path / "d.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="First" sheetId="1" r:id="rId2"/><sheet name="둘째" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;y&quot;mm"/><numFmt numFmtId="165" formatCode="[Red]0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(text("A1", "only")))
        z.writestr("xl/worksheets/sheet2.xml", sheet(text("A1", "d") + text("B1", "t") + text("C1", "n"), cell("A2", 45292, 1) + cell("B2", 45292.5000116, 2) + cell("C2", 7.5, 3)))
    assert readers.sheet_names(spark, path) == ["First", "둘째"]
    assert [tuple(r) for r in readers.read_xlsx(spark, path).collect()] == [("2024-01-01", "2024-01-01 12:00:01.002", "7.5")]
    assert readers.read_xlsx(spark, path, "둘째").columns == ["only"] and readers.read_xlsx(spark, path, "First").count() == 1
    with pytest.raises(ValueError, match="no sheet"):
        readers.read_xlsx(spark, path, "third")


def test_conversion_errors_name_the_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,d\n1,2024-01-01\n2,x\nthree,2024-02-30\n")
    df = readers.read_delimited(spark, str(tmp_path / "a.csv"))
    with pytest.raises(ValueError, match="n, row 3: 'three' to integer, d, row 2: 'x' to datetime"):
        readers.typed(df, {"n": "integer", "d": "datetime"})


def test_delimited_files_are_split_unless_cells_span_lines(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"x ""y"""\n2,z\n')
    (tmp_path / "spanning.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    for name, cell in (("plain", 'x "y"'), ("spanning", "x\ny")):
        assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / f"{name}.csv")).collect()] == [("1", cell), ("2", "z")]


def test_region_names(spark):
    pairs = {"서울특별시": "서울", "Seoul ": "서울", "성남시": "성남", "강남구": "강남", "제주도": "제주", "세종": "세종", "경기 도": "경기", "USA": "united states", "대한민국": "south korea", "New-York.": "new york", "  Viet   Nam": "viet nam", "중구": "중구", "": ""}
    got = spark.createDataFrame([(k,) for k in pairs], "l string").select("l", charts.region_name(F.col("l")).alias("k")).collect()
    assert {r.l: r.k for r in got} == pairs
    known = spark.createDataFrame([("서울",), ("South Korea",)], "n string")
    assert [r.label for r in charts.unmatched(spark.createDataFrame([("Seoul",), ("한국",), ("nowhere",), (None,)], "l string"), "l", known, "n").collect()] == ["nowhere"]


def test_formulas_with_words_of_other_languages(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x?y")], "`class` double, `from` double, `in` string")
    of = lambda f: df.select(compile_formula(f, df.schema).alias("v")).first().v
    assert of("row.class + row.from * 2") == 5.0 and of("row.in === 'x?y' ? row . class : 0") == 1.0 and of('row["from"] > 1 && !(row.class > 1)') is True
    for bad in ("1 if row.class else 2", "row.class and 1", "not 1", "7 // 2", "row.class in [1]", "None", "~1"):
        with pytest.raises(FormulaError):
            of(bad)


def test_as_of_join_odd(spark):
    """A hot key over many ranges, keys without a match, null keys and times, repeated times."""
    rng = random.Random(5)
    left = [(i, None if i % 97 == 0 else "hot" if i % 3 else f"k{i % 7}", None if i % 89 == 0 else rng.randrange(500)) for i in range(1, 900)]
    right = [(None if i % 50 == 0 else "hot" if i % 2 else f"k{i % 5}", None if i % 41 == 0 else rng.randrange(20, 480), i) for i in range(1, 120)]
    got = windows.as_of_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, rt int, v int"), ["k"], "t", "rt", ["v"])
    want = {}
    for i, k, t in left:
        past = [(rt, v) for rk, rt, v in right if k is not None and rk == k and t is not None and rt is not None and rt <= t]
        want[i] = max(past)[1] if past else None
    assert {r.id: r.v for r in got.collect()} == want
    none = spark.createDataFrame([], "k string, rt int, v int")
    assert windows.as_of_join(spark.createDataFrame(left, "id int, k string, t int"), none, ["k"], "t", "rt", ["v"]).where("v is null").count() == len(left)


def test_spearman_matrix_with_gaps(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 4 else float(-i), 1.0) for i in range(10)], "id int, a double, b double, c double")
    got = {(r.a, r.b): (r.rho, r.n) for r in windows.spearman_matrix(df, ["a", "b", "c"], "id").collect()}
    assert len(got) == 9 and got["a", "b"] == got["b", "a"] and got["a", "b"][0] == pytest.approx(-1) and got["a", "b"][1] == 9
    assert got["b", "b"] == (1.0, 9) and got["c", "a"][0] == pytest.approx(1)  # ties in the order of id


def test_normal_distribution_function(spark):
    z = [-8.0, -1.96, -0.5, 0.0, 0.5, 1.0, 3.0, 8.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", distributions.normal_cdf_column(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.z / math.sqrt(2)))) < 2e-7 for r in got)


def test_types_by_bounded_counts(spark):
    rows = [(f"c{i % 30}", f"s{i % 31}", f"u{i}", "x", None) for i in range(200)]
    df = spark.createDataFrame(rows, "thirty string, more string, unique string, one string, none string")
    assert {r.column: r.type for r in readers.infer_types(df).collect()} == {"thirty": "category", "more": "string", "unique": "string", "one": "category", "none": "string"}
    assert {r.type for r in readers.infer_types(df.limit(0)).collect()} == {"string"}


def test_clipboard_and_names():
    assert readers.paste_block("a\tb\r\n1\t\r\n") == [["a", "b"], ["1", ""]]
    assert readers.paste_block(None) == readers.paste_block("") == readers.paste_block("\n") == []
    assert clean.free_name(["new_col", "new_col_2"]) == "new_col_3" and clean.free_name([]) == "new_col"


def test_analysis_by_types(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), 4.0 * i, "ab"[i % 2], "xyz"[i % 3]) for i in range(30)], "a double, b double, c double, g string, h string")
    kinds = {"a": "float", "b": "float", "c": "float", "g": "category", "h": "category"}
    asked = lambda *a: stats.analyse(df, *a, kinds)["type"]
    assert asked("b", ["a", "g"]) == "regression" and asked("b", ["g"]) == "anova" and asked("g", ["h"]) == "chi_square"
    assert asked("b", ["a", "c"]) == "unavailable" and asked("g", ["a"]) == "unsupported" and asked("b", ["gone"]) == "unsupported"


def test_scores_of_models(spark):
    df = spark.createDataFrame([(i, float(i), 3.0 * i + 1, 2.0 * i, "lo" if i < 20 else "hi") for i in range(40)], "id int, x double, y double, z double, c string")
    assert learn.cross_validate(df, "id", 4, learn.linear_score("y", ["x"]))["mean"] == pytest.approx(1)
    assert learn.cross_validate(df, "id", 4, learn.linear_score("y", ["x", "z"])) == {"scores": [None] * 4, "mean": None, "std": None}
    assert learn.cross_validate(df, "id", 4, learn.bayes_score("c", ["x"]))["mean"] > 0.9
    assert learn.binary_metrics(df.select(F.lit(0).alias("actual"), F.lit(None).cast("int").alias("predicted"))).first().asDict() == {"tp": 0, "fp": 0, "tn": 40, "fn": 0, "accuracy": 1.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_joint_outliers(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5) if i else 90.0) for i in range(60)], "id int, a double, b double")
    far, why = clean.joint_outliers(df, ["a", "b"])
    assert [r.id for r in far.collect()] == [0] and why is None
    assert clean.joint_outliers(df, ["a"]) == (None, "two columns are needed at least")
    assert clean.joint_outliers(df.withColumn("c", F.col("a") * 2), ["a", "c"]) == (None, "singular covariance")


def test_radar_and_heatmap_odd(spark):
    df = spark.createDataFrame([(f"k{i:02}", "s", None if i == 1 else float(-i)) for i in range(20)], "k string, s string, v double")
    spec = charts.ChartSpec("radar", ("k",), (("v", "sum", "v"), ("v", "count", "n")))
    got = charts.radar(df, spec).collect()
    assert len(got) == 24 and {(r.axis, r.top) for r in got} == {("v", 1.15), ("n", 1.15)}
    with pytest.raises(ValueError):
        charts.radar(df, charts.ChartSpec("radar", ("k",), (("v", "sum", "v"),)))
    assert charts.heatmap(df.limit(0), charts.ChartSpec("heatmap", ("k", "s"), (("v", "sum", "v"),))).count() == 0


def test_suggestions_and_class_lines(spark):
    df = spark.createDataFrame([(i, i % 3, float(i), "d") for i in range(60)], "id int, k int, v double, one string")
    assert assistant.grouping(df, ["id", "k", "one"]) == "k" and assistant.grouping(df, ["id"]) == "id" and assistant.grouping(df, []) is None
    assert assistant.suggestions(df, ["id", "k"], ["v", "id"], ["one"]) == [("bar", "v", "k"), ("top", "v", "k"), ("mix", None, "k"), ("outlier", "v", None), ("trend", "v", "one"), ("correlation", None, None)]
    assert assistant.suggestions(df, [], []) == [("last", None, None)]
    said = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "actual string, predicted string")
    lines = {r["class"]: r.line for r in assistant.class_lines(learn.class_metrics(said)).collect()}
    assert lines == {"a": "P=50%/R=50%", "b": "P=50%/R=100%", "c": "P=0%/R=0%"} and assistant.class_lines(learn.class_metrics(said), 2).count() == 0
