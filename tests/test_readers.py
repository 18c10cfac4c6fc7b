"""Ragged delimited files and JSON arrays read in pieces, against Python's own parsers; orders of a locale."""

import csv
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import clean
from sparkloom.operators.pivot import PivotSpec, tuples, wide
from sparkloom.plans import charts
from sparkloom.sources import readers
from sparkloom.sources.registry import export_quoted


def test_ragged_rows(spark, tmp_path):
    """Blank rows before the header, short rows and rows wider than it."""
    text = '\n,,\n" ",\n﻿name,n,\nx,1\n,,,\ny,2,3,"4, ""q""",5\nz\n,,,,,6\n'
    (tmp_path / "a.csv").write_text(text)
    df = readers.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["name", "n", "Column_3", "Column_4", "Column_5", "Column_6"]
    assert [tuple(r) for r in df.collect()] == [("x", "1", None, None, None, None), ("y", "2", "3", '4, "q"', "5", None), ("z", None, None, None, None, None), (None, None, None, None, None, "6")]


@pytest.mark.parametrize("over_lines", [False, True])
def test_ragged_rows_of_many_splits(spark, tmp_path, over_lines):
    rng = random.Random(3)
    rows = [[], ["", " "], ["a", "b"]] + [[rng.choice(["", "v", 'q"t', "c,d", "l\nm" if over_lines else "lm", str(rng.random())]) for _ in range(rng.randrange(0, 7))] for _ in range(3000)]
    with open(tmp_path / "m.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        df = readers.read_delimited(spark, str(tmp_path / "m.csv"))
        got = [tuple(r) for r in df.collect()]
        if not over_lines:
            assert spark.read.text(str(tmp_path / "m.csv")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    width = max(len(r) for r in rows)
    want = [tuple(x if x.strip() else None for x in r + [""] * (width - len(r))) for r in rows if any(x.strip() for x in r)][1:]
    assert df.columns == ["a", "b", *[f"Column_{i}" for i in range(3, width + 1)]] and got == want


def test_headers_of_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"\na,b\n{k},x\n{k},y\n")
    df = readers.read_delimited(spark, str(tmp_path))
    assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect())) == [(str(k), v) for k in range(3) for v in "xy"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("\n \n")
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path / "none"))


ODD = ['plain', 'a "quoted" text', "back\\slash", 'end\\"', "{brace}", "}{", "[1]", "new\nline", "é 日本", "", "\\", 'x"}]', "},{"]


def test_json_array_in_pieces(spark, tmp_path):
    """Braces, brackets and quotes in texts and nested values, over many splits of one file."""
    rng = random.Random(9)
    items = [{"z": i, "name": rng.choice(ODD), **({"a b": {"k": rng.choice(ODD), "l": [{"m": rng.choice(ODD)}]}} if i % 3 == 0 else {}), **({"n": i / 2} if i % 4 else {}), **({"ok": i % 2 == 0} if i > 5 else {"o'k": None}), **({"mixed": rng.choice([1, "x", True])})} for i in range(2000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16384)
    try:
        for indent in (None, 1):
            path = str(tmp_path / f"{indent}.json")
            with open(path, "w") as f:
                f.write("﻿ " + json.dumps(items, indent=indent, ensure_ascii=False) + "\n")
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 4
            df = readers.read_json(spark, path)
            assert df.columns == ["z", "name", "a b", "o'k", "mixed", "n", "ok"]
            assert dict(df.dtypes) == {"z": "bigint", "name": "string", "a b": "string", "o'k": "string", "mixed": "string", "n": "double", "ok": "boolean"}
            got = {r.z: r for r in df.collect()}
            assert len(got) == len(items)
            for x in items:
                r = got[x["z"]]
                assert r["name"] == (x["name"] if x["name"].strip() else None) and r.n == x.get("n") and r.ok == x.get("ok")
                assert (json.loads(r["a b"]) if r["a b"] else None) == x.get("a b") and r.mixed == {True: "true"}.get(x["mixed"] if x["mixed"] is True else None, str(x["mixed"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text, row", [('[{"a": 1}, 2, {"a": 3}]', 2), ('[{"a": 1}, {"a": 2}, {"a" 3}]', 3), ('[{"a": 1}, [2]]', 2), ('[[{"a": 1}]]', 1), ('{"a": 1}\nnope\n', 2), ('[{"a": 1}', 2), ("[]", None), ("[{}]", None), ("", None)])
def test_json_errors_name_their_row(spark, tmp_path, text, row):
    (tmp_path / "e.json").write_text(text)
    with pytest.raises(ValueError, match=f"row {row} must be an object" if row else "non-empty"):
        readers.read_json(spark, str(tmp_path / "e.json"))


def test_preview(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as k").repartition(5)
    shown = readers.preview(df, 3).collect()
    assert len(shown) == 3 and {r.n_rows for r in shown} == {1000} and readers.preview(df.limit(0)).count() == 0


def test_json_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"b": 1, "a": "x"}\n\n{"c": [1, 2], "a": " "}\n')
    df = readers.read_json(spark, str(tmp_path / "l.json"))
    assert df.columns == ["b", "a", "c"] and sorted(map(tuple, df.collect()), key=str) == [(1, "x", None), (None, None, "[1,2]")]


# ---- orders of a locale


def test_orders_of_a_locale(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["b", "A", "a", "B", "가", "z", "ä", "나", None])], "id long, x string")
    page = lambda **k: [r.x for r in charts.sorted_page(df, "x", "id", 0, **k).collect()]
    assert page() == ["A", "B", "a", "b", "z", "ä", "가", "나", None]
    assert page(locale="UNICODE") == ["a", "A", "ä", "b", "B", "z", "가", "나", None]
    assert page(locale="ko", descending=True) == ["z", "B", "b", "ä", "A", "a", "나", "가", None]
    assert [r.x for r in tuples(df, ["x"], "ko").orderBy("place").collect()] == ["", "가", "나", "a", "A", "ä", "b", "B", "z"]
    cells = wide(df.where("x is not null").withColumn("n", F.lit(1)), PivotSpec((), ("x",), (("n", "sum"),)))
    assert [c[0] for c in cells.columns if not c.startswith("total")] == ["a", "A", "ä", "b", "B", "z", "가", "나"]


# ---- workbooks


def test_a_long_sheet_in_order(spark, tmp_path):
    """Rows of several batches keep their order, short rows and blank ones too; an empty sheet is left out of the previews."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda at, n, v: f'<c r="{at}{n}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [f'<row r="1">{cell("A", 1, " ")}</row>', f'<row r="2">{cell("A", 2, "id")}{cell("B", 2, "v")}</row>']
    rows += [f'<row r="{i}">{cell("A", i, i)}{cell("D", i, "wide") if i % 1000 == 0 else ""}</row>' for i in range(3, 5003)]
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(rows)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData></sheetData></worksheet>")
    path = str(tmp_path / "w.xlsx")
    df = readers.read_xlsx(spark, path)
    assert df.columns == ["id", "v", "Column_3", "Column_4"]
    assert [(r.id, r.Column_4) for r in df.collect()] == [(str(i), "wide" if i % 1000 == 0 else None) for i in range(3, 5003)]
    with pytest.raises(ValueError):
        readers.read_xlsx(spark, path, "Sheet2")
    shown = readers.preview_sheets(spark, path, 2)
    assert list(shown) == ["Sheet1"] and [(r.id, r.n_rows) for r in shown["Sheet1"].collect()] == [("3", 5000), ("4", 5000)]


def test_export_with_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\\', None), (2, None, 2.5)], "n long, `the name` string, x double").coalesce(1)
    assert export_quoted(df, str(tmp_path / "out")) and not export_quoted(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ['"n","the name","x"', '1,"a \\"b\\"\\\\",', "2,,2.5"]


def test_change_of_type_changes_the_role(spark):
    df = spark.range(1).withColumn("s", F.lit("x"))
    meta = lambda kind: clean.Pipeline().add(clean.Step("change_type", "s", {"type": kind})).apply(df, "id").schema["s"].metadata
    assert meta("float") == {"type": "float", "role": "measure"} and meta("category")["role"] == "dimension"
