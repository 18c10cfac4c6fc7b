"""Readers of CSV, TSV, JSON, XLSX and Parquet, with type inference over whole columns by one aggregate pass."""

from __future__ import annotations

import contextlib
import csv
import datetime
import io
import itertools
import re
import unicodedata
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, FractionalType, IntegralType, StringType, StructField, StructType, TimestampType

from sparkloom.functions.values import all_of, blank_trimmed
from sparkloom.operators.order import numbered, running_sums
from sparkloom.plans.storage import materialise

TYPES = ("boolean", "integer", "float", "datetime", "category", "string")
FORMATS = ("csv", "tsv", "json", "xlsx", "parquet")
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DATETIME = r"^\d{4}-\d{2}-\d{2}([T ][0-9:.+-]+Z?)?$"


@dataclass(frozen=True)
class ColumnMeta:
    """The logical type of a column, its role, and how a measure is aggregated by default."""

    key: str
    type: str
    role: str
    agg: str | None


def role_of(kind: str) -> str:
    return "measure" if kind in ("integer", "float") else "dimension"


def column_meta(key: str, kind: str) -> ColumnMeta:
    return ColumnMeta(key, kind, role_of(kind), "sum" if role_of(kind) == "measure" else None)


def logical_type(kind: DataType) -> str:
    if isinstance(kind, BooleanType):
        return "boolean"
    if isinstance(kind, IntegralType):
        return "integer"
    if isinstance(kind, FractionalType):
        return "float"
    return "datetime" if isinstance(kind, (DateType, TimestampType)) else "string"


def header(names: Sequence[str | None]) -> list[str]:
    """Trimmed names; blank ones are Column_i, repeated ones get _2, _3, ..."""
    out: list[str] = []
    for i, raw in enumerate(names, 1):
        name, k = (raw or "").strip() or f"Column_{i}", 2
        unique = name
        while unique in out:
            unique, k = f"{name}_{k}", k + 1
        out.append(unique)
    return out


def slug(name: str) -> str:
    """NFKC, everything but letters, digits and Hangul an underscore, lower case."""
    return re.sub(r"[^A-Za-z0-9가-힣]+", "_", unicodedata.normalize("NFKC", name)).strip("_").lower()


def _flags(c: Column) -> dict[str, Column]:
    t = F.trim(c)
    return {
        "boolean": F.lower(t).isin("true", "yes", "false", "no"),
        "integer": t.rlike(r"^[+-]?(0|[1-9]\d*)$"),
        # only what looks like a number is cast: a cast that fails costs an exception
        "float": t.rlike(_FLOAT) & ~t.rlike(r"^0\d") & (F.abs(t.try_cast("double")) < float("inf")),
        "datetime": t.rlike(_DATETIME) & t.try_cast("timestamp").isNotNull(),
    }


def infer_types(df: DataFrame) -> DataFrame:
    """column and type of every column of texts: the first of boolean, integer, float, datetime that all values are; else a
    category (at most 30 distinct values and a fifth of all), else a string.

    One pass sketches the distinct values; so few values are counted by the sketch without loss or a little under, so those
    beyond twice 30 are no category. Only columns that may be one are counted exactly, by a second pass; no pass expands all columns.
    """
    texts = {name: F.when(~blank_trimmed(F.col(f"`{name}`")), F.trim(F.col(f"`{name}`"))) for name in df.columns}
    cells = []
    for name, t in texts.items():
        kind = F.when(F.count(t) == 0, "string")
        for label, flag in _flags(F.col(f"`{name}`")).items():
            kind = kind.when(F.count_if(t.isNotNull() & ~flag) == 0, label)
        cells.append(F.struct(kind.alias("kind"), F.count(t).alias("n"), F.approx_count_distinct(t, 0.02).alias("about")))
    seen = dict(zip(texts, df.agg(F.array(*cells).alias("r")).first().r))
    open_ = [name for name, s in seen.items() if s.kind is None and s.about <= 60]
    few = dict(zip(open_, df.agg(*[F.count_distinct(texts[name]) for name in open_]).first())) if open_ else {}
    named = lambda name, s: s.kind or ("category" if name in few and few[name] <= min(30, 0.2 * s.n) else "string")
    return df.sparkSession.createDataFrame([(name, named(name, s)) for name, s in seen.items()], "column string, type string")


def paste_block(text: str | None) -> list[list[str]]:
    """The cells of a block of tab-separated lines from the clipboard, whose last line break counts for nothing; they feed ``set_cells``."""
    lines = re.sub(r"\r\n?", "\n", text or "").removesuffix("\n")
    return [line.split("\t") for line in lines.split("\n")] if lines else []


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns converted to their types, blanks null. A value that doesn't convert raises ValueError with an example of each such column."""
    made: dict[str, Column] = {}
    for name, kind in kinds.items():
        if kind not in TYPES:
            raise ValueError(f"unknown type {kind}")
        c = F.trim(F.col(f"`{name}`"))
        value = F.when(~blank_trimmed(F.col(f"`{name}`")), c)
        made[name] = {"boolean": F.when(F.lower(value).isin("true", "yes"), True).when(F.lower(value).isin("false", "no"), False), "integer": value.try_cast("long"), "float": value.try_cast("double"), "datetime": F.when(value.try_cast("timestamp").isNotNull(), value)}.get(kind, value)
    failed = df.agg(*[F.min(F.when(~blank_trimmed(F.col(f"`{n}`")) & made[n].isNull(), F.col(f"`{n}`"))).alias(n) for n in kinds]).first()
    bad = {n: failed[n] for n in kinds if failed[n] is not None}
    if bad:
        # only now rows are numbered, in the order in which they were read
        placed = numbered(df.withColumn("__read", F.monotonically_increasing_id()), ["__read"], "__row")
        fails = lambda n: ~blank_trimmed(F.col(f"`{n}`")) & made[n].isNull()
        first = placed.agg(*[F.min(F.when(fails(n), F.struct("__row", F.col(f"`{n}`").alias("v")))).alias(n) for n in bad]).first()
        raise ValueError("Cannot convert: " + ", ".join(f"{n}, row {first[n]['__row']}: {first[n]['v']!r} to {kinds[n]}" for n in bad))
    return df.select(*[made[n].alias(n) if n in made else F.col(f"`{n}`") for n in df.columns])


def _clean_rows(df: DataFrame) -> DataFrame:
    """Without all-blank rows; blank cells null."""
    held = df.select(*[F.when(~blank_trimmed(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return held.where(~all_of([F.col(f"`{c}`").isNull() for c in held.columns]))


#: Files whose header rows are broadcast at most; they were counted.
BROADCAST_FILES = 10_000


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multiline: bool | None = None) -> DataFrame:
    """All columns as text; quotes are doubled inside quoted cells, which may span lines.

    The first row of a file that is not blank is its header; the widest row says how many columns there are, and cells that a row
    has not are null. Blank rows are left out.

    A file with cells over several lines can't be split, so that mode is on only where one occurs: a line with an odd number
    of quotes. One pass over the lines looks for it, unless the caller says; one over the parsed rows finds headers and width.
    """
    if multiline is None:
        multiline = not spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1).isEmpty()
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": multiline, "header": False, "enforceSchema": True}
    n = len(spark.read.options(**options).csv(path).columns)  # of the first row
    if not n:
        raise ValueError("the file is empty")
    at = {"__file": F.col("_metadata.file_path"), "__at": F.monotonically_increasing_id()}
    names = [f"c{i}" for i in range(n)]
    schema = StructType([StructField(c, StringType()) for c in (*names, "__odd")])  # __odd: the row as written, where it has more or fewer cells
    rows = spark.read.options(**options, columnNameOfCorruptRecord="__odd").schema(schema).csv(path).withColumns(at)
    loose = F.regexp_replace("__odd", '"[^"]*"', "")
    blank_row = all_of([blank_trimmed(F.col(c)) | F.col(c).isNull() for c in names]) & F.coalesce(F.translate("__odd", sep + '" \t\r\n', "") == "", F.lit(True))
    width = F.greatest(F.lit(n), F.coalesce(F.length(loose) - F.length(F.replace(loose, F.lit(sep))) + 1, F.lit(0)))
    heads = rows.where(~blank_row).groupBy("__file").agg(F.min(F.struct("__at", F.col("__odd").alias("odd"), F.array(*names).alias("cells"))).alias("head"), F.max(width).alias("width"))
    heads = materialise(heads.select("__file", "head.__at", "head.odd", "head.cells", "width"), "headers")  # one row for each file
    first = heads.orderBy("__at").first()
    if first is None:
        raise ValueError("the file is empty")
    width = heads.agg(F.max("width")).first()[0]
    told = next(csv.reader([first.odd], delimiter=sep)) if first.odd is not None else list(first.cells)
    named = header([(x or "").lstrip("\ufeff") for x in (*told, *[None] * (width - len(told)))])
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(width)])
    body = spark.read.options(**options).schema(schema).csv(path).withColumns(at)
    side = heads.select("__file", "__at")
    kept = body.join(F.broadcast(side) if heads.count() <= BROADCAST_FILES else side, ["__file", "__at"], "left_anti")
    return _clean_rows(kept.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(named)]))


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """at (in the order of the file) and text of each element of an array of objects; the file is split between tasks at its closing braces.

    Whether a brace stands in a text, and how deep it lies, follow from running sums of quotes and brackets over the pieces.
    """
    pieces = spark.read.option("lineSep", "}").text(path).withColumn("__at", F.monotonically_increasing_id())
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x)))
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # no escaped quotes
    quoted = running_sums(pieces.withColumn("__plain", plain).withColumn("__q", count(F.col("__plain"), '"')), {"__quotes": "__q"}, ["__at"])
    begun = (F.col("__quotes") - F.col("__q")) % 2 == 1
    bare = F.regexp_replace(F.when(begun, F.regexp_replace("__plain", r'^[^"]*"?', "")).otherwise(F.col("__plain")), r'"[^"]*(?:"|\z)', "")
    closed = F.col("__quotes") % 2 == 0  # the brace at the end of the piece is no text
    deep = quoted.withColumn("__bare", bare).withColumn("__d", count(F.col("__bare"), "{") + count(F.col("__bare"), "[") - count(F.col("__bare"), "]") - closed.cast("int"))
    placed = running_sums(deep.select("__at", "value", "__d", closed.alias("__closed")), {"__depth": "__d"}, ["__at"])
    ends = placed.withColumn("__end", (F.col("__closed") & (F.col("__depth") == 1)).cast("int"))
    named = running_sums(ends.select("__at", "value", "__end"), {"__ends": "__end"}, ["__at"])
    held = named.groupBy((F.col("__ends") - F.col("__end")).alias("at")).agg(F.array_sort(F.collect_list(F.struct("__at", "value"))).alias("p"), F.max("__end").alias("whole"))
    text = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["value"]), "}"), r"^\ufeff?\s*[\[,]\s*", "")
    return held.select("at", F.when(F.col("whole") == 1, F.concat(text, F.lit("}"))).otherwise(F.array_join(F.transform("p", lambda x: x["value"]), "}")).alias("text"), (F.col("whole") == 1).alias("whole"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or one object a line: columns in the order in which keys first appear, nested values as JSON text, blanks null.

    Elements are kept as text and read as VARIANT, so no schema has to be found before. What is no object raises
    ValueError with the number of its row. A key is a column of whole numbers, numbers or truths if all of its values are, else of texts.
    """
    first = next((r.value for r in spark.read.text(path).where(F.trim("value") != "").limit(1).collect()), "")
    array = first.lstrip("\ufeff \t").startswith("[")
    if array:
        found = _objects(spark, path)
    else:
        found = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"), F.lit(None).cast("boolean").alias("whole"))
    found = materialise(found.withColumn("v", F.expr("try_parse_json(text)")), "objects")
    rows = found.where(F.coalesce("whole", F.lit(True)))
    bad = rows.where(F.col("v").isNull() | ~F.ltrim("text").startswith("{")).agg(F.min("at")).first()[0]
    if bad is not None:
        raise ValueError(f"JSON row {rows.where(F.col('at') <= bad).count()} must be an object")
    if array:
        rest = [r.text for r in found.where("not whole").select("text").limit(2).collect()]  # what follows the last object
        if len(rest) != 1 or not re.fullmatch(r"\ufeff?\s*\[?\s*\]\s*", rest[0]):
            raise ValueError(f"JSON row {rows.count() + 1} must be an object")
    seen = rows.select("at", F.posexplode(F.json_object_keys("text")).alias("k", "key")).groupBy("key").agg(F.min(F.struct("at", "k")).alias("first"))
    keys = [r.key for r in seen.orderBy("first").select("key").limit(MAX_KEYS + 1).collect()]
    if not keys:
        raise ValueError("JSON must be a non-empty array of objects")
    if len(keys) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys")

    def path_of(key: str) -> str:
        mark = '"' if "'" in key else "'"
        if mark in key:
            raise ValueError(f"a key with both kinds of quotes: {key}")
        return f"$[{mark}{key}{mark}]"

    at = {k: F.variant_get("v", path_of(k), "variant") for k in keys}
    kinds = rows.agg(*[F.schema_of_variant_agg(v).alias(f"k{i}") for i, v in enumerate(at.values())]).first()
    cast = lambda k: "boolean" if k == "BOOLEAN" else "long" if k == "BIGINT" else "double" if k == "DOUBLE" or k.startswith("DECIMAL") else "string"
    made = [F.variant_get("v", path_of(k), cast(kind)) for k, kind in zip(keys, kinds)]
    return rows.select(*[(F.when(~blank_trimmed(c), c) if cast(kind) == "string" else c).alias(k) for k, kind, c in zip(keys, kinds, made)])


#: Columns of a JSON file at most.
MAX_KEYS = 10_000


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format shows a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[.*?\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{{{_NS['m']}}}numFmt")}
    shows = lambda k: 14 <= k <= 22 or 45 <= k <= 47 or re.search("[ymdhs]", own.get(k, ""), re.IGNORECASE) is not None
    cells = root.find("m:cellXfs", _NS)
    return {i for i, x in enumerate(cells if cells is not None else ()) if shows(int(x.get("numFmtId", "0")))}


def _moment(serial: str, from_1904: bool) -> str:
    """The ISO text of a day number and its fraction; days before March 1900 are off by one there, as everywhere."""
    when = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
    when += datetime.timedelta(milliseconds=round(float(serial) * 86_400_000))
    return when.strftime("%Y-%m-%d") if when.time() == datetime.time() else when.isoformat(" ", "milliseconds" if when.microsecond else "seconds")


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """The names of a workbook's sheets, in order."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    yield pa.RecordBatch.from_pydict({"names": [[name for name, _ in _sheets(z)]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(names, "names array<string>").first().names


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and file of each sheet in the workbook's order; by number where the workbook doesn't say."""
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(z.namelist()):
        return [(f"Sheet{i}", n) for i, n in enumerate(files, 1)]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    told = [(s.get("name"), targets.get(s.get(f"{{{_REL}}}id"), "")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")]
    return [(name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in told]


#: Rows of a sheet that a task hands on at a time.
SHEET_ROWS = 2000


def _cells(content: bytes, sheet: int | str) -> Iterator[list[str | None]]:
    """The rows of one sheet of a workbook that are not blank, one at a time; dates in ISO form."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        dated, book = _date_styles(z), z.read("xl/workbook.xml") if "xl/workbook.xml" in z.namelist() else b""
        from_1904 = re.search(rb'date1904\s*=\s*"(1|true)"', book) is not None
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheets = _sheets(z)
        if isinstance(sheet, str) and sheet not in dict(sheets):
            raise ValueError(f"no sheet named {sheet}")
        with z.open(dict(sheets)[sheet] if isinstance(sheet, str) else sheets[sheet][1]) as body:
            for _, row in ElementTree.iterparse(body):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                cells: dict[int, str] = {}
                for c in row.findall("m:c", _NS):
                    at = reduce(lambda n, ch: n * 26 + ord(ch) - 64, re.match(r"[A-Z]+", c.get("r")).group(), 0) - 1
                    value, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                    if c.get("t") == "inlineStr" and inline is not None:
                        cells[at] = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t"))
                    elif value is not None and c.get("t", "n") == "n" and int(c.get("s", "0")) in dated:
                        cells[at] = _moment(value.text, from_1904)
                    elif value is not None:
                        cells[at] = strings[int(value.text)] if c.get("t") == "s" else {"1": "true", "0": "false"}[value.text] if c.get("t") == "b" else value.text
                row.clear()
                if any(v.strip() for v in cells.values()):
                    yield [cells.get(i) for i in range(max(cells) + 1)]


def read_xlsx(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """One sheet of a workbook, by place or name, from any store that Spark reads; all columns as text, dates in ISO form.

    A workbook is unpacked by one task, row by row, and written; its first row that is not blank is the header, the widest says
    how many columns there are.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows, n = _cells(raw.as_py(), sheet), 0
                while some := list(itertools.islice(rows, SHEET_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(some)), pa.int64()), pa.array(some, pa.list_(pa.string()))], ["n", "cells"])
                    n += len(some)

    book = spark.read.format("binaryFile").load(path).select("content")
    try:
        rows = materialise(book.mapInArrow(unpacked, "n long, cells array<string>"), "sheet")
    except PythonException as wrong:
        if found := re.search(r"ValueError: (no sheet named [^\n]*)", str(wrong)):
            raise ValueError(found[1]) from None
        raise
    first, width = rows.where("n = 0").first(), rows.agg(F.max(F.size("cells"))).first()[0]
    if first is None:
        raise ValueError("the sheet is empty")
    names = header([*first.cells, *[None] * (width - len(first.cells))])
    return _clean_rows(rows.where("n > 0").select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)]))


def preview_sheets(spark: SparkSession, path: str, rows: int = 20) -> dict[str, DataFrame]:
    """For each sheet that is not empty its first rows and their number, as ``preview`` gives them."""
    out = {}
    for name in sheet_names(spark, path):
        with contextlib.suppress(ValueError):  # an empty sheet
            out[name] = preview(read_xlsx(spark, path, name), rows)
    return out


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension; texts get their inferred types."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError("Supported formats: " + ", ".join(x.upper() for x in FORMATS))
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return read_json(spark, path)
    df = read_xlsx(spark, path) if kind == "xlsx" else read_delimited(spark, path, "\t" if kind == "tsv" else ",")
    return typed(df, {r["column"]: r["type"] for r in infer_types(df).collect()})


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows in the order in which they were read, each with n_rows, the number of all: a preview, not a sample."""
    first = df.withColumn("__read", F.monotonically_increasing_id()).orderBy("__read").limit(rows).drop("__read")
    return first.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_rows"))))  # one row
