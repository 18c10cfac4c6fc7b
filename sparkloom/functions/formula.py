"""Row formulas and KPI formulas compiled to Spark columns.

A formula is read by Python's own expression parser after its operators are spelled the Python way, and
only arithmetic, comparisons, logic, column references, numbers, texts and a fixed list of functions
pass; anything else is a FormulaError. Nothing is evaluated on the driver.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from sparkloom.functions.values import text


class FormulaError(ValueError):
    """A formula that doesn't compile."""


#: The mathematical constants of formulas.
CONSTANTS = {"PI": math.pi, "E": math.e, "LN2": math.log(2), "LN10": math.log(10), "LOG2E": math.log2(math.e), "LOG10E": math.log10(math.e), "SQRT2": math.sqrt(2), "SQRT1_2": math.sqrt(0.5)}

_INF = float("inf")


def _log(base: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, -_INF).when(x < 0, float("nan")).otherwise(base(x))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "ceil": lambda x: F.ceil(x).cast("double"),
    "floor": lambda x: F.floor(x).cast("double"),
    "round": lambda x: F.floor(x + 0.5).cast("double"),
    "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)),
    "sign": F.signum,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "exp": F.exp,
    "expm1": F.expm1,
    "log": _log(F.log),
    "log2": _log(F.log2),
    "log10": _log(F.log10),
    "log1p": lambda x: F.when(x == -1, -_INF).when(x < -1, float("nan")).otherwise(F.log1p(x)),
    "pow": F.pow,
    "min": lambda *x: F.least(*x) if len(x) > 1 else x[0],
    "max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "hypot": F.hypot,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "atan2": F.atan2,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
}


_MEMBER = re.compile(r"\brow\s*\.\s*([^\W\d][\w$]*)")
_QUOTED = re.compile(r'"[^"]*"')
#: Words and signs that only Python's grammar knows.
_PYTHON_ONLY = re.compile(r"\b(and|or|not|if|else|in|is|lambda|for|while|await|async|yield|import|None|True|False)\b|//|:=|[@~]")


def _python(source: str) -> ast.expr:
    """Python's tree of a formula; operators outside quotes are spelled the Python way."""
    parts = re.split(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')""", source)
    for k in range(0, len(parts), 2):
        p = _MEMBER.sub(r'row["\1"]', parts[k])  # a column may be named by any word, and no word is folded to another form
        if found := _PYTHON_ONLY.search(_QUOTED.sub("", p)):
            raise FormulaError(f"not allowed in a formula: {found[0]}")
        p = p.replace("===", "==").replace("!==", "!=").replace("&&", " and ").replace("||", " or ")
        p = re.sub(r"!(?!=)", " not ", p)
        p = re.sub(r"\btrue\b", "True", p)
        p = re.sub(r"\bfalse\b", "False", p)
        parts[k] = re.sub(r"\bnull\b", "None", p)
    joined = "".join(parts)
    if "?" in "".join(_QUOTED.sub("", p) for p in parts[::2]):
        joined = _ternary(joined)
    try:
        return ast.parse(joined.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"bad formula: {e.msg}") from None


def _ternary(s: str) -> str:
    """a ? b : c as (b if a else c), the first outermost question mark first."""
    depth, mark, quote = 0, -1, ""
    for k, ch in enumerate(s):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "?" and depth == 0 and mark < 0:
            mark, nested = k, 0
        elif mark >= 0 and depth == 0 and ch == "?":
            nested += 1
        elif mark >= 0 and depth == 0 and ch == ":":
            if nested == 0:
                return f"(({_ternary(s[mark + 1 : k])}) if ({s[:mark]}) else ({_ternary(s[k + 1 :])}))"
            nested -= 1
    if mark >= 0:
        raise FormulaError("a ? without its :")
    return s


class _Typed:
    """A column with what is known of its type: number, text or truth."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind

    def number(self) -> Column:
        c = self.column
        if self.kind == "text":
            return F.when(c.isNull() | (F.trim(c) == ""), 0.0).otherwise(F.coalesce(F.trim(c).try_cast("double"), F.lit(float("nan"))))
        return F.coalesce(c.cast("double"), F.lit(0.0))

    def text(self) -> Column:
        c = self.column
        shown = text(c, _DOUBLE) if self.kind == "number" else c.cast("string")
        return F.coalesce(shown, F.lit("null"))

    def truth(self) -> Column:
        c = self.column
        if self.kind == "truth":
            return F.coalesce(c, F.lit(False))
        return F.coalesce(c != "", F.lit(False)) if self.kind == "text" else F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))


_DOUBLE = StructType().add("x", "double")[0].dataType


def compile_formula(source: str, schema: StructType) -> Column:
    """A row formula over the columns of a schema: row.x or row["x"], + - * / % **, comparisons, logic, ?:, Math.f(...)."""
    return _row(_python(source), schema).column


def _row(node: ast.expr, schema: StructType) -> _Typed:
    go = lambda n: _row(n, schema)
    match node:
        case ast.Constant(value=bool() as v):
            return _Typed(F.lit(v), "truth")
        case ast.Constant(value=int() | float() as v):
            return _Typed(F.lit(float(v)), "number")
        case ast.Constant(value=str() as v):
            return _Typed(F.lit(v), "text")
        case ast.Constant(value=None):
            return _Typed(F.lit(None).cast("double"), "number")
        case ast.Name(id="NaN"):
            return _Typed(F.lit(float("nan")), "number")
        case ast.Name(id="Infinity"):
            return _Typed(F.lit(_INF), "number")
        case ast.Attribute(value=ast.Name(id="row"), attr=name) | ast.Subscript(value=ast.Name(id="row"), slice=ast.Constant(value=str() as name)):
            if name not in schema.names:
                return _Typed(F.lit(None).cast("double"), "number")
            kind, c = schema[name].dataType, F.col(f"`{name}`")
            return _Typed(c, "text" if isinstance(kind, StringType) else "truth") if isinstance(kind, (StringType, BooleanType)) else _Typed(c.cast("double"), "number")
        case ast.Attribute(value=ast.Name(id="Math"), attr=name) if name in CONSTANTS:
            return _Typed(F.lit(CONSTANTS[name]), "number")
        case ast.Call(func=ast.Attribute(value=ast.Name(id="Math"), attr=name), args=args, keywords=[]) if name in FUNCTIONS and args:
            return _Typed(FUNCTIONS[name](*[go(a).number() for a in args]), "number")
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return _Typed(-go(x).number(), "number")
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _Typed(go(x).number(), "number")
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return _Typed(~go(x).truth(), "truth")
        case ast.BoolOp(op=op, values=values):
            out = go(values[0])
            for v in map(go, values[1:]):
                first, rest = (v, out) if isinstance(op, ast.And) else (out, v)
                same = out.kind == v.kind
                pick = lambda t, s=same: t.column if s else t.text()
                out = _Typed(F.when(out.truth(), pick(first)).otherwise(pick(rest)), out.kind if same else "text")
            return out
        case ast.IfExp(test=t, body=a, orelse=b):
            x, y = go(a), go(b)
            same = x.kind == y.kind
            return _Typed(F.when(go(t).truth(), x.column if same else x.text()).otherwise(y.column if same else y.text()), x.kind if same else "text")
        case ast.BinOp(left=a, op=ast.Add(), right=b):
            x, y = go(a), go(b)
            return _Typed(F.concat(x.text(), y.text()), "text") if "text" in (x.kind, y.kind) else _Typed(x.number() + y.number(), "number")
        case ast.BinOp(left=a, op=op, right=b):
            return _Typed(_arithmetic(op, go(a).number(), go(b).number()), "number")
        case ast.Compare(left=a, ops=[op], comparators=[b]):
            return _Typed(_compare(op, go(a), go(b)), "truth")
    raise FormulaError(f"not allowed in a formula: {ast.unparse(node)}")


def _arithmetic(op: ast.operator, x: Column, y: Column) -> Column:
    nan = F.lit(float("nan"))
    match op:
        case ast.Sub():
            return x - y
        case ast.Mult():
            return x * y
        case ast.Div():
            return F.when(y != 0, x / y).when(F.isnan(x) | F.isnan(y) | (x == 0), nan).otherwise(F.signum(x) * _INF)
        case ast.Mod():
            return F.when(y == 0, nan).otherwise(x % y)
        case ast.Pow():
            return F.pow(x, y)
    raise FormulaError("unknown operator")


def _compare(op: ast.cmpop, a: _Typed, b: _Typed) -> Column:
    texts = a.kind == b.kind == "text"
    x, y = (F.coalesce(a.column, F.lit("")), F.coalesce(b.column, F.lit(""))) if texts else (a.number(), b.number())
    ok = F.lit(True) if texts else ~(F.isnan(x) | F.isnan(y))
    both, one = a.column.isNull() & b.column.isNull(), a.column.isNull() != b.column.isNull()
    equal = F.when(both, True).when(one, False).otherwise(ok & (x == y))
    match op:
        case ast.Eq():
            return equal
        case ast.NotEq():
            return ~equal
        case ast.Lt():
            return ok & (x < y)
        case ast.LtE():
            return ok & (x <= y)
        case ast.Gt():
            return ok & (x > y)
        case ast.GtE():
            return ok & (x >= y)
    raise FormulaError("unknown comparison")


#: What a KPI formula can ask of a column, by its names.
AGGREGATES = {"SUM": "sum", "AVG": "avg", "MEAN": "avg", "MIN": "min", "MAX": "max", "MEDIAN": "median", "COUNT": "filled", "COUNTD": "countd"}


@dataclass
class Kpi:
    """A compiled KPI formula: its leaves (kind of aggregate, column) by the names of their columns, and its value and error over these."""

    leaves: dict[tuple[str, str], str]
    value: Column
    error: Column


def compile_kpi(source: str, schema: StructType, leaves: dict[tuple[str, str], str] | None = None) -> Kpi:
    """A KPI formula: aggregates of columns, numbers, + - * / and parentheses. Formulas that share ``leaves`` share their aggregates.

    Where a divisor is zero the value is null and the error says so; the first error from the left is told. A null operand gives null.
    """
    try:
        tree = ast.parse(re.sub(r"\(\s*\*\s*\)", "(__all__)", source.strip()), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"bad formula: {e.msg}") from None
    leaves = {} if leaves is None else leaves
    value, error = _kpi(tree, schema, leaves)
    return Kpi(leaves, F.when(error.isNull() & ~F.isnan(value), value), error)


def _kpi(node: ast.expr, schema: StructType, leaves: dict[tuple[str, str], str]) -> tuple[Column, Column]:
    fine = F.lit(None).cast("string")
    match node:
        case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
            return F.lit(float(v)), fine
        case ast.UnaryOp(op=ast.USub(), operand=x):
            value, error = _kpi(x, schema, leaves)
            return -value, error
        case ast.BinOp(left=a, op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() as op, right=b):
            (x, first), (y, second) = _kpi(a, schema, leaves), _kpi(b, schema, leaves)
            error = F.coalesce(first, second)
            match op:
                case ast.Add():
                    return x + y, error
                case ast.Sub():
                    return x - y, error
                case ast.Mult():
                    return x * y, error
            return F.when(y != 0, x / y), F.coalesce(error, F.when(x.isNotNull() & (y == 0), "Division by zero"))
        case ast.Call(func=ast.Name(id=name), args=[ast.Name(id=field)], keywords=[]):
            if name.upper() not in AGGREGATES:
                raise FormulaError(f"Unknown function: {name}")
            if field == "__all__":
                if name.upper() != "COUNT":
                    raise FormulaError("* is only allowed in COUNT")
                leaf = ("rows", "")
            elif field not in schema.names:
                raise FormulaError(f"Unknown field: {field}")
            else:
                leaf = (AGGREGATES[name.upper()], field)
            return F.col(leaves.setdefault(leaf, f"__kpi{len(leaves)}")).cast("double"), fine
    raise FormulaError(f"not allowed in a KPI: {ast.unparse(node)}")
