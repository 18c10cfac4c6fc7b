"""Value rules shared by cleaning, aggregation and pivots: blanks, numbers out of text, rounding, text of numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, NumericType, StringType


def blank(c: Column) -> Column:
    """Null or the empty text: the rule of cleaning and aggregation."""
    return c.isNull() | (c.cast("string") == "")


def blank_trimmed(c: Column) -> Column:
    """Null or white space only: the rule of import, union and join."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def number(c: Column, kind: DataType | None = None) -> Column:
    """A double out of any value; null for blanks, NaN and text that is no number; booleans are 1 and 0."""
    if isinstance(kind, BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, NumericType) and not isinstance(kind, (DoubleType, FloatType)):
        return c.cast("double")
    value = c.cast("double") if isinstance(kind, (DoubleType, FloatType)) else F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(c: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def text(c: Column, kind: DataType | None = None) -> Column:
    """Text of a value: whole doubles without a fraction, no trailing zeros, exponents from 1e21 and below 1e-6."""
    if isinstance(kind, (DoubleType, FloatType)):
        plain = F.regexp_replace(F.format_string("%.17f", c), r"\.?0+$", "")
        short = c.cast("string")
        mantissa = F.regexp_replace(F.regexp_replace(F.lower(short), r"\.0e", "e"), r"e(\d)", "e+$1")
        whole = (F.abs(c) < 1e15) & (F.floor(c) == c)
        fixed = F.when(short.contains("E"), F.when((F.abs(c) >= 1e-6) & (F.abs(c) < 1e21), plain).otherwise(mantissa)).otherwise(F.regexp_replace(short, r"\.0$", ""))
        return F.when(whole, c.cast("long").cast("string")).otherwise(fixed)
    return c.cast("string")


def group_text(c: Column, kind: DataType | None = None) -> Column:
    """Text of a group key; null and the empty text are one group."""
    return F.coalesce(text(c, kind), F.lit(""))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.when(b != 0, a / b)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))


def is_text(kind: DataType) -> bool:
    return isinstance(kind, StringType)


def collated(c: Column, kind: DataType, locale: str | None) -> Column:
    """A sort key: texts by a locale's rules (Spark's collations: ``UNICODE``, ``ko``, ``de`` and so on), anything else as it is."""
    return F.collate(c, locale) if locale and isinstance(kind, StringType) else c
