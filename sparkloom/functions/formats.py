"""Numbers as short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkloom.functions.values import round_half_up, text


def compact(c: Column) -> Column:
    """억 from 1e8, 만 from 1e4, k from 1e3, with one decimal; smaller numbers as they are."""
    short = lambda d: text(round_half_up(c / d, 1), DoubleType())
    a = F.abs(c)
    return F.when(a >= 1e8, F.concat(short(1e8), F.lit("억"))).when(a >= 1e4, F.concat(short(1e4), F.lit("만"))).when(a >= 1e3, F.concat(short(1e3), F.lit("k"))).otherwise(text(c.cast("double"), DoubleType()))


def won(c: Column) -> Column:
    """An amount in units of 10,000 won: 억 from 10,000 units with one decimal (two under 10억), else 만."""
    big = c / 1e4
    shown = F.when(big >= 10, text(round_half_up(big, 1), DoubleType())).otherwise(text(round_half_up(big, 2), DoubleType()))
    return F.when(F.abs(c) >= 1e4, F.concat(shown, F.lit("억"))).otherwise(F.concat(F.format_number(c, 0), F.lit("만")))


def grouped(c: Column, digits: int = 0) -> Column:
    return F.format_number(c, digits)


def plain_text(c: Column) -> Column:
    """HTML text without tags; non-breaking spaces become spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "&nbsp;", " "))
