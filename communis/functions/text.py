"""Text functions of the readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(line: Column, separator: str) -> Column:
    """The line split at each separator; empty fields stay."""
    return F.split(line, rf"\Q{separator}\E", -1)


def without_blanks(value: Column) -> Column:
    """The value without spaces, tabs, line ends, vertical tabs or carriage returns anywhere."""
    return F.translate(value, " \n\t\v\r", "")


def leading_int(value: Column) -> Column:
    """The integer (long) that a text starts with, as C's readers take it ("12abc" is 12), else null; so is one beyond a
    long."""
    return F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
