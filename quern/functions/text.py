"""Text cleaning as built-in column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that str.strip() takes for blanks. Fixed values.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"

#: A decimal number: sign, point and exponent allowed, no grouping.
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: A whole number; a fraction of zeros is allowed.
WHOLE = r"^[+-]?[0-9]+(\.0+)?$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def stripped_or_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def whole_number(c: Column) -> Column:
    """Text as bigint if, trimmed, it is a whole number that fits; else null."""
    s = strip(c)
    return F.when(s.rlike(WHOLE), F.regexp_extract(s, r"^([+-]?[0-9]+)", 1).try_cast("bigint"))


def decimal_number(c: Column) -> Column:
    """Text as double if, trimmed, it is a plain or exponent number; else null."""
    s = strip(c)
    return F.when(s.rlike(DECIMAL), s.try_cast("double"))


def integer_key(c: Column) -> Column:
    """Key text as bigint: blanks and leading zeros don't count; null if it is none or too long."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def folded_name(c: Column) -> Column:
    """Name for comparison: lower case, each run of blanks one space; null if blank."""
    s = strip(F.regexp_replace(F.lower(c), f"[{BLANKS}]+", " "))
    return F.when(s != "", s)
