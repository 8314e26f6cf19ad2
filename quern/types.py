"""Column types of text tables: name -> parser and formatter as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import TypeNameError

DATE, DATETIME = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


@dataclass(frozen=True)
class ColumnType:
    """parse(column, strict): failing cells are null, or an error if strict; show(column): the value as text."""

    parse: Callable[[Column, bool], Column]
    show: Callable[[Column], Column]


def text(c: Column) -> Column:
    return c.cast("string")


def _int(c: Column, strict: bool) -> Column:
    s = c.cast("string")
    if strict:
        return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.cast("int")).when(s.isNotNull(), F.raise_error(F.concat(F.lit("not an int: "), s)).cast("int"))
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("int"))


def _double(c: Column, strict: bool) -> Column:
    return c.cast("double") if strict else c.try_cast("double")


def _time(pattern: str, kind: str) -> ColumnType:
    def parse(c: Column, strict: bool) -> Column:
        made = F.to_timestamp(c, pattern) if strict else F.try_to_timestamp(c, F.lit(pattern))
        return made.cast("date" if kind == "date" else "timestamp_ntz")

    return ColumnType(parse, lambda c: F.date_format(c, pattern))


def column_type(name: str) -> ColumnType:
    """string, int, double, date[:pattern] or datetime[:pattern]."""
    kind, _, pattern = name.partition(":")
    if kind in ("date", "datetime"):
        return _time(pattern or (DATE if kind == "date" else DATETIME), kind)
    plain = {"string": ColumnType(lambda c, strict: c.cast("string"), text), "int": ColumnType(_int, text), "double": ColumnType(_double, text)}
    if kind not in plain or pattern:
        raise TypeNameError(f"no type {name!r}: string, int, double, date[:pattern] and datetime[:pattern] are known")
    return plain[kind]
