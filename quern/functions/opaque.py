"""Opaque Python functions for frames: the slow way, in Arrow batches, with a declared result type.

Frame operations take functions of columns that return a column. A Python function of values must be wrapped here, so that
everything else stays in the reach of the optimiser.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import Aggregate


@dataclass(frozen=True)
class Op:
    """A function of columns in a lenient form (a failing cell is null) and a strict one (it ends the job)."""

    name: str
    lenient: Callable[..., Column]
    strict: Callable[..., Column]

    def __call__(self, *columns: Column) -> Column:
        return self.lenient(*columns)


def _values(series: tuple[pd.Series, ...]):
    """Rows of values, missing ones as None."""
    return zip(*(s.astype(object).where(s.notna(), None) for s in series), strict=True)


def udf(fn: Callable, returns: str, name: str | None = None) -> Op:
    """A Python function of single values as an operation, predicate, parser, formatter or key function."""

    def batch(strict: bool):
        def run(*series: pd.Series) -> pd.Series:
            out = []
            for values in _values(series):
                try:
                    out.append(fn(*values))
                except Exception:
                    if strict:
                        raise
                    out.append(None)
            return pd.Series(out, dtype=object)

        def call(*columns: Column) -> Column:
            return F.pandas_udf(run, returns)(*columns)

        return call

    return Op(name or getattr(fn, "__name__", "fn"), batch(False), batch(True))


def vector(fn: Callable[..., pd.Series], returns: str, name: str | None = None) -> Op:
    """A Python function of whole pandas series, one per column. In the lenient form a batch that fails is done row by row, so that just its failing cells are null."""

    def batch(strict: bool):
        def run(*series: pd.Series) -> pd.Series:
            try:
                return fn(*series)
            except Exception:
                if strict:
                    raise
            out = []
            for i in range(len(series[0])):
                try:
                    out.append(fn(*(s.iloc[i : i + 1].reset_index(drop=True) for s in series)).iloc[0])
                except Exception:
                    out.append(None)
            return pd.Series(out, dtype=object)

        def call(*columns: Column) -> Column:
            return F.pandas_udf(run, returns)(*columns)

        return call

    return Op(name or getattr(fn, "__name__", "fn"), batch(False), batch(True))


def group_udf(fn: Callable[[list], object], returns: str, many: bool = False, name: str | None = None) -> Aggregate:
    """A Python function of all values of a group (which must fit into memory); many: it returns a list whose elements become rows."""
    kind = f"array<{returns}>" if many else returns

    def run(values: pd.Series) -> Any:
        found = fn(list(values.astype(object).where(values.notna(), None)))
        return list(found) if many else found

    def call(column: Column) -> Column:
        return F.pandas_udf(run, kind)(column)

    return Aggregate(name or getattr(fn, "__name__", "fn"), opaque=call, many=many)


def fold_udf(step: Callable, returns: str, start: object = None, merge: Callable | None = None, many: bool = False, name: str | None = None) -> Aggregate:
    """A fold of a whole table: acc = step(acc, value) from `start` on. With merge(acc, acc) every partition is folded by itself and the
    results merged; without, one task streams through all values, as an opaque sequential fold must. Memory is that of the accumulator."""
    import pickle

    kind = f"array<{returns}>" if many else returns

    def fold(df: DataFrame, column: str) -> DataFrame:
        def partial(batches):
            acc, any_row = start, False
            for pdf in batches:
                s = pdf.iloc[:, 0]
                for v in s.astype(object).where(s.notna(), None):
                    acc, any_row = step(acc, v), True
            if any_row:
                yield pd.DataFrame({"acc": [pickle.dumps(acc)]})

        def final(batches):
            acc, any_row = start, False
            for pdf in batches:
                for data in pdf["acc"]:
                    other = pickle.loads(data)
                    acc, any_row = (merge(acc, other) if any_row else other), True
            yield pd.DataFrame({"value": pd.Series([(list(acc) if many else acc) if any_row else None], dtype=object)})

        rows = df.select(column) if merge else df.select(column).coalesce(1)
        return rows.mapInPandas(partial, "acc binary").coalesce(1).mapInPandas(final, f"value {kind}")

    return Aggregate(name or getattr(step, "__name__", "fold"), fold=fold, many=many)


def try_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


#: Division that is null on failure in lenient frames and an error in strict ones.
divide = Op("divide", F.try_divide, lambda a, b: a / b)


def concat(*columns: Column) -> Column:
    """Text of the values one after the other; null as nothing."""
    return F.concat_ws("", *(c.cast("string") for c in columns))


def pair(a: Column, b: Column) -> Column:
    """Two values as one cell; as text a list of both."""
    return F.array(a.cast("string"), b.cast("string"))


def negate(c: Column) -> Column:
    return -c


def increment(c: Column) -> Column:
    return c + 1
