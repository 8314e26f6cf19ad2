"""Wide to long and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import OperationError
from ..frame import Frame


def melt(frame: Frame, ids: list[str], measures: list[str], measure_name: str = "measure", value_name: str = "value") -> Frame:
    """A row per measure, in the given order, with the value as formatted text; empty and null values stay."""
    names = frame.get_col_names()
    if missing := [c for c in (*ids, *measures) if c not in names]:
        raise OperationError(f"no columns {missing}")
    df = frame.to_df(formatted=True).toDF(*(f"c{i}" for i in range(len(names))))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    long = df.select(*(F.col(at[c]).alias(f"i{i}") for i, c in enumerate(ids)), *(F.col(at[c]).alias(f"m{i}") for i, c in enumerate(measures)))
    long = long.select(*(f"i{i}" for i in range(len(ids))), F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(f"m{i}").alias("value")) for i, c in enumerate(measures)))))
    return Frame.over(long, [*ids, measure_name, value_name])


def dcast(frame: Frame, ids: list[str], measure_name: str, value_name: str, values: list, value_names: list[str] | None = None) -> Frame:
    """A row per ids with a column per value of the measure column; the last row (in the source's order) of a cell wins, absent cells are null."""
    names = frame.get_col_names()
    if missing := [c for c in (*ids, measure_name, value_name) if c not in names]:
        raise OperationError(f"no columns {missing}")
    if value_names is not None and len(value_names) != len(values):
        raise OperationError("as many names as values are needed")
    df = frame.to_df().toDF(*(f"c{i}" for i in range(len(names))))
    at = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    rows = df.select(*(at[c].alias(f"i{i}") for i, c in enumerate(ids)), at[measure_name].alias("measure"), at[value_name].alias("value"), F.monotonically_increasing_id().alias("ord"))
    cells = [F.max_by("value", F.when(F.col("measure") == F.lit(v), F.col("ord"))).alias(f"v{i}") for i, v in enumerate(values)]
    wide = rows.groupBy(*(f"i{i}" for i in range(len(ids)))).agg(*cells)
    return Frame.over(wide, [*ids, *(value_names or [str(v) for v in values])])
