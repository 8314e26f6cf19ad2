"""Binding frames by rows and by columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OperationError
from ..frame import Frame
from ..sources.files import dataframe, repair_names
from ..sources.shared import written


def rbind(first: Frame, second: Frame, *more: Frame) -> Frame:
    """All rows one after the other, by position and under the names of the first; extra columns of the others are left out."""
    frames = [first, second, *more]
    width = len(first.get_col_names())
    if any(len(f.get_col_names()) < width for f in frames):
        raise OperationError("a frame has fewer columns than the first")
    parts = []
    for f in frames:
        df = f.to_df()
        plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        parts.append(plain.select(*(f"c{i}" for i in range(width))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return Frame.over(out, first.get_col_names())


def with_ordinal(df: DataFrame, name: str, order_by: list | None = None) -> DataFrame:
    """df with the place of each row from 0, in the order of its partitions, or of order_by.

    Rows are numbered within their partitions; the partitions' sizes (one number each) give the numbers before them. No row leaves its place
    but for the sort. What a second evaluation could order differently is written once in the shared folder."""
    ranked = (df.orderBy(*order_by) if order_by else df).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = written(ranked)
    sizes = sorted((r["__part"], r["n"]) for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "__p int, __before bigint")
    return kept.join(starts, F.col("__part") == F.col("__p")).withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__p", "__before")


def cbind(first: Frame, second: Frame, *more: Frame, order_by: list[list[str] | None] | None = None) -> Frame:
    """Rows side by side by their place; the shortest frame ends the result, duplicate names get numbers. order_by: for each frame the columns that order it (files have their own order)."""
    frames = [first, second, *more]
    orders = order_by or [None] * len(frames)
    out, names = None, []
    for k, (f, order) in enumerate(zip(frames, orders, strict=True)):
        own = f.get_col_names()
        df = f.to_df().toDF(*(f"c{k}_{i}" for i in range(len(own))))
        placed = with_ordinal(df, f"at{k}", [f"c{k}_{own.index(c)}" for c in order] if order else None)
        out = placed if out is None else out.join(placed, F.col("at0") == F.col(f"at{k}"))
        names += own
    columns = [c for c in out.columns if not c.startswith("at")]
    return Frame.over(out.select(*columns), repair_names(names))


def rbind_csv(first: str, second: str, *more: str, spark=None) -> Frame:
    return rbind(*(dataframe(p, spark=spark) for p in (first, second, *more)))


def cbind_csv(first: str, second: str, *more: str, spark=None) -> Frame:
    return cbind(*(dataframe(p, spark=spark) for p in (first, second, *more)))
