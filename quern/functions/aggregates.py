"""Aggregates of groups and whole tables.

A scalar aggregate is one column expression. A listing aggregate gives several rows per group (modes, k smallest or largest); it is
computed as an array per group by plans that never gather a group: modes from counts per value, k smallest by a limited ranking that
cuts each partition down before the shuffle. So are medians: values are counted in cells of nearly equal size on a logarithmic scale, and only those of the one or two cells that hold the
middle ranks are sorted. An opaque one is a Python function of all of a group's values.

Null rule: "sql" (the default) leaves nulls out; "strict" lets a null win min and makes the sum null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """One of: scalar(column, strict); listing(df, keys, column, strict) -> df of keys and `value` (an array if many); opaque(column) -> a grouped UDF call."""

    name: str
    scalar: Callable[[Column, bool], Column] | None = None
    listing: Callable[[DataFrame, list[str], str, bool], DataFrame] | None = None
    opaque: Callable[[Column], Column] | None = None
    fold: Callable[[DataFrame, str], DataFrame] | None = None
    many: bool = False  # the value is an array whose elements become rows


def _strict(c: Column, strict: bool, value: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), value) if strict else value


def _mean(c: Column, strict: bool) -> Column:
    return _strict(c, strict, F.avg(c))


def _sd(c: Column, strict: bool) -> Column:
    return _strict(c, strict, F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c)))


#: Cells for each factor of e of a value.
CELLS = 256


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return on


def _cell(value: str) -> Column:
    """A number that never decreases with the value; NaN is the greatest value."""
    v = F.col(value)
    size = F.least(F.log1p(F.abs(v) * 1000), F.lit(1000.0)) * CELLS
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v.isNotNull(), F.floor(F.when(v < 0, -size).otherwise(size)))


def _medians(df: DataFrame, keys: list[str], value: str, strict: bool) -> DataFrame:
    df = df.select(*keys, F.col(value).cast("double").alias(value))
    counts = df.groupBy(*keys, _cell(value).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    within = Window.partitionBy(*keys)  # one row per cell
    upto = counts.withColumn("__upto", F.sum(F.when(F.col("__cell").isNotNull(), F.col("__n")).otherwise(0)).over(within.orderBy("__cell")))
    upto = upto.withColumn("__all", F.max("__upto").over(within)).withColumn("__nulls", F.max(F.col("__cell").isNull()).over(within))
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    before = F.col("__upto") - F.col("__n")
    holds = F.col("__cell").isNotNull() & (((low > before) & (low <= F.col("__upto"))) | ((high > before) & (high <= F.col("__upto"))))
    wanted = upto.where(holds).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__cell").alias("__c"), before.alias("__before"), low.alias("__low"), high.alias("__high"), "__nulls")
    near = df.select(*keys, value, _cell(value).alias("__cell")).join(wanted, _same(keys) & (F.col("__cell") == F.col("__c")))
    ranked = near.withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(value)))
    middle = ranked.where((F.col("__rank") == F.col("__low")) | (F.col("__rank") == F.col("__high")))
    found = middle.groupBy(*keys).agg(F.avg(value).alias("value"), F.max("__nulls").alias("__nulls"))
    if keys:  # groups without values have a row too
        found = found.unionByName(upto.where("__all = 0").select(*keys, F.lit(None).cast("double").alias("value"), F.lit(True).alias("__nulls")))
    return found.select(*keys, F.when(~F.col("__nulls"), F.col("value")).alias("value") if strict else F.col("value"))


def _skews(df: DataFrame, keys: list[str], value: str, strict: bool) -> DataFrame:
    """Pearson's second coefficient; null where the deviation is 0."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd")).select(*(F.col(k).alias(f"__{k}") for k in keys), "__mean", "__sd")
    both = _medians(df, keys, value, strict).join(moments, _same(keys))
    return both.select(*keys, F.try_divide(F.lit(3.0) * (F.col("__mean") - F.col("value")), F.when(F.col("__sd") != 0, F.col("__sd"))).alias("value"))


def _modes(df: DataFrame, keys: list[str], value: str, strict: bool) -> DataFrame:
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    most = Window.partitionBy(*keys).orderBy(F.col("__n").desc())
    top = counts.withColumn("__r", F.rank().over(most)).where("__r = 1")
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v")))).alias("__v")).select(*keys, F.col("__v.v").alias("value"))


def _ranked(k: int, down: bool):
    def listing(df: DataFrame, keys: list[str], value: str, strict: bool) -> DataFrame:
        c = F.col(value)
        order = Window.partitionBy(*keys).orderBy(c.desc() if down else c.asc())
        top = df.where(c.isNotNull()).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
        return top.groupBy(*keys).agg(F.sort_array(F.collect_list(value), not down).alias("value"))

    return listing


max = Aggregate("max", lambda c, strict: F.max(c))  # noqa: A001
min = Aggregate("min", lambda c, strict: _strict(c, strict, F.min(c)))  # noqa: A001
sum = Aggregate("sum", lambda c, strict: _strict(c, strict, F.sum(c)))  # noqa: A001
count = Aggregate("count", lambda c, strict: F.count(F.lit(1)))
mean = Aggregate("mean", _mean)
median = Aggregate("median", listing=_medians)
sd = Aggregate("sd", _sd)
skew = Aggregate("skew", listing=_skews)
mode = Aggregate("mode", listing=_modes, many=True)


def smallest(k: int) -> Aggregate:
    return Aggregate(f"smallest{k}", listing=_ranked(k, False), many=True)


def largest(k: int) -> Aggregate:
    return Aggregate(f"largest{k}", listing=_ranked(k, True), many=True)


smallest3, largest3 = smallest(3), largest(3)
BY_NAME = {a.name: a for a in (max, min, sum, count, mean, median, sd, skew, mode, smallest3, largest3)}


def of_expression(name: str, expression: Callable[[Column], Column], many: bool = False) -> Aggregate:
    """A user's aggregate as a column expression; many: it gives an array whose elements become rows."""
    return Aggregate(name, lambda c, strict: expression(c), many=many)
