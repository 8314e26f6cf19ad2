"""As-of matching without unbounded groups.

For each left row, the last right row (in time, then in order) with the same keys and a time not after it.
The right side is cut into time buckets and gathered in a list per (keys, bucket); beside it stands the last right row of an earlier bucket, which a
running window carries over one row per (keys, bucket). A left row is joined with the one row of its keys and bucket: it is never grouped itself, so that
a key or a bucket with a third of all left rows is split as any skewed side of a join, and no pairs are formed.

Buckets are given from coarse to fine. Finer ones are taken where any list of coarser ones would be longer than CROWDED; where no keys have more right rows than that, there are
no buckets at all: a list holds all right rows of its keys, and nothing is carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Right rows of one (keys, bucket) from which on finer buckets are tried.
CROWDED = 256


def _key(keys: list[str]) -> Column:
    return F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).alias("__key")  # never null itself, so plain equality holds for null keys too


def fine_enough(right: DataFrame, keys: list[str], buckets: list[Column | None], most: int | None = None) -> Column | None:
    """The first of the buckets (none: the keys alone) in which no keys have more than `most` (CROWDED) right rows, or the last."""
    most = CROWDED if most is None else most
    for cut in buckets[:-1]:
        parts = [_key(keys)] if cut is None else [_key(keys), cut.alias("__bucket")]
        if right.groupBy(*parts).count().where(F.col("count") > most).isEmpty():
            return cut
    return buckets[-1]


def last_before(left: DataFrame, right: DataFrame, keys: list[str], time: str, buckets: Column | str | list[Column | str], value: str, descending: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """left with a column `value`: the right side's `value` (never null there) of the last row at or before.

    Both sides have the columns `keys` and `time`; the right side also has `value`, of one row per (keys, time).
    buckets: expressions over `time` that never decrease with it, coarse ones first; a single one is taken as it is. descending: the first row at or after instead.
    asked: rows with the same keys and times as the left's, if they are cheaper to get than the left itself. Null keys equal each other; a null time
    on the left finds nothing, on the right is found by nothing. The left's other columns stay; their names may not begin with __."""
    right = right.where(F.col(time).isNotNull())
    cuts = [F.expr(b) if isinstance(b, str) else b for b in (buckets if isinstance(buckets, list) else [buckets])]
    cut = fine_enough(right, keys, [None, *cuts]) if len(cuts) > 1 else cuts[0]
    key, own = _key(keys), [c for c in left.columns if c not in (*keys, time)]
    kind = right.schema[value].dataType
    entry = F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("__entry")
    none = F.lit(None).cast(right.select(entry).schema["__entry"].dataType)
    later = (lambda x, y: x["t"] < y["t"]) if descending else (lambda x, y: x["t"] > y["t"])
    here = (lambda x: x["t"] >= F.col(time)) if descending else (lambda x: x["t"] <= F.col(time))

    def last(entries: Column, within) -> Column:
        return F.aggregate(entries, none, lambda best, x: F.when(within(x) & (best.isNull() | later(x, best)), x).otherwise(best))["v"]

    placed = left.select(key, F.col(time), F.struct(*(left[c] for c in own) or [F.lit(0).alias("__none")]).alias("__own"))

    def named(out: DataFrame, found: Column) -> DataFrame:
        return out.select(*(F.col("__key")[f"k{i}"].alias(k) for i, k in enumerate(keys)), time, *(F.col("__own")[c].alias(c) for c in own), found.cast(kind).alias(value))

    if cut is None:
        lists = right.select(key.alias("__k"), entry).groupBy("__k").agg(F.collect_list("__entry").alias("__list"))
        return named(placed.join(lists, F.col("__key") == F.col("__k"), "left"), last(F.col("__list"), here))
    cut = F.when(F.col(time).isNotNull(), cut)
    lists = right.select(key, cut.alias("__bucket"), entry).groupBy("__key", "__bucket").agg(F.collect_list("__entry").alias("__list"))
    asked = (left if asked is None else asked).select(key, cut.alias("__bucket")).where("__bucket is not null").distinct().withColumn("__list", F.lit(None).cast(lists.schema["__list"].dataType))
    steps = lists.unionByName(asked).groupBy("__key", "__bucket").agg(F.first("__list", ignorenulls=True).alias("__list"))
    order = F.col("__bucket").desc() if descending else F.col("__bucket")
    before = Window.partitionBy("__key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("__end", last(F.col("__list"), lambda x: F.lit(True))).withColumn("__carried", F.last("__end", ignorenulls=True).over(before))
    steps = steps.select(F.col("__key").alias("__k"), F.col("__bucket").alias("__b"), "__list", "__carried")
    out = placed.withColumn("__bucket", cut).join(steps, (F.col("__key") == F.col("__k")) & (F.col("__bucket") == F.col("__b")), "left")
    return named(out, F.coalesce(last(F.col("__list"), here), F.col("__carried")))
