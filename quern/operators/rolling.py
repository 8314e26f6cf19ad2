"""Totals and averages over trailing periods, also for days without activity.

Rows are first summed per entity and day. Each (entity, day) asked for is put into the coarse buckets of days that its longest
period touches, joined with the daily totals of the same entity and bucket within its trailing bounds, and aggregated. A bucket holds at
most `bucket` daily totals of an entity, so a hot entity adds no more candidates than any other.

Defined results: a period of n days ends with the asked day and holds it; without activity totals are 0 and averages (per day of the
period) 0.0. Entities equal null-safely; repeated asked rows come out repeatedly; rows without day give null totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, whole_number
from ..sources.tables import columns
from .timestamps import DAY


def daily_totals(rows: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """(entity, day, total); rows without day or value add nothing."""
    return rows.where(F.col(day).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(F.sum(value).alias("total"))


def calendar(totals: DataFrame) -> DataFrame:
    """(entity, day): each day from the entity's first to its last."""
    ends = totals.groupBy("entity").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return ends.select("entity", F.explode(F.sequence("a", "b")).alias("day"))


def trailing_totals(asked: DataFrame, totals: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """asked (entity, day) with total_n and average_n for each period of n days; days are numbered."""
    longest = max(periods)
    width = F.lit(longest)
    each = asked.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("copies"))
    spread = each.withColumn("bucket", F.explode_outer(F.sequence(F.floor((F.col("day") - (longest - 1)) / width), F.floor(F.col("day") / width))))
    daily = totals.select(F.col("entity").alias("e"), F.col("day").alias("d"), "total", F.floor(F.col("day") / width).alias("b"))
    near = F.col("entity").eqNullSafe(F.col("e")) & (F.col("bucket") == F.col("b")) & (F.col("d") <= F.col("day")) & (F.col("d") > F.col("day") - longest)
    sums = [F.sum(F.when(F.col("d") > F.col("day") - n, F.col("total"))).alias(f"total_{n}") for n in periods]
    out = spread.join(daily, near, "left").groupBy("entity", "day", "copies").agg(*sums)
    for n in periods:
        total = F.when(F.col("day").isNotNull(), F.coalesce(f"total_{n}", F.lit(0)).cast("bigint"))
        out = out.withColumn(f"total_{n}", total).withColumn(f"average_{n}", F.col(f"total_{n}") / F.lit(float(n)))
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


def calendar_totals(totals: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """The rows of trailing_totals(calendar(totals), totals, periods). Each daily total gives the days up to the next one of its entity, beside the daily totals
    of the longest period that ends with it; so only daily totals are shuffled, not the days between them."""
    order = Window.partitionBy("entity").orderBy("day")
    near = F.collect_list(F.struct("day", "total")).over(order.rangeBetween(1 - max(periods), 0))
    after = F.coalesce(F.lead("day").over(order), F.col("day") + 1)
    each = totals.where("day is not null").select("entity", F.col("day").alias("last"), after.alias("after"), near.alias("near")).where("after > last")
    out = each.select("entity", "last", "near", F.explode(F.sequence(F.col("last"), F.col("after") - 1)).alias("day"))

    def total(n: int) -> Column:
        within = F.aggregate("near", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + F.when(x["day"] > F.col("day") - n, F.coalesce(x["total"], F.lit(0)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return F.when(F.col("day") - F.col("last") < n, within).otherwise(F.lit(0).cast("bigint"))

    out = out.select("entity", "day", *(total(n).alias(f"total_{n}") for n in periods))
    return out.select("entity", "day", *(c for n in periods for c in (F.col(f"total_{n}"), (F.col(f"total_{n}") / F.lit(float(n))).alias(f"average_{n}"))))


def sales_by_day(sales: DataFrame, instant) -> DataFrame:
    """(entity, day, total) of sales. instant: the function of timestamps.instant_column. Each ticket counts once, by its row of the least sale_id; rows without ticket
    count each for itself; sold counts if it is a whole number; days are days since 1970 in UTC. Texts are parsed where they are read, so that numbers are shuffled."""
    sales = columns(sales, "sale_id", "ticket", "date", "feed", "cust", "sold")
    ticket = strip(F.col("ticket"))
    known = F.when(ticket != "", ticket)
    day = F.floor(instant(F.col("date"), F.col("feed")) / F.lit(DAY)).cast("int")
    read = sales.select(known.alias("ticket"), F.when(known.isNull(), F.col("sale_id")).alias("lone"), "sale_id", day.alias("day"), strip(F.col("cust")).alias("cust"), whole_number(F.col("sold")).alias("sold"))
    once = read.groupBy("ticket", "lone").agg(F.min(F.struct("sale_id", "day", "cust", "sold")).alias("row")).select("row.*")
    return daily_totals(once.where("cust is not null").withColumn("day", F.col("day").cast("bigint")), "cust", "day", "sold")
