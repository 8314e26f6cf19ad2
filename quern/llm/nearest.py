"""Pairing records by nearest time within a tolerance.

Both sides are put into time buckets as wide as the tolerance, so that partners lie in the same or an adjacent bucket. The right records of an entity and
a bucket, of one time only that of the smallest key, are sent to that bucket and its two neighbours and gathered there in a list; left records are joined with the list of their entity and bucket, what
differs too much is filtered, and of the rest the nearest is kept, of equally near ones that of the smallest right key. So a left record meets all its candidates in one row, and no pairs are formed.

A list holds at most three times HOT records. Buckets of an entity with more right records than HOT, as bulk loads or a single entity with most rows have, are
not gathered: there the nearest record on either side is found by as-of matching over FINE cells of a bucket, which spreads them over many tasks.

Defined results: null entities and null times take no part; a difference of exactly the tolerance matches; repeated records on the left are paired each for
itself, of right records with the same time the smallest key stands for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import last_before
from ..sources.shared import written
from ..sources.tables import columns

#: Right records of one entity and bucket that are gathered, and cells that a bucket with more is cut into.
HOT, FINE = 256, 1024


def pair_nearest(left: DataFrame, right: DataFrame, tolerance: int, hot: int = HOT) -> DataFrame:
    """(left_key, right_key, difference) of left (entity, at, left_key) and right (entity, at, right_key); at is a bigint."""
    left, right = columns(left, "entity", "at", "left_key"), columns(right, "entity", "at", "right_key")
    bucket = F.floor(F.col("at") / F.lit(tolerance + 1))
    a = left.where("entity is not null and at is not null").withColumn("bucket", bucket)
    b = right.where("entity is not null and at is not null and right_key is not null").groupBy("entity", "at").agg(F.min("right_key").alias("right_key"))
    b = written(b.withColumn("bucket", bucket))
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias("bucket")
    spread = b.select("entity", near("bucket"), "at", "right_key")
    crowded = b.groupBy("entity", "bucket").count().where(F.col("count") > hot)
    if crowded.isEmpty():
        return _by_lists(a, spread, tolerance)
    groups = written(crowded.select("entity", near("bucket")).distinct())
    a = written(a)
    key = ["entity", "bucket"]
    lists = _by_lists(a.join(groups, key, "left_anti"), spread.join(groups, key, "left_anti"), tolerance)
    theirs = spread.join(groups, key, "left_semi").select("entity", "at", "right_key").distinct()
    return lists.unionByName(_by_cells(a.join(groups, key, "left_semi"), theirs, tolerance))


def _option(candidate: Column) -> Column:
    return F.struct(F.abs(candidate["at"] - F.col("at")).alias("difference"), candidate["right_key"].alias("right_key"))


def _by_lists(a: DataFrame, spread: DataFrame, tolerance: int) -> DataFrame:
    lists = spread.groupBy("entity", "bucket").agg(F.collect_list(F.struct("at", "right_key")).alias("candidates"))
    options = F.filter(F.transform("candidates", _option), lambda x: x["difference"] <= tolerance)
    best = a.join(lists, ["entity", "bucket"]).select("left_key", F.array_min(options).alias("best")).where("best is not null")
    return best.select("left_key", "best.right_key", "best.difference")


def _by_cells(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    cell = F.floor(F.col("at") / F.lit(max(1, (tolerance + 1) // FINE)))
    right = b.select("entity", "at", F.struct("at", "right_key").alias("before"))
    times = a.select("entity", "at").distinct()
    seen = last_before(times, right, ["entity"], "at", cell, "before")
    seen = last_before(seen, right.withColumnRenamed("before", "after"), ["entity"], "at", cell, "after", descending=True)
    best = F.least(*(F.when(F.col(c).isNotNull(), _option(F.col(c))) for c in ("before", "after"))).alias("best")
    found = seen.select(F.col("entity").alias("e"), F.col("at").alias("t"), best).where(F.col("best.difference") <= tolerance)
    return a.join(found, (F.col("entity") == F.col("e")) & (F.col("at") == F.col("t"))).select("left_key", "best.right_key", "best.difference")
