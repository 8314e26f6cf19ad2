"""References to records that do not exist (yet, or any more).

Parent keys are compressed into runs of contiguous integers. Each distinct referenced key is matched as-of to the
preceding run's start within its stretch of the number line; a key beyond that run's end is an orphan. References to
keys that exist are then matched as-of in time with the parent's history: none yet is late, a removed one deleted.

Defined results: keys are whole numbers, so blanks and leading zeros don't count; a key text that isn't a whole number
of 64 bits is compared as text without outer blanks. References with a null or blank key are no references. Of parent rows
loaded at the same time the one with the greatest number holds; a null removed mark counts as false, parent rows
without loading time prove that the key exists but are never its latest row. References without loading time can only
be missing. Repeated rows are reported each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import integer_key, strip
from ..sources.tables import columns
from .asof import last_before

#: Keys of one stretch of the number line are matched in one task's window.
STRETCH = 65_536


def key_runs(keys: DataFrame, key: str = "key") -> DataFrame:
    """(stretch, run_start, run_end) of the distinct bigint keys; no run crosses a stretch."""
    distinct = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().withColumn("stretch", F.floor(F.col("k") / F.lit(STRETCH)))
    at = Window.partitionBy("stretch").orderBy("k")
    return distinct.withColumn("run", F.col("k") - F.row_number().over(at)).groupBy("stretch", "run").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end")).drop("run")


def keys_beyond_runs(keys: DataFrame, runs: DataFrame, key: str = "key") -> DataFrame:
    """The distinct bigint keys that lie in none of the runs."""
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    asked = asked.select(F.floor(F.col("k") / F.lit(STRETCH)).alias("stretch"), "k", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("run_end"))
    both = asked.unionByName(runs.select("stretch", F.col("run_start").alias("k"), F.lit(0).alias("side"), "run_end"))
    preceding = Window.partitionBy("stretch").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("end", F.last("run_end", ignorenulls=True).over(preceding)).where("side = 1")
    return seen.where(F.col("end").isNull() | (F.col("k") > F.col("end"))).select(F.col("k").alias(key))


def find_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """(table_name, row_id, period, reason) of references (table_name, row_id, key_text, loaded_at) to
    parents (parent_id, key_text, loaded_at, removed)."""

    def keyed(df: DataFrame) -> DataFrame:
        text = strip(F.col("key_text"))
        number = integer_key(F.col("key_text"))
        return df.withColumn("key", number).withColumn("other", F.when(number.isNull() & (text != ""), text)).drop("key_text").where("key is not null or other is not null")

    refs = keyed(columns(references, "table_name", "row_id", "key_text", "loaded_at"))
    own = keyed(columns(parents, "parent_id", "key_text", "loaded_at", "removed").withColumn("removed", F.coalesce("removed", F.lit(False))))
    beyond = keys_beyond_runs(refs, key_runs(own)).select(F.col("key").alias("orphan"))
    flagged = refs.where("key is not null").join(beyond, F.col("key") == F.col("orphan"), "left")
    texts = own.where("other is not null").select(F.col("other").alias("known")).distinct()
    flagged = flagged.withColumn("missing", F.col("orphan").isNotNull()).drop("orphan").unionByName(
        refs.where("key is null").join(texts, F.col("other") == F.col("known"), "left").withColumn("missing", F.col("known").isNull()).drop("known")
    )
    history = own.where("loaded_at is not null").groupBy("key", "other", "loaded_at").agg(F.max_by("removed", F.struct("parent_id", "removed")).alias("gone"))
    state = last_before(flagged, history, ["key", "other"], "loaded_at", [f"date_trunc('{unit}', loaded_at)" for unit in ("day", "hour", "second")], "gone", asked=refs)
    reason = F.when(F.col("missing"), "missing").when(F.col("loaded_at").isNull(), None).when(F.col("gone").isNull(), "late").when(F.col("gone"), "deleted")
    return state.select("table_name", "row_id", F.date_format("loaded_at", "yyyy-MM").alias("period"), reason.alias("reason")).where("reason is not null")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, period and reason."""
    return orphans.groupBy("table_name", "period", "reason").agg(F.count(F.lit(1)).alias("n_rows"))
