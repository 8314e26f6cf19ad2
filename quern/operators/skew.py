"""Results per key when a few keys hold most rows.

Both results come from exact selection: histograms of values are counted (partial counts in every task, merged), the cells that matter are refined into
histograms of their own, and so on until a cell holds one value only. No task ever holds a hot key's values.

Hot keys: the values are hashes of the keys. Cells of fewer rows than a hot key has can't hold one and leave; at most 1/share cells stay in
each round, whatever the data. Keys whose cell holds one hash are then counted exactly, as two keys might share it.

Quantiles per key: keys of at most LARGE rows are sorted in groups; for all others each round counts the values in the cells of a key's open ranges (with each
cell's least and greatest value), takes the cell that holds the wanted rank and makes it the next range. What is open, one row per key and quantile, is itself a table, written after
each round, so neither the number of large keys nor their rows bound the size of the job.

Defined results: keys are trimmed; null and blank keys are in no result (but count in the number of all rows); null, NaN and infinite
values count for nothing. The quantile q of n values is the one of rank max(1, ceil(q n)) in ascending order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped_or_null
from ..sources.shared import written
from ..sources.tables import columns

#: Bits of the hash that a round refines, and bits of the hash.
ROUND_BITS, BITS = 12, 60
#: Cells of a range.
CELLS = 1024
#: Keys of more rows than this are never sorted in one task.
LARGE = 1_000


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key_value, n_rows) of the trimmed, non-blank keys that hold at least `share` of all rows."""
    keys = columns(df, key).select(stripped_or_null(F.col(key)).alias("key_value"))
    hashed = F.shiftrightunsigned(F.xxhash64("key_value"), 64 - BITS)

    def histogram(rows: DataFrame, bits: int) -> DataFrame:
        cell = F.when(F.col("key_value").isNotNull(), F.shiftrightunsigned(hashed, BITS - bits)).alias("cell")
        return rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("least"), F.max(hashed).alias("most"))

    bits = ROUND_BITS
    counted = histogram(keys, bits).collect()  # at most 2 ** ROUND_BITS + 1 rows
    least = max(1, math.ceil(sum(r.n for r in counted) * share - 1e-9))
    kept = [r for r in counted if r.cell is not None and r.n >= least]
    resolved = [r.least for r in kept if r.least == r.most]
    while open_ := [r.cell for r in kept if r.least != r.most]:
        within = F.col("key_value").isNotNull() & F.shiftrightunsigned(hashed, BITS - bits).isin(open_)
        bits += ROUND_BITS
        kept = histogram(keys.where(within), bits).where(F.col("n") >= least).collect()  # at most 1 / share rows
        resolved += [r.least for r in kept if r.least == r.most]
    refined = keys.where(F.col("key_value").isNotNull() & hashed.isin(resolved)) if resolved else keys.limit(0)
    return refined.groupBy("key_value").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)


def _rank(q: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(q * n - F.lit(1e-9)))


def exact_quantiles(df: DataFrame, key: str, value: str, probabilities: tuple[float, ...], large: int = LARGE) -> DataFrame:
    """(key_value, q, quantile): exact quantiles of the double column `value` for each trimmed, non-blank key. Keys of more than `large` rows are resolved by selection."""
    rows = columns(df, key, value).select(stripped_or_null(F.col(key)).alias("key_value"), F.col(value).cast("double").alias("v")).where("key_value is not null and abs(v) < double('Infinity')")
    rows = written(rows)  # parsed once for all rounds
    ends = rows.groupBy("key_value").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    big = written(ends.where(F.col("n") > large))
    wanted = F.explode(F.array(*(F.lit(float(q)) for q in probabilities))).alias("q")
    small = rows.join(big, "key_value", "left_anti")
    at = Window.partitionBy("key_value")
    ranked = small.withColumn("rank", F.row_number().over(at.orderBy("v"))).withColumn("n", F.count(F.lit(1)).over(at))
    out = ranked.select("*", wanted).where(F.col("rank") == _rank(F.col("q"), F.col("n"))).select("key_value", "q", F.col("v").alias("quantile"))
    state = big.select("key_value", wanted, "n", "lo", "hi").select("key_value", "q", "lo", "hi", _rank(F.col("q"), F.col("n")).alias("rank"))
    while True:
        out = out.unionByName(state.where("lo = hi").select("key_value", "q", F.col("lo").alias("quantile")))
        open_ = state.where("lo <> hi")
        if open_.isEmpty():
            return out
        state = written(_refined(rows, open_))


def _refined(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """The open (key_value, q, lo, hi, rank) with the range of the cell that holds the rank, and the rank within it."""
    ranges = open_.select(F.col("key_value").alias("k"), "lo", "hi").distinct()
    inside = rows.join(ranges, (F.col("key_value") == F.col("k")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    scale = F.when(F.col("hi") - F.col("lo") < float("inf"), 1.0).otherwise(0.5)  # halved where the range itself isn't finite; the ends of a range always fall into different cells
    place = (F.col("v") * scale - F.col("lo") * scale) / (F.col("hi") * scale - F.col("lo") * scale)
    cell = F.least(F.lit(CELLS - 1), F.floor(place * CELLS).cast("int"))
    counts = inside.groupBy("k", "lo", "hi", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    upto = Window.partitionBy("k", "lo", "hi").orderBy("cell")  # at most CELLS rows
    counts = counts.withColumn("upto", F.sum("n").over(upto))
    asked = open_.select(F.col("key_value"), "q", F.col("lo").alias("a"), F.col("hi").alias("b"), "rank")
    hit = asked.join(counts, (F.col("key_value") == F.col("k")) & (F.col("a") == F.col("lo")) & (F.col("b") == F.col("hi")) & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return hit.select("key_value", "q", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))
