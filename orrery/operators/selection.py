"""Exact percentiles of groups of any size, by histograms that narrow around the wanted ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import attach, written

#: Values of one group that a task may hold; larger groups are narrowed until what is left is no more.
HOLD = 1 << 20
#: Buckets of one histogram.
BUCKETS = 4096


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: Column, shares: Sequence[float], hold: int = HOLD) -> DataFrame:
    """(by, share, value, n): the linearly interpolated percentile of every group at every share.

    Groups of at most ``hold`` values are sorted by themselves. Of all larger groups at once, each pass counts the
    values between the bounds of every wanted rank in BUCKETS equal buckets and moves the bounds to the least and
    largest value of the bucket that holds the rank; rows are only counted, never moved, until the bounds meet or at
    most ``hold`` values are left between them. Nulls and NaN are left out, values must be finite; groups may be null;
    groups without values give no rows.
    """
    by = list(by)
    clean = rows.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = written(clean.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "percentiles")
    small = attach(clean, sizes.where(F.col("n") <= hold).select(*by), by)
    found = small.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares])).alias("_q"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("_q").alias("value"))
    out = found.select(*by, "n", F.explode(pairs).alias("_p")).select(*by, F.col("_p")["share"].alias("share"), F.col("_p")["value"].alias("value"), "n")
    large = sizes.where(F.col("n") > hold)
    if large.isEmpty():
        return out
    place = (F.col("n") - 1) * F.col("share")
    wanted = large.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_place", place)
    ranks = wanted.withColumn("_rank", F.explode(F.array(F.floor("_place"), F.ceil("_place")))).select(*by, "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_inside"))
    values = ranked_values(attach(clean, large.select(*by), by), by, ranks.distinct(), hold)
    low, high = values.select(*by, F.col("_rank").alias("_low"), F.col("_x").alias("_a")), values.select(*by, F.col("_rank").alias("_high"), F.col("_x").alias("_b"))
    both = wanted.withColumn("_low", F.floor("_place")).withColumn("_high", F.ceil("_place"))
    both = attach(attach(both, low, [*by, "_low"]), high, [*by, "_high"])
    part = F.col("_place") - F.col("_low")
    exact = F.when(F.col("_low") == F.col("_high"), F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_b"))
    return out.unionByName(both.select(*by, "share", exact.alias("value"), "n"))


def ranked_values(clean: DataFrame, by: list[str], ranks: DataFrame, hold: int = HOLD) -> DataFrame:
    """(by, _rank, _x): the values of wanted ranks, counted from 0, of the groups in ``clean``."""
    ranks = written(ranks, "percentiles")
    spread = F.col("_hi") / 2 - F.col("_lo") / 2
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / spread * BUCKETS))
    order = Window.partitionBy(*by, "_id").orderBy("_bucket")
    while True:
        open_ = ranks.where((F.col("_lo") < F.col("_hi")) & (F.col("_inside") > hold))
        if open_.isEmpty():
            break
        # ranks between the same bounds share a histogram, which goes by the least of them
        shared = open_.groupBy(*by, "_lo", "_hi", "_below").agg(F.min("_rank").alias("_id"), F.collect_list("_rank").alias("_ranks"))
        shared = written(shared, "percentiles")
        inside = _within(clean, by, shared.select(*by, "_id", "_lo", "_hi", "_below")).withColumn("_bucket", bucket)
        counted = inside.groupBy(*by, "_id", "_below", "_bucket").agg(F.count(F.lit(1)).alias("_inside"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        counted = counted.withColumn("_first", F.col("_below") + F.sum("_inside").over(order) - F.col("_inside"))
        held = (F.col("_first") <= F.col("_rank")) & (F.col("_rank") < F.col("_first") + F.col("_inside"))
        found = attach(counted, shared.select(*by, "_id", "_ranks"), [*by, "_id"]).withColumn("_rank", F.explode("_ranks"))
        moved = found.where(held).select(*by, "_rank", "_lo", "_hi", F.col("_first").alias("_below"), "_inside")
        done = ranks.where((F.col("_lo") == F.col("_hi")) | (F.col("_inside") <= hold))
        ranks = written(done.unionByName(moved), "percentiles")
    met = ranks.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_x"))
    left = _within(clean, by, ranks.where("_lo < _hi").select(*by, "_rank", "_lo", "_hi", "_below"))
    left = left.groupBy(*by, "_rank", "_below", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*by, "_rank").orderBy("_v"))
    left = left.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
    return met.unionByName(left.select(*by, "_rank", F.col("_v").alias("_x")))


def _within(clean: DataFrame, by: list[str], bounds: DataFrame) -> DataFrame:
    """The values with each of their group's bounds that they lie in."""
    lists = bounds.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in bounds.columns if c not in by])).alias("_r"))
    # rows are laid beside all bounds and then compared, which compiles; a filter over the list would be interpreted
    return attach(clean, lists, by).select(*by, "_v", F.inline("_r")).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
