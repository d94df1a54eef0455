"""Interval series: differences of event times, the running clock, and the record's baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASELINE_INTERVALS = 200
#: Rows of one task, counted as often as the windows' scales repeat them.
ROWS_A_TASK = 200_000


def intervals_from_events(events: DataFrame, record: str, at: Column, order: list[str], per_ms: float = 1.0) -> DataFrame:
    """(record_id, idx, rr_ms): successive differences of ``at`` (in units of ``per_ms`` to a millisecond).

    The first event of a record yields no interval. ``order`` must be total within a record.
    """
    w = Window.partitionBy("record_id").orderBy(*order)
    keyed = events.withColumn("record_id", F.col(record)).withColumn("_at", at)
    steps = keyed.withColumn("rr_ms", (F.col("_at") - F.lag("_at").over(w)) / per_ms).withColumn("idx", F.row_number().over(w) - 2)
    return steps.where("idx >= 0").select("record_id", F.col("idx").cast("long").alias("idx"), "rr_ms")


def series(df: DataFrame, record: str, value: str, order: list[str], copies: int | None = None) -> DataFrame:
    """(record_id, idx, rr_ms): a column of positive values taken as the intervals themselves.

    With ``copies``, the number of windows a row will lie in, records are dealt to as many tasks as hold
    ROWS_A_TASK of these rows each, so that what a task sorts does not grow with the table.
    """
    w = Window.partitionBy("record_id").orderBy(*order)
    keyed = df.select(F.col(record).alias("record_id"), F.col(value).alias("rr_ms"), *[c for c in order if c not in ("record_id", "rr_ms")])
    if copies:
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * copies // ROWS_A_TASK))
        keyed = keyed.repartition(tasks, "record_id")
    return keyed.select("record_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "rr_ms")


def with_clock(intervals: DataFrame, baseline: int = BASELINE_INTERVALS) -> DataFrame:
    """Adds to (record_id, idx, rr_ms) the clock, the record's size and its baseline.

    ``t`` is the time in seconds at the end of each interval; milliseconds are summed as decimals, so that it does
    not depend on the order of summation. ``mu`` and ``sigma`` are mean and sample deviation of the first
    ``baseline`` intervals (sigma 1 where it is undefined or 0), ``z`` the standardized interval, ``n_total`` and
    ``max_t`` the record's length in intervals and seconds. One shuffle by record serves all of it.
    """
    whole = Window.partitionBy("record_id")
    upto = whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.when(F.col("idx") < baseline, F.col("rr_ms"))
    sigma = F.stddev_samp(first).over(whole)
    out = intervals.withColumn("t", F.sum(F.col("rr_ms").cast("decimal(20,6)")).over(upto).cast("double") / 1000.0)
    out = out.withColumn("n_total", F.count(F.lit(1)).over(whole)).withColumn("max_t", F.max("t").over(whole))
    out = out.withColumn("mu", F.avg(first).over(whole)).withColumn("sigma", F.when(sigma > 0, sigma).otherwise(1.0))
    return out.withColumn("z", (F.col("rr_ms") - F.col("mu")) / F.col("sigma"))


def baselines(clocked: DataFrame) -> DataFrame:
    """One row for each record: mu, sigma, intervals, duration."""
    return clocked.groupBy("record_id").agg(F.first("mu").alias("mu"), F.first("sigma").alias("sigma"), F.first("n_total").alias("n_rr"), F.first("max_t").alias("duration_s"))
