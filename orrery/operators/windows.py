"""Record-anchored windows: fixed counts, fixed durations and whole records, all scales in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["record_id", "window_type", "window_size", "window_index"]
PROHIBITED_SECONDS = 30.0


class ProhibitedWindowError(ValueError):
    """A window length that must not be used in a main task."""


def guard(seconds: float, task: str) -> None:
    """30-second windows are refused for tasks labelled as main."""
    if seconds == PROHIBITED_SECONDS and "main" in task:
        raise ProhibitedWindowError(f"{seconds:g}-second windows are not allowed in task {task!r}")


def _scale(kind: str, size: float, index: Column, keep: Column) -> Column:
    return F.when(keep, F.struct(F.lit(kind).alias("window_type"), F.lit(float(size)).alias("window_size"), index.cast("long").alias("window_index")))


def four_places(seconds: Column) -> Column:
    """Rounded as a decimal, half away from zero."""
    return F.round(seconds.cast("decimal(20,10)"), 4).cast("double")


def multi_scale(clocked: DataFrame, counts: Sequence[int] = (), seconds: Sequence[float] = (), full: float | None = None, task: str = "", least: int = 2) -> DataFrame:
    """Every interval once for each window it lies in.

    Count windows are consecutive blocks, without an incomplete tail. Time windows are [k w, (k+1) w) from the
    record's start as long as they begin before its end; those of fewer than ``least`` intervals are left out, their
    index is not reused. The whole-record window has ``full`` as its nominal size. Scales are exploded from one
    array, so the record's partitioning serves all. Adds window keys, ``n`` and ``pos`` within the window, its start
    and end in seconds, and ``t_local``, the clock restarted at the window.
    """
    for s in seconds:
        guard(s, task)
    idx, t = F.col("idx"), F.col("t")
    scales = [_scale("rr_count", n, F.floor(idx / n), F.floor(idx / n) < F.floor(F.col("n_total") / n)) for n in counts]
    scales += [_scale("time", s, F.floor(t / s), F.floor(t / s) * s < F.col("max_t")) for s in seconds]
    if full is not None:
        scales.append(_scale("full_record", full, F.lit(0), F.lit(True)))
    exploded = clocked.withColumn("_w", F.explode(F.filter(F.array(*scales), lambda s: s.isNotNull())))
    exploded = exploded.select(*[c for c in clocked.columns], "_w.*")
    whole = Window.partitionBy(*KEYS)
    ordered = whole.orderBy("idx")
    out = exploded.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("pos", (F.row_number().over(ordered) - 1).cast("long"))
    opened = F.first(t - F.col("rr_ms") / 1000.0).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("_open", F.when((F.col("window_index") == 0) & (F.col("window_type") != "time"), 0.0).otherwise(opened))
    out = out.where((F.col("window_type") != "time") | (F.col("n") >= least))
    start = F.when(F.col("window_type") == "time", F.col("window_index") * F.col("window_size")).when(F.col("window_type") == "full_record", 0.0).otherwise(F.col("_open"))
    end = F.when(F.col("window_type") == "time", F.least((F.col("window_index") + 1) * F.col("window_size"), F.col("max_t"))).otherwise(F.max("t").over(whole))
    out = out.withColumn("start_time_sec", four_places(start)).withColumn("end_time_sec", four_places(end))
    return out.withColumn("t_local", t - F.col("_open")).drop("_open")


def zero_based(windowed: DataFrame) -> DataFrame:
    """The variant whose local clock is 0 at a window's first interval."""
    first = F.first("t").over(Window.partitionBy(*KEYS).orderBy("idx"))
    return windowed.withColumn("t_local", F.col("t") - first)


def provenance(windowed: DataFrame) -> DataFrame:
    """One row for each window: its keys, bounds and number of intervals."""
    return windowed.groupBy(*KEYS).agg(F.first("start_time_sec").alias("start_time_sec"), F.first("end_time_sec").alias("end_time_sec"), F.count(F.lit(1)).alias("n_rr"))


def quarantined(clocked: DataFrame, least: int = 2) -> DataFrame:
    """Records with too few intervals for any feature, which the others do without."""
    return clocked.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_rr")).where(F.col("n_rr") < least)
