"""From windows to records, and over the sequence of a record's windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import how

RECORD_KEYS = ["record_id", "pair_id", "y", "window_type", "window_size"]
SUFFIXES = ["global_median", "global_p90", "global_max", "late_third_median", "late_third_p90", "late_third_max", "last5_mean", "last5_max", "slope_over_time", "late_minus_early"]


def records_of_windows(features: DataFrame, names: list[str], span_s: float, keys: list[str] = RECORD_KEYS, empty_sum_is_zero: bool = True) -> DataFrame:
    """One row for each record and scale.

    Counts are summed (0 where all are null, or null if ``empty_sum_is_zero`` is off), first alarms take the least,
    extremes the largest and all else the median. ``lead_time_sec`` is the time from the first absolute alarm to
    ``span_s`` for y = 1, ``false_alarms_per_hour`` the alarm rate for y = 0.
    """
    made = []
    for c in names:
        kind = how(c)
        value = {"sum": F.sum(c), "min": F.min(c), "max": F.max(c), "median": F.median(c)}[kind]
        made.append((F.coalesce(value, F.lit(0)) if kind == "sum" and empty_sum_is_zero else value).alias(c))
    alarm = F.min(F.col("start_time_sec") + F.col("cusum_first_alarm_time_sec"))
    out = features.groupBy(*keys).agg(*made, F.sum("n_rr").alias("n_rr"), F.max("end_time_sec").alias("end_time_sec"), alarm.alias("cusum_first_alarm_abs_sec"))
    hours = F.col("end_time_sec") / 3600.0
    lead = F.when((F.col("y") == 1) & F.col("cusum_first_alarm_abs_sec").isNotNull(), span_s - F.col("cusum_first_alarm_abs_sec"))
    rate = F.when((F.col("y") == 0) & (hours > 0), F.col("cusum_alarm_count") / hours)
    return out.withColumn("lead_time_sec", lead).withColumn("false_alarms_per_hour", rate)


def temporal(features: DataFrame, names: list[str], keys: list[str] = RECORD_KEYS, order: str = "start_time_sec") -> DataFrame:
    """Ten figures of each feature over a record's windows in time order.

    Thirds and the last five are counted over all rows, nulls included; statistics are over the values there are; the
    slope is against the row number, so gaps keep their width.
    """
    w = Window.partitionBy(*keys)
    rows = features.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    third = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    late, early, last = F.col("_i") >= F.col("_n") - third, F.col("_i") < third, F.col("_i") >= F.col("_n") - 5
    out = []
    for c in names:
        x = F.col(c)
        in_late, in_last = F.when(late, x), F.when(last, x)
        values = [
            F.median(x), F.percentile(x, 0.9), F.max(x), F.median(in_late), F.percentile(in_late, 0.9), F.max(in_late), F.avg(in_last), F.max(in_last),
            F.regr_slope(x, F.col("_i").cast("double")), F.avg(in_late) - F.avg(F.when(early, x)),
        ]
        out += [v.alias(f"{c}_{s}") for v, s in zip(values, SUFFIXES)]
    return rows.groupBy(*keys).agg(*out, F.count(F.lit(1)).alias("n_windows"))


def temporal_names(names: list[str]) -> list[str]:
    return [f"{c}_{s}" for c in names for s in SUFFIXES]


def labels_are_unused(features: DataFrame, names: list[str], keys: list[str], label: str = "y") -> bool:
    """Whether the temporal figures stay as they are when the labels are swapped."""
    plain = [k for k in keys if k != label]
    swapped = features.withColumn(label, 1 - F.col(label))
    a, b = (temporal(f, names, keys).drop(label) for f in (features, swapped))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and bool(plain)
