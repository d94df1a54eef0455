"""The older record pipeline: dense windows of successive differences, a robust score, gated and charted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .charts import Chart, cusum_points

BASELINE_WINDOWS = 10
SUB_WINDOWS = 3
SUB_WINDOW_LEAST = 3


def dense_windows(clocked: DataFrame, seconds: float) -> DataFrame:
    """(record_id, pos, center_s, rmssd, gate): every window of the record, also those without intervals.

    ``rmssd`` is null under two intervals; ``gate`` holds if each third of the window has three intervals.
    """
    keys = ["record_id", "pos"]
    rows = clocked.withColumn("pos", F.floor(F.col("t") / seconds).cast("long")).where(F.col("pos") * seconds < F.col("max_t"))
    part = F.floor((F.col("t") - F.col("pos") * seconds) / (seconds / SUB_WINDOWS))
    rows = rows.withColumn("_d", F.col("rr_ms") - F.lag("rr_ms").over(Window.partitionBy(*keys).orderBy("idx"))).withColumn("_sub", F.least(part, F.lit(SUB_WINDOWS - 1)))
    counts = [F.count_if(F.col("_sub") == j) >= SUB_WINDOW_LEAST for j in range(SUB_WINDOWS)]
    gate = counts[0]
    for c in counts[1:]:
        gate = gate & c
    made = rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"), gate.alias("gate"))
    spans = clocked.groupBy("record_id").agg(F.max("max_t").alias("max_t"))
    grid = spans.select("record_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("max_t") / seconds) - 1, F.lit(0)).cast("long"))).alias("pos"))
    out = grid.join(made, keys, "left")
    return out.select(*keys, ((F.col("pos") + 0.5) * seconds).alias("center_s"), "rmssd", F.coalesce("gate", F.lit(False)).alias("gate"))


def robust_scores(windows: DataFrame, baseline: int = BASELINE_WINDOWS) -> DataFrame:
    """Adds ``z``: deviation from the median of the first ``baseline`` valid windows, in median deviations of these.

    Null throughout a record with fewer valid windows; a median deviation of 0 counts as 1e-6.
    """
    whole = Window.partitionBy("record_id")
    valid = F.col("rmssd").isNotNull()
    rank = F.row_number().over(Window.partitionBy("record_id", valid).orderBy("pos"))
    rows = windows.withColumn("_base", F.when(valid & (rank <= baseline), F.col("rmssd")))
    rows = rows.withColumn("_n", F.count("_base").over(whole)).withColumn("_med", F.median("_base").over(whole))
    rows = rows.withColumn("_mad", F.median(F.abs(F.col("_base") - F.col("_med"))).over(whole))
    spread = F.when(F.col("_mad") == 0, 1e-6).otherwise(F.col("_mad"))
    return rows.withColumn("z", F.when(F.col("_n") >= baseline, (F.col("rmssd") - F.col("_med")) / spread)).drop("_base", "_n", "_med", "_mad")


def gated(windows: DataFrame) -> DataFrame:
    """Scores and values only where the window passed its gate."""
    return windows.withColumn("z", F.when(F.col("gate"), F.col("z"))).withColumn("rmssd", F.when(F.col("gate"), F.col("rmssd")))


def charted(windows: DataFrame, chart: Chart = Chart()) -> DataFrame:
    """Cumulative sums and alarms over windows with gaps: a gap keeps the sums, yields none itself, and breaks runs."""
    points = cusum_points(windows, chart, ["record_id"])
    hidden = F.col("z").isNull()
    return points.withColumn("s_pos", F.when(~hidden, F.col("s_pos"))).withColumn("s_neg", F.when(~hidden, F.col("s_neg"))).withColumn("alarm", F.col("alarm") & ~hidden)


def rising_edges(alarm: Column, order: Window) -> Column:
    """1 where an alarm begins."""
    return (alarm & ~F.coalesce(F.lag(alarm).over(order), F.lit(False))).cast("int")


def record_features(clocked: DataFrame, seconds: float, chart: Chart = Chart(), gate: bool = True, baseline: int = BASELINE_WINDOWS) -> DataFrame:
    """Fourteen features of each record: alarms, extreme and final sums, medians, gate share, irregularity."""
    scored = robust_scores(dense_windows(clocked, seconds), baseline)
    points = charted(gated(scored) if gate else scored, chart)
    points = points.withColumn("_edge", rising_edges(F.col("alarm"), Window.partitionBy("record_id").orderBy("pos")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    charts = points.groupBy("record_id").agg(
        F.sum("_edge").alias("alarm_events"),
        (F.count_if("alarm") / F.count(F.lit(1))).alias("pct_alarm_sustained"),
        F.greatest(F.max("s_pos"), F.max("s_neg")).alias("max_cusum"),
        F.greatest(last("s_pos"), last("s_neg")).alias("final_cusum"),
        F.max("s_pos").alias("max_cusum_pos"),
        F.max("s_neg").alias("max_cusum_neg"),
        last("s_pos").alias("final_cusum_pos"),
        last("s_neg").alias("final_cusum_neg"),
        F.median("rmssd").alias("median_rmssd"),
        F.median("z").alias("median_z"),
        F.avg(F.col("gate").cast("double")).alias("sqi_ok_fraction"),
    )
    return charts.join(irregularity(clocked), "record_id")


def irregularity(clocked: DataFrame) -> DataFrame:
    """Relative deviation (population), mean absolute step over the mean, and median deviation of a whole record."""
    whole = Window.partitionBy("record_id")
    x = F.col("rr_ms")
    rows = clocked.withColumn("_d", F.abs(x - F.lag(x).over(whole.orderBy("idx")))).withColumn("_far", F.abs(x - F.median(x).over(whole)))
    return rows.groupBy("record_id").agg((F.stddev_pop(x) / F.avg(x)).alias("rr_cv"), (F.avg("_d") / F.avg(x)).alias("rr_masd_over_mean"), F.median("_far").alias("segment_rr_mad_ms"))


def scan(manifest: DataFrame, features: DataFrame) -> DataFrame:
    """Every record of the manifest with its features; a record without intervals keeps its row, with nulls."""
    return manifest.join(features, "record_id", "left")
