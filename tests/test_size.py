"""What tasks hold does not grow with the tables."""

from pyspark.sql import functions as F

from orrery.operators import charts, intervals, windows
from orrery.operators.intervals import with_clock


def events(spark):
    rows = spark.range(600).select((F.col("id") % 12).alias("user"), F.col("id").alias("at"), (F.lit(500.0) + F.pmod(F.col("id") * 37, F.lit(91))).alias("value"))
    return rows.repartition(3)


def test_records_are_dealt_by_rows_and_copies(spark, monkeypatch):
    monkeypatch.setattr(intervals, "ROWS_A_TASK", 100)
    made = intervals.series(events(spark), "user", "value", ["at"], 5)
    assert made.rdd.getNumPartitions() == 30
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, intervals.series(events(spark), "user", "value", ["at"]).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_need_no_order_of_their_own(spark):
    windowed = windows.multi_scale(with_clock(intervals.series(events(spark), "user", "value", ["at"], 3), 10), [10], [], 1800.0)
    assert plan(charts.cusum_points(windowed)).count("Sort [") - plan(windowed).count("Sort [") <= 1
    swept = charts.cusum_sweep(windowed, [0.25, 0.5], [3.0, 5.0], [1, 2, 3], ["window_type"])
    assert plan(swept).count("Sort [") - plan(windowed).count("Sort [") <= 1
    assert swept.count() == 2 * 2 * 2 * 3
