"""References whose medians are made for the columns that need them alone."""

from pyspark.sql import functions as F

from orrery.operators import keyed_distance


def test_medians_of_missing_columns_alone_give_equal_references(spark):
    names = ["a", "b", "c"]
    made = [(i % 2, float(i * 7 % 11), None if i % 5 == 0 else float(i * i % 13), float("inf") if i == 3 else float(i % 4)) for i in range(60)]
    rows = spark.createDataFrame(made, "key long, a double, b double, c double")
    filled = keyed_distance.lacking(rows, names)
    assert filled == ["b", "c"]
    far = [sorted(keyed_distance.with_keyed_distance(rows, keyed_distance.fit_keys(rows.where(F.col("a") < 9), names, ["key"], filled=f), names, ["key"]).select("key", F.round("dm", 9)).collect()) for f in (None, filled)]
    assert len(far[0]) == 60 and far[0] == far[1]
