"""Charts of long records by stretches: rows are ordered once, and what crosses stretches is what whole windows have."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import charts, intervals, long_records, windows

CHART = charts.Chart(h=2.0, k=0.25, sustained=5, weight=0.05)


def made_rows(spark, holes):
    """Records with slow waves, whose runs beyond the limit are longer than several stretches, and single large steps against them."""
    pick = random.Random(11)
    rows = []
    for record, n in (("a", 700), (None, 90), ("c", 1), ("d", 6), ("e", 5), ("f", 333)):
        for i in range(n):
            wave = 60.0 * (1 if (i // 40) % 2 else -1) if i >= 20 else 0.0
            value = 800.0 + wave + pick.gauss(0, 25) - 400.0 * (i % 97 == 96)
            rows.append((record, i, None if holes and record in ("a", "f") and i in (150, 151, 300) else round(value, 3)))
    pick.shuffle(rows)
    return spark.createDataFrame(rows, "record_id string, at_ long, rr_ms double").repartition(5)


@pytest.mark.parametrize("holes", [False, True])
def test_runs_and_means_across_stretches(spark, monkeypatch, holes):
    monkeypatch.setattr(long_records, "STRETCH", 3)
    rows = made_rows(spark, holes)
    plain = intervals.with_clock(intervals.series(rows, "record_id", "rr_ms", ["at_"]), 20)
    want = {r.record_id: r.asDict() for r in charts.all_features(windows.multi_scale(plain, full=1800.0), CHART).collect()}
    found = long_records.record_charts(long_records.clocked(rows, ["at_"], 20, parts=7), CHART, hold=50)
    got = {r.record_id: r.asDict() for r in found.collect()}
    assert got.keys() == want.keys() and len(got["a"]) == 27 and got["a"]["cusum_alarm_count"] > 100
    for key, row in got.items():
        unknown = holes and key in ("a", "f")
        if unknown:
            # the mean is known up to the first missing interval alone
            e, top = 0.0, 0.0
            for r in plain.where(F.col("record_id") == key).where("idx < 150").orderBy("idx").collect():
                e = CHART.weight * r.z + (1 - CHART.weight) * e
                top = max(top, abs(e))
            assert row["ewma_last"] is row["ewma_slope"] is row["ewma_alarm_count"] is None and abs(row["ewma_max_abs"] - top) < 1e-9
        for c in [c for c in row if c != "record_id" and not (unknown and c.startswith("ewma_"))]:
            v, w = row[c], want[key][c]
            assert (v is None) == (w is None) and (v is None or abs(v - w) < 1e-7), (key, c, v, w)


def test_a_long_record_is_ordered_and_written_once(spark, monkeypatch):
    """Every table of a row an interval is one more pass of all rows through the disk."""
    n, sizes = 30_000, []

    def counted(df, name="scan"):
        table = written(df, name)
        sizes.append((table.count(), "rr" in table.columns and table.agg(F.sum(F.size("rr"))).head()[0]))
        return table

    written = long_records.written
    monkeypatch.setattr(long_records, "written", counted)
    rows = spark.range(n).select(F.lit("x").alias("record_id"), F.col("id").alias("at_"), (800.0 + F.col("id") % 11).alias("rr_ms"))
    assert long_records.record_charts(long_records.clocked(rows, ["at_"], 200, parts=4), charts.Chart(), hold=1000).head().n_rr == n
    # the stretches, and the moving ranges that percentiles are taken of
    assert [s for s in sizes if s[0] >= n / 2] == [(n, False)] and [s[1] for s in sizes if s[1]] == [n]
