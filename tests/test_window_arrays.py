"""Features of windows from arrays of their intervals, against window functions over a row for each interval and window."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import charts, stats, window_arrays, windows
from orrery.operators.intervals import series, with_clock
from orrery.plans import estimator_queries, model_queries, wide_queries

COUNTS, SECONDS, FULL = (3, 5, 8, 25), (4.0,), 1800.0


def clocked(spark, records):
    rows = [(r, i, v) for r, values in records.items() for i, v in enumerate(values)]
    return with_clock(series(spark.createDataFrame(rows, "r string, i long, v double"), "r", "v", ["i"]), 20)


def drawn(odd):
    draw = random.Random(11)
    records = {f"r{n}": [draw.choice((0.0, 300.0, 325.0, 400.0, 625.0, 900.0)) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 24, 25, 26, 140, 301)}
    records |= {"drift": [500 + 3.3 * i + draw.gauss(0, 40) for i in range(160)], "flat": [333.3] * 60, "zero": [0.0] * 30, "turns": [300.0, 900.0] * 40, "three": [300.0, 650.0, 650.0] * 30}
    if odd:
        records |= {"gap": [None if i % 9 == 4 else 400.0 + i for i in range(70)], "back": [(-1) ** i * 500.0 for i in range(50)]}
    return records


def same(got, want):
    keys = windows.KEYS
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for k, row in want.items():
        for c, v in row.items():
            assert got[k][c] == v or v is not None and got[k][c] is not None and abs(got[k][c] - v) < 1e-9, (k, c, got[k][c], v)


@pytest.mark.parametrize("chart", [charts.Chart(h=3.0), charts.Chart(h=1.0, sustained=3, limit=1.5, weight=0.4)])
def test_arrays_give_what_window_functions_give(spark, monkeypatch, chart):
    monkeypatch.setattr(window_arrays, "ROWS", 200)
    rows = clocked(spark, drawn(False))
    got = window_arrays.all_features(rows, COUNTS, SECONDS, FULL, chart)
    want = charts.all_features(windows.multi_scale(rows, COUNTS, SECONDS, FULL), chart)
    assert got.schema.simpleString() == want.schema.simpleString()
    same(got, want)


def test_unfit_records_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(window_arrays, "LONGEST", 150)
    rows = clocked(spark, drawn(True))
    plain, others = window_arrays.split(rows)
    assert {r[0] for r in others.select("record_id").distinct().collect()} == {"gap", "back", "r301", "drift"}
    assert plain.count() + others.count() == rows.count() and window_arrays.unfit_records(rows, "record_id", F.col("rr_ms")) == 4


def test_window_features_lay_no_row_out_for_each_window(spark, monkeypatch):
    """Plain intervals are charted without a row for each of their windows; missing and negative ones as before."""
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_suppkey < 4")
    monkeypatch.setattr(wide_queries, "load", lambda *_: items)
    laid = []
    plain = windows.multi_scale
    monkeypatch.setattr(windows, "multi_scale", lambda *a, **k: laid.append(1) or plain(*a, **k))
    same(wide_queries.window_features(spark, ""), charts.all_features(plain(wide_queries.supplier_intervals(spark, ""), wide_queries.COUNTS, wide_queries.SECONDS, wide_queries.FULL), wide_queries.CHART))
    assert not laid
    quantity = F.when((F.col("l_suppkey") == 1) & (F.col("l_linenumber") == 2), None).when((F.col("l_suppkey") == 2) & (F.col("l_linenumber") == 3), -4.0).otherwise(F.col("l_quantity"))
    items = items.withColumn("l_quantity", quantity)
    same(wide_queries.window_features(spark, ""), charts.all_features(plain(wide_queries.supplier_intervals(spark, ""), wide_queries.COUNTS, wide_queries.SECONDS, wide_queries.FULL), wide_queries.CHART))
    assert laid


@pytest.mark.parametrize("make, scales", [
    (lambda s, d: model_queries.folded_records(model_queries.record_features(s, d)), 6),
    (lambda s, d: model_queries._window_rows(s, d), 6),
    (lambda s, d: model_queries.folded_records(model_queries.whole_record_features(s, d)), 1),
    (estimator_queries.whole_records, 1),
])
def test_models_and_estimators_chart_only_their_scales_and_from_arrays(spark, monkeypatch, make, scales):
    def laid(*_):
        raise AssertionError("a row for each interval and window")

    charted, plain = [], window_arrays._scales
    monkeypatch.setattr(windows, "multi_scale", laid)
    monkeypatch.setattr(window_arrays, "_scales", lambda *a: charted.append(plain(*a)) or charted[-1])
    assert make(spark, "/root/testdata/sf0.001").count()
    assert [len(c) for c in charted] == [scales]


def test_correlations_of_all_rows_share_orders(spark, monkeypatch):
    draw = random.Random(7)
    names = ["a", "b", "c", "d", "e"]
    rows = [(i, 1, float(draw.randrange(9)), None if i % 4 == 0 else draw.gauss(0, 1), i * 0.5 if i % 3 else float("nan"), 2.0, None) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, 1, 1.0, 1.0, 1.0, 1.0, 1.0)], "record_id long, g int, a double, b double, c double, d double, e double")
    want = {(r.a, r.b): (r.rho, r.n) for r in stats.spearman(df, names, by=["g"]).collect()}
    monkeypatch.setattr(stats, "average_ranks", None)
    got = {(r.a, r.b): (r.rho, r.n) for r in stats.spearman(df, names).collect()}
    assert got.keys() == want.keys()
    for k, (rho, n) in want.items():
        assert got[k][1] == n and (got[k][0] == rho or abs(got[k][0] - rho) < 1e-12)


def test_constant_features_correlate_with_none(spark):
    """The variance of equal ranks, added up over many tasks, may differ from 0 by rounding."""
    df = spark.range(1000, numPartitions=7).select(F.col("id").alias("record_id"), F.lit(0.0).alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(1).alias("g"))
    for by in (None, ["g"]):
        assert [r.rho for r in stats.spearman(df, ["a", "b"], by=by).collect()] == [None]


def test_medians_under_all_settings_are_those_of_sweeps(spark, monkeypatch):
    """Each record's medians are held once for all settings; what arrays do not fit goes through the sweeps."""
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_suppkey < 3").repartition(2)
    items = items.unionByName(items.withColumn("l_shipdate", F.col("l_shipdate") + F.expr("INTERVAL 9 YEARS"))).cache()
    monkeypatch.setattr(wide_queries, "load", lambda *_: items)
    got = {(*r[:5],): r for r in model_queries.tuning_medians(spark, "").collect()}
    swept = model_queries.swept_medians(model_queries.supplier_windows(spark, "").where(model_queries.TUNED).where("n >= 6"))
    want = {(r[0], r[0] // 2, r[0] % 2, *r[1:3]): r[3:] for r in swept.collect()}
    assert got.keys() == want.keys() and len({k[3:] for k in got}) == 3
    assert all(abs(a - (b or 0.0)) < 1e-9 for k, row in want.items() for a, b in zip(got[k][5:], row))
    monkeypatch.setattr(window_arrays, "LONGEST", 10)
    assert {(*r[:5],): r for r in model_queries.tuning_medians(spark, "").collect()}.keys() == want.keys()


def test_choice_of_settings_from_medians_held_once(spark, monkeypatch):
    draw = random.Random(2)
    columns = model_queries._GRID_COLUMNS
    rows = [(i, i // 2, i % 2, "time", 300.0, *[draw.gauss(i % 2 * (j % 3) / 2, 1) for j in range(len(columns))]) for i in range(24)]
    medians = spark.createDataFrame(rows, "record_id long, pair_id long, y long, window_type string, window_size double, " + ", ".join(f"{c} double" for c in columns))
    grid = window_arrays.Grid([3.0], [0.25, 0.5], [0.1], [1], [2.5], [2.25])
    of_all = {s: p for s, p in zip(model_queries.GRID.settings, model_queries.GRID.places(model_queries.TUNED_FEATURES))}
    monkeypatch.setattr(window_arrays.Grid, "places", lambda self, _: [of_all[s] for s in grid.settings])
    monkeypatch.setattr(window_arrays.Grid, "settings", property(lambda _: [(3.0, 0.25, 0.1, 1, 2.5), (3.0, 0.5, 0.1, 1, 2.5)]))
    got = {r.outer: r for r in model_queries.nested_choice_of_medians(medians).collect()}
    want = {r.outer: r for r in model_queries.nested_choice(model_queries.under_settings(medians), model_queries.TUNED_FEATURES).collect()}
    assert got.keys() == want.keys() and len(got) == 5
    for k, r in want.items():
        assert got[k][:8] == r[:8] and all(abs(a - b) < 1e-7 for a, b in zip(got[k][8:], r[8:]))
