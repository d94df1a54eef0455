"""Truth tables, plain recursions and invariances of the series operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import features
from orrery.operators import aggregate, charts, folds, intervals, legacy, mahalanobis, models, stats, windows
from orrery.sources import files, manifests, wfdb

CHART = charts.Chart(h=2.0, k=0.5, sustained=2)


def points(spark, values, z=None):
    rows = [("a", k, float(v), float(v if z is None else z[k])) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "record_id string, idx long, rr_ms double, z double").withColumn("t", F.col("idx").cast("double") + 1)
    df = df.withColumn("n_total", F.lit(len(rows)).cast("long")).withColumn("max_t", F.lit(float(len(rows))))
    return windows.multi_scale(df, full=1800.0)


def test_chart_grid_against_single_charts(spark):
    rng = random.Random(5)
    w = points(spark, [rng.gauss(0.3, 1.4) for _ in range(90)])
    grid = charts.chart_grid(w, [0.25, 0.5], [2.0, 3.0], [0.1, 0.3], [1, 3], [1.5, 2.5], ["record_id"]).collect()
    assert len(grid) == 32
    for h, k, lam, sustained, limit in [(2.0, 0.25, 0.1, 3, 1.5), (3.0, 0.5, 0.3, 1, 2.5)]:
        chart = charts.Chart(h=h, k=k, sustained=sustained, weight=lam, limit=limit)
        row = next(r for r in grid if (r.h, r.k, r.lam, r.sustained, r.shewhart_l) == (h, k, lam, sustained, limit))
        assert row.cusum_alarms == charts.cusum(w, chart).first().cusum_alarm_count > 0
        assert row.ewma_alarms == charts.ewma(w, chart).first().ewma_alarm_count > 0
        assert row.shewhart_alarms == charts.shewhart(w, chart).first().shewhart_out_count > 0


def test_chart_grid_leaves_out_short_windows(spark):
    assert charts.chart_grid(points(spark, [9.0] * 5), [0.5], [3.0], [0.2], [1], [3.0], ["record_id"]).isEmpty()


def test_cusum_against_recursion(spark):
    rng = random.Random(1)
    for _ in range(3):
        z = [rng.gauss(0.2, 1.2) for _ in range(120)]
        got = charts.cusum_points(points(spark, z), CHART).orderBy("pos").select("s_pos", "s_neg", "alarm").collect()
        up = down = 0.0
        run = [0, 0]
        alarm = [False] * len(z)
        for i, x in enumerate(z):
            up, down = max(0.0, up + x - CHART.k), max(0.0, down - x - CHART.k)
            assert math.isclose(got[i].s_pos, up, abs_tol=1e-9) and math.isclose(got[i].s_neg, down, abs_tol=1e-9)
            for s, v in enumerate((up, down)):
                run[s] = run[s] + 1 if v > CHART.h else 0
                if run[s] >= CHART.sustained:
                    alarm[i - CHART.sustained + 1 : i + 1] = [True] * CHART.sustained
        assert [g.alarm for g in got] == alarm


def test_ewma_against_recursion(spark):
    z = [random.Random(2).gauss(0, 2) for _ in range(50)]
    got = charts.ewma(points(spark, z), CHART).head()
    e, path = 0.0, []
    for x in z:
        e = CHART.weight * x + (1 - CHART.weight) * e
        path.append(e)
    bound = CHART.ewma_limit * math.sqrt(CHART.weight / (2 - CHART.weight))
    assert math.isclose(got.ewma_last, path[-1]) and math.isclose(got.ewma_max_abs, max(map(abs, path)))
    assert math.isclose(got.ewma_slope, np.polyfit(range(25), path[25:], 1)[0]) and got.ewma_alarm_count == sum(abs(v) > bound for v in path)


@pytest.mark.parametrize(
    "z,want",
    [
        ([0, 0, 0, 0, 0, 0], (0, 0, 0, 0, 0)),
        ([1, 2, 3, 4, 5, 6], (3, 3, 6, 0, 3)),
        ([6, 5, 4, 3, 2, 1], (3, 3, 0, 6, 3)),
        ([0, 3, 0, 3, 0, 0, 0], (1, 0, 2, 2, 1)),
    ],
)
def test_runs_truth_table(spark, z, want):
    got = charts.runs(points(spark, [v + 10 for v in z], z)).head()
    assert (got.longest_run_above_median, got.longest_run_below_median, got.trend_run_up_max, got.trend_run_down_max) == tuple(map(float, want[:4]))
    assert got.n_runs_rule_violations == want[4]


@pytest.mark.parametrize("symbols,want", [("SNSNN", (2, 0, 1, 0, 0)), ("SNNSNNN", (2, 0, 0, 1, 0)), ("SSSLNNNN", (4, 1, 0, 0, 1)), ("NNNNN", (0, 0, 0, 0, 0)), ("SLSLN", (4, 2, 0, 0, 0))])
def test_patterns(spark, symbols, want):
    value = {"S": 10.0, "N": 100.0, "L": 300.0}
    w = points(spark, [value[s] for s in symbols]).withColumn("n", F.lit(len(symbols)).cast("long"))
    got = charts.ectopy(w).head()
    assert (got.ectopy_like_count, got.short_long_sequence_count, got.bigeminy_like_pattern_count, got.trigeminy_like_pattern_count, got.atrial_tachy_like_run_count) == want


def test_short_windows_are_null(spark):
    w = points(spark, [1.0, 2.0, 3.0])
    v = charts.variability(w).head()
    assert v.mean_rr is None and v.sd1 is not None and charts.cusum(w).head().cusum_pos_max is None and charts.ectopy(w).head().ectopy_like_count is None


def test_windows(spark):
    df = intervals.with_clock(spark.createDataFrame([("r", k, 1000.0) for k in range(10)], "record_id string, idx long, rr_ms double"), 5)
    got = {(r.window_type, r.window_size, r.window_index): (r.start_time_sec, r.end_time_sec, r.n_rr) for r in windows.provenance(windows.multi_scale(df, (4,), (5.0,), 1800.0)).collect()}
    assert got == {("rr_count", 4.0, 0): (0.0, 4.0, 4), ("rr_count", 4.0, 1): (4.0, 8.0, 4), ("time", 5.0, 0): (0.0, 5.0, 4), ("time", 5.0, 1): (5.0, 10.0, 5), ("full_record", 1800.0, 0): (0.0, 10.0, 10)}
    with pytest.raises(windows.ProhibitedWindowError):
        windows.multi_scale(df, seconds=(30.0,), task="main_x")
    windows.multi_scale(df, seconds=(30.0,), task="secondary")
    assert windows.quarantined(df.limit(1)).count() == 1


def test_shuffle_partitions_do_not_matter(spark):
    rng = random.Random(3)
    rows = [(r, k, round(rng.uniform(1, 90), 2)) for r in range(6) for k in range(40)]
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = intervals.with_clock(spark.createDataFrame(rows, "record_id long, idx long, rr_ms double"), 20)
        features_ = charts.all_features(windows.multi_scale(df, (16,), (), 1800.0), CHART)
        seen.append(sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in features_.select(*windows.KEYS, *features.ALL).fillna(-99.0).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and len(features.ALL) == 49


def test_legacy_gap_keeps_the_sum(spark):
    z = [2.0, 2.0, None, 2.0, None, 0.0]
    df = spark.createDataFrame([("a", k, v, 1.0, True) for k, v in enumerate(z)], "record_id string, pos long, z double, rmssd double, gate boolean")
    got = legacy.charted(df, charts.Chart(h=2.0, sustained=2)).orderBy("pos").collect()
    assert [g.s_pos for g in got] == [1.5, 3.0, None, 4.5, None, 4.0] and not any(g.alarm for g in got)


def test_wilcoxon_probabilities(spark):
    rng = random.Random(9)
    cases = {"plain": [0.3, -0.1, 0.7, 1.1, -0.4, 0.0, 2.0], "ties": [1.0, -1.0, 1.0, 2.0, -2.0, 2.0, 3.0, 3.0, 3.0, 0.5, -0.5, 0.0], "one": [2.0], "even": [1.0, -1.0]}
    cases["many"] = [float(rng.randrange(-4, 9)) for _ in range(90)]
    df = spark.createDataFrame([(f, k, v) for f, d in cases.items() for k, v in enumerate(d)], "feature string, pair_id long, delta double")
    got = {r.feature: r for r in stats.wilcoxon_p(df).collect()}
    assert (got["plain"].n_used, got["plain"].t_plus, got["plain"].t_minus) == (6, 17.0, 4.0)
    for name, deltas in cases.items():
        d = [v for v in deltas if v]
        a = sorted(map(abs, d))
        rank = {v: (a.index(v) + 1 + len(a) - a[::-1].index(v)) / 2 for v in a}
        low = min(sum(rank[abs(v)] for v in d if v > 0), sum(rank[abs(v)] for v in d if v < 0))
        assert got[name].wilcoxon_w == low
        if len(d) <= 50:
            few = sum(sum(rank[a] for a, s in zip(map(abs, d), signs) if s) <= low for signs in itertools.product((0, 1), repeat=len(d)))
            want = min(1.0, 2 * few / 2 ** len(d))
        else:
            n = len(d)
            ties = sum(a.count(v) ** 3 - a.count(v) for v in set(a))
            want = math.erfc(abs(low - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / math.sqrt(2))
        assert abs(got[name].p_value - want) < 1e-12


def test_normal_tail(spark):
    z = [0.0, 0.01, 1.0, 2.9999, 3.0, 3.5, 6.0, 12.0, 30.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(stats.normal_tail(F.col("z"))).collect()]
    assert all(abs(g - math.erfc(v / math.sqrt(2))) < 1e-12 for g, v in zip(got, z))


@pytest.mark.parametrize("p,y,want", [((0.1, 0.9), (0, 1), 1.0), ((0.9, 0.1), (0, 1), 0.0), ((0.1, 0.9), (1, 0), 0.0)])
def test_concordance_direction(spark, p, y, want):
    df = spark.createDataFrame([("c", 0, a, b) for a, b in zip(p, y)], "config string, pair_id long, p double, y int")
    assert stats.concordance(df, ["config"]).head().pairwise_concordance == want


def test_pruner_keeps_priority_and_sees_fitting_rows_only(spark):
    rng = random.Random(4)
    rows = [(k, x, x * 2 + 1, rng.random()) for k in range(60) for x in [rng.random()]]
    df = spark.createDataFrame(rows, "record_id long, a double, b double, c double")
    pruner = stats.CorrelationPruner(["a", "b", "c"], 0.9, ["b"]).fit(df.where("record_id < 40"))
    assert pruner.kept == ["b", "c"] and pruner.n_dropped == 1 and pruner.transform(df).columns == ["record_id", "b", "c"]
    spoiled = df.withColumn("b", F.when(F.col("record_id") >= 40, 9999.0).otherwise(F.col("b")))
    assert stats.CorrelationPruner(["a", "b", "c"], 0.9, ["b"]).fit(spoiled.where("record_id < 40")).kept == pruner.kept


def test_reference_distances(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 5))
    x[3, 2] = np.nan
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, x array<double>")
    fit = mahalanobis.fit_reference(df, F.col("x"), 5)
    full = np.where(np.isfinite(x), x, np.nanmedian(x, 0))
    c = full - full.mean(0)
    s = c.T @ c / 80
    m = np.trace(s) / 5
    d2 = ((s - m * np.eye(5)) ** 2).sum() / 5
    share = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / 5 / 80**2) / d2
    assert np.isclose(fit.shrinkage, share) and np.allclose(fit.precision, np.linalg.inv((1 - share) * s + share * m * np.eye(5)))
    got = sorted(mahalanobis.with_distance(df, F.col("x"), fit).collect())
    assert np.allclose([g.dm for g in got], fit.distances(x)) and min(g.dm for g in got) >= 0
    with pytest.raises(ValueError):
        mahalanobis.fit_reference(df.limit(3), F.col("x"), 5)


def test_logistic_folds_reach_the_optimum(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=120) > 0).astype(int)
    rows = [(k, int(k % 3), int(v), *map(float, r)) for k, (r, v) in enumerate(zip(x, y))]
    scaled = models.impute_and_scale(spark.createDataFrame(rows, "id long, fold long, y int, a double, b double, c double"), ["a", "b", "c"])
    beta = models.logistic_folds(scaled, 3)
    for m, b in beta.items():
        own = scaled.where((F.col("model") == m) & F.col("train")).collect()
        xs, ys = np.array([r.x for r in own]), np.array([r.y for r in own])
        assert np.allclose(xs.mean(0), 0) and np.allclose(xs.std(0), 1)
        q = 1 / (1 + np.exp(-(xs @ b[:-1] + b[-1])))
        assert np.allclose(xs.T @ (ys - q) - b[:-1], 0, atol=1e-6) and abs((ys - q).sum()) < 1e-6
    held = models.predictions(scaled, beta).collect()
    assert len(held) == 120 and np.mean([(r.p >= 0.5) == r.y for r in held]) > 0.8


def test_temporal_ignores_labels(spark):
    rng = random.Random(8)
    rows = [(r, r // 2, r % 2, "t", 1.0, float(k), rng.random() if k % 4 else None) for r in range(6) for k in range(9)]
    df = spark.createDataFrame(rows, "record_id long, pair_id long, y long, window_type string, window_size double, start_time_sec double, f double")
    assert aggregate.labels_are_unused(df, ["f"], aggregate.RECORD_KEYS)
    assert aggregate.temporal_names(["f"])[0] == "f_global_median"


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(k // 2, k) for k in range(50)], "pair_id long, id long")
    got = {r.pair_id: r.fold for r in folds.group_folds(df, "pair_id").collect()}
    assert got == {p: (24 - p) % 5 + 1 for p in range(25)}
    assert folds.disjoint(df.where("pair_id < 5"), df.where("pair_id >= 5"), "pair_id")


def test_manifests(spark):
    assert manifests.main_manifest(spark).where("record_id = 'p04'").head()[1:3] == (1, 1)
    assert manifests.secondary_manifest(spark).count() == 100 and manifests.audit_manifest(spark).where("included").count() == 50


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "a int, b double")
    assert files.nan_to_null(df).where("b IS NULL").count() == 1
    files.write_report_csv(df, f"{tmp_path}/c")
    assert files.read_csv(spark, f"{tmp_path}/c", "a int, b double").count() == 2
    made = []
    for force in (False, False, True):
        files.read_or_build(spark, f"{tmp_path}/t", lambda: made.append(1) or df, force)
    assert len(made) == 2 and files.markdown(df, "T").startswith("## T") and files.checksums(spark, f"{tmp_path}/c/*.csv").head().sha256.__len__() == 16


def test_beats_from_annotation_files(spark, tmp_path):
    words = [(1, 100), (28, 3), (59, 0), None, (1, 200), (63, 3), "abc\0", (60, 1), (1, 50), (0, 0)]
    out = b""
    for w in words:
        out += w.encode() if isinstance(w, str) else (1).to_bytes(2, "little") + (0).to_bytes(2, "little") if w is None else (w[0] << 10 | w[1]).to_bytes(2, "little")
    (tmp_path / "p01.qrs").write_bytes(out)
    (tmp_path / "p01.hea").write_text("# note\np01 2 128 1000\n")
    got = wfdb.read_beats(spark, str(tmp_path)).orderBy("beat_index").collect()
    assert [g["sample"] for g in got] == [100, 103, 65839, 65889] and {g.fs for g in got} == {128}
