"""Scans, percentiles, keyed fits and tables of models against plain Python on the same rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import charts, intervals, keyed_distance, long_records, mahalanobis, model_table, resampling, scan, selection, stats, windows
from orrery.plans import engine_queries, model_queries
from orrery.plans.base import load

DATA = "/root/testdata/sf0.001"


# --- scans


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_figures(spark, parts):
    pick = random.Random(parts)
    rows = [(g, i, pick.gauss(0, 1), pick.random() < 0.6) for g, n in ((None, 7), (1, 300), (2, 1), (3, 40)) for i in range(n)]
    table = scan.segmented(spark.createDataFrame(rows, "g int, i long, v double, f boolean").repartition(3), ["g"], ["i"], parts)
    out = scan.running(table, ["g"], ["i"], {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))})
    out = scan.running(out, ["g"], ["i"], {"left": ("max", F.col("v"))}, inclusive=False, backward=True)
    out = scan.before(out, ["g"], ["i"], "v", "b")
    out = scan.stretch_lengths(scan.reflected(out, ["g"], ["i"], {"c": F.col("v") - 0.1}), ["g"], "i", {"len": "f"})
    got = {(r.g, r.i): r for r in out.collect()}
    assert len(got) == len(rows) and (parts == 1) == (table.select(scan.PART).distinct().count() == 1)
    for g in (None, 1, 2, 3):
        own = [r for r in rows if r[0] == g]
        s, c, before, least = 0.0, 0.0, None, np.inf
        for k, (_, i, v, f) in enumerate(own):
            s, c, least = s + v, max(0.0, c + v - 0.1), min(least, v)
            lo = hi = k
            while f and lo and own[lo - 1][3]:
                lo -= 1
            while f and hi + 1 < len(own) and own[hi + 1][3]:
                hi += 1
            r = got[g, i]
            assert abs(r.s - s) < 1e-9 and r.m == least and r.b == before and abs(r.c - c) < 1e-9 and r.len == (hi - lo + 1 if f else 0)
            assert r.left == max((x[2] for x in own[k + 1 :]), default=None)
            before = v


@pytest.mark.parametrize("hold", [10, 1000, 10**6])
def test_exact_percentiles(spark, hold):
    rng = np.random.default_rng(5)
    groups = {None: rng.standard_cauchy(900) * 10.0 ** rng.integers(-3, 3, 900), 1: rng.normal(size=4000), 2: rng.normal(size=5), 5: np.array([1.0] * 3000 + [2.0] * 10), 7: np.array([-1e308, 1e308] * 40)}
    rows = [(g, float(v)) for g, a in groups.items() for v in a] + [(6, None), (1, None), (1, float("nan"))]
    shares = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    found = selection.exact_percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], F.col("v"), shares, hold).collect()
    got = {(r.g, r.share): (r.value, r.n) for r in found}
    assert len(found) == len(got) == len(groups) * len(shares)
    for g, a in groups.items():
        a = np.sort(a)
        for s in shares:
            at = (len(a) - 1) * s
            lo, hi = a[int(np.floor(at))], a[int(np.ceil(at))]
            want = lo if lo == hi else (1 - (at - np.floor(at))) * lo + (at - np.floor(at)) * hi
            assert np.isclose(got[g, s][0], want, rtol=1e-12, atol=0) and got[g, s][1] == len(a)


def test_charts_of_long_records_are_those_of_whole_windows(spark, monkeypatch):
    monkeypatch.setattr(long_records, "STRETCH", 7)
    chart = charts.Chart(h=1.5, sustained=3)
    events = load(spark, DATA, "events").where("user_id < 9").select(F.col("user_id").alias("record_id"), "ts", "event_id", F.col("value").alias("rr_ms"))
    single = spark.createDataFrame([(900 + k, i, float(v)) for k in range(3) for i, v in enumerate([50, 60, 55, 58, 90, 91][: 4 + k])], "record_id long, event_id long, rr_ms double").withColumn("ts", F.lit(None).cast(events.schema["ts"].dataType))
    events = events.unionByName(single)
    plain = intervals.with_clock(intervals.series(events, "record_id", "rr_ms", ["ts", "event_id"]), 20)
    want = {r.record_id: r.asDict() for r in charts.all_features(windows.multi_scale(plain, full=1800.0), chart).collect()}
    clocked = long_records.clocked(events, ["ts", "event_id"], 20, parts=13)
    assert clocked.groupBy("record_id").agg(F.count_distinct(scan.PART).alias("n")).agg(F.max("n")).head()[0] > 1
    got = {r.record_id: r.asDict() for r in long_records.record_charts(clocked, chart, hold=5).collect()}
    assert got.keys() == want.keys() and any(r["cusum_alarm_count"] for r in got.values())
    for key, row in got.items():
        for c, v in row.items():
            w = want[key][c]
            assert (v is None and w is None) or (isinstance(v, (int, float)) and abs(v - w) < 1e-7) or c == "record_id", (key, c, v, w)


def test_one_long_record_lies_in_all_parts(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("x").alias("record_id"), F.col("id").alias("at"), (50 + F.col("id") % 7 + F.when(F.col("id") > n // 2, 9.0).otherwise(0.0)).alias("rr_ms"))
    clocked = long_records.clocked(rows, ["at"], 1000, parts=8)
    sizes = [r["count"] for r in clocked.groupBy(scan.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < n / 4
    got = long_records.record_charts(clocked, charts.Chart(), hold=1000).head()
    value = 50 + np.arange(n) % 7 + np.where(np.arange(n) > n // 2, 9.0, 0.0)
    z = (value - value[:1000].mean()) / value[:1000].std(ddof=1)
    s = e = 0.0
    top = out = 0
    for v in z:
        s = max(0.0, s + v - 0.5)
        e = 0.2 * v + 0.8 * e
        top, out = max(top, abs(e)), out + (abs(e) > 2.7 * (0.2 / 1.8) ** 0.5)
    assert got.n_rr == n and abs(got.cusum_last_pos - s) < 1e-3 and abs(got.ewma_last - e) < 1e-9 and abs(got.ewma_max_abs - top) < 1e-9 and got.ewma_alarm_count == out
    assert got.mr_median == np.median(np.abs(np.diff(value)))


# --- ranks in ranges


def test_ranks_of_one_huge_setting(spark):
    rng = np.random.default_rng(3)
    p, y = np.round(rng.normal(size=20_000), 2), rng.integers(0, 2, 20_000)
    rows = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    order = pd.Series(p).rank().to_numpy()
    up = y == 1
    want = (order[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())
    assert abs(stats.roc_auc(rows, []).head()["auc"] - want) < 1e-12
    got = {r.p: r.rank for r in stats.average_ranks(rows, [], "p", "rank").collect()}
    assert all(got[a] == b for a, b in zip(p, order))


@pytest.mark.parametrize("multiplicity", [False, True])
def test_replicates_of_tied_scores(spark, multiplicity):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"pair_id": np.repeat(np.arange(40), 2), "y": np.tile([0, 1], 40), "p": np.round(rng.random(80), 1)})
    rows = pd.concat([rows, rows[rows.pair_id < 3], pd.DataFrame({"pair_id": [77], "y": [1], "p": [0.5]})])
    scores = spark.createDataFrame(rows).repartition(5)
    draws = resampling.replicate_draws(scores, 20)
    times = {r.pair_id: np.bincount(r.draws, minlength=20) for r in draws.collect()}
    assert sum(times.values()).tolist() == [41] * 20
    got = {(r.b, r.metric): r.v for r in resampling.replicate_metrics(scores, draws, 20, multiplicity).collect()}
    for b in range(21):
        w = np.array([1 if b == 20 else times[k][b] if multiplicity else min(1, times[k][b]) for k in rows.pair_id], float)
        p, y = rows.p.to_numpy(), rows.y.to_numpy()
        pair = ((p[:, None] > p) + 0.5 * (p[:, None] == p)) * np.outer(w * (y == 1), w * (y == 0))
        hit = p >= 0.5
        tp, fp, fn, tn = ((w * m).sum() for m in (hit & (y == 1), hit & (y == 0), ~hit & (y == 1), ~hit & (y == 0)))
        want = {"auc": pair.sum() / ((tp + fn) * (fp + tn)), "sensitivity": tp / (tp + fn), "specificity": tn / (tn + fp), "f1": 2 * tp / (2 * tp + fp + fn), "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2}
        want["mcc"] = (tp * tn - fp * fn) / np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        sides = rows.groupby(["pair_id", "y"]).p.mean().unstack().dropna()
        own = np.array([1 if b == 20 else times[k][b] if multiplicity else min(1, times[k][b]) for k in sides.index], float)
        want["pairwise_concordance"] = (own * (sides[1] > sides[0])).sum() / own.sum()
        assert all(abs(got[b, m] - v) < 1e-12 for m, v in want.items()), (b, want)


# --- models


def newton(x, y, ridge=1.0):
    x = np.column_stack([x, np.ones(len(x))])
    penalty, b = np.append(np.full(x.shape[1] - 1, ridge), 0.0), np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x.T * (q * (1 - q))) @ x + np.diag(penalty + 1e-12), x.T @ (y - q) - penalty * b)
    return b


def hinge_descent(x, y):
    """Squared hinge by plain gradient steps with halving."""
    x, sign, b = np.column_stack([x, np.ones(len(x))]), 2 * y - 1, np.zeros(x.shape[1] + 1)
    cost = lambda b: b @ b / 2 + (np.maximum(1 - sign * (x @ b), 0) ** 2).sum()
    step = 1.0
    for _ in range(20_000):
        g = b - 2 * x.T @ (sign * np.maximum(1 - sign * (x @ b), 0))
        if np.abs(g).max() < 1e-9:
            break
        while cost(b - step * g) > cost(b) - 0.4 * step * (g @ g) and step > 1e-18:
            step /= 2
        b, step = b - step * g, step * 1.5
    return b


def sample_models(seed, p=4):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(6):
        x = rng.normal(size=(60 + 10 * m, p))
        y = (x @ rng.normal(size=p) + rng.normal(size=len(x)) > 0.3).astype(int)
        rows += [(f"m{m}", int(t), [float(v) for v in r]) for r, t in zip(x, y)]
    return rows


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge"])
@pytest.mark.parametrize("rows_a_task", [100_000, 25])
def test_table_of_models(spark, monkeypatch, loss, rows_a_task):
    monkeypatch.setattr(model_table, "ROWS_A_TASK", rows_a_task)
    rows = sample_models(4)
    table = model_table.fit_table(spark.createDataFrame(rows, "model string, y int, x array<double>").repartition(3), 4, loss, plain_intercept=loss == "logistic")
    got = {r.model: np.array(r.beta) for r in table.collect()}
    assert len(got) == 6
    for m, beta in got.items():
        x, y = (np.array([r[k] for r in rows if r[0] == m], float) for k in (2, 1))
        assert np.allclose(beta, newton(x, y) if loss == "logistic" else hinge_descent(x, y), atol=1e-6)


def test_no_models(spark):
    assert model_table.fit_table(spark.createDataFrame([], "model string, y int, x array<double>"), 4).collect() == []


def dealt_folds(pairs, k):
    """Pairs of equal size, later ids first, in turn."""
    return {p: i % k + 1 for i, p in enumerate(sorted(pairs, reverse=True))}


def scaled_sides(train, held):
    """Both sides with missing values at the training median, standardized by the training side."""
    middle = train.median().fillna(0)
    a, b = train.fillna(middle), held.fillna(middle)
    spread = a.std(ddof=0)
    return ((a - a.mean()) / spread.where(spread > 0, 1)).to_numpy(), ((b - a.mean()) / spread.where(spread > 0, 1)).to_numpy()


def area(p, y):
    return ((p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])).mean() if len(set(y)) == 2 else np.nan


def test_blocks_scales_and_steps(spark, monkeypatch):
    found = model_queries.block_metrics(spark, DATA)
    schema, rows = found.schema, found.collect()
    got = {(r.kind, r.block, r.window_type, r.window_size): r for r in rows}
    assert len(got) == len(rows) == 2 * 9 * 6
    records = model_queries.record_features(spark, DATA).toPandas()
    fold = dealt_folds(records.pair_id.unique(), 5)
    part = dealt_folds(records.pair_id.unique(), 3)
    for block, kind, size in (("full.A_HRV", "rr_count", 100.0), ("full.E_HRV_SPC_Poincare_Ectopy", "full_record", 1800.0), ("reduced.C_HRV_SPC", "time", 300.0)):
        own = records[(records.window_type == kind) & (records.window_size == size)].sort_values("record_id")
        names = model_queries.names.BLOCKS[block]
        measured = {"logistic": [], "svm": []}
        for k in range(1, 6):
            side = own.pair_id.map(fold) == k
            train, held = own[~side], own[side]
            if not len(held):
                continue
            x, v = scaled_sides(train[names].astype(float), held[names].astype(float))
            y = train.y.to_numpy(float)
            measured["logistic"].append(area(np.round(np.column_stack([v, np.ones(len(v))]) @ newton(x, y), 9), held.y.to_numpy()))
            inside = train.pair_id.map(part).to_numpy()
            guess = []
            for q in (1, 2, 3):
                beta = hinge_descent(x[inside != q], y[inside != q])
                score = lambda a: np.column_stack([a, np.ones(len(a))]) @ beta  # noqa: B023, E731
                seen = y[inside == q]
                if not len(seen):
                    continue
                aim = np.where(seen == 1, (seen.sum() + 1) / (seen.sum() + 2), 1 / ((1 - seen).sum() + 2))
                a = newton(score(x[inside == q])[:, None], aim, 0.0)
                guess.append(1 / (1 + np.exp(-(score(v) * a[0] + a[1]))))
            measured["svm"].append(area(np.round(np.mean(guess, 0), 7), held.y.to_numpy()))
        for model, areas in measured.items():
            r = got[model, block, kind, size]
            assert r.n_folds == len(areas) and abs(r.auc_mean - np.nanmean(areas)) < 1e-6, (model, block, r.auc_mean, areas)
    monkeypatch.setattr(model_queries, "block_metrics", lambda *_: spark.createDataFrame(rows, schema))
    steps = {(r.kind, r.window_type, r.window_size, r.a, r.b): r for r in model_queries.block_steps(spark, DATA).collect()}
    assert len(steps) == 2 * 6 * 7
    for (kind, wt, ws, a, b), r in steps.items():
        want = got[kind, b, wt, ws].f1_mean - got[kind, a, wt, ws].f1_mean
        assert abs(r.delta_f1_mean - want) < 1e-4


def test_coefficient_table(spark):
    got = {r.feature: r for r in model_queries.coefficient_table(spark, DATA).collect()}
    records = model_queries.record_features(spark, DATA).where("window_type = 'full_record'").toPandas()
    fold, names = dealt_folds(records.pair_id.unique(), 5), model_queries.names.ALL
    betas = []
    for k in range(1, 6):
        train = records[records.pair_id.map(fold) != k]
        betas.append(newton(scaled_sides(train[names].astype(float), train[names].astype(float))[0], train.y.to_numpy(float))[:-1])
    mean, up = np.mean(betas, 0), (np.array(betas) > 0).mean(0)
    assert all(abs(got[c].coef_mean - m) < 1e-6 for c, m in zip(names, mean)) and all(abs(got[c].share_positive - u) < 1e-9 for c, u, m in zip(names, up, mean) if abs(m) > 1e-9)
    assert sorted(r.place for r in got.values()) == list(range(1, 50))


def test_nested_choice_of_settings(spark):
    rng = np.random.default_rng(8)
    features, rows = ["f", "g", "e"], []
    for setting in range(6):
        for record in range(24):
            y = record % 2
            signal = y * (setting in (2, 5)) * 1.1
            rows.append((record, record // 2, y, "rr_count", 100.0, float(setting // 3), 0.5, 0.1, setting % 3, 2.5, *[float(v) for v in rng.normal(size=3) + signal]))
    frame = pd.DataFrame(rows, columns=["record_id", "pair_id", "y", *model_queries.SCALE, *model_queries.SETTING, *features])
    got = {r.outer: r for r in model_queries.nested_choice(spark.createDataFrame(frame), features).collect()}
    fold = dealt_folds(range(12), 5)

    def guess(train, held):
        x, v = scaled_sides(train[features], held[features])
        return area(np.round(np.column_stack([v, np.ones(len(v))]) @ newton(x, train.y.to_numpy(float)), 9), held.y.to_numpy())

    for outer in range(1, 6):
        inner = dealt_folds([p for p in range(12) if fold[p] != outer], 3)
        tried = []
        for (h, s), own in frame.groupby(["h", "sustained"]):
            own = own[own.pair_id.isin(inner)]
            tried.append((-round(np.mean([guess(own[own.pair_id.map(inner) != k], own[own.pair_id.map(inner) == k]) for k in (1, 2, 3)]), 9), h, s))
        best, h, s = min(tried)
        r = got[outer]
        assert (r.h, r.sustained) == (h, s) and abs(r.inner_auc + best) < 1e-8
        own = frame[(frame.h == h) & (frame.sustained == s)]
        assert abs(r.outer_auc - guess(own[own.pair_id.map(fold) != outer], own[own.pair_id.map(fold) == outer])) < 1e-8


def test_features_of_all_settings(spark):
    """One setting of the sweep against the single charts."""
    rows = model_queries.tuning_records(spark, DATA)
    assert rows.select(*model_queries.SETTING).distinct().count() == 162
    one = rows.where("h = 5.0 AND k = 0.25 AND lam = 0.3 AND sustained = 3 AND shewhart_l = 2.5").toPandas().set_index(["record_id", "window_type", "window_size"])
    windowed = model_queries.supplier_windows(spark, DATA).where(model_queries.TUNED)
    chart = charts.Chart(h=5.0, k=0.25, sustained=3, weight=0.3, ewma_limit=2.5 * 0.9, limit=2.5)
    want = charts.all_features(windowed, chart).toPandas().groupby(["record_id", "window_type", "window_size"])[model_queries.TUNED_FEATURES].median().fillna(0)
    both = one[model_queries.TUNED_FEATURES].astype(float).join(want, rsuffix="_w")
    assert len(both) and all(np.allclose(both[c], both[f"{c}_w"], atol=1e-8) for c in model_queries.TUNED_FEATURES)


# --- keyed distances


def plain_fit(ref):
    middle = np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in ref.T])
    ref = np.where(np.isfinite(ref), ref, middle)
    c = ref - ref.mean(0)
    s, p, n = c.T @ c / len(c), ref.shape[1], len(ref)
    m = np.trace(s) / p
    d2 = ((s - m * np.eye(p)) ** 2).sum() / p
    a = min(d2, (((c * c).sum(1) ** 2).mean() - (s**2).sum()) / (p * n)) / d2 if d2 > 0 else 0.0
    inverse = np.linalg.inv((1 - a) * s + a * m * np.eye(p))

    def distance(x):
        away = np.where(np.isfinite(x), x, middle) - ref.mean(0)
        return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", away, inverse, away), 0))

    return distance, np.percentile(distance(ref), 95)


def test_keyed_fits(spark):
    rng = np.random.default_rng(2)
    names = ["a", "b", "c"]
    frame = pd.DataFrame(rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)), columns=names)
    frame["key"], frame["y"] = [None if k % 5 == 4 else float(k % 5) for k in range(400)], rng.integers(0, 2, 400)
    frame.loc[::17, "b"] = np.nan
    frame.loc[frame.key == 3, "c"] = np.nan
    rows = spark.createDataFrame([(None if pd.isna(r.key) else r.key, int(r.y), r.a, r.b, r.c) for r in frame.itertuples()] + [(99.0, 0, 1.0, 2.0, 3.0)], "key double, y int, a double, b double, c double")
    fits = keyed_distance.fit_keys(rows.where("y = 0"), names, ["key"])
    assert fits.count() == 5
    got = keyed_distance.with_thresholds(keyed_distance.with_keyed_distance(rows, fits, names, ["key"]), F.col("y") == 0, ["key"]).toPandas()
    assert len(got) == 400
    for key, own in got.groupby("key", dropna=False):
        distance, limit = plain_fit(own[own.y == 0][names].to_numpy(float))
        assert np.allclose(own.dm, distance(own[names].to_numpy(float)), atol=1e-7) and np.allclose(own.threshold, limit, atol=1e-7)


def test_lead_times(spark):
    got = {(r.record_id, r.window_type, r.window_size, r.features): r for r in model_queries.distance_lead_times(spark, DATA).collect()}
    windowed = model_queries._window_rows(spark, DATA).toPandas()
    checked = 0
    for name, own in mahalanobis.FEATURE_SETS.items():
        for (kind, size), rows in windowed.groupby(["window_type", "window_size"]):
            ref = rows[rows.y == 0][own].to_numpy(float)
            if len(ref) < 5:
                continue
            distance, limit = plain_fit(ref)
            for record, w in rows[rows.y == 1].sort_values("window_index").groupby("record_id"):
                d = distance(w[own].to_numpy(float))
                assert abs(d - limit).min() > 1e-9
                alarm = np.flatnonzero(d > limit)
                r = got.pop((record, kind, size, name))
                assert r.alarms == len(alarm) and abs(r.farthest - d.max()) < 1e-6
                assert r.lead_time_sec is None if not len(alarm) else abs(r.lead_time_sec - (1800 - w.start_time_sec.iloc[alarm[0]])) < 1e-6
                checked += 1
    assert checked and not got


def test_harness(spark, monkeypatch):
    found = model_queries.harness_predictions(spark, DATA)
    p = found.toPandas()
    assert set(p["mode"]) == {"population_fold", "pair_baseline"} and set(p.kind) == {"logistic", "threshold"}
    windowed = model_queries._window_rows(spark, DATA).toPandas()
    fold = dealt_folds(windowed.pair_id.unique(), 5)
    own, size = mahalanobis.FEATURE_SETS["hrv_reduced"], 50.0
    rows = windowed[(windowed.window_type == "rr_count") & (windowed.window_size == size)]
    for k in range(1, 6):
        distance, _ = plain_fit(rows[(rows.pair_id.map(fold) != k) & (rows.y == 0)][own].to_numpy(float))
        far = rows.assign(d=distance(rows[own].to_numpy(float))).groupby(["record_id", "pair_id", "y"]).d.max().reset_index()
        t = np.percentile(far[(far.pair_id.map(fold) != k) & (far.y == 0)].d, 95)
        want = {r.record_id: 1 / (1 + np.exp(-2 / t * (r.d - t))) for r in far[far.pair_id.map(fold) == k].itertuples()}
        got = p[(p["mode"] == "population_fold") & (p.kind == "threshold") & (p.block == "D_Mahal") & (p.features == "hrv_reduced") & (p.window_type == "rr_count") & (p.window_size == size) & (p.held == k)]
        assert {r.record_id for r in got.itertuples()} == want.keys() and all(abs(r.p - want[r.record_id]) < 1e-7 for r in got.itertuples())
    assert p.p.between(0, 1).all()
    # no record is scored by a fold that saw it
    assert (p.pair_id.map(fold) == p.held).all()
    monkeypatch.setattr(model_queries, "harness_predictions", lambda *_: found)
    summary = {(r["mode"], r["features"], r["block"], r["kind"], r["window_size"]): r for r in model_queries.harness_metrics(spark, DATA).collect()}
    steps = model_queries.distance_steps(spark, DATA).collect()
    # whole records have fewer training windows with y = 0 than a reference needs
    assert len(steps) == 3 * 5
    for r in steps:
        a, b = (summary["population_fold", r.features, block, r.kind, r.window_size].f1_mean for block in ("C_HRV_SPC", "E_HRV_SPC_Mahal"))
        assert abs(r.delta_f1_mean - (b - a)) < 1e-4


def test_population_folds_and_pair_baselines(spark):
    names = mahalanobis.FEATURE_SETS["hrv_reduced"]
    windowed = engine_queries.feature_windows(spark, DATA).toPandas()
    users = engine_queries.users(spark, DATA).toPandas()
    sizes = users.groupby("pair_id").size()
    order = sorted(sizes.index, key=lambda p: (-sizes[p], -p))
    fold = {p: i % 3 + 1 for i, p in enumerate(order)}
    got = {r.record_id: r for r in engine_queries.population_folds(spark, DATA).collect()}
    assert got.keys() == set(windowed.record_id)
    for k in (1, 2, 3):
        seen = windowed.pair_id.map(fold) != k
        distance, limit = plain_fit(windowed[seen & (windowed.y == 0)][names].to_numpy(float))
        for record, own in windowed[~seen].groupby("record_id"):
            d = distance(own[names].to_numpy(float))
            r = got[record]
            assert r.fold == k and abs(r.mahalanobis_mean - d.mean()) < 1e-6 and abs(r.mahalanobis_max - d.max()) < 1e-6 and r.mahalanobis_alarm_count == (d > limit).sum()
    rows = engine_queries.pair_baselines(spark, DATA).toPandas()
    assert len(rows)
    for pair, own in windowed.groupby("pair_id"):
        ref = own[own.y == 0][names].to_numpy(float)
        mine = rows[rows.pair_id == pair].sort_values(["record_id", "start_time_sec"])
        assert len(mine) == (len(own) if len(ref) >= 5 else 0)
        if len(ref) >= 5:
            distance, limit = plain_fit(ref)
            own = own.sort_values(["record_id", "start_time_sec"])
            assert np.allclose(mine.dm, distance(own[names].to_numpy(float)), atol=1e-6) and np.allclose(mine.threshold, limit, atol=1e-6)


def test_smaller_blocks_by_plain_models(spark):
    """Metrics, gains and coefficients of the three small blocks on whole records."""
    records = engine_queries.fold_rows(spark, DATA).toPandas()
    names = engine_queries.FEATURES
    got = {(r.block, r.fold): r for r in engine_queries.cv_logistic(spark, DATA).collect()}
    areas, betas = {}, []
    for block, own in (("A", names[:2]), ("B", names[:4]), ("C", names)):
        for k in sorted(records.fold.unique()):
            train, held = records[records.fold != k], records[records.fold == k]
            x, v = scaled_sides(train[own].astype(float), held[own].astype(float))
            beta = newton(x, train.y.to_numpy(float))
            p = 1 / (1 + np.exp(-np.column_stack([v, np.ones(len(v))]) @ beta))
            r, y = got[block, k], held.y.to_numpy()
            areas[block, k] = area(np.round(p, 9), y)
            assert (r.auc is None and np.isnan(areas[block, k])) or abs(r.auc - areas[block, k]) < 1e-8
            assert (r.tp, r.fp, r.fn, r.tn) == (((p >= 0.5) & (y == 1)).sum(), ((p >= 0.5) & (y == 0)).sum(), ((p < 0.5) & (y == 1)).sum(), ((p < 0.5) & (y == 0)).sum())
            if block == "C":
                betas.append(beta[:-1])
    mean = {b: np.nanmean([v for (c, _), v in areas.items() if c == b]) for b in "ABC"}
    for r in engine_queries.incremental_blocks(spark, DATA).collect():
        assert abs(r.delta_auc - (mean[r.b] - mean[r.a])) < 1e-4
    stable = {r.feature: r.coef_mean for r in engine_queries.coefficient_stability(spark, DATA).collect()}
    assert all(abs(stable[c] - m) < 1e-6 for c, m in zip(names, np.mean(betas, 0)))
