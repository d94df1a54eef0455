"""Fitted steps against numpy and by hand, in a pipeline that is saved and loaded."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from orrery.functions import features
from orrery.operators.estimators import FeaturePruner, FeaturePrunerModel, MedianScaler, MedianScalerModel

SCHEMA = "record_id long, rmssd double, sdsd double, mean_rr double, level double, other string"


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        x = float(rng.normal())
        # sdsd follows rmssd by rank, mean_rr is on its own, level is constant
        rows.append((i, None if i % 11 == 0 else x, math.exp(x), float("nan") if i % 7 == 0 else float(rng.normal()), 3.0, "kept"))
    return spark.createDataFrame(rows, SCHEMA)


def _columns(df, names):
    rows = df.orderBy("record_id").select(*names).collect()
    return np.array([[np.nan if v is None else v for v in r] for r in rows], float)


def test_scaler_equals_numpy_and_uses_the_fitted_table(spark, train):
    names = ["rmssd", "mean_rr", "level"]
    model = MedianScaler(names).fit(train)
    x = _columns(train, names)
    middle = np.nanmedian(x, 0)
    filled = np.where(np.isnan(x), middle, x)
    spread = np.where(filled.std(0) > 1e-12, filled.std(0), 1)
    assert np.allclose(_columns(model.transform(train), names), (filled - filled.mean(0)) / spread)
    unseen = spark.createDataFrame([(1, None, 1.0, math.inf, 5.0, "kept")], SCHEMA)
    got = model.transform(unseen)
    assert np.allclose(_columns(got, names), (np.array([[middle[0], middle[1], 5.0]]) - filled.mean(0)) / spread)
    assert got.columns == unseen.columns and got.head()["other"] == "kept" and got.head()["sdsd"] == 1.0


def test_scaler_of_empty_tables_and_columns_without_values(spark, train):
    empty = MedianScaler(["rmssd", "level"]).fit(train.limit(0))
    assert _columns(empty.transform(train), ["level"]).tolist() == [[3.0]] * 60
    bare = spark.createDataFrame([(1, None, None, float("nan"), 2.0, None), (2, None, None, math.inf, 4.0, None)], SCHEMA)
    model = MedianScaler(["rmssd", "mean_rr", "level", "missing"]).fit(bare)
    assert model.getInputCols() == ["rmssd", "mean_rr", "level"]
    assert _columns(model.transform(bare), model.getInputCols()).tolist() == [[0, 0, -1], [0, 0, 1]]
    assert MedianScaler(["missing"]).fit(bare).transform(bare).columns == bare.columns


def test_pruner_keeps_the_first_by_priority(train):
    names = ["sdsd", "mean_rr", "level", "rmssd"]
    model = FeaturePruner(names).fit(train)
    assert model.getOrDefault(model.standing) == ["rmssd", "mean_rr", "level", "rmssd"]
    assert (model.kept, model.n_selected, model.n_dropped) == (["mean_rr", "level", "rmssd"], 3, 1)
    assert model.transform(train).columns == ["record_id", "rmssd", "mean_rr", "level", "other"]
    other = FeaturePruner(names, priority=["sdsd"]).fit(train)
    assert other.kept == ["sdsd", "mean_rr", "level"]
    assert FeaturePruner(names, threshold=1.1).fit(train).n_dropped == 0


def test_chains_of_pairs_are_one_group(spark):
    # a with b and b with c are strong, a with c alone is not
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate([(1, 2, 3), (2, 1, 1), (3, 4, 4), (4, 3, 2), (5, 5, 6), (6, 6, 5), (7, 8, 9), (8, 7, 7), (9, 9, 8)])]
    df = spark.createDataFrame(rows, "record_id long, a double, b double, c double")
    rank = lambda x: np.argsort(np.argsort(x))
    a, b, c = (rank(np.array([r[k] for r in rows])) for k in (1, 2, 3))
    rho = {p: round(float(np.corrcoef(*v)[0, 1]), 4) for p, v in {"ab": (a, b), "bc": (b, c), "ac": (a, c)}.items()}
    limit = min(rho["ab"], rho["bc"])
    assert rho["ac"] < limit
    model = FeaturePruner(["c", "b", "a"], threshold=limit, priority=["b"]).fit(df)
    assert model.getOrDefault(model.standing) == ["b", "b", "b"]


def test_a_saved_pipeline_gives_equal_rows(train, tmp_path):
    names = ["sdsd", "mean_rr", "level", "rmssd"]
    fitted = Pipeline(stages=[FeaturePruner(names), MedianScaler(names)]).fit(train)
    fitted.write().save(f"file://{tmp_path}/model")
    loaded = PipelineModel.load(f"file://{tmp_path}/model")
    assert [type(s) for s in loaded.stages] == [FeaturePrunerModel, MedianScalerModel]
    want, got = (m.transform(train).orderBy("record_id").collect() for m in (fitted, loaded))
    assert want == got and "sdsd" not in loaded.transform(train).columns
    FeaturePruner(names, threshold=0.5).save(f"file://{tmp_path}/stage")
    again = FeaturePruner.load(f"file://{tmp_path}/stage")
    assert again.getOrDefault("threshold") == 0.5 and again.getInputCols() == names


def test_priority_order_and_blocks():
    assert len(features.PRIORITY) == 33 and len(set(features.PRIORITY)) == 33 and set(features.PRIORITY) < set(features.ALL)
    assert [features.priority(c) for c in ("rmssd", "cusum_abs_max", "n_runs_rule_violations", "unknown")] == [0, 12, 32, 33]
    assert features.INTERPRETABLE["hrv_full_actual"] == features.HRV + features.POINCARE
    found, lacking = features.resolve(features.INTERPRETABLE["D_HRV_SPC_Poincare"], ["rmssd", "sd2", "sd1"])
    assert found == ["rmssd", "sd2", "sd1"] and lacking[0] == "cv_rr" and lacking.count("sd2") == 0
