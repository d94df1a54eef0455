"""What several models, folds and sets of features share is made once: whole records, orders of values."""

import random

import pytest

from orrery.operators import stats
from orrery.plans import engine_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def calls(monkeypatch):
    def counted(module, name):
        made, plain = [], getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: made.append(1) or plain(*a, **k))
        return made

    return counted


@pytest.mark.parametrize("query", ["cv_oof_predictions", "cv_logistic", "incremental_blocks", "pairwise_ranking"])
def test_fold_models_make_records_once(spark, calls, query):
    made, copied = calls(engine_queries, "records"), calls(engine_queries.models, "impute_and_scale")
    assert engine_queries.QUERIES[query](spark, DATA).count()
    assert len(made) == 1 and not copied


def test_a_fold_without_training_rows_scores_one_half(spark):
    rows = spark.createDataFrame([(i, 0, i, 1, *[float(i + j) for j in range(6)]) for i in range(2)], "record_id long, pair_id long, y long, fold long, " + ", ".join(f"{c} double" for c in engine_queries.FEATURES))
    assert [r.p for r in engine_queries.fold_predictions(rows, {"C": engine_queries.FEATURES}).collect()] == [0.5, 0.5]


def test_correlations_outside_folds_are_those_of_copied_rows(spark):
    draw = random.Random(3)
    names = ["a", "b", "c", "d"]
    made = []
    for i in range(150):
        a = float(draw.randrange(20))
        b = None if i % 6 == 0 else a + draw.gauss(0, 4)
        made.append((i, i % 3 + 1, a, b, None if b is None else -b + draw.gauss(0, 9), None if i % 7 == 0 else float(draw.randrange(5))))
    rows = spark.createDataFrame(made, "record_id long, fold long, a double, b double, c double, d double")
    got = {(r.model, r.a, r.b): r.rho for r in stats.spearman_outside_folds(rows, names).collect()}
    for k in (1, 2, 3):
        for r in stats.spearman(rows.where(f"fold <> {k}"), names).collect():
            assert abs(got.pop((k, r.a, r.b)) - r.rho) < 1e-12
    assert not got
