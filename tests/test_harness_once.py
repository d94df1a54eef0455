"""The harness of distances charts its windows once, for distances and for records."""

import pytest

from orrery.plans import model_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def calls(monkeypatch):
    def counted(module, name):
        made, plain = [], getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: made.append(1) or plain(*a, **k))
        return made

    return counted


class Reached(Exception):
    pass


def test_harness_charts_windows_once(spark, calls, monkeypatch):
    charted, records = calls(model_queries, "window_features"), calls(model_queries, "record_features")

    def reached(_):
        raise Reached

    # windows, records and folds are made before the first distances are
    monkeypatch.setattr(model_queries, "_each_set", reached)
    with pytest.raises(Reached):
        model_queries.harness_predictions(spark, DATA)
    assert len(charted) + len(records) == 1
