"""The registered model queries run the whole job: 200 rounds, 200 draws of the C-index."""

import inspect

import pytest

from tempora.operators import metrics, ml
from tempora.plans import model_queries, registry

registry.load()
DIR = "/root/testdata/sf0.001"


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name", ["train_failure", "batch_scores"])
def test_classifiers_are_fitted_with_all_rounds(spark, name, monkeypatch):
    real = inspect.signature(ml.fit_classifier)

    def fit(*a, **b):
        bound = real.bind(*a, **b)
        bound.apply_defaults()
        raise Fitted(bound.arguments["iterations"], bound.arguments["depth"], bound.arguments["rate"])

    monkeypatch.setattr(ml, "fit_classifier", fit)
    monkeypatch.setattr(model_queries, "_frame", lambda x: spark.createDataFrame([("TRAIN", 1)], "split string, target int"))
    with pytest.raises(Fitted) as e:
        registry.QUERIES[name](spark, DIR)
    assert e.value.args == (200, 4, 0.03)


def test_bootstrap_draws_the_c_index(spark):
    rows = spark.createDataFrame([(k, 10 + k % 30, k % 4 > 0, float(-(k % 30) + 9 * (k % 7 == 0))) for k in range(300)], "k long, duration_days int, event boolean, risk double")
    c = metrics.c_index(rows).first()["c_index"]
    r = metrics.bootstrap_ci(rows, "k").first()
    assert r["draws"] == 200 and r["low"] < c < r["high"] and r["high"] - r["low"] < 0.1
    assert registry.QUERIES["bootstrap_ci"](spark, DIR).first()["draws"] == 200
