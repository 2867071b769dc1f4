"""Models as rows: everything comes back, versions stay, an unfinished model is not seen."""

import numpy as np
import pytest

from fluxloom.operators import many, model_store, survival
from fluxloom.operators.classify import ClassModel
from fluxloom.session import staging_path


def models():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    edges = [np.quantile(x[:, f], [0.25, 0.5, 0.75]) for f in range(3)]
    trees = [many.boost(many._binned(x, edges), np.arange(120), (y == c).astype(float), edges, many.Boosting(trees=4, depth=2)) for c in range(3)]
    softmax = many.softmax_fit(x, y, np.ones(120), 3)
    isotonic = [([0.0, 0.5, 1.0], [0.1, 0.4, 0.9])] * 3
    return x, {
        "trees": ClassModel("gbt", ["a", "b", "c"], ["p", "q", "r"], [trees]),
        "softmax": ClassModel("logistic", ["a", "b", "c"], ["p", "q", "r"], [softmax], isotonic),
        "sigmoid": ClassModel("logistic", ["a", "b", "c"], ["p", "q", "r"], [softmax], [(1.5, -0.5)] * 3),
        "boosted": survival.BoostedModel(["p", "q", "r"], trees[0], 2.5),
        "cox": survival.CoxModel(["p", "q"], [0.5, 1.0], [0.1, -0.2], [(0.0, None, None, 3.0, 0.1), (1.0, 1.0, 0.05, None, None)], 4, -12.5, False),
    }


def test_every_kind_comes_back(spark):
    x, all_models = models()
    folder = staging_path(spark, "models")
    for i, (name, model) in enumerate(all_models.items()):
        assert model_store.save_model(spark, folder, name, model) == i + 1
    for name, model in all_models.items():
        again = model_store.load_model(spark, folder, name)
        assert type(again) is type(model) and again.columns == model.columns
        if name == "cox":
            assert again == model
        elif name == "boosted":
            assert again.scale == 2.5 and np.array_equal(again.model.margin(x), model.model.margin(x))
        else:
            assert again.classes == model.classes and again.calibration == model.calibration
            assert np.array_equal(many.class_probabilities(again.parts[0], x), many.class_probabilities(model.parts[0], x))
    assert all_models["trees"].importances(spark).collect() == model_store.load_model(spark, folder, "trees").importances(spark).collect()


def test_versions_and_unfinished_models(spark):
    _, all_models = models()
    folder = staging_path(spark, "models")
    first = model_store.save_model(spark, folder, "m", all_models["trees"])
    second = model_store.save_model(spark, folder, "m", all_models["cox"])
    assert isinstance(model_store.load_model(spark, folder, "m"), survival.CoxModel)
    assert isinstance(model_store.load_model(spark, folder, "m", version=first), ClassModel) and second == first + 1
    spark.createDataFrame(model_store.model_rows(all_models["trees"])[:5], model_store.SCHEMA).write.parquet(f"{folder}/half")
    assert isinstance(model_store.load_model(spark, folder, "m"), survival.CoxModel)
    with pytest.raises(KeyError):
        model_store.load_model(spark, folder, "other")
