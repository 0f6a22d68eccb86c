"""Models on planted signals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark import catalog
from tillmark.plans import boosting as B
from tillmark.plans import models as ML


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        x, noise = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, x, noise, int(x + 0.3 * rng.gauss(0, 1) > 0), "train" if i % 3 else "val"))
    df = spark.createDataFrame(rows, "id int, signal double, noise double, label int, data_split string")
    return ML.materialize(ML.assemble(df, ["signal", "noise"]))


def test_classifiers_find_the_signal(planted):
    for estimator in (ML.logistic(maxIter=30), ML.forest(numTrees=5), ML.boosted(maxIter=3)):
        report = {r.data_split: r for r in ML.split_report(ML.fit_on_train(estimator, planted), planted).collect()}
        assert report["val"].auc > 0.9 and report["val"].balanced_accuracy > 0.8


def test_permutation_importance_ranks_signal_first(planted):
    model = ML.fit_on_train(ML.forest(numTrees=5), planted)
    table = {r.feature: r for r in ML.permutation_importance(model, planted, ["signal", "noise"], ["id"], repeats=2).collect()}
    assert table["signal"].importance > 0.2 > abs(table["noise"].importance)


def test_balance_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    out = {r.label: r.weight for r in ML.balance(df).collect()}
    assert out == {1: 2.0, 0: pytest.approx(4 / 6)}


def test_nmf_reduces_the_loss_and_is_repeatable(spark):
    rng = np.random.default_rng(1)
    v = rng.random((120, 2)) @ rng.random((2, 6))
    cols = [f"c{j}" for j in range(6)]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(v)], "id int, " + ", ".join(f"{c} double" for c in cols))
    w, h, losses = ML.nmf(df, ["id"], cols, k=2, iters=25)
    assert losses[-1] < losses[0] * 0.05
    assert all(b <= a * 1.001 for a, b in zip(losses, losses[1:]))
    assert w.count() == 120 and w.filter(F.exists("w", lambda x: x < 0)).count() == 0
    again = ML.nmf(df, ["id"], cols, k=2, iters=25)[2]
    assert again == pytest.approx(losses)
    assert ML.top_factor_features(h, 3).count() == 6


def test_one_hot_drops_the_first_category(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "dept string")
    rows = {r.dept: r for r in ML.one_hot(df, "dept").collect()}
    assert set(rows["a"].asDict()) == {"dept", "dept_b", "dept_c"}
    assert (rows["a"].dept_b, rows["a"].dept_c) == (0, 0)
    assert (rows["b"].dept_b, rows["c"].dept_c) == (1, 1)


def test_pca_marks_components_up_to_the_target(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 3)) * np.array([10.0, 3.0, 0.1])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    model, _ = ML.pca_fit(ML.assemble(df, ["a", "b", "c"]), 3)
    rows = ML.pca_variance(model, spark, 0.95).orderBy("component").collect()
    assert rows[-1].cumulative == pytest.approx(1.0)
    assert [r.needed for r in rows] == [True, True, False]
    assert ML.pca_loadings(model, ["a", "b", "c"], spark).count() == 9


def test_grid_search_ranks_by_auc(planted):
    table = ML.grid_search(ML.boosted(maxIter=2), {"maxDepth": [1, 2], "stepSize": [0.1]}, planted).collect()
    assert len(table) == 2 and table[0].auc >= table[1].auc


def test_clusters_are_named_by_profile(spark):
    df = spark.createDataFrame([(i, 100.0 * (i % 2), i % 2) for i in range(10)], "id int, spend double, cluster int")
    out = {r.cluster: r.segment for r in ML.name_clusters(df, "spend", ["high", "low"]).collect()}
    assert out == {1: "high", 0: "low"}


class Seen(Exception):
    pass


def whole_fits(monkeypatch, owner, name, run):
    """What a query hands to a fit, which is not run."""
    seen = []

    def stop(*args, **kwargs):
        seen.append((args, kwargs))
        raise Seen

    monkeypatch.setattr(owner, name, stop)
    with pytest.raises(Seen):
        run()
    return seen[0]


def test_the_refit_grows_all_tuned_rounds(spark, folder, monkeypatch):
    args, kwargs = whole_fits(monkeypatch, B, "fit", lambda: catalog.load()["final_refit"](spark, folder))
    assert [(t, s.rounds, s.depth) for t, s in args[2].items()] == [
        ("target_return_1d", 400, 5), ("target_return_5d", 649, 9), ("target_return_20d", 649, 9)]


@pytest.mark.parametrize("name", ["least_important", "importance_by_horizon"])
def test_importances_come_from_all_tuned_rounds(spark, folder, monkeypatch, name):
    args, kwargs = whole_fits(monkeypatch, B, "fit", lambda: catalog.load()[name](spark, folder))
    assert [(t, s.rounds) for t, s in args[2].items()] == [("target_return_1d", 400), ("target_return_5d", 649), ("target_return_20d", 649)]


def test_the_grid_has_all_points_and_rounds(spark, folder, monkeypatch):
    (estimator, space, _), _ = whole_fits(monkeypatch, ML, "grid_search", lambda: catalog.load()["grid_search"](spark, folder))
    assert space == {"maxDepth": [3, 5, 7, 9], "stepSize": [0.01, 0.05, 0.1], "maxIter": [100, 200, 300]}
    assert estimator.like.getSubsamplingRate() == 0.8 and estimator.like.getFeatureSubsetStrategy() == "0.8"


def test_the_curve_grows_all_rounds(spark, folder, monkeypatch):
    (makers, _, _, fractions), _ = whole_fits(monkeypatch, ML, "learning_curve", lambda: catalog.load()["learning_curve"](spark, folder))
    assert {name: m.like.getMaxIter() for name, m in makers.items()} == {"default": 100, "tuned": 300}
    assert fractions == [i / 10 for i in range(1, 11)]


def test_search_and_curve_with_the_booster(planted):
    small = B.Classifier(ML.boosted(subsamplingRate=0.8), ["id"])
    table = ML.grid_search(small, {"maxDepth": [1, 2], "maxIter": [2, 4]}, planted).collect()
    assert len(table) == 4 and table[0].auc >= table[-1].auc > 0.9
    curve = ML.learning_curve({"small": small}, planted, ["id"], [0.5, 1.0]).collect()
    assert [r.fraction for r in curve] == [0.5, 1.0] and all(r.auc > 0.9 for r in curve)
