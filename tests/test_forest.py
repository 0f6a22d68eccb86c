"""Forests that are grown in tasks, against MLlib and against plain loops."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tillmark.plans import forest as RF
from tillmark.plans import models as ML

SMALL = RF.Settings(trees=6, depth=30, bins=32, seed=42)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        x = [rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4)), float(rng.randrange(2)), 1.0]
        label = int(x[0] + 0.5 * x[2] + rng.gauss(0, 0.7) > 0.7)
        rows.append((i, Vectors.dense(x), label, 0.4 if label else 1.7, "train" if i % 3 else "val"))
    frame = ML.materialize(spark.createDataFrame(rows, ["id", "features", "label", "weight", "data_split"]))
    return frame, ML.materialize(frame.where("data_split = 'train'"))


def scores(model, frame):
    return {r.id: r.score for r in ML.score(model, frame, ["id"]).collect()}


def test_no_part_of_a_tree_is_larger_than_a_block(noisy):
    """The sizes of blocks and of records do not change the trees."""
    frame, train = noisy
    whole = RF.fit_large(train, "features", "label", "weight", SMALL)
    assert sum(len(t.feature) for t in whole.tops) == SMALL.trees
    cut = RF.fit_large(train, "features", "label", "weight", RF.Settings(6, 30, 32, 42, block=40))
    assert sum(len(t.feature) for t in cut.tops) > 60 and sum(p.count() for p in cut.parts) > 30
    assert scores(cut, frame) == pytest.approx(scores(whole, frame), abs=1e-12)
    assert len(scores(cut, frame)) == frame.count()


def test_more_trees_than_grow_side_by_side(noisy, monkeypatch):
    frame, train = noisy
    whole = scores(RF.fit_large(train, "features", "label", "weight", SMALL), frame)
    monkeypatch.setattr(RF, "SIDE", 1)
    parts = RF.fit_large(train, "features", "label", "weight", RF.Settings(6, 30, 32, 42, block=2500))
    assert len(parts.parts) == 3 and scores(parts, frame) == pytest.approx(whole, abs=1e-12)


def test_the_driver_holds_no_lower_nodes(noisy, monkeypatch):
    """What the query holds on the driver is the tops of the trees, however deep they are."""
    _, train = noisy
    model = RF.fit(ML.forest(weightCol="weight", numTrees=6, maxDepth=30), train, largest=500)
    lower = sum(len(RF.unpacked(bytes(r.nodes))[0].feature) for p in model.parts for r in p.collect())
    assert lower > 200 and sum(len(t.feature) for t in model.tops) == 6


def test_mllib_fits_small_forests(noisy):
    _, train = noisy
    estimator = ML.forest(weightCol="weight", numTrees=3, maxDepth=30)
    small, again = RF.fit(estimator, train), estimator.fit(train)
    assert [t.toDebugString.split("\n", 1)[1] for t in small.trees] == [t.toDebugString.split("\n", 1)[1] for t in again.trees]


def test_like_mllib(noisy):
    """The same settings give trees of the same size and scores of the same quality."""
    frame, train = noisy
    estimator = ML.forest(weightCol="weight", numTrees=40, maxDepth=30)
    theirs, ours = estimator.fit(train), RF.fit(estimator, train, largest=0)
    nodes = sum(len(RF.unpacked(bytes(r.nodes))[0].feature) for p in ours.parts for r in p.collect())
    assert nodes == pytest.approx(theirs.totalNumNodes, rel=0.05)
    report = [{r.data_split: r for r in ML.split_report(m, frame).collect()} for m in (theirs, ours)]
    for split in ("train", "val"):
        assert report[1][split].auc == pytest.approx(report[0][split].auc, abs=0.02)
        assert report[1][split].balanced_accuracy == pytest.approx(report[0][split].balanced_accuracy, abs=0.03)
    a, b = scores(theirs, frame), scores(ours, frame)
    assert np.corrcoef([a[i] for i in a], [b[i] for i in a])[0, 1] > 0.95


def slow_leaf(x, bins, weight, tree, path, s, n_bins, level=0):
    """(share of class 1 or class, single) of the leaf that x ends in, by plain recursion over exact rows."""
    total = weight.sum(axis=0)
    own = (total[1] / total.sum(), int(total[1] > total[0]))

    def grow(rows, path, level):
        total = weight[rows].sum(axis=0)
        leaf = {"share": total[1] / total.sum(), "one": total[1] > total[0]}
        if level == s.depth or not total.all():
            return leaf
        best = (0.0, None)
        for f in RF.columns_of(np.array([path], np.uint64), tree, bins.shape[1], s)[0]:
            for cut in range(n_bins - 1):
                left = bins[rows, f] <= cut
                a, b = weight[rows[left]].sum(axis=0), weight[rows[~left]].sum(axis=0)
                if not a.sum() or not b.sum():
                    continue
                gain = (RF.gini(total) - RF.gini(a) - RF.gini(b)) / total.sum()
                if gain > max(best[0], 1e-15):
                    best = (gain, (f, cut, left))
        if best[1] is None:
            return leaf
        f, cut, left = best[1]
        low, high = grow(rows[left], 2 * path, level + 1), grow(rows[~left], 2 * path + 1, level + 1)
        if "f" not in low and "f" not in high and low["one"] == high["one"]:
            return leaf
        return {"f": f, "cut": cut, "low": low, "high": high}

    node = grow(np.arange(len(bins)), path, level)
    out = []
    for row in x:
        at = node
        while "f" in at:
            at = at["high"] if row[at["f"]] > at["cut"] else at["low"]
        out.append(at["share"])
    return own, np.array(out)


def test_trees_by_recursion():
    rng = np.random.default_rng(3)
    for depth, chunk in ((30, 1024), (30, 3), (4, 2)):
        s = RF.Settings(trees=1, depth=depth, bins=8, seed=1)
        bins = rng.integers(0, 8, (300, 5)).astype(np.uint8)
        label = (bins[:, 0] + rng.integers(0, 6, 300) > 7).astype(int)
        weight = RF.class_weights(label, rng.integers(1, 4, 300) * (label + 1)).astype(float)
        nodes, _ = RF.grown(bins, weight, 7, 1, s, 8, chunk=chunk).pruned()
        seen = rng.integers(0, 8, (200, 5)).astype(np.uint8)
        _, expected = slow_leaf(seen, bins, weight, 7, 1, s, 8)
        tree, share = RF.unpacked(nodes.pack())
        assert share[tree.walk(seen)] == pytest.approx(expected)


def test_thresholds():
    few = RF.thresholds(np.array([1.0, 2.0, 5.0]), np.ones(3), 32)
    assert few.tolist() == [1.5, 3.5]
    even = RF.thresholds(np.arange(100.0), np.ones(100), 4)
    assert even.tolist() == [24.5, 49.5, 74.5]


def test_cut_points_use_all_rows(spark):
    df = spark.range(5000).select(
        F.array((F.col("id") % 3).cast("double"), F.col("id").cast("double"), F.lit(2.0)).alias("x"), F.lit(1.0).alias("w"))
    cuts = RF.cut_points(df, 3, 32)
    assert cuts[0].tolist() == [0.5, 1.5] and len(cuts[2]) == 0
    assert len(cuts[1]) == 31 and np.abs(np.diff(cuts[1]) - 5000 / 32).max() < 25


def test_bootstrap_has_the_poisson_mean():
    times = RF.times_drawn(np.arange(100_000, dtype=np.uint64), 3, SMALL)
    assert times.mean() == pytest.approx(1, abs=0.02) and (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    drawn = RF.columns_of(np.arange(1, 2001, dtype=np.uint64), 0, 13, SMALL)
    assert drawn.shape == (2000, 4) and np.bincount(drawn.ravel(), minlength=13).min() > 500


def test_strange_labels_and_settings_are_refused(spark, noisy):
    _, train = noisy
    with pytest.raises(ValueError, match="labels"):
        RF.fit(ML.forest(weightCol="weight"), train.withColumn("label", F.lit(2)), largest=0)
    with pytest.raises(ValueError, match="impurity"):
        RF.fit(ML.forest(weightCol="weight", impurity="entropy"), train, largest=0)


def test_repeated_rows_and_one_class(spark):
    rows = [(1, Vectors.dense([1.0, 2.0]), 1, 1.0), (1, Vectors.dense([1.0, 2.0]), 1, 1.0), (2, Vectors.dense([0.0, 2.0]), 1, 1.0)]
    frame = spark.createDataFrame(rows, ["id", "features", "label", "weight"])
    out = ML.score(RF.fit_large(frame, "features", "label", "weight", SMALL), frame, ["id"]).collect()
    assert len(out) == 3 and all(0.5 < r.score <= 1 for r in out)
