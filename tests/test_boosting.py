"""The distributed booster equals a small exact one; penalties act; several targets grow side by side."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.plans import boosting as B
from tillmark.plans import models as ML


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        a, b, c = rng.randrange(12), rng.randrange(8), rng.choice([None, 0.0, 1.0, 2.0])
        y = 2.0 * (a > 5) + (b % 4) * 0.5 + (c or 0) + rng.gauss(0, 0.3)
        rows.append((i, float(a), float(b), c, y, None if i % 5 == 0 else -y + a))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, z double").repartition(3)


def shrink(g, l1):
    return max(abs(g) - l1, 0.0) * (1 if g > 0 else -1)


def exact_tree(rows, features, s, level=0, columns=None):
    """(value, feature, cut value, left, right) by trying every value of every feature."""
    g, h = sum(r["g"] for r in rows), len(rows)
    value = -s.eta * shrink(g, s.l1) / (h + s.l2)
    best = None
    if level < s.depth:
        for f in columns or features:
            for cut in sorted({r[f] for r in rows})[:-1]:
                left = [r["g"] for r in rows if r[f] <= cut]
                gl, hl = sum(left), len(left)
                if hl < s.child_weight or h - hl < s.child_weight:
                    continue
                gain = (shrink(gl, s.l1) ** 2 / (hl + s.l2) + shrink(g - gl, s.l1) ** 2 / (h - hl + s.l2)
                        - shrink(g, s.l1) ** 2 / (h + s.l2)) / 2 - s.gamma
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-6)):
                    best = (gain, f, cut)
    if best is None:
        return (value,)
    _, f, cut = best
    return (value, f, cut, exact_tree([r for r in rows if r[f] <= cut], features, s, level + 1, columns),
            exact_tree([r for r in rows if r[f] > cut], features, s, level + 1, columns))


def leaf(tree, row):
    while len(tree) > 1:
        tree = tree[3] if row[tree[1]] <= tree[2] else tree[4]
    return tree[0]


def exact_boost(frame, features, target, s):
    rows = [r.asDict() for r in frame.collect()]
    for r in rows:
        r.update({f: float("-inf") if r[f] is None else r[f] for f in features})
    known = [r for r in rows if r[target] is not None]
    base = sum(r[target] for r in known) / len(known)
    for r in rows:
        r["p"] = base
    for _ in range(s.rounds):
        for r in known:
            r["g"] = r["p"] - r[target]
        tree = exact_tree(known, features, s)
        for r in rows:
            r["p"] += leaf(tree, r)
    return {r["id"]: r["p"] for r in rows}


FEATURES = ["a", "b", "c"]
SETTINGS = [B.Settings(rounds=4, depth=3), B.Settings(rounds=3, depth=2, eta=0.5, l1=5.0, l2=3.0, gamma=2.0, child_weight=20)]


@pytest.mark.parametrize("keep_every", [1, 20])
def test_equals_an_exact_booster(frame, keep_every):
    targets = {"y": SETTINGS[0], "z": SETTINGS[1]}
    boosters = B.fit(frame, FEATURES, targets, ["id"], bins=64, keep_every=keep_every)
    got = {r["id"]: r for r in B.predict(frame, boosters).collect()}
    for target, s in targets.items():
        want = exact_boost(frame, FEATURES, target, s)
        assert max(abs(got[i][f"prediction_{target}"] - p) for i, p in want.items()) < 1e-6


def test_penalties_prune(frame):
    plain = B.fit(frame, FEATURES, {"y": B.Settings(rounds=1, depth=4)}, ["id"])["y"].trees[0]
    pruned = B.fit(frame, FEATURES, {"y": B.Settings(rounds=1, depth=4, gamma=30.0)}, ["id"])["y"].trees[0]
    assert 0 < (pruned.feature >= 0).sum() < (plain.feature >= 0).sum()
    flat = B.fit(frame, FEATURES, {"y": B.Settings(rounds=1, depth=4, l1=1e6)}, ["id"])["y"].trees[0]
    assert (flat.feature < 0).all() and not flat.value.any()


def test_drawn_rows_and_columns(frame):
    s = B.Settings(rounds=6, depth=2, row_share=0.5, column_share=0.34)
    first = B.fit(frame, FEATURES, {"y": s}, ["id"])["y"]
    again = B.fit(frame.repartition(2), FEATURES, {"y": s}, ["id"])["y"]
    assert all((x.feature == y.feature).all() and (x.bin == y.bin).all() for x, y in zip(first.trees, again.trees, strict=True))
    assert all(len(set(t.feature[t.feature >= 0].tolist())) <= 1 for t in first.trees)
    assert len({f for t in first.trees for f in t.feature[t.feature >= 0].tolist()}) > 1
    assert sum(v for _, v in first.importance()) == pytest.approx(1.0)


def test_the_error_falls(frame):
    errors = []
    for rounds in (1, 5, 15):
        out = B.predict(frame, B.fit(frame, FEATURES, {"y": B.Settings(rounds=rounds, depth=3)}, ["id"]))
        errors.append(out.agg(F.avg((F.col("y") - F.col("prediction_y")) ** 2)).first()[0])
    assert errors[0] > errors[1] > errors[2]


def test_awkward_frames(spark):
    rows = spark.createDataFrame([(1, None, 3.0), (2, None, 5.0)], "id int, a double, y double")
    boosters = B.fit(rows, ["a"], {"y": B.Settings(rounds=2, depth=2)}, ["id"])
    assert {r["prediction_y"] for r in B.predict(rows, boosters).collect()} == {4.0}
    none = spark.createDataFrame([], "id int, a double, y double")
    assert B.predict(none, B.fit(none, ["a"], {"y": B.Settings(rounds=1)}, ["id"])).count() == 0


def test_permutation_errors_equal_brute_force(frame):
    targets = {"y": B.Settings(rounds=3, depth=2), "z": B.Settings(rounds=2, depth=2)}
    boosters = B.fit(frame, FEATURES, targets, ["id"])
    got = B.permutation_errors(frame, boosters, ["id"], repeats=3, seed=7)
    placed = [r.asDict() for r in B.positions(frame, ["id"], "_pos", 7).collect()]
    n, rng = len(placed), random.Random(7)
    steps = [B.donor_step(n, rng) for _ in range(3)]
    by_position = {r["_pos"]: r for r in placed}

    def errors(rows):
        out = B.predict(frame.sparkSession.createDataFrame(rows, frame.schema), boosters).collect()
        return {t: np.mean([abs(r[t] - r[f"prediction_{t}"]) for r in out if r[t] is not None]) for t in targets}

    def tuples(rows):
        return [tuple(r[c] for c in frame.columns) for r in rows]

    base = errors(tuples(placed))
    for f in FEATURES:
        drops = {t: [] for t in targets}
        for a, b in steps:
            donor = {(a * p + b) % n: r for p, r in by_position.items()}
            shuffled = errors(tuples([{**r, f: donor[p][f]} for p, r in by_position.items()]))
            for t in targets:
                drops[t].append(shuffled[t] - base[t])
        for t in targets:
            row = next(r for r in got[t].collect() if r["feature"] == f)
            assert row["importance"] == pytest.approx(np.mean(drops[t]), abs=1e-9)
            assert row["importance_std"] == pytest.approx(np.std(drops[t], ddof=1), abs=1e-9)
    assert max(got["y"].collect(), key=lambda r: r["importance"])["feature"] in FEATURES


def test_no_level_looks_through_earlier_trees(frame, monkeypatch):
    lacking, passes, context = [], B.histograms, frame.sparkSession.sparkContext
    before = context._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(B, "histograms", lambda rows, boosters, pending, *rest: lacking.append(max(pending)) or passes(rows, boosters, pending, *rest))
    B.fit(frame, FEATURES, {"y": B.Settings(rounds=5, depth=2), "z": B.Settings(rounds=3, depth=1)}, ["id"], keep_every=3)
    assert len(lacking) > 5 and set(lacking) == {0}
    assert context._jsc.getPersistentRDDs().size() == before


def classified(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b, c = float(rng.randrange(9)), float(rng.randrange(6)), float(rng.randrange(4))
        rows.append((i, a, b, c, int(a + 2 * (b % 3) + rng.gauss(0, 2) > 5)))
    return ML.materialize(ML.assemble(spark.createDataFrame(rows, "id int, a double, b double, c double, label int"), FEATURES))


def scores(model, frame):
    return {r.id: r.score for r in ML.score(model, frame, ["id"]).collect()}


def test_classifier_equals_mllib_where_nothing_is_drawn(spark):
    frame = classified(spark)
    like = ML.boosted(maxIter=12, maxDepth=3)
    want, got = scores(like.fit(frame), frame), scores(B.Classifier(like, ["id"]).fit(frame), frame)
    assert len(set(want.values())) > 20 and max(abs(want[i] - got[i]) for i in want) < 1e-6


def test_long_fits_need_no_pass_per_tree(spark, monkeypatch):
    frame = classified(spark)
    monkeypatch.setattr(B, "histograms", lambda *_: pytest.fail("a pass over the cluster for a level of a tree"))
    tracker, group = spark.sparkContext.statusTracker(), []
    for rounds in (2, 60):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "")
        B.Classifier(ML.boosted(maxIter=rounds, subsamplingRate=0.8, featureSubsetStrategy="0.8"), ["id"]).fit(frame)
        group.append(len(tracker.getJobIdsForGroup(f"rounds {rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert group[0] == group[1] > 0


@pytest.mark.parametrize("drawn", [{}, {"subsamplingRate": 0.6, "featureSubsetStrategy": "0.5"}])
def test_one_task_and_passes_grow_the_same_classifier(spark, drawn):
    frame, like = classified(spark), ML.boosted(maxIter=4, maxDepth=3, **drawn)
    one, many = (scores(B.Classifier(like, ["id"], whole=w).fit(frame), frame) for w in (B.WHOLE, 0))
    assert max(abs(one[i] - many[i]) for i in one) < 1e-9


def test_one_task_and_passes_grow_the_same_trees(frame):
    targets = {"y": B.Settings(rounds=4, depth=3, row_share=0.7, column_share=0.67), "z": SETTINGS[1]}
    one, many = (B.fit(frame, FEATURES, targets, ["id"], whole=w) for w in (B.WHOLE, 0))
    for t in targets:
        assert len(one[t].trees) == len(many[t].trees) == targets[t].rounds
        for x, y in zip(one[t].trees, many[t].trees, strict=True):
            assert (x.feature == y.feature).all() and (x.bin == y.bin).all() and np.allclose(x.value, y.value, atol=1e-9)


def test_points_share_the_longest_fit(spark):
    frame, like = classified(spark), ML.boosted(subsamplingRate=0.8)
    maps = ML.grid(like, {"maxDepth": [2, 3], "maxIter": [2, 5]})
    for index, model in B.Classifier(like, ["id"]).fitMultiple(frame, maps):
        alone = scores(B.Classifier(like.copy(maps[index]), ["id"]).fit(frame), frame)
        assert scores(model, frame) == pytest.approx(alone)
