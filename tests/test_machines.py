"""Kernel machines and randomised trees against plain forms on small tables."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import boosting, extra_trees, kernel, models


def table(spark, n=240, seed=1, features=4):
    """Three classes on rings, so that no line parts them; one feature is constant, some rows are repeated."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, features))
    x[:, :2] *= ((y + 1) / np.linalg.norm(x[:, :2], axis=1) * rng.normal(1, 0.18, n))[:, None]
    x[:, -1] = 5.0
    x[10:20], y[10:20] = x[0], y[0]
    frame = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y long").repartition(3)
    return x, y, models.prepared(frame, "x", "y", [0, 1, 2])


def two_class_machine(k, sign, most, rounds=20000):
    """The dual of a weighted hinge machine with an intercept, by the most violating pair."""
    a, gradient = np.zeros(len(sign)), -np.ones(len(sign))
    q = k * sign[:, None] * sign[None]
    for _ in range(rounds):
        up = ((sign > 0) & (a < most)) | ((sign < 0) & (a > 0))
        down = ((sign > 0) & (a > 0)) | ((sign < 0) & (a < most))
        score = -sign * gradient
        i, j = np.where(up, score, -np.inf).argmax(), np.where(down, score, np.inf).argmin()
        if score[i] - score[j] < 1e-6:
            break
        bend = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = (score[i] - score[j]) / bend
        step = min(step, most[i] - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else most[j] - a[j])
        a[i] += sign[i] * step
        a[j] -= sign[j] * step
        gradient += step * (q[:, i] * sign[i] - q[:, j] * sign[j])
    return a * sign, (score[i] + score[j]) / 2


def test_machine_is_the_kernel_machine(spark):
    """Scaling comes first, and decisions are those of a dual solver over all rows, when every row may be a landmark."""
    x, y, train = table(spark, 150)
    new = np.random.default_rng(9).normal(0, 1.5, (400, x.shape[1]))
    new[:, -1] = 5.0
    model = kernel.RbfMachine(c=10.0).fit(train)
    spread = x.std(0)
    scaled = lambda v: (v - x.mean(0)) / np.where(spread > 0, spread, 1)
    gamma = 1 / (x.shape[1] * scaled(x).var())
    assert model.gamma == pytest.approx(gamma)
    weight = len(y) / (3 * np.bincount(y))
    margins = []
    for a, b in combinations(range(3), 2):
        own = np.flatnonzero((y == a) | (y == b))
        dual, shift = two_class_machine(kernel.rbf(scaled(x[own]), scaled(x[own]), gamma), np.where(y[own] == b, 1, -1), 10.0 * weight[y[own]])
        margins.append(kernel.rbf(scaled(new), scaled(x[own]), gamma) @ dual + shift)
    got = (model.kernel(new) @ model.machines + model.intercepts).T
    assert np.median(np.abs(got - margins)) < 0.02
    votes = np.zeros((len(new), 3))
    for (a, b), m in zip(combinations(range(3), 2), margins, strict=True):
        votes[np.arange(len(new)), np.where(m >= 0, b, a)] += 1
    alone = np.sort(votes, 1)[:, -1] > np.sort(votes, 1)[:, -2]
    assert (model.decisions(new).argmax(1) == votes.argmax(1))[alone].mean() >= 0.99


def test_few_landmarks_come_near(spark):
    x, y, train = table(spark, 300)
    exact, near = kernel.RbfMachine(c=10.0, landmarks=300).fit(train), kernel.RbfMachine(c=10.0, landmarks=100).fit(train)
    assert len(near.landmarks) == 100 and len(np.unique(near.landmarks, axis=0)) == 100
    hits = [(m.decisions(x).argmax(1) == y).mean() for m in (exact, near)]
    assert hits[0] > 0.9 and abs(hits[0] - hits[1]) < 0.02


def test_calibration_is_the_least_loss(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    d = np.round(rng.normal(0, 1, 500) + 1.5 * y, 3)
    rows = spark.createDataFrame([(float(k), [-v, v]) for k, v in zip(y.tolist(), d.tolist(), strict=True)], "label double, decisions array<double>")
    found = kernel.sigmoids(rows, 2)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (500 - y.sum() + 2))
    loss = lambda a, b: (np.logaddexp(0, a * d + b) - (1 - target) * (a * d + b)).sum()
    least = loss(*found[1])
    assert all(least <= loss(found[1, 0] + i, found[1, 1] + j) for i in (-0.01, 0, 0.01) for j in (-0.01, 0, 0.01))
    assert found[1, 0] < 0 and found[0, 0] == pytest.approx(found[1, 0], abs=0.1)


def test_calibrated_probabilities(spark):
    x, y, train = table(spark, 300)
    model = kernel.RbfMachine(c=10.0, landmarks=40, calibrated=True, folds=2).fit(train)
    rows = model.transform(train).select("label", "prediction", "probability").collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 and r.prediction == int(np.argmax(r.probability)) for r in rows)
    assert sum(r.label == r.prediction for r in rows) > 0.85 * len(rows)


def plain(x, y, rows, weights, seed, tree, name, size, depth):
    """One tree, grown node by node: (feature, threshold, left, right) or class counts."""
    counts = [int((y[rows] == k).sum()) for k in range(len(weights))]
    if sum(n > 0 for n in counts) < 2 or name.bit_length() > depth:
        return counts

    def gini(part):
        held = [float((y[part] == k).sum()) * weights[k] for k in range(len(weights))]
        return sum(held) - sum(h * h for h in held) / sum(held) if sum(held) else 0.0

    for turn in range(-(-x.shape[1] // size)):
        best = None
        for f, share in zip(*extra_trees.draw(seed, tree, name, x.shape[1], size, turn), strict=True):
            low, high = x[rows, f].min(), x[rows, f].max()
            if low == high:
                continue
            threshold = min(low + share * (high - low), np.nextafter(high, low))
            left, right = rows[x[rows, f] <= threshold], rows[x[rows, f] > threshold]
            fall = gini(rows) - gini(left) - gini(right)
            if best is None or fall > best[0] + 1e-12:
                best = fall, int(f), threshold, left, right
        if best:
            _, f, threshold, left, right = best
            below = lambda part, side: plain(x, y, part, weights, seed, tree, name * 2 + side, size, depth)
            return f, threshold, below(left, 0), below(right, 1)
    return counts


def unfolded(tree, node=0):
    if tree.feature[node] < 0:
        return [int(n) for n in tree.counts[node]]
    return tree.feature[node], tree.threshold[node], unfolded(tree, tree.left[node]), unfolded(tree, tree.left[node] + 1)


@pytest.mark.parametrize(("depth", "tried"), [(4, None), (12, 1)])
def test_trees_are_those_grown_alone(spark, depth, tried):
    x, y, train = table(spark, 150)
    y = np.array([int(r.label) for r in train.collect()])
    x = np.array([r.raw.toArray() for r in train.collect()])
    model = extra_trees.ExtraTrees(trees=3, depth=depth, tried=tried, seed=7).fit(train)
    for t, tree in enumerate(model.trees):
        assert unfolded(tree) == plain(x, y, np.arange(len(y)), model.weights, 7, t, 1, tried or 2, depth)
    again = extra_trees.ExtraTrees(trees=3, depth=depth, tried=tried, seed=7).fit(train.repartition(7))
    assert [unfolded(t) for t in again.trees] == [unfolded(t) for t in model.trees]


def test_trees_without_end(spark):
    x, y, train = table(spark, 200)
    model = extra_trees.ExtraTrees(trees=10, depth=None).fit(train)
    rows = model.transform(train).select("label", "prediction").collect()
    assert all(r.label == r.prediction for r in rows)
    one = train.filter("label = 1")
    assert [t.feature for t in extra_trees.ExtraTrees(trees=2).fit(one).trees] == [[-1], [-1]]
    with pytest.raises(ValueError):
        extra_trees.ExtraTrees().fit(train.filter(F.lit(False)))
    constant = spark.createDataFrame([([1.0, 1.0], float(i % 2)) for i in range(6)], "x array<double>, label double").select(array_to_vector("x").alias("raw"), "label")
    assert [t.feature for t in extra_trees.ExtraTrees(trees=1).fit(constant).trees] == [[-1]]


def alone(x, y, bounds, rounds, leaves, depth, rate, least, l2, classes=3):
    """Boosted scores, a split at a time over all thresholds; missing values go right."""
    scores = np.tile(np.log(np.bincount(y, minlength=classes) / len(y)), (len(y), 1))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        step = np.zeros_like(scores)
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k]) * classes / (classes - 1)
            whole = lambda part: g[part].sum() ** 2 / max(h[part].sum() + l2, 1e-12)  # noqa: B023, E731

            def best(part):
                found = (0.0, None, None)
                for f in range(x.shape[1]):
                    for t in bounds[f]:
                        left, right = part[x[part, f] <= t], part[~(x[part, f] <= t)]
                        if min(len(left), len(right)) >= least and min(h[left].sum(), h[right].sum()) >= 1e-3:  # noqa: B023
                            gain = whole(left) + whole(right) - whole(part)  # noqa: B023
                            if gain > found[0] + 1e-9:
                                found = (gain, left, right)
                return found

            held = [(np.arange(len(y)), 0, best(np.arange(len(y))))]
            while leaves is None or len(held) < leaves:
                able = [i for i, (_, level, b) in enumerate(held) if b[0] > 0 and (depth is None or level < depth)]
                if not able:
                    break
                _, level, (_, left, right) = held.pop(max(able, key=lambda i: held[i][2][0]))
                held += [(part, level + 1, best(part)) for part in (left, right)]
            for part, _, _ in held:
                step[part, k] = -g[part].sum() / (h[part].sum() + l2) * rate
        scores += step
    return scores


@pytest.mark.parametrize(("leaves", "depth", "l2"), [(6, None, 0.0), (None, 2, 1.0), (5, 3, 0.5)])
def test_boosting_is_as_grown_alone(spark, leaves, depth, l2):
    _, _, train = table(spark, 160)
    seen = train.select("raw", "label").collect()
    x, y = np.array([r.raw.toArray() for r in seen]), np.array([int(r.label) for r in seen])
    made = boosting.Boosted(rounds=3, leaves=leaves, depth=depth, rate=0.3, least_rows=5, l2=l2, every=2)
    model = made.fit(train)
    np.testing.assert_allclose(model.scores(x), alone(x, y, model.bounds, 3, leaves, depth, 0.3, 5, l2), atol=1e-6)
    again = made.fit(train.repartition(5))
    np.testing.assert_array_equal(again.scores(x), model.scores(x))
    for trees in model.rounds:
        for tree in trees:
            assert sum(f < 0 for f in tree.feature) <= (leaves or 2**depth)
            assert depth is None or max(tree.name).bit_length() <= depth + 1


def test_boosting_learns_and_keeps_to_its_edges(spark):
    x, _, train = table(spark, 240)
    rows = boosting.Boosted(rounds=8, leaves=8, rate=0.5, least_rows=3).fit(train).transform(train).select("label", "prediction", "probability").collect()
    assert sum(r.label == r.prediction for r in rows) > 0.9 * len(rows)
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in rows)
    one = boosting.Boosted(rounds=4).fit(train.filter("label = 1"))
    assert len(one.rounds) == 1 and [r.prediction for r in one.transform(train).limit(3).collect()] == [1.0] * 3
    gaps = spark.createDataFrame([([float("nan") if i % 2 else float(i % 3), 1.0], float(i % 2)) for i in range(60)], "x array<double>, label double").select(array_to_vector("x").alias("raw"), "label")
    filled = boosting.Boosted(rounds=5, least_rows=1).fit(gaps).transform(gaps).collect()
    assert all(r.label == r.prediction for r in filled)
    with pytest.raises(ValueError):
        boosting.Boosted().fit(train.filter(F.lit(False)))
    with pytest.raises(ValueError):
        boosting.Boosted(leaves=None).fit(train)
