"""Merged curves against plain interpolation, and values carried over partitions."""

import numpy as np
import pytest

from tessera.operators import metrics, ranking


@pytest.mark.parametrize("falling", [False, True])
def test_values_beside_cross_partitions(spark, falling):
    rng = np.random.default_rng(5)
    rows = [(k, float(o), None if rng.random() < 0.7 else f"{k}{o}") for k, n in (("a", 300), ("b", 7), ("c", 1)) for o in rng.permutation(n)]
    rows += [("d", float(o), None) for o in range(5)]
    got = ranking.beside(spark.createDataFrame(rows, "key string, at double, v string"), ["key"], "at", "v", "left", "right", falling).collect()
    want = {}
    for k in "abcd":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1], reverse=falling)
        for i, r in enumerate(own):
            before, after = [q[2] for q in own[:i] if q[2]], [q[2] for q in own[i + 1 :] if q[2]]
            want[k, r[1]] = (r[2], before[-1] if before else None, after[0] if after else None)
    assert {(r.key, r["at"]): (r.v, r.left, r.right) for r in got} == want and len(got) == len(rows)


def test_macro_curve_is_the_mean_of_interpolated_ones(spark):
    rng = np.random.default_rng(8)
    truth = rng.integers(0, 3, 400)
    score = {k: np.round(rng.random(400) * 0.6 + 0.4 * (truth == k), 2 + k) for k in range(3)}
    rows = [(k, bool(t == k), float(s)) for k in range(3) for t, s in zip(truth, score[k], strict=True)]
    points = metrics.roc_points(spark.createDataFrame(rows, "label long, pos boolean, score double"), "pos", "score", ["label"])
    curves, areas = {}, {}
    for k in range(3):
        cuts = np.unique(score[k])[::-1]
        x = np.r_[0, [((score[k] >= c) & (truth != k)).sum() / (truth != k).sum() for c in cuts]]
        y = np.r_[0, [((score[k] >= c) & (truth == k)).sum() / (truth == k).sum() for c in cuts]]
        curves[k], areas[k] = (x, y), float(np.trapezoid(y, x))
    union = np.unique(np.concatenate([x for x, _ in curves.values()]))
    want = sum(np.interp(union, x, y) for x, y in curves.values()) / 3
    got = sorted((r.fpr, r.tpr) for r in metrics.macro_roc(points, [0, 1, 2]).collect())
    np.testing.assert_allclose([g[0] for g in got], union, atol=1e-12)
    ties = np.array([max(np.sum(np.isclose(x, u)) for x, _ in curves.values()) for u in union]) > 1  # there the highest point counts
    assert (~ties).sum() > 20
    np.testing.assert_allclose(np.array([g[1] for g in got])[~ties], want[~ties], atol=1e-9)
    highest = sum(np.where([np.any(x == u) for u in union], [max(y[x == u], default=0) for u in union], np.interp(union, x, y)) for x, y in curves.values()) / 3
    np.testing.assert_allclose([g[1] for g in got], highest, atol=1e-9)
    found = {r.label: r.auc for r in metrics.trapezoid_auc(points, ["label"]).collect()}
    assert all(abs(found[k] - areas[k]) < 1e-9 for k in range(3))
