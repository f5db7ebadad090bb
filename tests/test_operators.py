"""Operators against brute force and against the reference scenarios."""

import itertools
import re
from fractions import Fraction
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import boxes, pixels
from tessera.operators import features, metrics, nearness, ranking, split, temporal, tracking
from tessera.sources import config, io
from tessera.streaming.fusion import Fusion


def parse(spark, text, **options):
    r = spark.createDataFrame([(text,)], "t string").select(boxes.parse_yolo(F.col("t"), {0: 0, 1: 1}, 160, 120, **options).alias("r")).first().r
    return [b.class_id for b in r.boxes], list(r.warnings), r.valid


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        (None, {}, ([], [], True)),
        ("", {}, ([], [], True)),
        ("0 0.5 0.5 0.3 0.4\r\n\r\n1 0.65 0.5 0.2 0.3", {}, ([0, 1], [], True)),
        ("0 0.5 0.5 0.3", {}, ([], ["line_1:expected_5_fields"], False)),
        ("0 .5 .5 .3 .3 9\n0.9 0.5 0.5 0.3 0.4", {}, ([0], ["line_1:expected_5_fields"], False)),
        ("abc 0.5 0.5 0.1 0.1", {}, ([], ["line_1:invalid_number"], False)),
        ("inf 0.5 0.5 0.1 0.1\n0 nan 0.5 0.1 0.1", {}, ([], ["line_1:invalid_number", "line_2:invalid_number"], False)),
        ("7 0.5 0.5 0.1 0.1", {}, ([], ["line_1:unknown_class_7"], True)),
        ("7 0.5 0.5 0.1 0.1", {"drop_unknown": False}, ([], ["line_1:unknown_class_7"], False)),
        ("0 0.5 0.5 0.01 0.01", {}, ([], ["line_1:tiny_box_dropped"], True)),
        ("0 0.95 0.5 0.2 0.3", {}, ([0], ["line_1:clamped_out_of_bounds_box"], True)),
        ("0 0.95 0.5 0.2 0.3", {"repair": False}, ([], ["line_1:out_of_bounds_box"], False)),
        ("0 0.5 0.5 0 0.3", {}, ([], ["line_1:zero_or_negative_area_box"], False)),
    ],
)
def test_yolo(spark, text, options, want):
    assert parse(spark, text, **options) == want


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ("<a><object><name> Fire </name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>50</xmax><ymax>60</ymax></bndbox></object></a>", (1, [], True)),
        ("<a><object><name>cat</name></object><object><name>smoke</name></object></a>", (0, ["object_1:unknown_class_cat", "object_2:missing_bndbox"], False)),
        ("<a><object><bndbox><xmin>1</xmin></bndbox></object></a>", (0, ["object_1:unknown_class_empty"], True)),
        ("<a><object><name>fire</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>50</xmax></bndbox></object></a>", (0, ["object_1:invalid_coordinates"], False)),
        ("<a><object>", (0, ["invalid_xml"], False)),
        (None, (0, [], True)),
    ],
)
def test_voc(spark, xml, want):
    r = spark.createDataFrame([(xml,)], "t string").select(boxes.parse_voc(F.col("t"), {"fire": 0, "smoke": 1}, 160, 120).alias("r")).first().r
    assert (len(r.boxes), list(r.warnings), r.valid) == want


def test_near_groups_match_union_find(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    hashes = [s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for s in seeds for _ in range(6)]
    hashes = [(h + (1 << 63)) % (1 << 64) - (1 << 63) for h in hashes] + [None, None, hashes[0] - (1 << 64) * (hashes[0] >> 63)]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    distance = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    for most in (0, 2, 4):
        different = sorted({h for h in hashes if h is not None})
        want = {(a, b, distance(a, b)) for a, b in itertools.combinations(different, 2) if distance(a, b) <= most}
        assert {tuple(r) for r in nearness.hamming_pairs(df, "h", most).collect()} == want
        root = list(range(len(hashes)))
        for a, b in itertools.combinations(range(len(hashes)), 2):
            if hashes[a] is not None and hashes[b] is not None and distance(hashes[a], hashes[b]) <= most:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
        groups = {r.id: (r.representative, r.group) for r in nearness.near_groups(df, "id", "h", most).collect()}
        order = sorted(set(root))
        assert groups == {i: (r, f"dup_{order.index(r):06d}") for i, r in enumerate(root)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)]
    found = {r.node: r.root for r in nearness.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 98: 98, 99: 98, 100: 98}


def test_rank(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x long")
    assert all(r.x == r.rank for r in ranking.with_rank(df, "rank", [F.col("x")], 5).collect())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 300)), min_size=1, max_size=6, unique_by=lambda x: x[0]))
def test_fill_splits(sizes):
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    filled = split.fill_splits(sizes, ratios)
    assert {s: sum(g.values()) for s, g in filled} == dict(sizes)
    total, largest = sum(s * n for s, n in sizes), max(s for s, _ in sizes)
    for name, ratio in ratios.items():
        assert abs(sum(s * g[name] for s, g in filled) - total * ratio) <= largest + 1e-6


def one_by_one(sizes, ratios):
    """Each unit, largest first, to the split that lacks most, in whole hundredths."""
    total = sum(s * n for s, n in sizes)
    target = {k: total * round(r * 100) for k, r in ratios.items()}
    lacks, out = dict(target), []
    for size, n in sorted(sizes, reverse=True):
        given = dict.fromkeys(ratios, 0)
        for _ in range(n):
            best = max(ratios, key=lambda k: (lacks[k], Fraction(lacks[k], max(target[k], 1))))
            given[best] += 1
            lacks[best] -= size * 100
        out.append((size, given))
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 400), min_size=1, max_size=5), st.sampled_from([(70, 15, 15), (80, 20, 0), (34, 33, 33), (60, 25, 15)]))
def test_fill_splits_is_filling_one_by_one(sizes, shares):
    ratios = {k: s / 100 for k, s in zip(("train", "val", "test"), shares, strict=True)}
    assert split.fill_splits(list(sizes.items()), ratios) == one_by_one(sizes.items(), ratios)


def test_degenerate_splits():
    assert split.fill_splits([(50, 1)], {"train": 1.0, "val": 0.0, "test": 0.0}) == [(50, {"train": 1, "val": 0, "test": 0})]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.randoms())
def test_assignment_is_optimal(n, m, rng):
    cost = np.array([[rng.randrange(50) for _ in range(m)] for _ in range(n)], float)
    pairs = tracking.assign(cost)
    small, large = min(n, m), max(n, m)
    work = cost if n <= m else cost.T
    best = min(sum(work[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(large), small))
    assert len(pairs) == small and sum(cost[i, j] for i, j in pairs) == best


def test_identity_is_kept():
    tracker = tracking.Tracker(tracking.TrackerOptions(max_age=3, min_hits=1))
    seen = [tracker.update(np.array(b), np.array([0] * len(b)), np.array([0.8] * len(b))) for b in ([[10, 20, 40, 60]], [[13, 20, 43, 60]], [])]
    assert [[t.number for t in s] for s in seen] == [[1], [1], [1]]
    assert [t.observed for t in tracker.tracks] == [False]


def test_filter_is_the_whole_one():
    """Against the 8 x 8 form with a pseudo-inverse."""
    rng, options = np.random.default_rng(9), tracking.TrackerOptions()
    f, h, measure = np.eye(8) + np.eye(8, k=4), np.eye(4, 8), tracking._measure
    for _ in range(5):
        box = np.array([0, 0, 30, 40.0])
        own, x, p = tracking.Kalman(box, options), np.concatenate([measure(box), np.zeros(4)]), np.eye(8) * options.initial_variance
        for _ in range(30):
            own.predict()
            x = f @ x
            x[2:4] = np.maximum(x[2:4], 1)
            p = f @ p @ f.T + np.eye(8) * options.process_noise
            if rng.random() < 0.7:
                box = box + rng.normal(0, 3, 4)
                own.update(box)
                gain = p @ h.T @ np.linalg.pinv(h @ p @ h.T + np.eye(4) * options.measurement_noise)
                x, p = x + gain @ (measure(box) - h @ x), (np.eye(8) - gain @ h) @ p
                x[2:4] = np.maximum(x[2:4], 1)
            assert np.allclose(np.concatenate([own.at, own.speed]), x) and np.allclose([own.place, own.both, own.rate], [p[0, 0], p[0, 4], p[4, 4]])


def test_new_tracks_need_hits_once_missed():
    tracker = tracking.Tracker()
    assert len(tracker.update(np.array([[0, 0, 9, 9]]), np.array([0]), np.array([0.5]))) == 1
    assert tracker.update(np.empty((0, 4)), np.empty(0), np.empty(0)) == []


def test_track_scenario(spark):
    rows = [("a", f, float(10 + 2 * f), 20.0, float(40 + 2 * f), 60.0, 0, 0.8) for f in range(5)] + [("a", 5, None, None, None, None, None, None)]
    out = tracking.track(spark.createDataFrame(rows, "stream string, frame_index long, x1 double, y1 double, x2 double, y2 double, class_id int, confidence double")).orderBy("frame_index").collect()
    assert [r.track_id for r in out] == [1] * 6 and [r.observed for r in out] == [True] * 5 + [False] and len(out[-1].center_history) == 5


def test_vote_event_and_risk(spark):
    fusion, found = Fusion(length=5), []
    for f in range(4):
        found += fusion.step(f, True, 0.8, "fire", 1200.0, 0.1, 0.5, False)
    assert found == [] and fusion.open[1] == 2
    assert list(fusion.step(4, False, 0.0, "", 0.0, 0.0, 0.0, True))[0][:3] == ("fire", 2, 4)
    one = spark.range(1).select(temporal.risk_score(F.lit(0.8), F.lit(1.0), F.lit(0.5), F.lit(0.1), F.lit(0.2)).alias("r"))
    assert one.first().r == pytest.approx(0.715) and one.select(temporal.risk_level(F.col("r")).alias("l")).first().l == "HIGH"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.booleans(), st.floats(0, 1)), max_size=30))
def test_fusion_survives_restoring(rows):
    whole, parts, a, b, frame = Fusion(), Fusion(), [], [], 0
    for gap, seen, confidence in rows:
        frame += 1 + (gap == 2)
        a += whole.step(frame, seen, confidence, "fire", 100 * confidence, confidence, 0.5, False)
        b += parts.step(frame, seen, confidence, "fire", 100 * confidence, confidence, 0.5, False)
        parts = Fusion().restored(parts.state())
    assert a == b and whole.state() == parts.state()


def test_iou(spark):
    cases = [((0, 0, 2, 2), (1, 1, 3, 3), 1 / 7), ((0, 0, 1, 1), (2, 2, 3, 3), 0), ((0, 0, 1, 1), (1, 0, 2, 1), 0), ((0, 0, 4, 4), (1, 1, 2, 2), 1 / 16), ((0, 0, 0, 0), (0, 0, 0, 0), 0), ((0, 0, 1, 1), (0, 0, 1, 1), 1)]
    kind = "struct<x1:double,y1:double,x2:double,y2:double>"
    df = spark.createDataFrame([(tuple(map(float, a)), tuple(map(float, b)), float(w)) for a, b, w in cases], f"a {kind}, b {kind}, w double")
    for r in df.select(boxes.iou(F.col("a"), F.col("b")).alias("x"), boxes.iou(F.col("b"), F.col("a")).alias("y"), "w").collect():
        assert r.x == r.y == pytest.approx(r.w)


def test_class_without_rows(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "t long, p long")
    rows = {r.label: r for r in metrics.per_class(metrics.confusion(df, "t", "p", [0, 1])).collect()}
    assert rows[0].f1 == 1 and rows[1].f1 == 0 and rows[1].support == 0
    with pytest.raises(Exception, match="no rows of class"):
        metrics.class_weights(df, "t", [0, 1]).collect()


def test_pixels():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (40, 50)).astype(np.uint8)
    assert pixels.perceptual_bits(image) == pixels.perceptual_bits(image.copy()) < 1 << 64
    assert pixels.uniform_lbp(image).sum() == pytest.approx(1) and len(pixels.glcm_properties(image)) == 32
    mask = np.zeros((9, 9), bool)
    mask[1:4, 1:4] = mask[6, 6] = mask[7, 7] = True
    assert pixels.region_summary(mask)["component_count"] == 2 and pixels.regions(mask).max() == 2
    assert pixels.opened(mask)[2, 2] and not pixels.opened(mask)[6, 6] and (pixels.closed(mask) >= mask).all()
    assert pixels.blurred(np.full((8, 8), 7)).round(6).tolist() == np.full((8, 8), 7.0).tolist()
    x, y = pixels.undistorted(np.array([3.0]), np.array([4.0]), np.array([[100, 0, 60], [0, 100, 50], [0, 0, 1.0]]), np.zeros(5))
    assert (x[0], y[0]) == pytest.approx((3, 4)) and pixels.letterbox(50, 100, 96) == (0.96, 0, 24)
    with pytest.raises(ValueError, match="odd"):
        pixels.ellipse(4)


def test_sources(spark, tmp_path):
    for name in ("a/one.JPG", "a/b/two.png", "c.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    images = io.discover(spark, str(tmp_path / "in"))
    assert sorted(r.rel_stem for r in images.collect()) == ["a/b/two", "a/one"]
    assert [r.text for r in io.text_files(spark, str(tmp_path / "in")).collect()] == ["x"]
    labels = spark.createDataFrame([("a/one", "0 1")], "rel_stem string, label string")
    accepted, rejected = io.with_labels(images, labels, missing_is_negative=False)
    assert accepted.count() == 1 and rejected.first().reason == "missing_annotation" and io.with_labels(images, labels)[0].count() == 2
    both = io.union_rows([labels, spark.createDataFrame([(1,)], "k long")])
    assert both.columns == ["k", "label", "rel_stem"]
    io.write_csv(both, str(tmp_path / "csv"), ["rel_stem", "other"])
    assert sorted(r.rel_stem or "" for r in io.read_manifest(spark, str(tmp_path / "csv"), "rel_stem string, other string").collect()) == ["", "a/one"]
    io.write_split(labels.withColumn("split", F.lit("train")), str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        io.write_split(labels.withColumn("split", F.lit("train")), str(tmp_path / "out"))
    assert "| rel_stem | label |" in io.markdown_table(labels)
    rates = spark.createDataFrame([(float("nan"),), (0.0,), (None,), (30.0,)], "r double").select(io.frame_rate("r").alias("r"))
    assert [r.r for r in rates.collect()] == [25.0, 25.0, 25.0, 30.0]


def test_config():
    assert config.SourceOptions("s", "voc", {"Fire": "0"}).class_map == {"fire": 0}
    for wrong in (lambda: config.CurationOptions(classes={0: "a", 2: "b"}), lambda: config.CurationOptions(ratios={"a": 0.5}), lambda: config.SourceOptions("s", "x", {}), lambda: config.FusionOptions(levels=(0.6, 0.3, 0.8)), lambda: config.odd(4)):
        with pytest.raises(ValueError, match="."):
            wrong()


def test_smoothing_at_its_ends(spark):
    rows = spark.createDataFrame([("k", 0, 0.7, False), ("k", 1, 0.9, True), ("k", 2, 0.1, True), ("k", 3, 0.3, False), ("k", 4, 0.5, True)], "k string, f long, v double, o boolean")
    smoothed = lambda alpha: [r.smoothed for r in temporal.with_smoothed(rows, ["k"], "f", "v", "o", alpha).orderBy("f").collect()]
    assert smoothed(0.0) == [None, 0.9, 0.9, 0.9, 0.9] and smoothed(1.0) == [None, 0.9, 0.1, 0.1, 0.5]
    assert smoothed(0.01)[4] == pytest.approx(0.01 * 0.5 + 0.99 * (0.01 * 0.1 + 0.99 * 0.9))


def test_best_areas_by_four_keys(spark):
    schema = "fire_area double, smoke_area double, macro_f1 double, accuracy double"
    chosen = lambda *rows: tuple(metrics.best_areas(spark.createDataFrame(list(rows), schema)).first())[:2]
    assert chosen((0.1, 0.1, 0.5, 0.9), (0.2, 0.2, 0.6, 0.1)) == (0.2, 0.2)
    assert chosen((0.1, 0.1, 0.5, 0.9), (0.2, 0.2, 0.5, 0.8)) == (0.1, 0.1)
    assert chosen((0.1, 0.4, 0.5, 0.9), (0.25, 0.25, 0.5, 0.9), (0.2, 0.3, 0.5, 0.9), (0.1, 0.2, 0.5, 0.9)) == (0.25, 0.25)
    assert chosen((0.75, 0.25, 0.5, 0.9), (0.25, 0.75, 0.5, 0.9)) == (0.25, 0.75)


def test_calibration_needs_ten_views(spark):
    views = lambda n: spark.createDataFrame([(i, float(i)) for i in range(n)], "view long, error double")
    assert tuple(metrics.calibration(views(10)).first()) == (10, 4.5, 9.0, True) and not metrics.calibration(views(9)).first().usable


def test_motion_of_boxes_that_leave_the_frame(spark):
    """Corners are rounded half to even and clamped; a box outside has zeros."""
    pixels = spark.range(60).selectExpr("0 AS frame", "id % 10 AS x", "floor(id / 10) AS y", "double(id % 10) AS u", "-double(id % 3) AS v", "id % 2 = 0 AS foreground")
    boxes_of = lambda rows: spark.createDataFrame(rows, "frame int, box int, x1 double, y1 double, x2 double, y2 double")
    loose = boxes_of([(0, 0, -4.2, -1.0, 2.5, 3.5), (0, 1, 2.5, 1.5, 99.0, 99.0), (0, 2, 20.0, 20.0, 30.0, 30.0)])
    whole = boxes_of([(0, 0, 0.0, 0.0, 2.0, 4.0), (0, 1, 2.0, 2.0, 10.0, 6.0), (0, 2, 10.0, 6.0, 10.0, 6.0)])
    got = features.region_motion(pixels, loose, ["frame"], "box", size=(10, 6)).orderBy("box").collect()
    assert got == features.region_motion(pixels, whole, ["frame"], "box").orderBy("box").collect()
    assert got[0].mean_magnitude > 0 and got[2].score == 0


def test_selection_of_trials(spark):
    """Failed trials, missing rates and rates of 0, ties."""
    rows = [(0, 512, 0.40, 0.70, 0.66), (1, 640, 0.45, 0.68, 0.64), (3, 800, 0.45, 0.68, None), (4, 832, 0.0, None, 0.99), (5, 864, 0.45, 0.68, 0.64)]
    trials = spark.createDataFrame(rows, "trial long, size long, a double, b double, c double")
    assert metrics.best(trials, [*[metrics.missing_as(F.col(c)).desc() for c in "abc"], F.col("trial")]).first().trial == 1
    rates = spark.createDataFrame([(0.75, 0.60), (0.0, 0.0), (None, 0.5), (1.0, 1.0)], "p double, r double")
    found = [r.f for r in rates.select(metrics.f1_from(F.col("p"), F.col("r")).alias("f")).collect()]
    assert abs(found[0] - 0.9 / 1.35) < 1e-12 and found[1:] == [None, None, 1.0]


# Published confusion tables, rows true fire, smoke, normal.
KNOWN = {
    "colour": [[592, 8, 0], [600, 0, 0], [572, 28, 0]],
    "svm": [[500, 86, 14], [70, 524, 6], [16, 10, 574]],
    "rf": [[485, 90, 25], [95, 500, 5], [15, 10, 575]],
    "et": [[482, 88, 30], [107, 489, 4], [23, 10, 567]],
    "xgb": [[502, 78, 20], [91, 504, 5], [16, 8, 576]],
    "lgbm": [[508, 75, 17], [88, 507, 5], [19, 7, 574]],
}
PUBLISHED = {"colour": (0.3289, 0.1669), "svm": (0.8878, 0.8879), "rf": (0.8667, 0.8665), "et": (0.8544, 0.8545), "xgb": (0.8789, 0.8789), "lgbm": (0.8828, 0.8830)}


def test_published_confusions(spark):
    for name, matrix in KNOWN.items():
        cells = spark.createDataFrame([(t, p, n) for t, own in enumerate(matrix) for p, n in enumerate(own)], "truth long, predicted long, n long")
        found = metrics.summary(cells).first()
        assert (round(found.accuracy, 4), round(found.macro_f1, 4)) == PUBLISHED[name]


def test_fingerprints_without_a_row_for_each_word(spark, monkeypatch):
    """Votes of texts in parts of any size equal those by hand; nothing is exploded, and the join is dealt to all cores."""
    from hashlib import md5

    texts = ["a b  a\tC", " É é\x0bÉ\u00a0x ", "", None, " \n", "one", "x y z " * 50, "w\u2003v u\x1ct"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(6, "y q"), (None, "a")]
    want = {}
    for k in {r[0] for r in rows}:
        words = [w for i, t in rows if i == k for w in set(re.split("[ \t\n\x0b\f\r]+", (t or "").lower())) - {""}]
        order = [int(md5(w.encode()).hexdigest()[:15], 16) for w in words]
        want[k] = sum((sum(1 if o >> i & 1 else -1 for o in order) > 0) << i for i in range(60)) if words else None
    df = spark.createDataFrame(rows, "k int, t string").coalesce(1)
    for most, part in ((4096, 1 << 16), (3, 2)):
        monkeypatch.setattr(nearness, "TEXTS", most)
        monkeypatch.setattr(nearness, "VOTES", part)
        found = nearness.simhash(df, "k", "t")
        assert dict(map(tuple, found.collect())) == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = nearness.hamming_pairs(spark.range(500).select(F.col("id").alias("h")), "h", 1)
    assert pairs.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name, scans", [("neardup_pairs", 0), ("duplicate_audit_union", 1)])
def test_near_pairs_read_texts_once(spark, sf, name, scans):
    """Fingerprints are written before they are counted and joined, so a side of the join reads no text again."""
    from tessera.plans import curation

    plan = getattr(curation, name)(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= scans and "Generate explode" not in plan
