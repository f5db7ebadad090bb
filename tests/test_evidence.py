"""Sources, sinks, strict reads, checks and model files, and joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import boxes
from tessera.operators import features, metrics, models, nearness
from tessera.sources import config, io


def test_strict_boxes_raise(spark):
    read = lambda text: spark.createDataFrame([(text,)], "t string").select(boxes.strict_boxes(F.col("t"), 160, 120).alias("b")).first().b
    assert [tuple(b) for b in read("\n 0 0.5 0.5 0.5 0.5\r\n1 0 0 0 0\n7 a b c d\n")] == [(0, 40, 30, 120, 90), (1, 0, 0, 1, 1)]
    assert read(None) == read("") == []
    for wrong in ("0 0.5 0.5 0.5", "0 0.5 0.5 0.5 0.5 1", "x 0.5 0.5 0.5 0.5", "0.9 0.5 0.5 0.5 0.5", "0 0.5 y 0.5 0.5"):
        with pytest.raises(Exception, match="invalid label line"):
            read(wrong)


def test_class_folders(spark, tmp_path):
    for name in ("train/fire/a/x.JPG", "train/smoke/y.png", "train/other/z.png", "train/fire/n.txt", "val/fire/x.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = io.class_folders(spark, str(tmp_path), "train", ["fire", "smoke"]).collect()
    assert sorted((r.class_id, r.class_name, r.path.rsplit("/", 1)[1]) for r in rows) == [(0, "fire", "x.JPG"), (1, "smoke", "y.png")]
    with pytest.raises(ValueError, match="smoke"):
        io.class_folders(spark, str(tmp_path), "val", ["fire", "smoke"])


def test_files(spark, tmp_path):
    assert io.thresholds(spark, None) == io.thresholds(spark, str(tmp_path / "none.json")) == (640, 0.25, 0.45)
    (tmp_path / "t.json").write_text('{"selected_image_size": 512,\n "selected_confidence": 0.3, "selected_iou": null}')
    assert io.thresholds(spark, str(tmp_path / "t.json")) == (512, 0.3, 0.45)
    rows = spark.createDataFrame([("a", 1, [0.5]), ("b", 0, [0.25])], "path string, label long, features array<float>")
    io.write_features(rows, str(tmp_path / "f"), {"kind": "x"})
    found, about = io.read_features(spark, str(tmp_path / "f"))
    assert sorted(found.collect()) == sorted(rows.collect()) and about == {"kind": "x", "rows": 2, "columns": ["path", "label", "features"]}
    with pytest.raises(Exception, match="exist"):
        io.write_features(rows, str(tmp_path / "f"), {})


def test_configuration():
    options, sources = config.curation_options(config.read_yaml("seed: 7\nclasses: {0: fire, 1: smoke}\nsources: [{name: a, format: voc, class_map: {Fire: 0}}]"))
    assert options.seed == 7 and sources[0].class_map == {"fire": 0}
    assert config.draw_seed(42, 1, "val") == 42 + 1009 + 2
    for wrong in (lambda: config.read_yaml("- 1"), lambda: config.FusionOptions(weights={"a": 0.5}), lambda: config.DetectorOptions(image_sizes=(500,)), lambda: config.PatchOptions(crop_fraction=(0.5, 0.4)), lambda: config.FusionOptions(fallback_rate=0)):
        with pytest.raises(ValueError):
            wrong()


def test_incomplete_splits_raise(spark):
    rows = spark.createDataFrame([("train", 0), ("train", 1), ("val", 1), ("test", None)], "split string, label long")
    with pytest.raises(ValueError, match="split val has no rows of classes: 0"):
        metrics.checked_classes(rows, "split", "label", [0, 1])
    assert metrics.checked_classes(rows.filter("split = 'train'"), "split", "label", [0, 1]).count() == 2


def test_flow_without_motion(spark):
    rows = spark.createDataFrame([("a", 0.1, 0.1, True), ("a", 3.0, -4.0, False), ("b", 0.0, -2.0, True), ("b", 0.0, 2.0, False)], "k string, u double, v double, m boolean")
    found = {r.k: tuple(r)[1:] for r in features.flow_statistics(rows, "u", "v", ["k"], 1.0, F.col("m")).collect()}
    assert found["a"] == pytest.approx((0.02**0.5, 0, 0, 0, 0)) and found["b"] == pytest.approx((2, 0, 1, 270, 1))
    nothing = features.flow_statistics(rows, "u", "v", ["k"], 1.0, F.lit(False)).collect()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0) for r in nothing)


@pytest.mark.parametrize("blocks", [None, 3, 5, 6])
def test_hamming_pairs_match_brute_force(spark, blocks):
    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(12)]
    hashes = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))) for b in bases for _ in range(8)}
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    want = {(a, b, (a ^ b & ((1 << 64) - 1) if a >= 0 and b >= 0 else (a ^ b) & ((1 << 64) - 1)).bit_count()) for a in signed for b in signed if a < b}
    rows = nearness.hamming_pairs(spark.createDataFrame([(h,) for h in signed * 2], "f long"), "f", 2, 64, blocks).collect()
    assert sorted(map(tuple, rows)) == sorted(x for x in want if x[2] <= 2)


def test_model_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 3), i % 7 / 7], i % 3) for i in range(90)], "i long, x array<double>, label long")
    kernel = models.kernel_features(rows, "x", 2, 16)
    assert len(kernel.first().x) == 16 and kernel.count() == 90
    ready = models.prepared(rows, "x", "label", [0, 1, 2])
    trials, model = models.grid_search(ready, ready, models.random_forest, {"trees": [3], "depth": [3]}, [0, 1, 2])
    models.save(model, str(tmp_path / "m"))
    shown = models.probabilities(models.load(str(tmp_path / "m")), ready, 3)
    assert trials.first().macro_f1 == 1 and all(abs(sum(r.probabilities) - 1) < 1e-9 and len(r.probabilities) == 3 for r in shown.collect())
