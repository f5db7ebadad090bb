"""The cascade of rejections and the manifest, case by case."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import inspection

SOURCES = "source string, images_dir string, present boolean, format string, missing_label_is_negative boolean"
IMAGES = "source string, image string, stem string, width int, height int, sha256 string, phash long"
LABELS = "source string, stem string, label string, text string"


def test_each_reason_comes_first_where_it_should(spark):
    sources = spark.createDataFrame([("a", "a/images", True, "yolo", False), ("b", "b/images", True, "voc", True), ("gone", "gone/images", False, "yolo", True), ("bare", "bare/images", True, "yolo", True)], SOURCES)
    xml = "<annotation><object><name>Fire</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>60</xmax><ymax>50</ymax></bndbox></object></annotation>"
    cases = {  # (source, stem): width, height, text (None: no label), reason, boxes
        ("a", "good"): (100, 80, "0 0.5 0.5 0.2 0.2\n1 0.4 0.4 0.1 0.1", None, 2),
        ("a", "torn"): (None, None, None, "corrupt_or_unreadable_image", None),
        ("a", "tiny"): (31, 80, None, "image_too_small:31x80", None),
        ("a", "bare"): (100, 80, None, "missing_annotation", None),
        ("a", "bad"): (100, 80, "0 0.5 x 0.2 0.2", "annotation_invalid_no_usable_boxes", 0),
        ("a", "half"): (100, 80, "0 0.5 x 0.2 0.2\n1 0.5 0.5 0.2 0.2", None, 1),
        ("a", "void"): (100, 80, "", None, 0),
        ("b", "good"): (100, 80, xml, None, 1),
        ("b", "bare"): (100, 80, None, None, 0),
        ("b", "bad"): (100, 80, "<annotation><object>", "annotation_invalid_no_usable_boxes", 0),
    }
    images = [(s, f"{s}/{n}.jpg", n, w, h, f"hash{s}{n}", -1 if n == "good" else None) for (s, n), (w, h, *_) in cases.items()] + [("gone", "gone/x.jpg", "x", 90, 90, "h", 1), ("unlisted", "u/x.jpg", "x", 90, 90, "h", 1)]
    labels = [(s, n, f"{s}/{n}.txt", t) for (s, n), (_, _, t, *_) in cases.items() if t is not None]
    args = spark.createDataFrame(images, IMAGES), spark.createDataFrame(labels, LABELS)
    found = inspection.inspect(sources, *args, {0: 0, 1: 1}, {"fire": 0, "smoke": 1}).cache()
    got = {r.image: (r.reason, None if r.boxes is None else len(r.boxes)) for r in found.collect()}
    want = {f"{s}/{n}.jpg": (reason, count) for (s, n), (_, _, _, reason, count) in cases.items()}
    assert got == want | {"gone/images": ("source_images_directory_missing", None), "bare/images": ("source_contains_no_supported_images", None)}
    reported = {r.image: r.warnings for r in inspection.rejected(found).collect()}
    assert len(reported) == 7 and reported["a/bad.jpg"].startswith("line_1:") and reported["a/tiny.jpg"] == ""
    rows = {r.source_image: r for r in inspection.manifest(found.filter("reason IS NULL").withColumn("split", F.lit("val"))).collect()}
    one = rows["a/good.jpg"]
    assert len(one) == 16 and (one.boxes, one.fire_boxes, one.smoke_boxes, one.class_signature, one.phash_hex, one.split) == (2, 1, 1, "fire_and_smoke", "f" * 16, "val")
    assert (rows["b/bare.jpg"].source_label, rows["b/bare.jpg"].class_signature, rows["b/bare.jpg"].phash_hex, rows["b/bare.jpg"].duplicate_group) == ("", "negative", "", "")
    assert rows["a/half.jpg"].warnings.startswith("line_1:") and set(rows) == {i for i, (reason, _) in want.items() if reason is None}
    with pytest.raises(ValueError, match="gone/images"):
        inspection.inspect(sources.filter("source = 'gone'"), *args, {0: 0}, {"fire": 0})
    alone = inspection.inspect(sources.filter("source = 'bare'"), args[0].filter(F.lit(False)), args[1].filter(F.lit(False)), {0: 0}, {"fire": 0}).collect()
    assert [r.reason for r in alone] == ["source_contains_no_supported_images"]
