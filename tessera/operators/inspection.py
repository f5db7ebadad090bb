"""Inspection of labelled sources: every source and image is kept or gets the first reason that rejects it; manifest rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import boxes

# Reasons as reports name them, in the order in which they are looked for.
SOURCE_MISSING = "source_images_directory_missing"
SOURCE_EMPTY = "source_contains_no_supported_images"
UNREADABLE = "corrupt_or_unreadable_image"
TOO_SMALL = "image_too_small:"
NO_LABEL = "missing_annotation"
NO_BOXES = "annotation_invalid_no_usable_boxes"


def inspect(
    sources: DataFrame, images: DataFrame, labels: DataFrame, classes: Mapping[int, int], names: Mapping[str, int], least_width: int = 32, least_height: int = 32, repair: bool = True, drop_unknown: bool = True, least_pixels: int = 4
) -> DataFrame:
    """(source, image, reason, label, width, height, boxes, warnings, sha256, phash): a row for each rejected source and each image.

    sources: (source, images_dir, present, format: yolo or voc, missing_label_is_negative), a short configured list; images:
    (source, image, stem, width, height, sha256, phash), width or height null if it can't be read; labels: (source, stem,
    label, text). reason is null for kept rows; boxes, warnings and label are there as far as the inspection came. A null
    text of a label that exists is an empty one. Images of sources that are missing or not listed are left out. No source
    present is an error. `classes` holds for yolo labels, `names` for voc; sources with other maps take a call of their own.
    """
    held = F.broadcast(sources.select("source", "images_dir", "present", "format", "missing_label_is_negative"))
    if sources.filter("present").isEmpty():
        raise ValueError("no configured source is present: " + ", ".join(sorted(str(r.images_dir) for r in sources.select("images_dir").collect())))
    filled = images.select("source").distinct()
    empty = sources.filter("present").join(filled, "source", "left_anti").select("source", F.col("images_dir").alias("image"), F.lit(SOURCE_EMPTY).alias("reason"))
    missing = sources.filter(~F.coalesce("present", F.lit(False))).select("source", F.col("images_dir").alias("image"), F.lit(SOURCE_MISSING).alias("reason"))
    found = labels.select("source", "stem", "label", "text", F.lit(True).alias("_has"))
    joined = images.join(held.filter("present"), "source").join(found, ["source", "stem"], "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    early = (
        F.when(F.col("width").isNull() | F.col("height").isNull(), UNREADABLE)
        .when((F.col("width") < least_width) | (F.col("height") < least_height), F.concat(F.lit(TOO_SMALL), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")))
        .when(~F.col("_has") & ~F.coalesce("missing_label_is_negative", F.lit(False)), NO_LABEL)
    )
    voc = F.col("format") == "voc"
    read = (classes, F.col("width"), F.col("height"), repair, drop_unknown, least_pixels)
    text = F.when(F.col("_has"), F.coalesce("text", F.lit("")))
    parsed = joined.withColumn("_early", early).withColumn("_r", F.when(F.col("_early").isNull() & voc, boxes.parse_voc(F.when(voc, text), names, *read[1:])).when(F.col("_early").isNull(), boxes.parse_yolo(text, *read)))
    late = F.when(F.col("_r").isNotNull() & ~boxes.usable(F.col("_r")), NO_BOXES)
    done = parsed.select("source", "image", F.coalesce("_early", late).alias("reason"), "label", "width", "height", F.col("_r.boxes").alias("boxes"), F.col("_r.warnings").alias("warnings"), "sha256", "phash")
    return done.unionByName(missing.union(empty), allowMissingColumns=True)


def rejected(inspected: DataFrame) -> DataFrame:
    """(source, image, reason, warnings) as reported; warnings only where no box could be used."""
    warnings = F.when(F.col("reason") == NO_BOXES, F.array_join("warnings", " | ")).otherwise("")
    return inspected.filter("reason IS NOT NULL").select("source", "image", "reason", warnings.alias("warnings"))


def manifest(kept: DataFrame) -> DataFrame:
    """The rows of the manifest: 16 columns, texts empty where there is nothing yet.

    kept: rows of `inspect` without a reason; split, output_image, output_label and duplicate_group are taken where they exist.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in kept.columns else F.lit("").alias(c)
    of_class = lambda c: F.size(F.filter("boxes", lambda b: b.class_id == c)).cast("long")
    return kept.select(
        "source", F.col("image").alias("source_image"), F.coalesce("label", F.lit("")).alias("source_label"), text("split"), text("output_image"), text("output_label"), "width", "height",
        F.size("boxes").cast("long").alias("boxes"), of_class(0).alias("fire_boxes"), of_class(1).alias("smoke_boxes"), boxes.class_signature(F.transform("boxes", lambda b: b.class_id)).alias("class_signature"),
        "sha256", F.coalesce(F.lpad(F.lower(F.hex("phash")), 16, "0"), F.lit("")).alias("phash_hex"), text("duplicate_group"), F.array_join("warnings", " | ").alias("warnings"),
    )
