"""Inspection and manifest of parts as labelled images: brands are sources, regions are sources without images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import boxes
from tessera.operators import dedup, inspection
from tessera.plans import annotations
from tessera.plans.annotations import HEIGHT, WIDTH
from tessera.session import table


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of some sizes can't be read, are too small or have no label; brands with an even number take that for a negative."""
    part = table(spark, sf_dir, "part")
    even = (F.substring("source", -1, 1).cast("int") % 2 == 0).alias("missing_label_is_negative")
    place = F.concat(F.lit("images/"), F.col("source")).alias("images_dir")
    brands = part.select(F.col("p_brand").alias("source")).distinct().select("source", place, F.lit(True).alias("present"), F.lit("yolo").alias("format"), even)
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("source"), (F.col("r_regionkey") % 2 == 1).alias("present")).select("source", place, "present", F.lit("yolo").alias("format"), F.lit(True).alias("missing_label_is_negative"))
    stem = F.col("p_partkey").cast("string")
    width = F.when(F.col("p_size") % 11 == 0, None).when(F.col("p_size") % 13 == 0, 20).otherwise(WIDTH)
    images = part.select(
        F.col("p_brand").alias("source"), F.concat(F.lit("images/"), F.col("p_brand"), F.lit("/"), stem, F.lit(".jpg")).alias("image"), stem.alias("stem"), width.alias("width"), F.lit(HEIGHT).alias("height"),
        dedup.content_digest("p_name").alias("sha256"), boxes.hash_order(F.col("p_name")).alias("phash"),
    )
    labelled = annotations.label_texts(spark, sf_dir).join(part.filter("p_size % 7 <> 0").select("p_partkey", "p_brand"), "p_partkey")
    labels = labelled.select(F.col("p_brand").alias("source"), stem.alias("stem"), F.concat(F.lit("labels/"), stem, F.lit(".txt")).alias("label"), "text")
    return inspection.inspect(brands.union(regions), images, labels, {0: 0, 1: 1}, {"fire": 0, "smoke": 1})


def inspection_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.rejected(inspected(spark, sf_dir))


def inspection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept images without exact copies (the one with most boxes stays, then the first by path), dealt to splits by content."""
    kept = dedup.keep_first_copies(inspected(spark, sf_dir).filter("reason IS NULL"), "sha256", [F.size("boxes").desc(), F.col("image")])
    at = boxes.hash_order(F.col("sha256")) % 100
    return inspection.manifest(kept.withColumn("split", F.when(at < 70, "train").when(at < 85, "val").otherwise("test")))


_I = f"""x AS ({annotations._parse_oracle(True)}), y AS ({annotations._lines(True)} SELECT p_partkey, count(*) FILTER (fine AND (no = 2 OR p_partkey % 3 = 0)) AS fire, count(*) FILTER (fine AND no = 1 AND p_partkey % 3 = 1) AS smoke FROM r GROUP BY 1),
i AS (SELECT p_brand AS source, 'images/' || p_brand || '/' || p_partkey || '.jpg' AS image, p_size % 7 <> 0 AS labelled, p.*, x.* EXCLUDE (p_partkey), y.* EXCLUDE (p_partkey), right(p_brand, 1)::INT % 2 = 0 AS negative FROM part p JOIN x USING (p_partkey) JOIN y USING (p_partkey)),
z AS (SELECT *, CASE WHEN p_size % 11 = 0 THEN 'corrupt_or_unreadable_image' WHEN p_size % 13 = 0 THEN 'image_too_small:20x{HEIGHT}' WHEN NOT labelled AND NOT negative THEN 'missing_annotation' WHEN labelled AND NOT valid AND boxes = 0 THEN 'annotation_invalid_no_usable_boxes' END AS reason FROM i)"""
_AT = "('0x' || substr(md5(sha256(p_name)), 1, 15))::BIGINT % 100"

QUERIES = {f.__name__: f for f in (inspection_rejects, inspection_manifest)}
ORACLES = {
    "inspection_rejects": f"""WITH {_I} SELECT source, image, reason, CASE WHEN starts_with(reason, 'annotation') THEN warnings ELSE '' END AS warnings FROM z WHERE reason IS NOT NULL
UNION ALL SELECT r_name, 'images/' || r_name, CASE WHEN r_regionkey % 2 = 1 THEN 'source_contains_no_supported_images' ELSE 'source_images_directory_missing' END, '' FROM region""",
    "inspection_manifest": f"""WITH {_I}, l AS (SELECT *, CASE WHEN labelled THEN boxes ELSE 0 END AS n, CASE WHEN labelled THEN fire ELSE 0 END AS f, CASE WHEN labelled THEN smoke ELSE 0 END AS s FROM z WHERE reason IS NULL)
SELECT source, image AS source_image, CASE WHEN labelled THEN 'labels/' || p_partkey || '.txt' ELSE '' END AS source_label, CASE WHEN {_AT} < 70 THEN 'train' WHEN {_AT} < 85 THEN 'val' ELSE 'test' END AS split, '' AS output_image, '' AS output_label,
{WIDTH}::INT AS width, {HEIGHT}::INT AS height, n AS boxes, f AS fire_boxes, s AS smoke_boxes, CASE WHEN f > 0 AND s > 0 THEN 'fire_and_smoke' WHEN f > 0 THEN 'fire_only' WHEN s > 0 THEN 'smoke_only' ELSE 'negative' END AS class_signature,
sha256(p_name) AS sha256, printf('%016x', ('0x' || substr(md5(p_name), 1, 15))::BIGINT) AS phash_hex, '' AS duplicate_group, CASE WHEN labelled THEN warnings ELSE '' END AS warnings
FROM l QUALIFY row_number() OVER (PARTITION BY sha256(p_name) ORDER BY n DESC, image) = 1""",
}
