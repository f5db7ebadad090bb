"""Queries of motion and colour evidence, macro curves, completeness, failures, samples and names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import boxes
from tessera.operators import features, lineage, metrics, split
from tessera.plans import curation
from tessera.plans import features as pixels
from tessera.plans import metrics as scores
from tessera.session import table
from tessera.sources import io


def _coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that are no padding, with all channels; kind 1 is fire, kind 2 smoke."""
    rows = pixels.rgb(spark, sf_dir).filter(F.greatest("r", "g", "b") > 5)
    return rows.select("*", *[c.alias(n) for n, c in features.pixel_channels(F.col("r"), F.col("g"), F.col("b")).items()])


def fitted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thresholds of both rule sets, from quantiles of each class's pixels."""
    fit = features.fit_rules(_coloured(spark, sf_dir), "kind", 1, 2)
    return fit.select(*[F.round(c, 6).alias(c) for c in fit.columns])


def colour_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels under each mask by kind; the fit is one broadcast row."""
    fire, smoke = features.colour_masks()
    rows = _coloured(spark, sf_dir).crossJoin(F.broadcast(fitted_rules(spark, sf_dir))).select("kind", fire.alias("fire"), smoke.alias("smoke"))
    return rows.groupBy("kind").agg(F.sum(F.col("fire").cast("long")).alias("fire"), F.sum(F.col("smoke").cast("long")).alias("smoke"), F.count("*").alias("n"))


def _frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as pixels of ten frames (their labels), 25 wide."""
    at = lambda i: F.col("embedding")[i].cast("double") * 10
    place = [(F.col("vec_id") % 25).alias("x"), (F.floor(F.col("vec_id") / 25) % 20).alias("y")]
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("frame"), *place, at(0).alias("u"), at(1).alias("v"), (at(4) > 0).alias("foreground"), (at(2) > 0.6).alias("fire"), (at(3) > 0.6).alias("smoke"))


def region_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in three boxes of each frame, one of them outside."""
    frames = spark.range(10).select(F.col("id").alias("frame"), F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("box", "x1", "y1", "x2", "y2"), b, strict=True)]) for b in BOXES])).alias("b")).select("frame", "b.*")
    found = features.region_motion(_frame_pixels(spark, sf_dir), frames, ["frame"], "box")
    return found.select("frame", F.col("box").cast("long").alias("box"), *[F.round(c, 5).alias(c) for c in found.columns[2:]])


BOXES = [(0, 0, 0, 12, 10), (1, 5, 3, 25, 20), (2, 90, 90, 99, 99)]


def frame_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.frame_evidence(_frame_pixels(spark, sf_dir), ["frame"])
    return found.select("frame", *[F.round(c, 5).alias(c) for c in sorted(set(found.columns) - {"frame"})])


def frame_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as one pixel by type for each user, frames in time order."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.struct("ts", "event_id").alias("frame"))
    return features.frame_difference(rows, ["user_id"], "frame", "value", ["event_type"]).select("event_id", F.round("difference", 6).alias("difference"))


def macro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The macro area over all classes, and over a class that never occurs: null."""
    each = metrics.roc_auc(scores._one_vs_rest(spark, sf_dir), "is_label", "score", ["label"])
    whole = metrics.macro_auc(each, scores.CLASSES).select(F.lit("all").alias("classes"), F.round("macro_auc", 6).alias("macro_auc"))
    return whole.union(metrics.macro_auc(each, [0, 7]).select(F.lit("absent"), F.col("macro_auc")))


def macro_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.roc_points(scores._one_vs_rest(spark, sf_dir), "is_label", "score", ["label"])
    return metrics.macro_roc(points, scores.CLASSES).select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of embeddings that hold some of six classes only."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("split"), F.col("label").cast("long").alias("label"))
    found = metrics.missing_classes(rows, "split", "label", list(range(6)))
    return found.select("split", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


def top_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve wrong predictions."""
    return metrics.misclassified(scores.scored(spark, sf_dir), "truth", "predicted", [F.col("vec_id")], 12).select("vec_id", "truth", "predicted")


def written_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong predictions as read back from the written ones."""
    path = f"{lineage.folder(spark)}/predictions-{uuid.uuid4().hex}"
    io.write_predictions(scores.scored(spark, sf_dir).select("vec_id", "truth", "predicted"), path)
    return io.read_failures(spark, path, "vec_id long, truth long, predicted long")


def confidence_iou_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for each confidence and overlap threshold; the grid meets merged scores, never raw rows."""
    at = lambda i: F.round(F.abs(F.col("embedding")[i].cast("double")) * 4, 2)
    rows = table(spark, sf_dir, "embeddings").select(at(5).alias("score"), at(6).alias("overlap"), (F.col("label") % 2).cast("long").alias("truth"))
    grid = spark.createDataFrame([(c, i) for c in CONFIDENCES for i in IOUS], "confidence double, iou double")
    decide = ((F.col("score") >= F.col("confidence")) & (F.col("overlap") >= F.col("iou"))).cast("long")
    return metrics.threshold_grid(rows, ["score", "overlap"], grid, decide, "truth")


CONFIDENCES, IOUS = (0.15, 0.20, 0.25, 0.30), (0.45, 0.55)


def pixel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pixels of each order at most, then 2,000 of all, by hash order."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").select(*keys)
    order = [boxes.hash_order(*[F.col(k) for k in keys]), *[F.col(k) for k in keys]]
    return split.sample_two_stage(rows, ["l_orderkey"], 3, 2000, order)


def strict_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of parts read strictly; class 2 is left out."""
    part = table(spark, sf_dir, "part")
    share = lambda m: F.format_string("%.3f", (F.col("p_partkey") * m % 1000) / 1000.0)
    text = F.concat_ws(" ", (F.col("p_partkey") % 3).cast("string"), share(37), share(61), share(13), share(29))
    found = part.select("p_partkey", F.explode(boxes.strict_boxes(text, 160, 120)).alias("b"))
    return found.select("p_partkey", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("class_id", "x1", "y1", "x2", "y2")])


def usable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a bad line are kept if a good box is left."""
    part = table(spark, sf_dir, "part")
    good, bad = F.lit("0 0.5 0.5 0.5 0.5"), F.lit("0 0.5 x 0.5 0.5")
    text = F.when(F.col("p_partkey") % 3 == 0, good).when(F.col("p_partkey") % 3 == 1, bad).otherwise(F.concat(bad, F.lit("\n"), good))
    parsed = boxes.parse_yolo(text, {0: 0}, 160, 120)
    return part.select("p_partkey", boxes.usable(parsed).alias("kept"))


def detector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("label").isin(0, 1)).select("vec_id", F.col("label").cast("long").alias("class_id"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths, patch names and seeds from names."""
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "/data/set").otherwise("/other"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", boxes.relative_path(F.col("path"), "/data/set").alias("relative"), boxes.patch_name(F.col("doc_id"), F.col("path")).alias("patch"), boxes.name_seed(F.col("path"), 42).alias("seed"))


_CH = f"""{pixels._R}, a AS (SELECT *, greatest(r, g, b) AS value, greatest(r, g, b) - least(r, g, b) AS sp, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS luma FROM p WHERE greatest(r, g, b) > 5),
h AS (SELECT *, CASE WHEN sp = 0 THEN 0 WHEN value = r THEN 60 * (g - b) / sp WHEN value = g THEN 120 + 60 * (b - r) / sp ELSE 240 + 60 * (r - g) / sp END AS hue0 FROM a),
c AS (SELECT kind, r, g, b, value, (round_even(CASE WHEN hue0 < 0 THEN hue0 + 360 ELSE hue0 END / 2, 0) % 180)::DOUBLE AS hue, CASE WHEN value = 0 THEN 0 ELSE round_even(255::DOUBLE * sp / value, 0) END::DOUBLE AS saturation,
least(greatest(round_even((r - luma) * 0.713::DOUBLE + 128, 0), 0), 255)::DOUBLE AS cr, least(greatest(round_even((b - luma) * 0.564::DOUBLE + 128, 0), 0), 255)::DOUBLE AS cb FROM h)"""
_q = lambda expr, q, kind: f"quantile_cont(({expr})::DOUBLE, {q}::DOUBLE) FILTER (kind = {kind})"
_FIT = f"""{_CH}, t AS (SELECT
round(greatest({_q("r - g", 0.25, 1)}, 0::DOUBLE), 6) AS fire_red_minus_green_min, round(greatest({_q("g - b", 0.2, 1)}, -5::DOUBLE), 6) AS fire_green_minus_blue_min,
round(greatest({_q("saturation", 0.2, 1)}, 35::DOUBLE), 6) AS fire_saturation_min, round(greatest({_q("value", 0.15, 1)}, 70::DOUBLE), 6) AS fire_value_min,
round(greatest({_q("cr", 0.2, 1)}, 135::DOUBLE), 6) AS fire_cr_min, round(least({_q("cb", 0.8, 1)}, 145::DOUBLE), 6) AS fire_cb_max,
round(least(greatest({_q("hue", 0.75, 1)}, 15::DOUBLE), 60::DOUBLE), 6) AS fire_hue_max,
round(least(greatest({_q("saturation", 0.8, 2)}, 35::DOUBLE), 125::DOUBLE), 6) AS smoke_saturation_max, round(greatest({_q("value", 0.08, 2)}, 35::DOUBLE), 6) AS smoke_value_min,
round(least({_q("value", 0.98, 2)}, 255::DOUBLE), 6) AS smoke_value_max, round(least(greatest({_q("abs(cr - 128)", 0.85, 2)}, 12::DOUBLE), 55::DOUBLE), 6) AS smoke_cr_deviation_max,
round(least(greatest({_q("abs(cb - 128)", 0.85, 2)}, 12::DOUBLE), 55::DOUBLE), 6) AS smoke_cb_deviation_max,
round(least(greatest({_q("abs(r - g)", 0.85, 2)}, 12::DOUBLE), 65::DOUBLE), 6) AS smoke_red_green_difference_max,
round(least(greatest({_q("abs(g - b)", 0.85, 2)}, 12::DOUBLE), 65::DOUBLE), 6) AS smoke_green_blue_difference_max FROM c)"""
_PX = "x AS (SELECT label::BIGINT AS frame, vec_id % 25 AS x, (vec_id // 25) % 20 AS y, embedding[1]::DOUBLE * 10 AS u, embedding[2]::DOUBLE * 10 AS v, embedding[5]::DOUBLE * 10 > 0 AS foreground, embedding[3]::DOUBLE * 10 > 0.6::DOUBLE AS fire, embedding[4]::DOUBLE * 10 > 0.6::DOUBLE AS smoke FROM embeddings), m AS (SELECT *, sqrt(u * u + v * v) AS m FROM x)"
_POINTS = f"{scores._O}, k AS (SELECT label, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM o GROUP BY 1, 2), r AS (SELECT label, sum(q) OVER d / (sum(q) OVER (PARTITION BY label))::DOUBLE AS fpr, sum(p) OVER d / (sum(p) OVER (PARTITION BY label))::DOUBLE AS tpr FROM k WINDOW d AS (PARTITION BY label ORDER BY score DESC) UNION ALL SELECT unnest([0, 1, 2])::BIGINT, 0, 0)"
_PATH = "CASE WHEN doc_id % 2 = 0 THEN '/data/set' ELSE '/other' END || '/' || source || '/' || doc_id"
_share = lambda m: f"round((p_partkey * {m} % 1000) / 1000.0::DOUBLE, 3)"
_edge = lambda m, size, sign, most: f"round_even(({_share(m)} {sign} {_share(size)} / 2) * {most}, 0)"
_low = lambda m, size, most: f"least(greatest({_edge(m, size, '-', most)}, 0), {most - 1})"
_high = lambda m, size, most: f"greatest(least({_edge(m, size, '+', most)}, {most}), {_low(m, size, most)} + 1)"

QUERIES = {
    f.__name__: f
    for f in (
        fitted_rules, colour_masks, region_motion, frame_evidence, frame_difference, macro_auc, macro_roc, completeness, top_failures, written_failures, confidence_iou_grid,
        pixel_sample, strict_boxes, usable_files, detector_classes, file_names,
    )
}
ORACLES = {
    "fitted_rules": f"WITH {_FIT} SELECT * FROM t",
    "colour_masks": f"""WITH {_FIT}, v AS (SELECT kind, (r - g >= fire_red_minus_green_min)::INT + (g - b >= fire_green_minus_blue_min)::INT + (saturation >= fire_saturation_min)::INT + (value >= fire_value_min)::INT + (cr >= fire_cr_min)::INT + (cb <= fire_cb_max)::INT + (hue <= fire_hue_max OR hue >= 170)::INT >= 4 AS fire,
(saturation <= smoke_saturation_max)::INT + (value >= smoke_value_min)::INT + (value <= smoke_value_max)::INT + (abs(cr - 128) <= smoke_cr_deviation_max)::INT + (abs(cb - 128) <= smoke_cb_deviation_max)::INT + (abs(r - g) <= smoke_red_green_difference_max)::INT + (abs(g - b) <= smoke_green_blue_difference_max)::INT >= 5 AS smoke FROM c, t)
SELECT kind, count(*) FILTER (fire) AS fire, count(*) FILTER (smoke AND NOT fire) AS smoke, count(*) AS n FROM v GROUP BY kind""",
    "region_motion": f"""WITH {_PX}, b AS (SELECT * FROM range(10) f(frame), (VALUES {", ".join(map(str, BOXES))}) t(box, x1, y1, x2, y2)),
j AS (SELECT b.frame, b.box, coalesce(avg(m), 0) AS mean_magnitude, coalesce(avg((m >= 1)::INT), 0) AS moving_ratio, coalesce(avg((v < 0)::INT) FILTER (m >= 1), 0) AS upward_ratio, coalesce(avg(foreground::INT), 0) AS foreground_ratio, coalesce(avg(u) FILTER (m >= 1), 0) AS dx, coalesce(avg(v) FILTER (m >= 1), 0) AS dy FROM b LEFT JOIN m ON m.frame = b.frame AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY 1, 2)
SELECT frame, box::BIGINT AS box, {", ".join(f"round({c}, 5) AS {c}" for c in ("mean_magnitude", "moving_ratio", "upward_ratio", "foreground_ratio", "dx", "dy"))}, round(least(greatest(0.35::DOUBLE * least(1, mean_magnitude / 5::DOUBLE) + 0.35::DOUBLE * moving_ratio + 0.15::DOUBLE * upward_ratio + 0.15::DOUBLE * foreground_ratio, 0), 1), 5) AS score FROM j""",
    "frame_evidence": f"""WITH {_PX} SELECT frame, round(avg(fire::INT), 5) AS fire_area_ratio, round(avg(smoke::INT), 5) AS smoke_area_ratio, round(count(*) FILTER (foreground AND (fire OR smoke)) / greatest(1, count(*) FILTER (fire OR smoke))::DOUBLE, 5) AS foreground_ratio,
round(coalesce(avg(m) FILTER (fire OR smoke), 0), 5) AS mean_flow, round(coalesce(avg((m >= 1)::INT) FILTER (fire OR smoke), 0), 5) AS moving_ratio, round(coalesce(avg((v < 0)::INT) FILTER ((fire OR smoke) AND m >= 1), 0), 5) AS upward_ratio FROM m GROUP BY frame""",
    "frame_difference": "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), 6) AS difference FROM events",
    "macro_auc": f"WITH x AS ({scores._AUC.replace(', 6) AS auc', ', 15) AS auc')}) SELECT 'all' AS classes, round(avg(auc), 6) AS macro_auc FROM x UNION ALL SELECT 'absent', NULL",
    "macro_roc": f"""WITH {_POINTS}, h AS (SELECT label, fpr, max(tpr) AS tpr, min(tpr) AS low FROM r GROUP BY 1, 2), z AS (SELECT label, fpr AS x0, tpr AS y0, lead(fpr) OVER w AS x1, lead(low) OVER w AS y1 FROM h WINDOW w AS (PARTITION BY label ORDER BY fpr)), g AS (SELECT DISTINCT fpr FROM h)
SELECT round(fpr, 9) AS fpr, round(sum(CASE WHEN fpr = x0 OR x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (fpr - x0) / (x1 - x0) END) / 3, 6) AS tpr FROM g JOIN z ON fpr >= x0 AND (x1 IS NULL OR fpr < x1) GROUP BY fpr""",
    "completeness": "WITH c AS (SELECT DISTINCT vec_id % 40 AS split, label FROM embeddings), s AS (SELECT DISTINCT split FROM c), m AS (SELECT split, l FROM s, range(6) t(l) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.split = s.split AND c.label = l)) SELECT split, string_agg(l::VARCHAR, ',' ORDER BY l) AS missing FROM m GROUP BY split HAVING count(*) < 6",
    "top_failures": f"WITH {scores._S} SELECT vec_id, truth, predicted FROM s WHERE truth <> predicted ORDER BY vec_id LIMIT 12",
    "written_failures": f"WITH {scores._S} SELECT vec_id, truth, predicted FROM s WHERE truth <> predicted",
    "confidence_iou_grid": f"WITH s AS (SELECT round(abs(embedding[6]::DOUBLE) * 4, 2) AS score, round(abs(embedding[7]::DOUBLE) * 4, 2) AS overlap, (label % 2)::BIGINT AS truth FROM embeddings) SELECT confidence, iou, truth, (score >= confidence AND overlap >= iou)::BIGINT AS predicted, count(*) AS n FROM s, (SELECT unnest({list(CONFIDENCES)}::DOUBLE[]) AS confidence), (SELECT unnest({list(IOUS)}::DOUBLE[]) AS iou) GROUP BY 1, 2, 3, 4",
    "pixel_sample": f"WITH k AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {curation.K.format('concat_ws(chr(124), l_orderkey, l_partkey, l_suppkey, l_linenumber)')} AS k FROM lineitem), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k, l_partkey, l_suppkey, l_linenumber) <= 3) SELECT * EXCLUDE (k) FROM f ORDER BY k, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 2000",
    "strict_boxes": f"SELECT p_partkey, p_partkey % 3 AS class_id, {_low(37, 13, 160)}::BIGINT AS x1, {_low(61, 29, 120)}::BIGINT AS y1, {_high(37, 13, 160)}::BIGINT AS x2, {_high(61, 29, 120)}::BIGINT AS y2 FROM part WHERE p_partkey % 3 < 2",
    "usable_files": "SELECT p_partkey, p_partkey % 3 <> 1 AS kept FROM part",
    "detector_classes": "SELECT vec_id, label::BIGINT AS class_id FROM embeddings WHERE label IN (0, 1)",
    "file_names": f"WITH n AS (SELECT doc_id, {_PATH} AS path FROM documents), h AS (SELECT *, xor(('0x' || substr(sha256(path), 1, 16))::UBIGINT, 42::UBIGINT)::HUGEINT AS s FROM n) SELECT doc_id, CASE WHEN starts_with(path, '/data/set/') THEN substr(path, 11) ELSE path END AS relative, printf('%05d_', doc_id) || substr(sha1(path), 1, 12) || '.jpg' AS patch, (CASE WHEN s >= 9223372036854775808::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE s END)::BIGINT AS seed FROM h",
}
