"""Feature queries: quantile-fitted rules, colour channels, histograms, moments, flow, vision kernels, tracking, models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import patches, pixels
from tessera.operators import boosting, extra_trees, features, kernel, metrics, models, tracking
from tessera.operators.lineage import cut
from tessera.session import table

RGB = {"r": "(l_partkey * 7 + l_linenumber * 31) % 256", "g": "(l_suppkey * 13 + l_linenumber * 5) % 256", "b": "(l_orderkey * 3) % 256"}


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *[F.expr(e).cast("double").alias(c) for c, e in RGB.items()], (F.col("l_partkey") % 3).alias("kind"))


def pixel_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = features.pixel_channels(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in channels.items()])


def quantile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear quantiles of pixels that are no padding, held in each rule's range."""
    rows = rgb(spark, sf_dir).filter(F.greatest("r", "g", "b") > 5)
    fit = features.quantiles(rows, {"rg": (F.col("r") - F.col("g"), 0.25), "gb": (F.col("g") - F.col("b"), 0.20), "value": (F.greatest("r", "g", "b"), 0.15)})
    return fit.select(F.round(F.greatest(F.col("rg"), F.lit(0.0)), 6).alias("rg"), F.round(F.greatest(F.col("gb"), F.lit(-5.0)), 6).alias("gb"), F.round(F.greatest(F.col("value"), F.lit(70.0)), 6).alias("value"))


def vote_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels by kind for which at least two of three fitted rules hold; the fit is one broadcast row."""
    fit = F.broadcast(quantile_thresholds(spark, sf_dir))
    votes = features.votes([F.col("r") - F.col("g") >= F.col("rg"), F.col("g") - F.col("b") >= F.col("gb"), F.greatest("r", "g", "b") >= F.col("value")])
    return rgb(spark, sf_dir).crossJoin(fit).groupBy("kind").agg(F.sum((votes >= 2).cast("long")).alias("hits"), F.count("*").alias("n"))


def patch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as patches: shares of red and of grey pixels against area thresholds."""
    share = rgb(spark, sf_dir).groupBy("l_orderkey").agg(F.avg((F.col("r") > 128).cast("int")).alias("fire"), F.avg((F.abs(F.col("r") - F.col("g")) < 64).cast("int")).alias("smoke"))
    return share.select("l_orderkey", features.patch_decision(F.col("fire"), F.col("smoke"), F.lit(0.5), F.lit(0.5)).alias("decision"))


FIRES, SMOKES = (0.25, 0.5, 0.75), (0.3, 0.5, 0.8)


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patches, each of a class that its order's key tells, under all pairs of area thresholds."""
    share = rgb(spark, sf_dir).groupBy("l_orderkey").agg(F.avg((F.col("r") > 128).cast("int")).alias("fire"), F.avg((F.abs(F.col("r") - F.col("g")) < 64).cast("int")).alias("smoke"))
    kind = F.element_at(F.array(F.lit("fire"), F.lit("smoke"), F.lit("normal")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return metrics.area_grid(share.withColumn("truth", kind), "truth", "fire", "smoke", FIRES, SMOKES)


def area_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir)


def best_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_areas(_areas(spark, sf_dir)).select("fire_area", "smoke_area", "macro_f1", "accuracy")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are labels of embeddings; ten of them make a calibration usable."""
    found = metrics.calibration(reprojection_error(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_error", "largest_error")})


def histogram_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.histogram(rgb(spark, sf_dir), "r", 16, 0.0, 256.0, ["kind"]).select("kind", F.col("bin").cast("long").alias("bin"), F.round("share", 6).alias("share"))


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [f(F.col(c) / 255).alias(f"{n}_{c}") for c in RGB for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    stats = rgb(spark, sf_dir).groupBy("kind").agg(*out)
    return stats.select("kind", *[F.round(c, 6).alias(c) for c in stats.columns if c != "kind"])


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return features.standardised(rows, ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("z"))


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double") * 10
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), at(0).alias("u"), at(1).alias("v"), at(2).alias("x"), at(3).alias("y"))


def circular_flow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = features.flow_statistics(_flow(spark, sf_dir), "u", "v", ["label"])
    return stats.select("label", *[F.round(c, 5).alias(c) for c in stats.columns if c != "label"])


def mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.mask_overlap(_flow(spark, sf_dir), F.col("u") > 0, F.col("v") > 0, ["label"]).select("label", F.round("overlap", 6).alias("overlap"))


def reprojection_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.reprojection_error(_flow(spark, sf_dir), "label", F.col("u") - F.col("x"), F.col("v") - F.col("y")).select("label", F.round("error", 6).alias("error"))


# Images drawn from part keys, 24 x 32.

_H, _W = 24, 32


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys take little room on disk, so a few splits of a file hold all of them; they are dealt to all cores before images are drawn."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[:_H, :_W]
        for rows in batches:
            made: list = []
            for keys in np.array_split(rows["p_partkey"].to_numpy(), len(rows) // 128 + 1):
                k = keys[:, None, None]
                made += [i.tobytes() for i in ((x * (k % 7 + 1) + y * (k % 5 + 1) + (x * y) % (k % 11 + 2) * 9) % 256).astype(np.uint8)]
            yield pd.DataFrame({"p_partkey": rows["p_partkey"], "data": made, "height": _H, "width": _W})

    keys = table(spark, sf_dir, "part").select("p_partkey").repartition(3 * spark.sparkContext.defaultParallelism, "p_partkey")
    return keys.mapInPandas(draw, "p_partkey long, data binary, height int, width int")


def phash_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("p_partkey", pixels.perceptual_hash("data", "height", "width").alias("phash"))


def lbp_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("p_partkey", pixels.lbp_histogram("data", "height", "width").alias("lbp"))


def texture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("p_partkey", pixels.texture_features("data", "height", "width").alias("features"))


def morph_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = images(spark, sf_dir).withColumn("data", pixels.opened_mask("data", "height", "width"))
    return opened.select("p_partkey", pixels.region_statistics("data", "height", "width").alias("r")).select("p_partkey", "r.*")


def text_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as patches: their bytes are the colours of rows of 16 pixels, the last row filled up with zeros."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(3 * spark.sparkContext.defaultParallelism, "doc_id")  # as files may be one split
    raw = texts.select("doc_id", F.encode("text", "utf-8").alias("raw"))
    height = F.ceil(F.octet_length("raw") / 48).cast("int")
    return raw.select("doc_id", F.rpad("raw", height * 48, F.lit(b"\x00")).alias("data"), height.alias("height"), F.lit(16).alias("width"))


def patch_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of features of each patch; null for an empty one."""
    options = patches.PatchFeatures(side=32, levels=16)
    return text_patches(spark, sf_dir).select("doc_id", patches.extract(options, F.col("data"), F.col("height"), F.col("width")).alias("features"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of each user's events: boxes drift with the frame, every sixth frame is empty."""
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream"), frame.alias("frame_index"), (F.col("event_id") % 2).cast("int").alias("class_id"), "value")
    x = (F.col("frame_index") * 2 + F.col("class_id") * 60).cast("double")
    some = F.col("frame_index") % 6 != 0
    box = {"x1": x, "y1": F.lit(20.0), "x2": x + 30, "y2": F.lit(60.0)}
    return rows.select("stream", "frame_index", *[F.when(some, c).alias(n) for n, c in box.items()], "class_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))


def sort_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracking.track(detections(spark, sf_dir), history=False)
    return rows.select("stream", "frame_index", "track_id", "class_id", "observed", "hits", F.round("x1", 4).alias("x1"))


def kalman_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracking.kalman_smooth(detections(spark, sf_dir).filter("x1 IS NOT NULL"))
    return rows.select("stream", "frame_index", F.round("x1", 4).alias("x1"), F.round("x2", 4).alias("x2"))


def _learning(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") % 3).alias("label"))
    ready = lambda part: models.prepared(rows.filter(part), "embedding", "label", [0, 1, 2])
    return ready("vec_id % 4 != 0"), ready("vec_id % 4 = 0")


def rf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.grid_search(*_learning(spark, sf_dir), models.random_forest, {"trees": [10, 20], "depth": [4, 8]}, [0, 1, 2])[0]


def gbt_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.grid_search(*_learning(spark, sf_dir), models.boosted, {"trees": [3], "depth": [2, 3]}, [0, 1, 2])[0]


def svm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RBF machines over at most 64 landmarks, gamma by scale."""
    return models.grid_search(*_learning(spark, sf_dir), lambda c: kernel.RbfMachine(c, landmarks=64), {"c": [1.0, 10.0]}, [0, 1, 2])[0]


def et_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.grid_search(*_learning(spark, sf_dir), extra_trees.ExtraTrees, {"trees": [10, 20], "depth": [4, 8]}, [0, 1, 2])[0]


def leaf_boost_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf-wise boosting, all classes in one softmax."""
    return models.grid_search(*_learning(spark, sf_dir), lambda depth: boosting.Boosted(rounds=3, leaves=8, depth=depth), {"depth": [3, 6]}, [0, 1, 2])[0]


METHODS = {"colour": 0, "svm": 3, "rf": 6, "et": 9, "xgb": 12, "lgbm": 15}  # where a method's three scores begin


def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro F1 of six methods, each the greatest of three coordinates; all confusion tables in one aggregate."""
    first = lambda at: F.array_position(F.slice("embedding", at + 1, 3), F.array_max(F.slice("embedding", at + 1, 3))) - 1
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).cast("long").alias("truth"), F.explode(F.create_map(*[x for n, at in METHODS.items() for x in (F.lit(n), first(at).cast("long"))])).alias("method", "predicted"))
    cells = cut(rows.groupBy("method", "truth", "predicted").agg(F.count("*").alias("n")))  # at most 54 rows
    every = metrics.confusion(rows.limit(0), "truth", "predicted", [0, 1, 2]).drop("n")
    out = None
    for name in METHODS:
        own = F.broadcast(every).join(cells.filter(F.col("method") == name), ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
        one = metrics.summary(own).select(F.lit(name).alias("method"), F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))
        out = one if out is None else out.union(one)
    return out


_R = "p AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in RGB.items()) + ", (l_partkey % 3) AS kind FROM lineitem)"
_Q = f"{_R}, q AS (SELECT round(greatest(quantile_cont((r - g)::DOUBLE, 0.25::DOUBLE), 0::DOUBLE), 6) AS rg, round(greatest(quantile_cont((g - b)::DOUBLE, 0.2::DOUBLE), -5::DOUBLE), 6) AS gb, round(greatest(quantile_cont(greatest(r, g, b)::DOUBLE, 0.15::DOUBLE), 70::DOUBLE), 6) AS value FROM p WHERE greatest(r, g, b) > 5)"
_FL = "f AS (SELECT label::BIGINT AS label, embedding[1]::DOUBLE * 10 AS u, embedding[2]::DOUBLE * 10 AS v, embedding[3]::DOUBLE * 10 AS x, embedding[4]::DOUBLE * 10 AS y FROM embeddings)"

QUERIES = {
    f.__name__: f
    for f in (
        pixel_channels, quantile_thresholds, vote_rules, patch_decisions, area_grid, best_areas, calibration, histogram_norm, channel_stats, standard_scale, circular_flow_stats, mask_overlap, reprojection_error,
        phash_udf, lbp_hist, texture_features, morph_open, patch_vectors, sort_tracker, kalman_smooth, rf_grid, gbt_ovr, svm_grid, et_grid, leaf_boost_grid, method_comparison,
    )
}
_VALUES = lambda name, values: "(VALUES " + ", ".join(f"({x}::DOUBLE)" for x in values) + f") {name}({name}_area)"
_AREAS = f"""WITH {_R}, s AS (SELECT l_orderkey, avg((r > 128)::INT) AS fire, avg((abs(r - g) < 64)::INT) AS smoke FROM p GROUP BY 1),
t AS (SELECT *, CASE l_orderkey % 3 WHEN 0 THEN 'fire' WHEN 1 THEN 'smoke' ELSE 'normal' END AS truth FROM s),
d AS (SELECT fire_area, smoke_area, truth, CASE WHEN t.fire >= fire_area AND (t.smoke < smoke_area OR t.fire / fire_area >= t.smoke / smoke_area) THEN 'fire' WHEN t.smoke >= smoke_area THEN 'smoke' ELSE 'normal' END AS predicted FROM t, {_VALUES("fire", FIRES)}, {_VALUES("smoke", SMOKES)}),
c AS (SELECT fire_area, smoke_area, label, count(*) FILTER (truth = label AND predicted = label) AS hit, count(*) FILTER (truth = label) + count(*) FILTER (predicted = label) AS held FROM d, (VALUES ('fire'), ('smoke'), ('normal')) l(label) GROUP BY 1, 2, 3),
m AS (SELECT fire_area, smoke_area, round(sum(CASE WHEN held > 0 THEN 2 * hit / held::DOUBLE ELSE 0 END) / 3, 9) AS macro_f1 FROM c GROUP BY 1, 2),
a AS (SELECT fire_area, smoke_area, round(avg((truth = predicted)::INT), 9) AS accuracy FROM d GROUP BY 1, 2), g AS (SELECT * FROM m JOIN a USING (fire_area, smoke_area))"""
_ERRORS = f"WITH {_FL}, e AS (SELECT label, round(sqrt(sum((u - x) * (u - x) + (v - y) * (v - y))) / count(*), 6) AS error FROM f GROUP BY label)"
ORACLES = {
    "area_grid": f"{_AREAS} SELECT * FROM g",
    "best_areas": f"{_AREAS} SELECT * FROM g ORDER BY macro_f1 DESC, accuracy DESC, fire_area + smoke_area DESC, least(fire_area, smoke_area) DESC, fire_area, smoke_area LIMIT 1",
    "calibration": f"{_ERRORS} SELECT count(error) AS views, round(avg(error), 6) AS mean_error, round(max(error), 6) AS largest_error, count(error) >= 10 AS usable FROM e",
    "pixel_channels": f"""WITH {_R}, a AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS sp, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS luma FROM p),
h AS (SELECT *, CASE WHEN sp = 0 THEN 0 WHEN hi = r THEN 60 * (g - b) / sp WHEN hi = g THEN 120 + 60 * (b - r) / sp ELSE 240 + 60 * (r - g) / sp END AS hue0 FROM a)
SELECT l_orderkey, l_linenumber, (round_even(CASE WHEN hue0 < 0 THEN hue0 + 360 ELSE hue0 END / 2, 0) % 180)::DOUBLE AS hue, CASE WHEN hi = 0 THEN 0 ELSE round_even(255::DOUBLE * sp / hi, 0) END::DOUBLE AS saturation, hi AS value,
least(greatest(round_even((r - luma) * 0.713::DOUBLE + 128, 0), 0), 255)::DOUBLE AS cr, least(greatest(round_even((b - luma) * 0.564::DOUBLE + 128, 0), 0), 255)::DOUBLE AS cb FROM h""",
    "quantile_thresholds": f"WITH {_Q} SELECT rg, gb, value FROM q",
    "vote_rules": f"WITH {_Q} SELECT kind, sum(((r - g >= rg)::INT + (g - b >= gb)::INT + (greatest(r, g, b) >= q.value)::INT >= 2)::BIGINT)::BIGINT AS hits, count(*) AS n FROM p, q GROUP BY kind",
    "patch_decisions": f"WITH {_R}, s AS (SELECT l_orderkey, avg((r > 128)::INT) AS fire, avg((abs(r - g) < 64)::INT) AS smoke FROM p GROUP BY 1) SELECT l_orderkey, CASE WHEN fire >= 0.5 AND (smoke < 0.5 OR fire >= smoke) THEN 'fire' WHEN smoke >= 0.5 THEN 'smoke' ELSE 'normal' END AS decision FROM s",
    "histogram_norm": f"WITH {_R}, c AS (SELECT kind, floor(r / 256 * 16)::BIGINT AS bin, count(*) AS n FROM p GROUP BY 1, 2), g AS (SELECT DISTINCT kind, unnest(range(16)) AS bin FROM p) SELECT kind, bin, round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY kind))::DOUBLE, 6) AS share FROM g LEFT JOIN c USING (kind, bin)",
    "channel_stats": f"WITH {_R} SELECT kind, " + ", ".join(f"round(avg({c} / 255), 6) AS mean_{c}, round(stddev_pop({c} / 255), 6) AS std_{c}" for c in RGB) + " FROM p GROUP BY kind",
    "standard_scale": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer",
    "circular_flow_stats": f"WITH {_FL}, m AS (SELECT *, sqrt(u * u + v * v) AS m FROM f) SELECT label, round(avg(m), 5) AS mean_magnitude, round(var_pop(m), 5) AS magnitude_variance, round(avg((m >= 1)::INT), 5) AS moving_ratio, round(coalesce((degrees(atan2(avg(sin(atan2(v, u))) FILTER (m >= 1), avg(cos(atan2(v, u))) FILTER (m >= 1))) + 360) % 360, 0), 5) AS mean_direction, round(coalesce(avg((v < 0)::INT) FILTER (m >= 1), 0), 5) AS upward_ratio FROM m GROUP BY label",
    "mask_overlap": f"WITH {_FL} SELECT label, round(count(*) FILTER (u > 0 AND v > 0) / greatest(1, count(*) FILTER (v > 0))::DOUBLE, 6) AS overlap FROM f GROUP BY label",
    "reprojection_error": f"WITH {_FL} SELECT label, round(sqrt(sum((u - x) * (u - x) + (v - y) * (v - y))) / count(*), 6) AS error FROM f GROUP BY label",
    "method_comparison": f"""WITH m AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {at})" for n, at in METHODS.items())}) t(method, place)), e AS (SELECT method, label % 3 AS truth, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS predicted FROM (SELECT method, label, embedding[place + 1] AS a, embedding[place + 2] AS b, embedding[place + 3] AS c FROM embeddings, m)),
f AS (SELECT method, l, count(*) FILTER (truth = l AND predicted = l) AS hit, count(*) FILTER (truth = l) + count(*) FILTER (predicted = l) AS held FROM e, range(3) r(l) GROUP BY 1, 2), s AS (SELECT method, avg(CASE WHEN held > 0 THEN 2 * hit / held::DOUBLE ELSE 0 END) AS macro_f1 FROM f GROUP BY 1)
SELECT method, round(avg((truth = predicted)::INT), 4) AS accuracy, round(any_value(macro_f1), 4) AS macro_f1 FROM e JOIN s USING (method) GROUP BY method""",
}
