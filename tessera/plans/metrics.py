"""Metric and selection queries over embeddings, labels and fixed trial tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.session import table

CLASSES = [0, 1, 2]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, truth, predicted, s0, s1, s2): three classes from the label, scores from the first coordinates."""
    at = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), (F.col("label") % 3).cast("long").alias("truth"), *[at(i).alias(f"s{i}") for i in range(3)])
    best = F.when((F.col("s0") >= F.col("s1")) & (F.col("s0") >= F.col("s2")), 0).when(F.col("s1") >= F.col("s2"), 1).otherwise(2)
    return rows.withColumn("predicted", best.cast("long"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), "truth", "predicted", CLASSES)


def per_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.per_class(confusion_matrix(spark, sf_dir))
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.summary(confusion_matrix(spark, sf_dir))
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns if c != "support"], "support")


def _one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    melted = scored(spark, sf_dir).unpivot(["truth"], ["s0", "s1", "s2"], "name", "score")
    return melted.select(F.substring("name", 2, 1).cast("long").alias("label"), (F.col("truth") == F.substring("name", 2, 1).cast("long")).alias("is_label"), "score")


def roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = metrics.roc_auc(_one_vs_rest(spark, sf_dir), "is_label", "score", ["label"])
    return each.select(F.col("label"), F.round("auc", 6).alias("auc"))


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.roc_points(_one_vs_rest(spark, sf_dir), "is_label", "score", ["label"])
    return points.select("label", F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def roc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area under the points, which equals the rank form."""
    areas = metrics.trapezoid_auc(metrics.roc_points(_one_vs_rest(spark, sf_dir), "is_label", "score", ["label"]), ["label"])
    return areas.select("label", F.round("auc", 6).alias("auc"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.class_weights(table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label")), "label", list(range(10)))
    return rows.select("label", F.round("weight", 6).alias("weight"))


THRESHOLDS = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("n_chars") / 1000.0).alias("score"), F.col("quality").cast("long").alias("truth"))
    points = spark.createDataFrame([(t,) for t in THRESHOLDS], "threshold double")
    return metrics.threshold_grid(rows, ["score"], points, (F.col("score") >= F.col("threshold")).cast("long"), "truth")


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("threshold", "truth", "predicted", "n")


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid point with the best F1, then recall, then the higher threshold."""
    hit = lambda t, p: F.sum(F.when((F.col("truth") == t) & (F.col("predicted") == p), F.col("n")).otherwise(0))
    sums = _grid(spark, sf_dir).groupBy("threshold").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    rated = sums.select("threshold", metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    rated = rated.withColumn("f1", F.round(metrics.f1_from(F.col("precision"), F.col("recall")), 9))
    chosen = metrics.best(rated.filter("f1 IS NOT NULL"), [F.desc("f1"), F.desc("recall"), F.desc("threshold")])
    return chosen.select("threshold", F.round("f1", 6).alias("f1"))


_SHARE = "p_partkey * {} % 1000 / CAST(1000 AS DOUBLE)"
TRIAL = {
    "trial": "p_partkey", "status": "CASE WHEN p_size % 5 = 0 THEN 'failed' ELSE 'completed' END", "image_size": "CAST(p_size * 32 AS BIGINT)", "map50_95": f"CASE WHEN p_size % 7 > 0 THEN {_SHARE.format(37)} ELSE CAST(0 AS DOUBLE) END",
    "map50": f"CASE WHEN p_size % 3 > 0 THEN {_SHARE.format(61)} END", "f1": f"CASE WHEN p_size % 4 > 0 THEN {_SHARE.format(13)} END",
}
RATE = {"trial": "p_partkey", "precision": "CASE WHEN p_size % 9 > 0 THEN p_partkey * 61 % 11 / CAST(10 AS DOUBLE) END", "recall": "CASE WHEN p_size % 8 > 0 THEN p_partkey * 37 % 11 / CAST(10 AS DOUBLE) END"}


def trial_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as trials, some failed, with rates that are missing or 0; many share the best one."""
    trials = table(spark, sf_dir, "part").select(*[F.expr(e).alias(c) for c, e in TRIAL.items()]).filter("status = 'completed'")
    order = [metrics.missing_as(F.col(c)).desc() for c in ("map50_95", "map50", "f1")]
    return metrics.best(trials, [*order, F.col("trial")]).select("trial", "image_size")


def f1_from_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "part").select(*[F.expr(e).alias(c) for c, e in RATE.items()])
    return rates.select("trial", F.round(metrics.f1_from(F.col("precision"), F.col("recall")), 6).alias("f1"))


def metric_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finite value among alternative keys of a metric map."""
    part = table(spark, sf_dir, "part")
    found = F.create_map(F.lit("a"), F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")), F.lit("b"), F.col("p_size").cast("double"))
    finite = F.map_filter(found, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return part.select("p_partkey", F.coalesce(F.try_element_at(finite, F.lit("a")), F.try_element_at(finite, F.lit("b"))).alias("metric"))


def melt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_class_report(spark, sf_dir).unpivot(["label"], ["precision", "recall", "f1"], "metric", "value")


def comparison_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with their place by F1, best first."""
    from tessera.operators.ranking import with_rank

    ranked = with_rank(per_class_report(spark, sf_dir), "place", [F.desc("f1"), F.col("label")], 2)
    return ranked.select((F.col("place") + 1).alias("place"), "label", "f1")


def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of losses weighted by batch sizes, by ship mode of flag and status."""
    loss, n = F.col("l_discount"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(loss * n) / F.sum(n), 6).alias("mean_loss"))


_S = "s AS (SELECT vec_id, (label % 3)::BIGINT AS truth, embedding[1]::DOUBLE AS s0, embedding[2]::DOUBLE AS s1, embedding[3]::DOUBLE AS s2, CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 0 WHEN embedding[2] >= embedding[3] THEN 1 ELSE 2 END::BIGINT AS predicted FROM embeddings)"
_C = f"{_S}, l AS (SELECT unnest([0, 1, 2])::BIGINT AS label), c AS (SELECT a.label AS truth, b.label AS predicted, count(s.vec_id) AS n FROM l a CROSS JOIN l b LEFT JOIN s ON s.truth = a.label AND s.predicted = b.label GROUP BY 1, 2)"
_P = f"""{_C}, q AS (SELECT label, sum(n) FILTER (truth = label AND predicted = label) AS hit, sum(n) FILTER (predicted = label) AS given, (sum(n) FILTER (truth = label))::BIGINT AS support FROM l, c GROUP BY label),
p0 AS (SELECT label, CASE WHEN given > 0 THEN hit / given::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS recall, support FROM q),
p AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p0)"""
_O = f"{_S}, o AS (SELECT 0::BIGINT AS label, truth = 0 AS pos, s0 AS score FROM s UNION ALL SELECT 1, truth = 1, s1 FROM s UNION ALL SELECT 2, truth = 2, s2 FROM s)"
_AUC = f"WITH {_O}, k AS (SELECT label, pos, rank() OVER w + (count(*) OVER (PARTITION BY label, score) - 1) / 2::DOUBLE AS r FROM o WINDOW w AS (PARTITION BY label ORDER BY score)) SELECT label, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2::DOUBLE) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos))::DOUBLE, 6) AS auc FROM k GROUP BY label"
_REPORT = "SELECT label, round(precision::DOUBLE, 6) AS precision, round(recall::DOUBLE, 6) AS recall, round(f1::DOUBLE, 6) AS f1, support FROM p"
_G = "g AS (SELECT threshold, quality::BIGINT AS truth, (n_chars / 1000::DOUBLE >= threshold)::BIGINT AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id), (SELECT unnest([" + ", ".join(map(str, THRESHOLDS)) + "]::DOUBLE[]) AS threshold) GROUP BY 1, 2, 3)"
_T, _R = ("(SELECT " + ", ".join(f"{e} AS {c}" for c, e in made.items()) + " FROM part)" for made in (TRIAL, RATE))

QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix, per_class_report, macro_metrics, roc_auc_ovr, roc_points, roc_trapezoid, class_weights, threshold_grid, best_threshold, trial_select, f1_from_pr,
        metric_coalesce, melt_metrics, comparison_sorted, mean_loss,
    )
}
ORACLES = {
    "confusion_matrix": f"WITH {_C} SELECT truth, predicted, n FROM c",
    "per_class_report": f"WITH {_P} {_REPORT}",
    "macro_metrics": f"WITH {_P} SELECT " + ", ".join(f"round(avg({c})::DOUBLE, 6) AS macro_{c}, round((sum({c} * support) / sum(support))::DOUBLE, 6) AS weighted_{c}" for c in ("precision", "recall", "f1")) + ", round((sum(recall * support) / sum(support))::DOUBLE, 6) AS accuracy, sum(support)::BIGINT AS support FROM p",
    "roc_auc_ovr": _AUC,
    "roc_points": f"WITH {_O}, k AS (SELECT label, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM o GROUP BY 1, 2) SELECT label, round(score, 9) AS threshold, round(sum(q) OVER d / (sum(q) OVER (PARTITION BY label))::DOUBLE, 6) AS fpr, round(sum(p) OVER d / (sum(p) OVER (PARTITION BY label))::DOUBLE, 6) AS tpr FROM k WINDOW d AS (PARTITION BY label ORDER BY score DESC)",
    "roc_trapezoid": _AUC,
    "class_weights": "SELECT label::BIGINT AS label, round(sum(count(*)) OVER () / (10 * count(*))::DOUBLE, 6) AS weight FROM embeddings GROUP BY label",
    "threshold_grid": f"WITH {_G} SELECT threshold, truth, predicted, n FROM g",
    "best_threshold": f"WITH {_G}, a AS (SELECT threshold, coalesce(sum(n) FILTER (truth = 1 AND predicted = 1), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (truth = 0 AND predicted = 1), 0)::DOUBLE AS fp, coalesce(sum(n) FILTER (truth = 1 AND predicted = 0), 0)::DOUBLE AS fn FROM g GROUP BY 1), b AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM a) SELECT threshold, round(f1, 6) AS f1 FROM (SELECT threshold, r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 9) AS f1 FROM b) WHERE f1 IS NOT NULL ORDER BY f1 DESC, r DESC, threshold DESC LIMIT 1",
    "trial_select": f"SELECT trial::BIGINT AS trial, image_size::BIGINT AS image_size FROM {_T} WHERE status = 'completed' ORDER BY coalesce(nullif(map50_95, 0), -1) DESC, coalesce(nullif(map50, 0), -1) DESC, coalesce(nullif(f1, 0), -1) DESC, trial LIMIT 1",
    "f1_from_pr": f"SELECT trial::BIGINT AS trial, round(CASE WHEN precision + recall > 0 THEN 2::DOUBLE * precision * recall / (precision + recall) END, 6)::DOUBLE AS f1 FROM {_R}",
    "metric_coalesce": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE ELSE p_retailprice END AS metric FROM part",
    "melt_metrics": f"WITH {_P}, x AS ({_REPORT}) SELECT label, 'precision' AS metric, precision AS value FROM x UNION ALL SELECT label, 'recall', recall FROM x UNION ALL SELECT label, 'f1', f1 FROM x",
    "comparison_sorted": f"WITH {_P}, x AS ({_REPORT}) SELECT row_number() OVER (ORDER BY f1 DESC, label) AS place, label, f1 FROM x",
    "mean_loss": "SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean_loss FROM lineitem GROUP BY 1, 2",
}
