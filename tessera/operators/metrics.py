"""Classification metrics and deterministic selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import features
from tessera.operators.lineage import cut
from tessera.operators.ranking import beside, running_sums


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, truth: str, predicted: str, labels: Sequence) -> DataFrame:
    """(truth, predicted, n) for all pairs of the fixed labels, zeros among them."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[truth]
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"truth {kind}, predicted {kind}")
    counted = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counted, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of a confusion table; a class without cases or predictions scores 0."""
    cells = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given")))).alias("c"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    sums = cells.groupBy("c.label").agg(F.sum("c.support").alias("support"), F.sum("c.given").alias("given"), (F.sum("hit") / 2).alias("hit"))
    scored = sums.withColumn("precision", ratio(F.col("hit"), F.col("given"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select("label", "precision", "recall", f1.alias("f1"), "support")


def summary(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro and support-weighted averages, support."""
    classes = per_class(matrix)
    total = F.sum("support")
    averages = classes.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    # The support-weighted recall is the accuracy over the fixed labels.
    return averages.withColumn("accuracy", F.col("weighted_recall"))


def f1_from(precision: Column, recall: Column) -> Column:
    """Null where either is null or both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))


def roc_auc(df: DataFrame, truth: str, score: str, keys: Sequence[str]) -> DataFrame:
    """(keys, auc) from average ranks (Mann-Whitney); null unless both truths occur. truth: boolean.

    Counts are merged by score first; ranks are running sums over range partitions.
    """
    ties = df.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("long")).alias("pos"))
    ranked = running_sums(ties, keys, F.col(score), {"_before": "n"}).withColumn("rank", F.col("_before") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def macro_auc(areas: DataFrame, labels: Sequence) -> DataFrame:
    """One row: the mean of the classes' areas; null unless each of the labels has one."""
    whole = F.count(F.when(F.col("label").isin(*labels), F.col("auc"))) == len(labels)
    return areas.agg(F.when(whole, F.avg(F.when(F.col("label").isin(*labels), F.col("auc")))).alias("macro_auc"))


def roc_points(df: DataFrame, truth: str, score: str, keys: Sequence[str]) -> DataFrame:
    """(keys, threshold, fpr, tpr) at each different score, falling."""
    ties = df.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("_p"), F.sum((~F.col(truth)).cast("long")).alias("_q"))
    summed = running_sums(ties, keys, F.col("threshold").desc(), {"_ps": "_p", "_qs": "_q"})
    whole = F.broadcast(summed.groupBy(*keys).agg(F.sum("_p").alias("_all_p"), F.sum("_q").alias("_all_q")))
    rates = (ratio(F.col("_qs") + F.col("_q"), F.col("_all_q")).alias("fpr"), ratio(F.col("_ps") + F.col("_p"), F.col("_all_p")).alias("tpr"))
    return summed.join(whole, list(keys)).select(*keys, "threshold", *rates)


def macro_roc(points: DataFrame, labels: Sequence, key: str = "label") -> DataFrame:
    """(fpr, tpr): the mean of the classes' curves, interpolated at the sorted union of their false-positive rates.

    points: of roc_points; each curve also starts at (0, 0). At a rate that a curve reaches more than once its highest point
    counts. Every rate is merged into each class's curve and takes the points beside it, so the work follows rates times
    classes and no curve is one task's.
    """
    each = points.select(key, "fpr", "tpr").union(points.sparkSession.createDataFrame([(x,) for x in labels], f"{key} {dict(points.dtypes)[key]}").select(key, F.lit(0.0), F.lit(0.0)))
    listed = F.array(*[F.lit(x) for x in labels]).cast(f"array<{dict(points.dtypes)[key]}>")
    highest = cut(each.filter(F.col(key).isin(list(labels))).groupBy(key, "fpr").agg(F.struct(F.first("fpr").alias("x"), F.max("tpr").alias("high"), F.min("tpr").alias("low")).alias("_own")))
    rates = highest.select("fpr").distinct().select("fpr", F.explode(listed).alias(key), F.lit(None).cast(dict(highest.dtypes)["_own"]).alias("_own"))
    merged = rates.unionByName(highest).groupBy(key, "fpr").agg(F.max("_own").alias("_own"))
    found = beside(merged, [key], "fpr", "_own", "_from", "_to")
    slope = (F.col("_to.low") - F.col("_from.high")) / (F.col("_to.x") - F.col("_from.x"))
    height = F.when(F.col("_own").isNotNull(), F.col("_own.high")).when(F.col("_to").isNull(), F.col("_from.high")).otherwise(F.col("_from.high") + slope * (F.col("fpr") - F.col("_from.x")))
    return found.groupBy("fpr").agg((F.sum(height) / len(labels)).alias("tpr"))


def trapezoid_auc(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, auc) of ROC points by the trapezoid rule from (0, 0)."""
    placed = beside(points.withColumn("_own", F.struct("fpr", "tpr")), keys, "threshold", "_own", "_from", falling=True)
    x0, y0 = F.coalesce("_from.fpr", F.lit(0.0)), F.coalesce("_from.tpr", F.lit(0.0))
    return placed.withColumn("_a", (F.col("fpr") - x0) * (F.col("tpr") + y0) / 2).groupBy(*keys).agg(F.sum("_a").alias("auc"))


def best(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first row in the order (a top-1, not a sort)."""
    return df.orderBy(*order).limit(1)


def missing_as(column: Column, value: float = -1.0) -> Column:
    """0 and null count as missing."""
    return F.coalesce(F.nullif(column, F.lit(0.0)), F.lit(value))


def class_weights(df: DataFrame, label: str, labels: Sequence) -> DataFrame:
    """(label, weight) = n / (classes * n of the class); raises if a class has no rows."""
    kind = dict(df.dtypes)[label]
    listed = df.sparkSession.createDataFrame([(x,) for x in labels], f"label {kind}")
    counts = F.broadcast(listed).join(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")), "label", "left")
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each class
    weight = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.raise_error(F.concat(F.lit("no rows of class "), F.col("label").cast("string"))).cast("double")).otherwise(whole / (len(labels) * F.col("n")))
    return counts.select("label", weight.alias("weight"))


def threshold_grid(scores: DataFrame, columns: Sequence[str], thresholds: DataFrame, decide: Column, truth: str) -> DataFrame:
    """For each point of a small grid: counts by (truth, predicted).

    Scores are merged by their values first; the grid meets the merged rows, never the raw ones.
    """
    merged = scores.groupBy(*columns, truth).agg(F.count("*").alias("_n"))
    return merged.crossJoin(F.broadcast(thresholds)).groupBy(*thresholds.columns, F.col(truth).alias("truth"), decide.alias("predicted")).agg(F.sum("_n").alias("n"))


def missing_classes(df: DataFrame, split: str, label: str, labels: Sequence) -> DataFrame:
    """(split, missing): the labels that a split which holds some rows lacks; no row for splits that hold all."""
    held = df.groupBy(split).agg(F.collect_set(F.when(F.col(label).isin(*labels), F.col(label))).alias("_held"))
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in labels]), "_held"))
    return held.select(split, lacking.alias("missing")).filter((F.size("missing") > 0) & (F.size("missing") < len(labels)))


def checked_classes(df: DataFrame, split: str, label: str, labels: Sequence) -> DataFrame:
    """The rows, unless a split holds some classes only: that raises, naming it. An empty split is allowed."""
    found = missing_classes(df, split, label, labels).orderBy(split).first()
    if found:
        raise ValueError(f"split {found[0]} has no rows of classes: {', '.join(map(str, found.missing))}")
    return df


def misclassified(df: DataFrame, truth: str, predicted: str, order: Sequence[Column], most: int | None = None) -> DataFrame:
    """Rows whose prediction is wrong (null counts as wrong), the first `most` of them in the order."""
    wrong = df.filter(~F.col(truth).eqNullSafe(F.col(predicted)))
    return wrong if most is None else wrong.orderBy(*order).limit(most)


def area_grid(patches: DataFrame, truth: str, fire: str, smoke: str, fires: Sequence[float], smokes: Sequence[float], labels: Sequence[str] = ("fire", "smoke", "normal")) -> DataFrame:
    """(fire_area, smoke_area, macro_f1, accuracy) of each pair of area thresholds; patches are decided by every pair in one
    pass and counted before anything is shuffled."""
    pairs = F.array(*(F.struct(F.lit(float(f)).alias("fire_area"), F.lit(float(s)).alias("smoke_area")) for f in fires for s in smokes))
    tried = patches.select(F.col(truth).alias("truth"), F.col(fire).alias("fire"), F.col(smoke).alias("smoke"), F.explode(pairs).alias("pair")).select("truth", "fire", "smoke", "pair.*")
    decided = tried.withColumn("predicted", features.patch_decision(F.col("fire"), F.col("smoke"), F.col("fire_area"), F.col("smoke_area")))
    count = lambda c: F.sum(c.cast("long")).cast("double")
    parts = []
    for label in labels:
        is_true, is_given = F.col("truth") == label, F.col("predicted") == label
        parts.append((count(is_true & is_given), count(is_true), count(is_given)))
    f1 = sum((ratio(2 * hit, support + given) for hit, support, given in parts), F.lit(0.0)) / len(labels)
    return decided.groupBy("fire_area", "smoke_area").agg(F.round(f1, 9).alias("macro_f1"), F.round(count(F.col("truth") == F.col("predicted")) / F.count("*"), 9).alias("accuracy"))


def best_areas(grid: DataFrame) -> DataFrame:
    """The pair with the best macro F1, then accuracy, then the larger sum, then the larger lesser one; of equals the first."""
    total, lesser = F.col("fire_area") + F.col("smoke_area"), F.least("fire_area", "smoke_area")
    return best(grid, [F.desc("macro_f1"), F.desc("accuracy"), total.desc(), lesser.desc(), F.asc("fire_area"), F.asc("smoke_area")])


def calibration(errors: DataFrame, error: str = "error", least: int = 10) -> DataFrame:
    """(views, mean_error, largest_error, usable): a calibration needs so many views."""
    return errors.agg(F.count(error).alias("views"), F.avg(error).alias("mean_error"), F.max(error).alias("largest_error"), (F.count(error) >= least).alias("usable"))
