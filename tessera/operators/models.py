"""Model grids on MLlib: standardised features, class weights, trials, and selection by macro F1, then accuracy."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics


def random_forest(trees: int = 50, depth: int = 10, seed: int = 42, every_feature: bool = False) -> RandomForestClassifier:
    """every_feature: trees without bootstrap samples, the nearest form to extremely randomised trees that MLlib has."""
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, bootstrap=not every_feature, featureSubsetStrategy="sqrt")


def boosted(trees: int = 20, depth: int = 3, rate: float = 0.1, seed: int = 42) -> OneVsRest:
    """One-vs-rest gradient boosting, for either boosted-tree family."""
    return OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed), featuresCol="features", labelCol="label", weightCol="weight")


def linear_machine(c: float = 1.0) -> OneVsRest:
    return OneVsRest(classifier=LinearSVC(regParam=1.0 / c, maxIter=30), featuresCol="features", labelCol="label", weightCol="weight")


def fourier_features(column: str, size: int, out: int, gamma: float, seed: int = 42) -> SQLTransformer:
    """Random cosine features whose dot products approximate the RBF kernel exp(-gamma |x - y|^2); fixed by the seed."""
    import numpy as np

    rng = np.random.default_rng(seed)
    weights, phases = rng.normal(0, (2 * gamma) ** 0.5, (out, size)), rng.uniform(0, 2 * np.pi, out)
    rows = ", ".join("array(" + ", ".join(f"{w:.9g}D" for w in row) + ")" for row in weights)
    shift = ", ".join(f"{p:.9g}D" for p in phases)
    dot = f"aggregate(zip_with(w, {column}, (a, b) -> a * b), 0D, (s, x) -> s + x)"
    return SQLTransformer(statement=f"SELECT *, zip_with(transform(array({rows}), w -> {dot}), array({shift}), (d, p) -> cos(d + p) * {(2 / out) ** 0.5:.9g}D) AS fourier FROM __THIS__")


def kernel_features(df: DataFrame, column: str, size: int, out: int = 128, gamma: float | str = "scale", seed: int = 42) -> DataFrame:
    """The array column replaced by its cosine features; gamma "scale" is one over its length times its variance.

    Columns that a kernel is to see alike are standardised before; kernel.RbfMachine does so by itself."""
    if gamma in ("scale", "auto"):
        spread = 1.0
        if gamma == "scale":
            spread = df.select(F.explode(column).alias("x")).agg(F.var_pop(F.col("x").cast("double"))).first()[0] or 1.0
        gamma = 1.0 / (size * spread)
    return fourier_features(column, size, out, gamma, seed).transform(df).withColumn(column, F.col("fourier")).drop("fourier")


def save(model, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def probabilities(model, df: DataFrame, classes: int) -> DataFrame:
    """The model's predictions with an array of class probabilities, null for models that have none."""
    found = model.transform(df)
    if "probability" not in found.columns:
        return found.withColumn("probabilities", F.lit(None).cast("array<double>"))
    return found.withColumn("probabilities", F.slice(vector_to_array("probability"), 1, classes)).drop("probability")


def prepared(df: DataFrame, features: str, label: str, labels: Sequence) -> DataFrame:
    """features (vector), label (double) and balanced weight."""
    weights = metrics.class_weights(df, label, labels)
    joined = df.join(F.broadcast(weights.withColumnRenamed("label", "_l")), F.col(label) == F.col("_l"))
    return joined.select(array_to_vector(F.col(features).cast("array<double>")).alias("raw"), F.col(label).cast("double").alias("label"), F.col("weight"))


def grid_search(train: DataFrame, validation: DataFrame, make: Callable, grid: Mapping[str, Sequence], labels: Sequence) -> tuple[DataFrame, object]:
    """(trials, best model): a row for each combination with macro F1 and accuracy on the validation rows.

    make gives an MLlib estimator, which is fitted on standardised features, or anything with fit (kernel.RbfMachine,
    extra_trees.ExtraTrees, boosting.Boosted), which is given the raw ones. The choice never sees other rows; an empty validation table is an error. Equal scores keep the earlier combination.
    """
    if validation.isEmpty():
        raise ValueError("selection needs validation rows")
    train, validation = train.persist(), validation.persist()
    rows, best_model, best = [], None, None
    for i, values in enumerate(product(*grid.values())):
        options = dict(zip(grid, values, strict=True))
        made = make(**options)
        if isinstance(made, Estimator):
            made = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), made])
        model = made.fit(train)
        scored = model.transform(validation).select(F.col("label").cast("long").alias("truth"), F.col("prediction").cast("long").alias("predicted"))
        result = metrics.summary(metrics.confusion(scored, "truth", "predicted", [int(x) for x in labels])).first()
        rows.append((i, str(options), result.macro_f1, result.accuracy))
        if best is None or (result.macro_f1, result.accuracy) > best:
            best_model, best = model, (result.macro_f1, result.accuracy)
    train.unpersist()
    validation.unpersist()
    return train.sparkSession.createDataFrame(rows, "trial int, options string, macro_f1 double, accuracy double"), best_model
