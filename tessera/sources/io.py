"""Scans and sinks of labelled collections. All paths go through Spark's readers and writers."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.patches import PatchFeatures, extract

# Suffixes of images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
PATCH_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def discover(spark: SparkSession, folder: str, suffixes: Sequence[str] = IMAGE_SUFFIXES, content: bool = False) -> DataFrame:
    """Files below a folder by suffix in any case: path, modificationTime, length, rel_stem and, if asked for, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    pattern = r"\.(" + "|".join(suffixes) + ")$"
    root = F.lit(folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")
    rel = F.element_at(F.split(F.col("path"), F.concat(F.lit(r"\Q"), root, F.lit(r"\E")), 2), -1)
    found = files.filter(F.lower("path").rlike(pattern)).withColumn("rel_stem", F.regexp_replace(rel, r"\.[^./]*$", ""))
    return found if content else found.drop("content")


def with_labels(images: DataFrame, labels: DataFrame, keys: Sequence[str] = ("rel_stem",), missing_is_negative: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): images with their label rows. Without a label they are negatives, or rejected."""
    if missing_is_negative:
        return images.join(labels, list(keys), "left"), images.limit(0).withColumn("reason", F.lit(None).cast("string"))
    return images.join(labels, list(keys)), images.join(labels, list(keys), "left_anti").withColumn("reason", F.lit("missing_annotation"))


def text_files(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(path, rel_stem, text) of whole text files."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    path = F.col("_metadata.file_path")
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    rel = F.element_at(F.split(path, r"\Q" + root + r"\E", 2), -1)
    return read.select(path.alias("path"), F.regexp_replace(rel, r"\.[^./]*$", "").alias("rel_stem"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a fixed schema; empty fields are null."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="", emptyValue="")


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of different shapes under the sorted union of their columns; missing ones are null."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.select(*sorted(merged.columns))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """A CSV with a header; with given columns, missing ones are null."""
    if columns:
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    df.write.mode(mode).option("header", True).csv(path)


def write_split(df: DataFrame, path: str, split: str = "split", overwrite: bool = False) -> None:
    """The collection by split; an existing one is replaced only if asked for."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(split).parquet(path)


def rejected(reason_column: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether a reason is given."""
    return df.filter(F.col(reason_column).isNull()).drop(reason_column), df.filter(F.col(reason_column).isNotNull())


def frame_rate(column: str, fallback: float = 25.0):
    """The rate, or the fallback where it is null, not finite or not above 0."""
    value = F.col(column)
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value <= 0), F.lit(fallback)).otherwise(value)


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table of a small frame; more than `most` rows are an error, as reports are of aggregates."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def class_folders(spark: SparkSession, root: str, split: str, classes: Sequence[str], suffixes: Sequence[str] = PATCH_SUFFIXES) -> DataFrame:
    """(path, class_id, class_name) of the images below root/split/class, in any depth. A split without images raises."""
    names = "|".join(re.escape(c) for c in classes)
    files = discover(spark, f"{root.rstrip('/')}/{split}", suffixes)
    name = F.regexp_extract("path", f"/{re.escape(split)}/({names})/", 1)
    found = files.withColumn("class_name", name).filter("class_name != ''")
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class_name")).cast("int") - 1
    listed = found.select("path", number.alias("class_id"), "class_name")
    held = {r.class_name for r in listed.select("class_name").distinct().collect()}  # a row for each class at most
    if missing := [c for c in classes if c not in held]:
        raise ValueError(f"no images of classes in split {split}: {', '.join(missing)}")
    return listed


def write_features(df: DataFrame, path: str, metadata: Mapping, overwrite: bool = False) -> None:
    """Feature rows as Parquet, and beside them one JSON row of metadata with the rows' number and columns."""
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).parquet(f"{path}/rows")
    n = df.sparkSession.read.parquet(f"{path}/rows").count()
    text = json.dumps({**metadata, "rows": n, "columns": df.columns}, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").write.mode(mode).text(f"{path}/metadata")


def write_split_features(df: DataFrame, split: str, options: PatchFeatures, path: str, overwrite: bool = False) -> None:
    """Features of a split's patches, with labels and paths, below features/split=<split>, and the settings below metadata.

    Columns: path, split, label, data, height, width. A split without patches, or a patch that can't be read, is an error, and
    then nothing is committed; splits that were written before stay. Each split is a run of its own, as patches are read once.
    """
    chosen = df.filter(F.col("split") == split)
    if chosen.isEmpty():
        raise ValueError(f"no patches in split {split}")
    vector = extract(options, F.col("data"), F.col("height"), F.col("width"))
    read = F.coalesce("features", F.raise_error(F.concat(F.lit("a patch can't be read: "), F.coalesce(F.col("path"), F.lit("without a path")))).cast("array<float>"))
    rows = chosen.select("path", "label", vector.alias("features")).withColumn("features", read)
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/features/split={split}")
    text = json.dumps(options.metadata(), sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/metadata")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/metadata").first().value)


def write_predictions(df: DataFrame, path: str, truth: str = "truth", predicted: str = "predicted") -> None:
    """All rows with a column that says whether the prediction is right."""
    df.withColumn("correct", F.col(truth).eqNullSafe(F.col(predicted))).write.mode("overwrite").option("header", True).csv(path)


def read_failures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The written predictions that are wrong: correct is false or 0."""
    rows = spark.read.csv(path, schema=schema + ", correct string", header=True)
    return rows.filter(F.lower(F.trim("correct")).isin("false", "0")).drop("correct")


def thresholds(spark: SparkSession, path: str | None, image_size: int = 640, confidence: float = 0.25, iou: float = 0.45) -> tuple[int, float, float]:
    """(image size, confidence, iou) that a JSON file of a selection names; the fallbacks for keys or a file that is missing."""
    kept = {"selected_image_size": image_size, "selected_confidence": confidence, "selected_iou": iou}
    if path and exists(spark, path):
        raw = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))  # a file of a few lines
        kept |= {k: v for k, v in raw.items() if k in kept and v is not None}
    return int(kept["selected_image_size"]), float(kept["selected_confidence"]), float(kept["selected_iou"])


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
