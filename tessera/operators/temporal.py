"""Per-key temporal logic over ordered rows: votes, smoothing, growth, risk, segments, events."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_segments(df: DataFrame, keys: Sequence[str], frame: str, name: str = "segment") -> DataFrame:
    """Numbers a key's runs of consecutive frames (any gap begins a new run): frame minus the row's number."""
    window = Window.partitionBy(*keys).orderBy(frame)
    return df.withColumn(name, (F.col(frame) - F.row_number().over(window)).cast("long"))


def with_votes(df: DataFrame, keys: Sequence[str], frame: str, observed: str, length: int = 8) -> DataFrame:
    """hits, window_length and persistence of the last `length` rows, fewer at the start."""
    window = Window.partitionBy(*keys).orderBy(frame).rowsBetween(1 - length, 0)
    return (
        df.withColumn("hits", F.sum(F.col(observed).cast("long")).over(window))
        .withColumn("window_length", F.count("*").over(window))
        .withColumn("persistence", F.col("hits") / F.col("window_length"))
    )


def with_smoothed(df: DataFrame, keys: Sequence[str], frame: str, value: str, observed: str, alpha: float = 0.4, name: str = "smoothed") -> DataFrame:
    """Exponential smoothing that only observed rows move; others hold it. The first observed value seeds it; null before.

    A fold over the key's last observed values, as many as can move a double; work is linear in a key's length. At alpha 0
    the first value stays, at 1 each row gives its own.
    """
    if alpha == 0:
        up_to = Window.partitionBy(*keys).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.first(F.when(F.col(observed), F.col(value).cast("double")), ignorenulls=True).over(up_to))
    reach = math.ceil(-60 * math.log(2) / math.log(1 - alpha)) + 1 if 0 < alpha < 1 else 1
    last = Window.partitionBy(*keys, "_seen").orderBy(frame).rowsBetween(1 - reach, 0)
    fold = F.aggregate(F.collect_list("_value").over(last), F.lit(None).cast("double"), lambda a, x: F.coalesce(F.lit(alpha) * x + F.lit(1 - alpha) * a, x))
    marked = df.withColumn("_value", F.when(F.col(observed), F.col(value).cast("double"))).withColumn("_seen", F.col("_value").isNotNull())
    moved = marked.withColumn("_moved", F.when(F.col("_seen"), fold))
    up_to = Window.partitionBy(*keys).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumn(name, F.last("_moved", ignorenulls=True).over(up_to)).drop("_value", "_seen", "_moved")


def with_growth(df: DataFrame, keys: Sequence[str], frame: str, area: str, name: str = "growth") -> DataFrame:
    """Relative change of the area since the key's last row; 0 without an earlier area above 0."""
    before = F.lag(area).over(Window.partitionBy(*keys).orderBy(frame))
    return df.withColumn(name, F.when(before.isNull() | (before <= 0), F.lit(0.0)).otherwise((F.col(area) - before) / before))


def confirmed(label: Column, hits: Column, smoothed: Column, needs: Mapping[str, int], least: float = 0.25, other: str = "smoke") -> Column:
    """Whether the label's number of hits and the least smoothed confidence are reached; unknown labels count as `other`."""
    wanted = F.lit(needs[other])
    for name, n in needs.items():
        wanted = F.when(label == name, F.lit(n)).otherwise(wanted)
    return (hits >= wanted) & (F.coalesce(smoothed, F.lit(0.0)) >= least)


def state(label: Column, is_confirmed: Column, first: str = "fire") -> Column:
    """CONFIRMED_ or POSSIBLE_, and FIRE or, for any other label, SMOKE."""
    return F.concat(F.when(is_confirmed, "CONFIRMED_").otherwise("POSSIBLE_"), F.when(label == first, "FIRE").otherwise("SMOKE"))


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


# Weights, saturations and levels of the risk score.
RISK_WEIGHTS = {"confidence": 0.35, "persistence": 0.20, "motion": 0.15, "area": 0.15, "growth": 0.15}
AREA_SATURATION, GROWTH_SATURATION = 0.15, 0.50
RISK_LEVELS = (("CRITICAL", 0.80), ("HIGH", 0.60), ("MODERATE", 0.30))


def risk_score(confidence: Column, persistence: Column, motion: Column, area: Column, growth: Column, weights: Mapping[str, float] = RISK_WEIGHTS) -> Column:
    parts = {
        "confidence": clip(confidence),
        "persistence": clip(persistence),
        "motion": clip(motion),
        "area": clip(area / max(AREA_SATURATION, 1e-6)),
        "growth": clip(F.greatest(growth, F.lit(0.0)) / max(GROWTH_SATURATION, 1e-6)),
    }
    total = None
    for name, part in parts.items():
        total = part * weights[name] if total is None else total + part * weights[name]
    return clip(total)


def risk_level(score: Column) -> Column:
    (first, least), *rest = RISK_LEVELS
    level = F.when(score >= least, first)
    for name, least in rest:
        level = level.when(score >= least, name)
    return level.otherwise("LOW")


def motion_score(magnitude: Column, moving: Column, upward: Column, foreground: Column, most: float = 5.0) -> Column:
    """Fixed shares: 0.35 clipped magnitude, 0.35 moving, 0.15 upward, 0.15 foreground."""
    return 0.35 * F.least(F.lit(1.0), magnitude / most) + 0.35 * moving + 0.15 * upward + 0.15 * foreground


def events(df: DataFrame, keys: Sequence[str], frame: str, flag: str, score: str, level: str, confidence: str, label: str) -> DataFrame:
    """Maximal runs of consecutive flagged frames: start, end (the first frame after), peaks; equal peaks take the later level."""
    on = df.filter(F.col(flag))
    runs = with_segments(on, keys, frame, "_run")
    return runs.groupBy(*keys, "_run").agg(
        F.min_by(label, frame).alias("label"),
        F.min(frame).alias("start_frame"),
        (F.max(frame) + 1).alias("end_frame"),
        F.max(score).alias("peak_risk"),
        F.max(confidence).alias("peak_confidence"),
        F.max_by(level, F.struct(score, frame)).alias("peak_risk_level"),
    ).drop("_run")


def trailing(df: DataFrame, keys: Sequence[str], frame: str, value: str, length: int, name: str) -> DataFrame:
    """The last `length` values, oldest first."""
    window = Window.partitionBy(*keys).orderBy(frame).rowsBetween(1 - length, 0)
    return df.withColumn(name, F.collect_list(value).over(window))


def early_stop(df: DataFrame, order: str, metric: str, patience: int, keys: Sequence[str] = (), margin: float = 1e-6) -> DataFrame:
    """best (so far), improved (by more than margin), stale (rows since) and stopped (stale reached patience, then or before).

    A row improves if it exceeds all before it by more than the margin; the first one does.
    """
    rows = Window.partitionBy(*keys).orderBy(order) if keys else Window.partitionBy(F.lit(0)).orderBy(order)
    before = F.max(metric).over(rows.rowsBetween(Window.unboundedPreceding, -1))
    up_to = rows.rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("improved", before.isNull() | (F.col(metric) > before + margin)).withColumn("_n", F.row_number().over(rows))
    stale = F.col("_n") - F.max(F.when(F.col("improved"), F.col("_n"))).over(up_to)
    marked = marked.withColumn("best", F.max(metric).over(up_to)).withColumn("stale", stale.cast("long"))
    return marked.withColumn("stopped", F.max((F.col("stale") >= patience).cast("int")).over(up_to) == 1).drop("_n")
