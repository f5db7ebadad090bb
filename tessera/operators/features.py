"""Quantile-fitted rules, votes, histograms, moments, flow statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import clamp_to_frame
from tessera.operators import temporal


def quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """One row: exact, linearly interpolated quantiles by name."""
    return df.agg(*[F.percentile(expr, q).alias(name) for name, (expr, q) in wanted.items()])


def votes(rules: Sequence[Column]) -> Column:
    """How many of the rules hold; null counts as no."""
    total = F.lit(0)
    for rule in rules:
        total = total + F.coalesce(rule.cast("int"), F.lit(0))
    return total


def pixel_channels(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue (0 to 180), saturation, value, Cr and Cb of 8-bit RGB, rounded as 8-bit images hold them."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = F.when(span == 0, 0.0).when(high == r, 60.0 * (g - b) / span).when(high == g, 120 + 60.0 * (b - r) / span).otherwise(240 + 60.0 * (r - g) / span)
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    return {
        "hue": F.pmod(F.bround(F.pmod(hue, F.lit(360.0)) / 2), F.lit(180.0)),
        "saturation": F.when(high == 0, 0.0).otherwise(F.bround(255.0 * span / high)),
        "value": high.cast("double"),
        "cr": F.least(F.greatest(F.bround((r - luma) * 0.713 + 128), F.lit(0.0)), F.lit(255.0)),
        "cb": F.least(F.greatest(F.bround((b - luma) * 0.564 + 128), F.lit(0.0)), F.lit(255.0)),
    }


def patch_decision(fire: Column, smoke: Column, fire_least: Column, smoke_least: Column) -> Column:
    """fire or smoke, whichever exceeds its threshold by the larger factor (fire if equal), else normal."""
    is_fire, is_smoke = fire >= fire_least, smoke >= smoke_least
    ahead = fire / fire_least >= smoke / smoke_least
    return F.when(is_fire & (~is_smoke | ahead), "fire").when(is_smoke, "smoke").otherwise("normal")


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, share) with all bins; the last bin holds the upper end, values outside count nowhere."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    inside = df.filter(F.col(value).between(low, high)).withColumn("bin", at)
    counts = inside.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    every = counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select(F.lit(0).alias("_one"))
    grid = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))  # a row for each bin
    return filled.select(*keys, "bin", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("share"))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their mean over their population deviation (0 where that is 0); the moments are a broadcast row."""
    moments = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(moments))
    scaled = [F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0).alias(c) for c in columns]
    return joined.select(*[c for c in df.columns if c not in columns], *scaled)


def flow_statistics(df: DataFrame, u: str, v: str, keys: Sequence[str], moving_from: float = 1.0, mask: Column | None = None) -> DataFrame:
    """Mean and variance of the magnitude and the moving share of the pixels in the mask; of those that move, the circular
    mean angle in degrees and the upward share (v < 0). Zeros where there are none."""
    magnitude = F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))
    inside = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    moving = inside & (magnitude >= moving_from)
    angle = F.atan2(F.col(v), F.col(u))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(
        zero(F.avg(F.when(inside, magnitude))).alias("mean_magnitude"),
        zero(F.var_pop(F.when(inside, magnitude))).alias("magnitude_variance"),
        zero(F.avg(F.when(inside, moving.cast("int")))).alias("moving_ratio"),
        zero(F.pmod(F.degrees(F.atan2(F.avg(F.when(moving, F.sin(angle))), F.avg(F.when(moving, F.cos(angle))))), F.lit(360.0))).alias("mean_direction"),
        zero(F.avg(F.when(moving, (F.col(v) < 0).cast("int")))).alias("upward_ratio"),
    )


def region_motion(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str], box: str, u: str = "u", v: str = "v", foreground: str = "foreground", moving_from: float = 1.0, most: float = 5.0, size: tuple[int, int] | None = None) -> DataFrame:
    """Motion evidence of each box: (keys, box, mean_magnitude, moving_ratio, upward_ratio, foreground_ratio, dx, dy, score).

    pixels: keys, x, y, flow and a boolean foreground; boxes: keys, box and whole-pixel corners x1, y1, x2, y2, the latter
    two outside. With the frame's size (width, height) corners may be any numbers: they are rounded half to even and held inside.
    Summed-area tables of each frame, by rows and then by columns, and four look-ups a box, so work follows pixels plus boxes;
    places between a frame's outermost pixels that have none are filled in with nothing. Repeated pixels count as often as they
    come, flow that is null not at all; a box that holds flow that is not finite has a mean magnitude, dx and dy of NaN. Boxes
    without pixels have zeros.
    """
    if size is not None:
        corners = clamp_to_frame(F.struct("x1", "y1", "x2", "y2"), *map(F.lit, size))
        boxes = boxes.withColumn("_corners", corners).withColumns({c: F.col("_corners")[c] for c in ("x1", "y1", "x2", "y2")}).drop("_corners")
    keys = list(keys)
    magnitude = F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))
    finite = ~F.isnan(magnitude) & (magnitude < float("inf"))
    moving = magnitude >= moving_from
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    flow = lambda c, where: F.coalesce(F.when(where & finite, c.cast("double")), F.lit(0.0))
    values = {
        "_n": one(magnitude.isNotNull()), "_bad": one(~finite), "_moving": one(moving), "_up": one(moving & (F.col(v) < 0)), "_shown": one(F.col(foreground).isNotNull()),
        "_front": one(F.col(foreground)), "_m": flow(magnitude, F.lit(True)), "_u": flow(F.col(u), moving), "_v": flow(F.col(v), moving),
    }
    placed = pixels.filter("x IS NOT NULL AND y IS NOT NULL").select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *[c.alias(n) for n, c in values.items()])
    ends = placed.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    grid = ends.select(*keys, F.explode(F.sequence("_low_y", "_high_y")).alias("y"), "_low_x", "_high_x").select(*keys, "y", F.explode(F.sequence("_low_x", "_high_x")).alias("x"))
    whole = placed.unionByName(grid.select("*", *[F.lit(0).cast(kind).alias(n) for n, kind in placed.dtypes if n in values]))
    area = whole.groupBy(*keys, "y", "x").agg(*[F.sum(n).alias(n) for n in values])
    for line, along in (("y", "x"), ("x", "y")):
        so_far = Window.partitionBy(*keys, line).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        area = area.select(*keys, "y", "x", *[F.sum(n).over(so_far).alias(n) for n in values])
    edge = lambda c, which: F.least(F.ceil(F.col(c)) - 1, F.col(which)).cast("long")
    x1, y1, x2, y2 = edge("x1", "_high_x"), edge("y1", "_high_y"), edge("x2", "_high_x"), edge("y2", "_high_y")
    looked = F.array(*[F.struct(x.alias("x"), y.alias("y"), F.lit(sign).cast("long").alias("sign")) for x, y, sign in ((x2, y2, 1), (x1, y1, 1), (x1, y2, -1), (x2, y1, -1))])
    some = (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))
    asked = boxes.join(ends, keys, "left").withColumn("_c", F.explode_outer(F.when(some, looked))).select(*keys, box, "_c.*")
    found = asked.join(area, [*keys, "x", "y"], "left").groupBy(*keys, box).agg(*[F.coalesce(F.sum(F.col(n) * F.col("sign")), F.lit(0)).alias(n) for n in values])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    mean = lambda a, b: F.when(F.col("_bad") > 0, F.lit(float("nan"))).otherwise(share(a, b))
    out = found.select(
        *keys, box, mean("_m", "_n").alias("mean_magnitude"), share("_moving", "_n").alias("moving_ratio"), share("_up", "_moving").alias("upward_ratio"), share("_front", "_shown").alias("foreground_ratio"),
        mean("_u", "_moving").alias("dx"), mean("_v", "_moving").alias("dy"),
    )
    score = temporal.motion_score(F.col("mean_magnitude"), F.col("moving_ratio"), F.col("upward_ratio"), F.col("foreground_ratio"), max(most, 1e-6))
    return out.withColumn("score", temporal.clip(score))


# The fitted thresholds of each rule set, as (expression, quantile, least, most).
FIRE_FIT = {
    "red_minus_green_min": ("r - g", 0.25, 0.0, None),
    "green_minus_blue_min": ("g - b", 0.20, -5.0, None),
    "saturation_min": ("saturation", 0.20, 35.0, None),
    "value_min": ("value", 0.15, 70.0, None),
    "cr_min": ("cr", 0.20, 135.0, None),
    "cb_max": ("cb", 0.80, None, 145.0),
    "hue_max": ("hue", 0.75, 15.0, 60.0),
}
SMOKE_FIT = {
    "saturation_max": ("saturation", 0.80, 35.0, 125.0),
    "value_min": ("value", 0.08, 35.0, None),
    "value_max": ("value", 0.98, None, 255.0),
    "cr_deviation_max": ("abs(cr - 128)", 0.85, 12.0, 55.0),
    "cb_deviation_max": ("abs(cb - 128)", 0.85, 12.0, 55.0),
    "red_green_difference_max": ("abs(r - g)", 0.85, 12.0, 65.0),
    "green_blue_difference_max": ("abs(g - b)", 0.85, 12.0, 65.0),
}
#: Hues from here on are red again.
HUE_WRAP = 170.0


def fit_rules(pixels: DataFrame, kind: str, fire, smoke) -> DataFrame:
    """One row with all fitted thresholds, as fire_* and smoke_*. pixels: r, g, b and the channels; kind tells the classes."""
    out = []
    for prefix, label, fit in (("fire_", fire, FIRE_FIT), ("smoke_", smoke, SMOKE_FIT)):
        for name, (expr, q, low, high) in fit.items():
            value = F.percentile(F.when(F.col(kind) == label, F.expr(expr).cast("double")), q)
            value = value if low is None else F.greatest(value, F.lit(low))
            out.append((value if high is None else F.least(value, F.lit(high))).alias(prefix + name))
    return pixels.agg(*out)


def colour_masks(fire_votes: int = 4, smoke_votes: int = 5) -> tuple[Column, Column]:
    """(fire, smoke) for pixels beside a row of fit_rules; red hues wrap, and smoke is cleared under fire."""
    c, t = F.col, F.col
    fire = votes([
        c("r") - c("g") >= t("fire_red_minus_green_min"), c("g") - c("b") >= t("fire_green_minus_blue_min"), c("saturation") >= t("fire_saturation_min"), c("value") >= t("fire_value_min"),
        c("cr") >= t("fire_cr_min"), c("cb") <= t("fire_cb_max"), (c("hue") <= t("fire_hue_max")) | (c("hue") >= HUE_WRAP),
    ]) >= fire_votes
    smoke = votes([
        c("saturation") <= t("smoke_saturation_max"), c("value") >= t("smoke_value_min"), c("value") <= t("smoke_value_max"), F.abs(c("cr") - 128) <= t("smoke_cr_deviation_max"),
        F.abs(c("cb") - 128) <= t("smoke_cb_deviation_max"), F.abs(c("r") - c("g")) <= t("smoke_red_green_difference_max"), F.abs(c("g") - c("b")) <= t("smoke_green_blue_difference_max"),
    ]) >= smoke_votes
    return fire, smoke & ~fire


def frame_evidence(pixels: DataFrame, keys: Sequence[str], u: str = "u", v: str = "v", foreground: str = "foreground", moving_from: float = 1.0) -> DataFrame:
    """Evidence of each frame from its pixels' masks (booleans fire and smoke) and flow: area shares, the foreground's share of
    the candidates, and the flow statistics of the candidates."""
    candidate = F.col("fire") | F.col("smoke")
    areas = pixels.groupBy(*keys).agg(F.avg(F.col("fire").cast("int")).alias("fire_area_ratio"), F.avg(F.col("smoke").cast("int")).alias("smoke_area_ratio"))
    flow = flow_statistics(pixels, u, v, keys, moving_from, candidate)
    flow = flow.select(*keys, F.col("mean_magnitude").alias("mean_flow"), "moving_ratio", "upward_ratio")
    overlap = mask_overlap(pixels, F.col(foreground), candidate, keys).withColumnRenamed("overlap", "foreground_ratio")
    return areas.join(overlap, list(keys)).join(flow, list(keys))


def frame_difference(frames: DataFrame, keys: Sequence[str], frame: str, value: str, pixel: Sequence[str], name: str = "difference") -> DataFrame:
    """A pixel's value minus that in the stream's frame before; null in the first."""
    window = Window.partitionBy(*keys, *pixel).orderBy(frame)
    return frames.withColumn(name, F.col(value) - F.lag(value).over(window))


def mask_overlap(df: DataFrame, foreground: Column, candidate: Column, keys: Sequence[str]) -> DataFrame:
    """The candidates' share that is foreground; 0 without candidates."""
    both = F.sum((foreground & candidate).cast("long"))
    return df.groupBy(*keys).agg((both / F.greatest(F.lit(1), F.sum(candidate.cast("long")))).alias("overlap"))


def reprojection_error(df: DataFrame, view: str, dx: Column, dy: Column) -> DataFrame:
    """(view, error): the norm of all differences over the number of points."""
    return df.groupBy(view).agg((F.sqrt(F.sum(dx * dx + dy * dy)) / F.count("*")).alias("error"))
