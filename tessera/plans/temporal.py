"""Temporal queries over events: a user is a track, its events in time order are frames, purchases and errors are sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import temporal
from tessera.session import table

LENGTH, ALPHA, LEAST = 8, 0.4, 0.25
NEEDS = {"fire": 3, "smoke": 4}


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", number.alias("frame"), F.col("event_type").isin("purchase", "error").alias("observed"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), F.when(F.col("user_id") % 2 == 0, "fire").otherwise("smoke").alias("label"), F.abs("value").alias("area"),
    )


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id"]
    voted = temporal.with_votes(frames(spark, sf_dir), keys, "frame", "observed", LENGTH)
    smooth = temporal.with_smoothed(voted, keys, "frame", "confidence", "observed", ALPHA)
    grown = temporal.with_growth(smooth, keys, "frame", "area")
    flagged = grown.withColumn("confirmed", temporal.confirmed(F.col("label"), F.col("hits"), F.col("smoothed"), NEEDS, LEAST))
    motion = temporal.motion_score(F.col("area") / 50, F.col("persistence"), F.lit(0.5), F.lit(0.25))
    score = temporal.risk_score(F.coalesce("smoothed", F.lit(0.0)), F.col("persistence"), motion, F.col("area") / 1000, F.col("growth"))
    scored = flagged.withColumn("risk", F.round(score, 9))
    return scored.withColumn("level", temporal.risk_level(F.col("risk")))


def nofm_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = temporal.with_votes(frames(spark, sf_dir), ["user_id"], "frame", "observed", LENGTH)
    return voted.select("event_id", "hits", "window_length", F.round("persistence", 6).alias("persistence"))


def ema_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.with_smoothed(frames(spark, sf_dir), ["user_id"], "frame", "confidence", "observed", ALPHA).select("event_id", F.round("smoothed", 6).alias("smoothed"))


def growth_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.with_growth(frames(spark, sf_dir), ["user_id"], "frame", "area").select("event_id", F.round("growth", 6).alias("growth"))


def state_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fused(spark, sf_dir)
    before = F.lag("confirmed", 1, False).over(Window.partitionBy("user_id").orderBy("frame"))
    return rows.select("event_id", temporal.state(F.col("label"), F.col("confirmed")).alias("state"), (F.col("confirmed") != before).alias("flipped"))


def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames after every fifth event is left out."""
    kept = frames(spark, sf_dir).filter(F.col("event_id") % 5 != 0)
    return temporal.with_segments(kept, ["user_id"], "frame").select("event_id", "frame", "segment")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.events(fused(spark, sf_dir), ["user_id"], "frame", "confirmed", "risk", "level", "smoothed", "label")
    return found.select("user_id", "label", "start_frame", "end_frame", "peak_risk", F.round("peak_confidence", 6).alias("peak_confidence"), "peak_risk_level")


def events_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_sessions(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.max("peak_risk").alias("peak_risk"))


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("event_id", "risk", "level")


def trailing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.trailing(frames(spark, sf_dir), ["user_id"], "frame", "event_id", 5, "last")
    return rows.select("event_id", F.array_join(F.transform("last", lambda x: x.cast("string")), ",").alias("last_events"))


def stale_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of a user's first ten frames without a sighting after frame 62."""
    rows = frames(spark, sf_dir)
    return rows.filter("frame <= 10").select("user_id").distinct().join(rows.filter("frame > 62 AND observed").select("user_id").distinct(), "user_id", "left_anti")


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of a monthly revenue series for each priority after three months without a new best."""
    orders = table(spark, sf_dir, "orders")
    months = orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    marked = temporal.early_stop(months, "month", "revenue", 3, ["o_orderpriority"])
    return marked.select("o_orderpriority", "month", "improved", "stale", "stopped")


def fps_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate between a user's events, smoothed 0.9 to 0.1 and seeded by the first."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(window).cast("timestamp"))) / 1e6
    rows = table(spark, sf_dir, "events").withColumn("rate", F.when(seconds > 0, 1 / seconds)).withColumn("frame", F.row_number().over(window)).withColumn("has", F.col("rate").isNotNull())
    return temporal.with_smoothed(rows, ["user_id"], "frame", "rate", "has", 0.1).select("event_id", F.round(F.col("smoothed") * 1000, 6).alias("per_1000_s"))


_F = "f AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, event_type IN ('purchase', 'error') AS observed, least(value / 100::DOUBLE, 1::DOUBLE) AS confidence, CASE WHEN user_id % 2 = 0 THEN 'fire' ELSE 'smoke' END AS label, abs(value) AS area FROM events)"
_V = f"v AS (SELECT *, (sum(observed::INT) OVER w)::BIGINT AS hits, count(*) OVER w AS window_length FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW))"
_FOLD = "CASE WHEN len({0}) = 0 THEN NULL ELSE list_reduce({0}, lambda a, x: {1}::DOUBLE * x + {2}::DOUBLE * a) END"
_S = f"""s0 AS (SELECT *, hits / window_length::DOUBLE AS persistence, list_filter(list(CASE WHEN observed THEN confidence END) OVER o, lambda z: z IS NOT NULL) AS seen, lag(area) OVER o AS before FROM v WINDOW o AS (PARTITION BY user_id ORDER BY frame)),
s AS (SELECT * EXCLUDE (seen, before), {_FOLD.format('seen', ALPHA, 1 - ALPHA)} AS smoothed, CASE WHEN before IS NULL OR before <= 0 THEN 0 ELSE (area - before) / before END AS growth FROM s0),
c AS (SELECT *, hits >= CASE label WHEN 'fire' THEN 3 ELSE 4 END AND coalesce(smoothed, 0) >= {LEAST} AS confirmed, 0.35::DOUBLE * least(1, area / 50 / 5::DOUBLE) + 0.35::DOUBLE * persistence + 0.15::DOUBLE * 0.5::DOUBLE + 0.15::DOUBLE * 0.25::DOUBLE AS motion FROM s),
r0 AS (SELECT *, round(least(greatest(least(greatest(coalesce(smoothed, 0), 0), 1) * 0.35::DOUBLE + least(greatest(persistence, 0), 1) * 0.2::DOUBLE + least(greatest(motion, 0), 1) * 0.15::DOUBLE + least(greatest(area / 1000 / 0.15::DOUBLE, 0), 1) * 0.15::DOUBLE + least(greatest(greatest(growth, 0) / 0.5::DOUBLE, 0), 1) * 0.15::DOUBLE, 0), 1), 9) AS risk FROM c),
r AS (SELECT *, CASE WHEN risk >= 0.8::DOUBLE THEN 'CRITICAL' WHEN risk >= 0.6::DOUBLE THEN 'HIGH' WHEN risk >= 0.3::DOUBLE THEN 'MODERATE' ELSE 'LOW' END AS level FROM r0)"""
_ALL = f"WITH {_F}, {_V}, {_S}"
_E = """, i AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM r WHERE confirmed),
e AS (SELECT user_id, min_by(label, frame) AS label, min(frame) AS start_frame, max(frame) + 1 AS end_frame, max(risk) AS peak_risk, round(max(smoothed), 6) AS peak_confidence, max_by(level, {'a': risk, 'b': frame}) AS peak_risk_level FROM i GROUP BY user_id, run)"""

QUERIES = {f.__name__: f for f in (nofm_vote, ema_hold, growth_lag, state_flip, track_segments, event_sessions, events_by_class, risk_score, trailing_history, stale_states, early_stop, fps_smoothed)}
ORACLES = {
    "nofm_vote": f"WITH {_F}, {_V} SELECT event_id, hits, window_length, round(hits / window_length::DOUBLE, 6) AS persistence FROM v",
    "ema_hold": f"{_ALL} SELECT event_id, round(smoothed, 6) AS smoothed FROM s",
    "growth_lag": f"{_ALL} SELECT event_id, round(growth::DOUBLE, 6) AS growth FROM s",
    "state_flip": f"{_ALL} SELECT event_id, CASE WHEN confirmed THEN 'CONFIRMED_' ELSE 'POSSIBLE_' END || CASE label WHEN 'fire' THEN 'FIRE' ELSE 'SMOKE' END AS state, confirmed <> lag(confirmed, 1, false) OVER (PARTITION BY user_id ORDER BY frame) AS flipped FROM r",
    "track_segments": f"WITH {_F} SELECT event_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS segment FROM f WHERE event_id % 5 <> 0",
    "event_sessions": f"{_ALL}{_E} SELECT * FROM e",
    "events_by_class": f"{_ALL}{_E} SELECT label, count(*) AS n, max(peak_risk) AS peak_risk FROM e GROUP BY label",
    "risk_score": f"{_ALL} SELECT event_id, risk, level FROM r",
    "trailing_history": f"WITH {_F} SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS last_events FROM f",
    "stale_states": f"WITH {_F} SELECT DISTINCT user_id FROM f WHERE frame <= 10 AND user_id NOT IN (SELECT user_id FROM f WHERE frame > 62 AND observed)",
    "early_stop": """WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER w AS n, max(revenue) OVER (PARTITION BY o_orderpriority ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)),
b AS (SELECT *, before IS NULL OR revenue > before + 1e-6::DOUBLE AS improved FROM a),
c AS (SELECT *, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY o_orderpriority ORDER BY month) AS stale FROM b)
SELECT o_orderpriority, month, improved, stale, bool_or(stale >= 3) OVER (PARTITION BY o_orderpriority ORDER BY month) AS stopped FROM c""",
    "fps_smoothed": f"""WITH g AS (SELECT event_id, user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6::DOUBLE AS sec FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT event_id, list_filter(list(CASE WHEN sec > 0 THEN 1 / sec END) OVER (PARTITION BY user_id ORDER BY ts, event_id), lambda z: z IS NOT NULL) AS seen FROM g)
SELECT event_id, round(({_FOLD.format('seen', 0.1, 0.9)}) * 1000, 6) AS per_1000_s FROM h""",
}
