"""Streaming queries: the event file as a stream, run to its end, against the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import temporal as operators
from tessera.operators.lineage import cut
from tessera.plans import temporal as plans
from tessera.session import table
from tessera.sources import frame_source as sources
from tessera.streaming import frames, fusion

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as input rows, with a final row for each key."""
    motion = operators.motion_score(F.col("area") / 50, F.col("persistence"), F.lit(0.5), F.lit(0.25))
    voted = operators.with_votes(plans.frames(spark, sf_dir), ["user_id"], "frame", "observed", plans.LENGTH)
    rows = voted.select(F.col("user_id").alias("key"), "frame", "observed", "confidence", "label", "area", (F.col("area") / 1000).alias("ratio"), motion.alias("motion"), F.lit(False).alias("final"))
    ends = rows.groupBy("key").agg((F.max("frame") + 1).alias("frame"))
    zero = F.lit(0.0)
    return rows.union(ends.select("key", "frame", F.lit(False), zero, F.lit(""), zero, zero, zero, F.lit(True)))


def _shown(found: DataFrame) -> DataFrame:
    return found.select(F.col("key").alias("user_id"), "label", "start_frame", "end_frame", "peak_risk", F.round("peak_confidence", 6).alias("peak_confidence"), "peak_risk_level")


def batch_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fusion.batch_events(_numbered(spark, sf_dir)))


def stream_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches of the frames through the stateful processor."""
    from tessera.operators import lineage

    scratch = f"{lineage.folder(spark)}/stream-{uuid.uuid4().hex}"
    # Earlier files hold each key's earlier frames, so events run over micro-batches; files are read in the order of writing.
    rows = _numbered(spark, sf_dir)
    halves = cut(rows.withColumn("late", F.col("frame") > F.max("frame").over(Window.partitionBy("key")) / 2))
    for late in (False, True):
        halves.filter(F.col("late") == late).drop("late").repartition("key").write.mode("append").parquet(f"{scratch}/in")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(fusion.INPUT).option("maxFilesPerTrigger", 4).parquet(f"{scratch}/in")
        query = fusion.stream_events(stream).writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept) if kept else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = spark.read.schema(fusion.EVENTS).parquet(f"{scratch}/out")
    return _shown(found)


#: Size of the made-up frames, and frames of a stream that a micro-batch of the streaming form holds.
WIDTH, HEIGHT, RANGE = 8, 6, 24
_END = "~"
#: Factors with so many digits that no result lies halfway between two rounded ones.
SLOWNESS, SURENESS = 53.718281828, 0.93718462539


def frame_source(spark: SparkSession, sf_dir: str, is_dealt: bool = False) -> DataFrame:
    """Frames of each user as a stream: sightings are detections of one box, the flow is the same all over a frame.

    is_dealt: by stream and in order, before planes are drawn, so that only the events' few bytes are shuffled.
    """
    rows = plans.frames(spark, sf_dir).select(F.col("user_id").cast("string").alias("stream"), F.col("frame").alias("frame_index"), "*")
    rows = frames.by_stream(rows) if is_dealt else rows
    left, top = F.col("user_id") % 3, F.col("user_id") % 2
    seen = lambda *values: F.when(F.col("observed"), F.array(*values))
    down = F.col("area") / SLOWNESS * F.when(F.col("event_id") % 3 != 0, -1.0).otherwise(1.0)
    plane = lambda value: F.when(F.col("frame") > 1, F.array_repeat(value.cast("double"), WIDTH * HEIGHT))
    return rows.select(
        "stream", "frame_index", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame")).alias("at"), (F.col("frame") / 25).alias("seconds"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), seen(*(x.cast("double") for x in (left, top, left + 4, top + 3))).alias("boxes"), seen((F.col("user_id") % 2).cast("int")).alias("classes"),
        seen("label").alias("labels"), seen(F.col("confidence") * SURENESS).alias("confidences"), plane(F.lit(0)).alias("u"), plane(down).alias("v"), plane(F.col("event_id") % 2).alias("foreground"),
    )


def _frame_columns(found: DataFrame) -> DataFrame:
    """Without the two times of processing, which differ from run to run."""
    return frames.frame_rows(found).drop("processing_latency_ms", "processing_fps")


def _event_columns(found: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("start_seconds", "end_seconds", "peak_risk", "peak_confidence")}
    return frames.event_rows(found).withColumns(rounded)


def fused_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every track in every frame."""
    return _frame_columns(frames.batch_frames(frame_source(spark, sf_dir, True), is_dealt=True))


def fused_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_columns(frames.batch_frames(frame_source(spark, sf_dir, True), is_dealt=True))


def run_frames(spark: SparkSession, source: DataFrame) -> DataFrame:
    """The frames as micro-batches of RANGE frames of each stream, run to their end; a last frame far ahead moves the
    watermark on, so that timers end what is open."""
    from tessera.operators import lineage

    scratch = f"{lineage.folder(spark)}/frames-{uuid.uuid4().hex}"
    ranged = cut(source.withColumn("range", F.floor((F.col("frame_index") - 1) / RANGE)))
    last, latest = ranged.agg(F.max("range"), F.max("at")).first()
    columns = [c.split()[0] for c in frames.INPUT.split(", ")]
    for n in range((-1 if last is None else last) + 1):
        ranged.filter(F.col("range") == n).select(columns).repartition("stream").write.mode("append").parquet(f"{scratch}/in")
    kinds = [c.split() for c in frames.INPUT.split(", ")]
    ends = {"stream": F.lit(_END), "frame_index": F.lit(0), "at": F.lit(latest) + F.expr("INTERVAL 1 DAY"), "seconds": F.lit(0), "width": F.lit(1), "height": F.lit(1)}
    spark.range(1).select(*(ends.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds)).write.mode("append").parquet(f"{scratch}/in")
    own = spark.newSession()  # the stream's settings stay its own
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = own.readStream.schema(frames.INPUT).option("maxFilesPerTrigger", files).parquet(f"{scratch}/in")
    found = frames.stream_frames(stream)
    query = found.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frames.OUTPUT).parquet(f"{scratch}/out").filter(F.col("stream") != _END)


def fused_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the same frames as a stream."""
    return _event_columns(run_frames(spark, frame_source(spark, sf_dir)))


#: The most frames of a stream that read_frames takes.
MOST_FRAMES = 40


def read_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as files of JSON lines, read again by the data source for frames; a rate of 0 gives way to another."""
    from tessera.operators import lineage

    path = f"{lineage.folder(spark)}/lines-{uuid.uuid4().hex}"
    rows = frame_source(spark, sf_dir).withColumn("frame_index", F.col("frame_index") - 1).withColumn("rate", F.when(F.col("stream").cast("long") % 2 == 0, 50).otherwise(0))
    line = F.struct("stream", "frame_index", "rate", "width", "height", F.when(F.col("boxes").isNotNull(), F.array("boxes")).alias("boxes"), "classes", "labels", "confidences", "v")
    rows.select(F.to_json(line)).write.text(path)
    sources.register(spark)
    found = spark.read.format("frames").option("max_frames", MOST_FRAMES).option("fallback_rate", 25).load(path)
    return found.select("stream", "frame_index", F.round("seconds", 6).alias("seconds"), F.round(F.element_at("confidences", 1), 6).alias("confidence"), F.element_at("labels", 1).alias("label"), F.coalesce(F.size("v"), F.lit(0)).alias("pixels"))


def label_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file for each customer in a tree by market segment, written by the data source for label trees and read again."""
    from tessera.operators import lineage

    path = f"{lineage.folder(spark)}/tree-{uuid.uuid4().hex}"
    split = F.lower(F.coalesce("c_mktsegment", F.lit("none")))
    text = F.concat(F.col("c_nationkey").cast("string"), F.lit(" "), "c_name", F.lit("\n"))
    sources.write_label_tree(table(spark, sf_dir, "customer").select(split.alias("split"), F.col("c_custkey").cast("string").alias("name"), text.alias("text")), path)
    return sources.read_label_tree(spark, path)


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows, the batch form of a watermarked aggregate."""
    events = table(spark, sf_dir, "events")
    window = F.window(F.col("ts").cast("timestamp"), "6 hours")
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


_EVENTS = f"{plans._ALL}{plans._E} SELECT user_id, label, start_frame, end_frame, peak_risk, peak_confidence, peak_risk_level FROM e"
_TRACKS = f"""WITH {plans._F},
o AS (SELECT user_id, frame, CASE WHEN frame - lag(frame) OVER w <= 9 THEN 0 ELSE 1 END AS fresh FROM f WHERE observed WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
p AS (SELECT f.*, sum(coalesce(fresh, 0)) OVER w AS track, max(CASE WHEN observed THEN frame END) OVER w AS seen FROM f LEFT JOIN o USING (user_id, frame) WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
q AS (SELECT *, sum(observed::INT) OVER (PARTITION BY user_id, track ORDER BY frame) AS all_hits FROM p WHERE track > 0),
t AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, track ORDER BY frame) AS segment FROM q WHERE frame - seen <= 8 AND (all_hits >= 2 OR frame = seen)),
v AS (SELECT *, sum(observed::INT) OVER w AS hits, count(*) OVER w AS held, list_filter(list(CASE WHEN observed THEN confidence * {SURENESS}::DOUBLE END) OVER (PARTITION BY user_id, track, segment ORDER BY frame), lambda z: z IS NOT NULL) AS told,
  CASE WHEN frame = 1 THEN 0::DOUBLE ELSE area / {SLOWNESS}::DOUBLE END AS mean FROM t WINDOW w AS (PARTITION BY user_id, track, segment ORDER BY frame ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, coalesce({plans._FOLD.format("told", 0.4, 0.6)}, 0) AS smoothed, hits / held::DOUBLE AS persistence, (mean >= 1)::INT::DOUBLE AS moving, (mean >= 1 AND event_id % 3 <> 0)::INT::DOUBLE AS upward, CASE WHEN frame = 1 THEN 0 ELSE event_id % 2 END::DOUBLE AS foreground FROM v),
m AS (SELECT *, hits >= CASE label WHEN 'fire' THEN 3 ELSE 4 END AND smoothed >= 0.25::DOUBLE AS confirmed, 0.35::DOUBLE * least(1, mean / 5) + 0.35::DOUBLE * moving + 0.15::DOUBLE * upward + 0.15::DOUBLE * foreground AS motion FROM s),
r0 AS (SELECT *, least(1, 0.35::DOUBLE * least(greatest(smoothed, 0), 1) + 0.2::DOUBLE * persistence + 0.15::DOUBLE * least(motion, 1) + 0.15::DOUBLE) AS risk FROM m),
r AS (SELECT *, CASE WHEN risk >= 0.8::DOUBLE THEN 'CRITICAL' WHEN risk >= 0.6::DOUBLE THEN 'HIGH' WHEN risk >= 0.3::DOUBLE THEN 'MODERATE' ELSE 'LOW' END AS level FROM r0)"""
_FRAMES = f"""{_TRACKS} SELECT user_id::VARCHAR AS stream, frame AS frame_index, round(frame / 25::DOUBLE, 6) AS timestamp_seconds, track::BIGINT AS track_id, (user_id % 2)::INT AS class_id, label, observed::INT AS observed,
(user_id % 3)::DOUBLE AS x1, (user_id % 2)::DOUBLE AS y1, (user_id % 3 + 4)::DOUBLE AS x2, (user_id % 2 + 3)::DOUBLE AS y2, CASE WHEN confirmed THEN 'CONFIRMED_' ELSE 'POSSIBLE_' END || upper(label) AS state, confirmed::INT AS confirmed,
round(smoothed, 6) AS smoothed_confidence, round(persistence, 6) AS persistence, round(least(motion, 1), 6) AS motion_score, round(mean, 6) AS mean_motion, moving AS moving_pixel_ratio, upward AS upward_motion_ratio, foreground AS foreground_ratio,
0.25::DOUBLE AS area_ratio, 0::DOUBLE AS growth_ratio, round(risk, 6) AS risk_score, level AS risk_level FROM r"""
_FUSED = f"""{_TRACKS}, i AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, track ORDER BY frame) AS run FROM r WHERE confirmed),
e AS (SELECT user_id, track, label, min(frame) AS start_frame, max(frame) + 1 AS end_frame, max(risk) AS peak_risk, max(smoothed) AS peak_confidence, max_by(level, {{'a': risk, 'b': frame}}) AS peak_risk_level FROM i GROUP BY user_id, track, label, run)
SELECT user_id::VARCHAR AS stream, row_number() OVER (PARTITION BY user_id ORDER BY start_frame) AS event_id, track::BIGINT AS track_id, label, start_frame, round(start_frame / 25::DOUBLE, 6) AS start_seconds, end_frame, round(end_frame / 25::DOUBLE, 6) AS end_seconds,
round(peak_risk, 6) AS peak_risk, round(peak_confidence, 6) AS peak_confidence, peak_risk_level FROM e"""
QUERIES = {f.__name__: f for f in (batch_fusion, stream_fusion, fused_frames, fused_events, fused_stream, read_frames, label_tree, hourly_windows)}
ORACLES = {
    "batch_fusion": _EVENTS,
    "stream_fusion": _EVENTS,
    "fused_frames": _FRAMES,
    "fused_events": _FUSED,
    "fused_stream": _FUSED,
    "read_frames": f"""WITH {plans._F} SELECT user_id::VARCHAR AS stream, frame - 1 AS frame_index, round((frame - 1) / CASE WHEN user_id % 2 = 0 THEN 50 ELSE 25 END::DOUBLE, 6) AS seconds,
round(CASE WHEN observed THEN confidence * {SURENESS}::DOUBLE END, 6) AS confidence, CASE WHEN observed THEN label END AS label, CASE WHEN frame > 1 THEN {WIDTH * HEIGHT} ELSE 0 END AS pixels FROM f WHERE frame <= {MOST_FRAMES}""",
    "label_tree": "SELECT lower(coalesce(c_mktsegment, 'none')) AS split, c_custkey::VARCHAR AS name, c_nationkey || ' ' || c_name || chr(10) AS text FROM customer",
    "hourly_windows": "SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
