"""The fused frame stream: tracker, votes, motion, growth, risk and events of a stream's frames in one stateful operator.

A row is a frame with its detections and, if there are any, its flow and foreground (row by row). A frame's tracks give rows
of evidence: the 25 FRAME columns. A track that a frame doesn't report (not enough hits, and not seen) loses its votes, its
smoothed confidence and its last area, so it starts a new segment; its event ends.

The streaming form keeps a stream's live tracks in a map state and its counters in a value state. Frames must come in order
across micro-batches and are sorted within one. A frame at or before one that was processed changes nothing and comes out as
a `late` row; frames behind the watermark are dropped by the engine, which counts them. When the watermark passes a stream's
last frame by `quiet`, a timer ends its events and tracks, as the end of a finite stream does in the batch form; frames that
come later begin new tracks, with numbers that go on.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import temporal
from tessera.operators.tracking import Kalman, Track, Tracker, TrackerOptions, changes, dealt
from tessera.sources.config import FusionOptions

#: boxes: four corners for each detection; u, v and foreground: height * width numbers, or null.
INPUT = "stream string, frame_index long, at timestamp, seconds double, width int, height int, boxes array<double>, classes array<int>, labels array<string>, confidences array<double>, u array<double>, v array<double>, foreground array<double>"
FRAME = (
    "frame_index long, timestamp_seconds double, track_id long, class_id int, label string, observed int, x1 double, y1 double, x2 double, y2 double, state string, confirmed int, smoothed_confidence double, "
    "persistence double, motion_score double, mean_motion double, moving_pixel_ratio double, upward_motion_ratio double, foreground_ratio double, area_ratio double, growth_ratio double, risk_score double, risk_level string, "
    "processing_latency_ms double, processing_fps double"
)
EVENT = "event_id long, start_frame long, start_seconds double, end_frame long, end_seconds double, peak_risk double, peak_confidence double, peak_risk_level string"
#: rec: frame, event or late; a frame has no EVENT columns, an event of FRAME only track_id and label, a late frame its index.
OUTPUT = f"rec string, stream string, {FRAME}, {EVENT}"
TRACK = (
    "class_id int, label string, confidence double, observed boolean, age long, hits long, missed long, place array<double>, speed array<double>, spread array<double>, votes string, smoothed double, area double, "
    "event_id long, start_frame long, start_seconds double, peak_risk double, peak_confidence double, peak_risk_level string"
)
CLOCK = "next_track long, next_event long, last_frame long, last_seconds double, step double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _clip(value: float) -> float:
    return min(max(value, 0.0), 1.0)


@dataclass
class Motion:
    mean: float = 0.0
    moving: float = 0.0
    upward: float = 0.0
    foreground: float = 0.0
    score: float = 0.0


@dataclass
class Event:
    event_id: int
    start_frame: int
    start_seconds: float
    peak_risk: float = 0.0
    peak_confidence: float = 0.0
    peak_risk_level: str = "LOW"


@dataclass
class Memory:
    """What is remembered of a track beside its filter; votes and what follows go when a frame doesn't report it."""

    label: str
    votes: str = ""
    smoothed: float | None = None
    area: float | None = None
    event: Event | None = None


def motion_in(box: Sequence[float], u: np.ndarray | None, v: np.ndarray | None, foreground: np.ndarray | None, moving_from: float = 1.0, most: float = 5.0) -> Motion:
    """Evidence of the whole pixels in a box: corners are rounded half to even and kept to the frame. Planes: height x width."""
    plane = u if u is not None else foreground
    if plane is None:
        return Motion()
    x1, y1, x2, y2 = (min(max(round(c), 0), plane.shape[1 - i % 2]) for i, c in enumerate(map(float, box)))
    if x2 <= x1 or y2 <= y1:
        return Motion()
    out = Motion()
    if u is not None and v is not None:
        across, down = u[y1:y2, x1:x2], v[y1:y2, x1:x2]
        size = np.sqrt(across**2 + down**2)
        moving = size >= moving_from
        n = int(np.count_nonzero(moving))
        out.mean, out.moving = float(size.mean()), n / moving.size
        out.upward = int(np.count_nonzero(moving & (down < 0))) / n if n else 0.0
    if foreground is not None:
        inside = foreground[y1:y2, x1:x2] > 0
        out.foreground = int(np.count_nonzero(inside)) / inside.size
    out.score = _clip(0.35 * min(1.0, out.mean / max(most, 1e-6)) + 0.35 * out.moving + 0.15 * out.upward + 0.15 * out.foreground)
    return out


def risk_of(smoothed: float, persistence: float, motion: float, area_ratio: float, growth: float, options: FusionOptions) -> tuple[float, str]:
    parts = {
        "confidence": smoothed, "persistence": persistence, "motion": motion,
        "area": area_ratio / max(temporal.AREA_SATURATION, 1e-6), "growth": growth / max(temporal.GROWTH_SATURATION, 1e-6),
    }
    score = _clip(sum(options.weights[k] * _clip(x) for k, x in parts.items()))
    moderate, high, critical = options.levels
    return score, "CRITICAL" if score >= critical else "HIGH" if score >= high else "MODERATE" if score >= moderate else "LOW"


class Engine:
    """One stream's tracks and events, frame by frame."""

    def __init__(self, options: FusionOptions | None = None, tracker: TrackerOptions | None = None):
        self.options, self.tracker = options or FusionOptions(), Tracker(tracker, history=1)
        self.memory: dict[int, Memory] = {}
        self.next_event, self.last_frame, self.last_seconds, self.step = 1, -1, 0.0, 0.0

    def _end(self, number: int, frame: int, seconds: float) -> dict:
        memory = self.memory[number]
        event, memory.event = memory.event, None
        return {"rec": "event", "track_id": number, "label": memory.label, "end_frame": frame, "end_seconds": seconds, **asdict(event)}

    def frame(self, index: int, seconds: float, width: int, height: int, boxes: np.ndarray, classes: np.ndarray, labels: list[str], confidences: np.ndarray, planes: tuple) -> list[dict]:
        began, rows = time.perf_counter(), []
        tracks = self.tracker.update(boxes, classes, confidences)
        for t in self.tracker.tracks:
            if t.number not in self.memory:
                self.memory[t.number] = Memory(labels[t.detection])
        for t in tracks:
            m = self.memory[t.number]
            m.votes = (m.votes + str(int(t.observed)))[-self.options.window :]
            if t.observed:
                m.smoothed = t.confidence if m.smoothed is None else self.options.alpha * t.confidence + (1 - self.options.alpha) * m.smoothed
            hits, smoothed = m.votes.count("1"), m.smoothed or 0.0
            persistence = hits / len(m.votes)
            is_confirmed = hits >= (self.options.fire_hits if m.label == "fire" else self.options.smoke_hits) and smoothed >= self.options.least_confidence
            x1, y1, x2, y2 = box = t.filter.corners()
            motion = motion_in(box, *planes)
            area = max(0.0, x2 - x1) * max(0.0, y2 - y1)
            ratio = area / max(1.0, float(width * height))
            growth = 0.0 if m.area is None or m.area <= 0 else (area - m.area) / m.area
            m.area = area
            risk, level = risk_of(smoothed, persistence, motion.score, ratio, growth, self.options)
            if is_confirmed:
                if m.event is None:
                    m.event, self.next_event = Event(self.next_event, index, seconds), self.next_event + 1
                if risk >= m.event.peak_risk:
                    m.event.peak_risk, m.event.peak_risk_level = risk, level
                m.event.peak_confidence = max(m.event.peak_confidence, smoothed)
            elif m.event is not None:
                rows.append(self._end(t.number, index, seconds))
            rows.append({
                "rec": "frame", "frame_index": index, "timestamp_seconds": round(seconds, 6), "track_id": t.number, "class_id": t.class_id, "label": m.label, "observed": int(t.observed),
                **{k: round(x, 3) for k, x in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)},
                "state": f"{'CONFIRMED' if is_confirmed else 'POSSIBLE'}_{'FIRE' if m.label == 'fire' else 'SMOKE'}", "confirmed": int(is_confirmed), "smoothed_confidence": round(smoothed, 6), "persistence": round(persistence, 6),
                "motion_score": round(motion.score, 6), "mean_motion": round(motion.mean, 6), "moving_pixel_ratio": round(motion.moving, 6), "upward_motion_ratio": round(motion.upward, 6), "foreground_ratio": round(motion.foreground, 6),
                "area_ratio": round(ratio, 6), "growth_ratio": round(growth, 6), "risk_score": round(risk, 6), "risk_level": level,
            })
        shown, live = {t.number for t in tracks}, {t.number for t in self.tracker.tracks}
        for number, m in self.memory.items():
            if number not in shown:
                if m.event is not None:
                    rows.append(self._end(number, index, seconds))
                m.votes, m.smoothed, m.area = "", None, None
        self.memory = {n: m for n, m in self.memory.items() if n in live}
        self.step = seconds - self.last_seconds if self.last_frame >= 0 else 0.0
        self.last_frame, self.last_seconds = index, seconds
        took = (time.perf_counter() - began) * 1000
        for row in rows:
            if row["rec"] == "frame":
                row |= {"processing_latency_ms": round(took, 6), "processing_fps": round(1000 / max(took, 1e-6), 6)}
        return rows

    def finish(self) -> list[dict]:
        """Ends all events and tracks, a step after the last frame."""
        rows = [self._end(n, self.last_frame + 1, self.last_seconds + self.step) for n, m in self.memory.items() if m.event is not None]
        self.memory, self.tracker.tracks = {}, []
        return rows

    def run(self, rows: pd.DataFrame) -> list[dict]:
        """A stream's next frames, in any order."""
        out: list = []
        for r in rows.sort_values("frame_index", kind="stable")[_names(INPUT)].itertuples(index=False):
            if r.frame_index <= self.last_frame:
                out.append({"rec": "late", "frame_index": r.frame_index})
                continue
            listed = lambda x, kind=float: np.asarray([] if x is None else x, kind)
            planes = tuple(None if p is None else listed(p).reshape(r.height, r.width) for p in (r.u, r.v, r.foreground))
            labels = [] if r.labels is None else list(r.labels)
            out += self.frame(int(r.frame_index), float(r.seconds), int(r.width), int(r.height), listed(r.boxes).reshape(-1, 4), listed(r.classes, np.int64), labels, listed(r.confidences), planes)
        return out

    def clock(self) -> tuple:
        return self.tracker.next_number, self.next_event, self.last_frame, self.last_seconds, self.step

    def set_clock(self, clock: tuple) -> None:
        self.tracker.next_number, self.next_event, self.last_frame, self.last_seconds, self.step = clock

    def kept(self) -> Iterator[tuple[int, tuple]]:
        """Each live track as a row of TRACK."""
        for t in self.tracker.tracks:
            f, m = t.filter, self.memory[t.number]
            event = [getattr(m.event, x.name) for x in fields(Event)] if m.event else [None] * len(fields(Event))
            yield t.number, (t.class_id, m.label, t.confidence, t.observed, t.age, t.hits, t.missed, f.at, f.speed, [float(f.place), float(f.both), float(f.rate)], m.votes, m.smoothed, m.area, *event)

    def restore(self, number: int, row: tuple) -> None:
        class_id, label, confidence, observed, age, hits, missed, place, speed, spread, votes, smoothed, area, *event = row
        f = Kalman([0.0, 0.0, 1.0, 1.0], self.tracker.options)
        f.at, f.speed = [float(x) for x in place], [float(x) for x in speed]
        f.place, f.both, f.rate = spread
        self.tracker.tracks.append(Track(number, f, class_id, confidence, observed, age, hits, missed))
        self.memory[number] = Memory(label, votes or "", smoothed, area, Event(*event) if event[0] is not None else None)


_PLACES = {c: i for i, c in enumerate(_names(OUTPUT))}


def _frame(rows: list[dict], stream: str | np.ndarray) -> pd.DataFrame:
    """stream: the rows' stream, or one for each row. Values stay objects: a stream's few rows aren't worth 34 typed columns."""
    out = np.full((len(rows), len(_PLACES)), None, object)
    for values, row in zip(out, rows, strict=True):
        for name, value in row.items():
            values[_PLACES[name]] = value
    out[:, _PLACES["stream"]] = stream
    return pd.DataFrame(out, columns=list(_PLACES))


class FrameProcessor(StatefulProcessor):
    """The engine of each stream, rebuilt from its state for the frames of a micro-batch. quiet: in milliseconds."""

    def __init__(self, options: FusionOptions, tracker: TrackerOptions, quiet: int):
        self.options, self.tracker, self.quiet = options, tracker, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "track long", TRACK)
        self.counters = handle.getValueState("clock", CLOCK)

    def _engine(self) -> Engine:
        engine = Engine(self.options, self.tracker)
        if self.counters.exists():
            engine.set_clock(tuple(self.counters.get()))
        for number, row in sorted((k[0], tuple(row)) for k, row in self.tracks.iterator()):
            engine.restore(number, row)
        return engine

    def _keep(self, engine: Engine) -> None:
        before, now = {k[0] for k in self.tracks.keys()}, dict(engine.kept())
        for number in before - now.keys():
            self.tracks.removeKey((number,))
        for number, row in now.items():
            self.tracks.updateValue((number,), row)
        self.counters.update(engine.clock())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frames, engine = pd.concat(list(rows)), self._engine()
        out = engine.run(frames)
        self._keep(engine)
        due = int(frames["at"].max().timestamp() * 1000) + self.quiet
        for timer in list(self.handle.listTimers()):
            due = max(due, timer)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        yield _frame(out, key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        engine = self._engine()
        out = engine.finish()
        self._keep(engine)
        yield _frame(out, key[0])

    def close(self) -> None:
        pass


def stream_frames(frames: DataFrame, options: FusionOptions | None = None, tracker: TrackerOptions | None = None, late: str = "10 seconds", quiet_seconds: float = 30.0) -> DataFrame:
    """OUTPUT rows of a stream of INPUT rows. late: how far behind the latest frame others may come."""
    processor = FrameProcessor(options or FusionOptions(), tracker or TrackerOptions(), int(quiet_seconds * 1000))
    return frames.select(_names(INPUT)).withWatermark("at", late).groupBy("stream").transformWithStateInPandas(processor, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def by_stream(frames: DataFrame) -> DataFrame:
    """Frames dealt to all cores by stream, in order, as batch_frames takes them; columns may be missing, or derived afterwards."""
    return dealt(frames, "stream", ["frame_index"])


def batch_frames(frames: DataFrame, options: FusionOptions | None = None, tracker: TrackerOptions | None = None, is_dealt: bool = False) -> DataFrame:
    """The same over whole streams; all events end with their stream. A stream's frames pass in batches, none is gathered.

    is_dealt: the frames come from by_stream, and their planes, if they are derived, needn't be shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, own = None, None
        for found in batches:
            parts, streams = [], found["stream"].to_numpy(object)
            cuts = np.flatnonzero(changes(streams))
            for a, b in zip(cuts, np.append(cuts[1:], len(streams)), strict=True):
                if engine is None or streams[a] != own:
                    if engine is not None:
                        parts.append((own, engine.finish()))
                    engine, own = Engine(options, tracker), streams[a]
                parts.append((own, engine.run(found.iloc[a:b])))
            yield _frame([r for _, rows in parts for r in rows], np.repeat(np.array([s for s, _ in parts], object), [len(rows) for _, rows in parts]))
        if engine is not None:
            yield _frame(engine.finish(), own)

    rows = frames.select(_names(INPUT))
    return (rows if is_dealt else by_stream(rows)).mapInPandas(run, OUTPUT)


def frame_rows(output: DataFrame) -> DataFrame:
    """The 25 columns of each stream's frames."""
    return output.filter("rec = 'frame'").select("stream", *_names(FRAME))


def event_rows(output: DataFrame) -> DataFrame:
    return output.filter("rec = 'event'").select("stream", "event_id", "track_id", "label", *_names(EVENT)[1:])


def summary(output: DataFrame) -> DataFrame:
    """(stream, events_total, evidence_rows, late_frames, events_by_class) of each stream."""
    count = lambda rec: F.sum((F.col("rec") == rec).cast("long"))
    by_class = output.filter("rec = 'event'").groupBy("stream", "label").count().groupBy("stream").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "count")))).alias("events_by_class"))
    return output.groupBy("stream").agg(count("event").alias("events_total"), count("frame").alias("evidence_rows"), count("late").alias("late_frames")).join(by_class, "stream", "left")
