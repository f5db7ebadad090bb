"""Multi-object tracking over ordered detections: constant-velocity Kalman filters and optimal one-to-one assignment.

A stream's frames depend on each other, so a stream is the unit of work: groups of streams run in parallel, and a stream's
state is its live tracks only. Streams are dealt over partitions and sorted there, so their frames pass through a task in
batches: no stream is gathered, and short ones don't pay for a call of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TrackerOptions:
    # Defaults of the tracker and its filter.
    min_iou: float = 0.20
    max_age: int = 8
    min_hits: int = 2
    process_noise: float = 0.01
    measurement_noise: float = 0.10
    initial_variance: float = 10.0


#: Cost of pairs of different classes, and the cost from which a pair is none.
FORBIDDEN, NO_PAIR = 1e6, 1e5


def assign(cost: np.ndarray | list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths; the smaller side is matched whole."""
    if len(cost) == 1 and len(cost[0]):
        return [(0, min(range(len(cost[0])), key=lambda j: cost[0][j]))]
    if len(cost) and len(cost[0]) == 1:
        return [(min(range(len(cost)), key=lambda i: cost[i][0]), 0)]
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    flipped = cost.shape[0] > cost.shape[1]
    work = cost.T if flipped else cost
    n, m = work.shape
    row_price, column_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # the row of each column; the last column starts paths
    for row in range(n):
        owner[m], column = row, m
        least, came, used = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[column] >= 0:
            used[column] = True
            here = owner[column]
            free = np.flatnonzero(~used[:m])
            slack = work[here, free] - row_price[here] - column_price[free]
            better = slack < least[free]
            least[free[better]], came[free[better]] = slack[better], column
            target = free[np.argmin(least[free])]
            step = least[target]
            row_price[owner[used]] += step
            column_price[used] -= step
            least[free] -= step
            column = target
        while column != m:
            owner[column] = owner[came[column]]
            column = came[column]
    pairs = sorted((int(owner[c]), c) for c in range(m) if owner[c] >= 0)
    return sorted((c, r) for r, c in pairs) if flipped else pairs


class Kalman:
    """State: centre, size and their velocities.

    The four coordinates have the same noise and are seen together, so their covariance is one 2 x 2 matrix (position,
    velocity) for all four, held as three numbers; predictions and gains are those of the whole 8 x 8 filter.
    """

    def __init__(self, box: Sequence[float], options: TrackerOptions):
        self.options = options
        self.at, self.speed = _measure(box), [0.0] * 4
        self.place = self.rate = options.initial_variance
        self.both = 0.0

    def predict(self) -> None:
        x, y, w, h = (a + s for a, s in zip(self.at, self.speed))
        self.at = [x, y, max(w, 1.0), max(h, 1.0)]
        self.place += 2 * self.both + self.rate + self.options.process_noise
        self.both += self.rate
        self.rate += self.options.process_noise

    def update(self, box: Sequence[float]) -> None:
        whole = self.place + self.options.measurement_noise
        moved, sped = self.place / whole, self.both / whole
        off = [m - a for m, a in zip(_measure(box), self.at)]
        x, y, w, h = (a + moved * o for a, o in zip(self.at, off))
        self.at, self.speed = [x, y, max(w, 1.0), max(h, 1.0)], [s + sped * o for s, o in zip(self.speed, off)]
        self.rate -= sped * self.both
        self.both *= 1 - moved
        self.place *= 1 - moved

    def corners(self) -> list[float]:
        x, y, w, h = self.at
        return [x - w / 2, y - h / 2, x + w / 2, y + h / 2]

    def box(self) -> np.ndarray:
        return np.array(self.corners())


def _measure(box: Sequence[float]) -> list[float]:
    x1, y1, x2, y2 = map(float, box)
    return [(x1 + x2) / 2, (y1 + y2) / 2, max(x2 - x1, 1.0), max(y2 - y1, 1.0)]


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(1)
    union = area(a)[:, None] + area(b)[None] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


#: Pairs up to which plain numbers are quicker than arrays.
FEW = 16


def overlaps(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """The same matrix as lists."""
    if len(a) * len(b) > FEW:
        return iou_matrix(np.array(a), np.array(b)).tolist()
    area = lambda x: max(x[2] - x[0], 0.0) * max(x[3] - x[1], 0.0)
    out = []
    for p in a:
        row = []
        for q in b:
            both = max(min(p[2], q[2]) - max(p[0], q[0]), 0.0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0.0)
            union = area(p) + area(q) - both
            row.append(both / union if union > 0 else 0.0)
        out.append(row)
    return out


@dataclass
class Track:
    number: int
    filter: Kalman
    class_id: int
    confidence: float
    observed: bool = True
    age: int = 1
    hits: int = 1
    missed: int = 0
    detection: int = -1  # the number of the detection it was last seen in, within that frame
    centres: list[tuple[int, int]] = field(default_factory=list)


class Tracker:
    """Predicts all tracks, matches, updates, spawns, expires and reports, in that order, frame by frame."""

    def __init__(self, options: TrackerOptions | None = None, history: int = 50):
        self.options, self.history = options or TrackerOptions(), history
        self.tracks: list[Track] = []
        self.next_number = 1

    def _pass(self, track: Track) -> None:
        """Adds the centre of a track that was seen, in whole pixels."""
        x1, y1, x2, y2 = track.filter.corners()
        track.centres = [*track.centres, (int((x1 + x2) / 2), int((y1 + y2) / 2))][-self.history :]

    def update(self, boxes: np.ndarray, classes: np.ndarray, confidences: np.ndarray) -> list[Track]:
        boxes, classes, confidences = np.asarray(boxes, float).reshape(-1, 4).tolist(), np.asarray(classes).tolist(), np.asarray(confidences).tolist()
        for t in self.tracks:
            t.filter.predict()
            t.age, t.missed, t.observed = t.age + 1, t.missed + 1, False
        matched = set()
        if self.tracks and boxes:
            overlap = overlaps([t.filter.corners() for t in self.tracks], boxes)
            cost = [[1 - o if t.class_id == c else FORBIDDEN for o, c in zip(row, classes, strict=True)] for t, row in zip(self.tracks, overlap, strict=True)]
            for i, j in assign(cost):  # the optimum first, then the gate
                if cost[i][j] >= NO_PAIR or overlap[i][j] < self.options.min_iou:
                    continue
                t = self.tracks[i]
                t.filter.update(boxes[j])
                t.confidence, t.hits, t.missed, t.observed, t.detection = float(confidences[j]), t.hits + 1, 0, True, j
                self._pass(t)
                matched.add(j)
        for j in range(len(boxes)):
            if j not in matched:
                self.tracks.append(Track(self.next_number, Kalman(boxes[j], self.options), int(classes[j]), float(confidences[j]), detection=j))
                self.next_number += 1
                self._pass(self.tracks[-1])
        self.tracks = [t for t in self.tracks if t.missed <= self.options.max_age]
        return [t for t in self.tracks if t.hits >= self.options.min_hits or t.missed == 0]


TRACK_SCHEMA = "stream string, frame_index long, track_id long, x1 double, y1 double, x2 double, y2 double, class_id int, confidence double, observed boolean, age long, hits long, time_since_update long, center_history array<struct<x:int,y:int>>"
DETECTION_COLUMNS = ["stream", "frame_index", "x1", "y1", "x2", "y2", "class_id", "confidence"]


def frame_rows(tracker: Tracker, stream: str, frame: int, boxes: np.ndarray, classes: np.ndarray, confidences: np.ndarray, history: bool = True) -> Iterator[tuple]:
    """Values of TRACK_SCHEMA, the last one if asked for."""
    there = ~np.isnan(boxes[:, 0])
    for t in tracker.update(boxes[there], classes[there], confidences[there]):
        row = (stream, frame, t.number, *t.filter.corners(), t.class_id, t.confidence, t.observed, t.age, t.hits, t.missed)
        yield (*row, [{"x": x, "y": y} for x, y in t.centres]) if history else row


def dealt(rows: DataFrame, stream: str, order: Sequence[str | Column]) -> DataFrame:
    """Rows dealt to all cores by stream, sorted by stream and then as given. The number of partitions is given, as adaptive
    plans would judge few bytes to be little work."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, stream).sortWithinPartitions(stream, *order)


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    return np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)


def _whole_frames(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut where a frame begins, with these places."""
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        cuts = np.flatnonzero(changes(rows["stream"].to_numpy(object)) | changes(rows["frame_index"].to_numpy()))
        if len(cuts) > 1:
            yield rows.iloc[: cuts[-1]], cuts[:-1]
        held = rows.iloc[cuts[-1] :] if len(cuts) else None
    if held is not None:
        yield held, np.array([0])


def track(detections: DataFrame, options: TrackerOptions | None = None, history: bool = True) -> DataFrame:
    """Tracks of each stream. detections: DETECTION_COLUMNS; a frame without any is a row with null corners.

    Without `history` there is no center_history, which repeats up to 50 places in each row.
    """
    schema = TRACK_SCHEMA if history else TRACK_SCHEMA[: TRACK_SCHEMA.index(", center_history")]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, own = None, None
        for found, cuts in _whole_frames(batches):
            rows: list = []
            streams, frames, boxes = found["stream"].to_numpy(object), found["frame_index"].to_numpy(), found[["x1", "y1", "x2", "y2"]].to_numpy(float)
            classes, confidences = found["class_id"].to_numpy(), found["confidence"].to_numpy(float)
            for a, b in zip(cuts, np.append(cuts[1:], len(frames)), strict=True):
                if tracker is None or streams[a] != own:
                    tracker, own = Tracker(options) if history else Tracker(options, 1), streams[a]
                rows += frame_rows(tracker, own, int(frames[a]), boxes[a:b], classes[a:b], confidences[a:b], history)
            yield pd.DataFrame(rows, columns=names)

    order = ["frame_index", *[F.asc_nulls_last(c) for c in ("x1", "y1", "x2", "y2", "class_id", "confidence")]]
    return dealt(detections.select(*DETECTION_COLUMNS), "stream", order).mapInPandas(run, schema)


def kalman_smooth(points: DataFrame, options: TrackerOptions | None = None) -> DataFrame:
    """(stream, frame_index, x1, y1, x2, y2) of single objects after the filter's update at each frame."""

    def run(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("frame_index", kind="stable").reset_index(drop=True)
        boxes, kalman, out = found[["x1", "y1", "x2", "y2"]].to_numpy(float), None, []
        for box in boxes:
            if kalman is None:
                kalman = Kalman(box, options or TrackerOptions())
            else:
                kalman.predict()
                kalman.update(box)
            out.append(kalman.box())
        found[["x1", "y1", "x2", "y2"]] = np.array(out)
        return found

    columns = ["stream", "frame_index", "x1", "y1", "x2", "y2"]
    return points.select(*columns).groupBy("stream").applyInPandas(run, "stream string, frame_index long, x1 double, y1 double, x2 double, y2 double")
