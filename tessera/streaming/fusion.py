"""Stateful streaming twins of the temporal operators: votes, smoothing, growth, risk and events in one processor.

Rows of a key must come in frame order across micro-batches and are sorted within one. As a stream has no end, an open event
is closed by a row whose `final` is true (its frame is the number of frames); until such a row comes it stays open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import temporal

INPUT = "key long, frame long, observed boolean, confidence double, label string, area double, ratio double, motion double, final boolean"
EVENTS = "key long, label string, start_frame long, end_frame long, peak_risk double, peak_confidence double, peak_risk_level string"
NEEDS = {"fire": 3, "smoke": 4}


def _clip(value: float) -> float:
    return min(max(value, 0.0), 1.0)


class Fusion:
    """One key's state: the last observations, the smoothed confidence, the last area, the open event."""

    def __init__(self, length: int = 8, alpha: float = 0.4, least: float = 0.25):
        self.length, self.alpha, self.least = length, alpha, least
        self.seen: list[int] = []
        self.smoothed: float | None = None
        self.last: int | None = None
        self.area: float | None = None
        self.open: list | None = None  # label, start, peak risk, peak confidence, level

    def state(self) -> tuple:
        return "".join(map(str, self.seen)), self.smoothed, self.last, self.area, *(self.open or [None] * 5)

    def restored(self, state: tuple) -> Fusion:
        seen, self.smoothed, self.last, self.area, *event = state
        self.seen = [int(x) for x in seen]
        self.open = list(event) if event[0] is not None else None
        return self

    def _close(self, end: int) -> Iterator[tuple]:
        if self.open:
            label, start, risk, confidence, level = self.open
            yield label, start, end, risk, confidence, level
        self.open = None

    def step(self, frame: int, observed: bool, confidence: float, label: str, area: float, ratio: float, motion: float, final: bool) -> Iterator[tuple]:
        """A frame of the key: area in any unit (for growth), ratio its share of the frame, motion a score from 0 to 1."""
        if final:
            yield from self._close(frame)
            return
        if self.last is not None and frame != self.last + 1:  # a gap forgets votes and ends what was open
            yield from self._close(self.last + 1)
            self.seen, self.smoothed, self.area = [], None, None
        self.last = frame
        self.seen = [*self.seen, int(observed)][-self.length :]
        if observed:
            self.smoothed = confidence if self.smoothed is None else self.alpha * confidence + (1 - self.alpha) * self.smoothed
        growth = (area - self.area) / self.area if self.area is not None and self.area > 0 else 0.0
        self.area = area
        hits = sum(self.seen)
        smoothed = self.smoothed or 0.0
        if hits >= NEEDS.get(label, NEEDS["smoke"]) and smoothed >= self.least:
            parts = {
                "confidence": smoothed, "persistence": hits / len(self.seen), "motion": motion,
                "area": ratio / max(temporal.AREA_SATURATION, 1e-6), "growth": growth / max(temporal.GROWTH_SATURATION, 1e-6),
            }
            risk = round(_clip(sum(_clip(v) * temporal.RISK_WEIGHTS[k] for k, v in parts.items())), 9)
            level = next((name for name, least in temporal.RISK_LEVELS if risk >= least), "LOW")
            if self.open is None:
                self.open = [label, frame, risk, smoothed, level]
            else:
                if risk >= self.open[2]:
                    self.open[2], self.open[4] = risk, level
                self.open[3] = max(self.open[3], smoothed)
        else:
            yield from self._close(frame)


def _steps(fusion: Fusion, rows: pd.DataFrame) -> list[tuple]:
    ordered = rows.sort_values(["frame", "final"], kind="stable")
    columns = (ordered[c.split()[0]].tolist() for c in INPUT.split(", ")[1:])
    return [e for row in zip(*columns, strict=True) for e in fusion.step(*row)]


class EventProcessor(StatefulProcessor):
    STATE = "seen string, smoothed double, last long, area double, label string, start long, risk double, confidence double, level string"

    def __init__(self, **options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("fusion", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        fusion = Fusion(**self.options)
        if self.kept.exists():
            fusion.restored(self.kept.get())
        found = _steps(fusion, pd.concat(list(rows)))
        self.kept.update(fusion.state())
        yield pd.DataFrame([(key[0], *e) for e in found], columns=[c.split()[0] for c in EVENTS.split(", ")])

    def close(self) -> None:
        pass


def stream_events(rows: DataFrame, **options) -> DataFrame:
    """Finished events of a stream (or a batch) of INPUT rows; options: length, alpha and least."""
    return rows.groupBy("key").transformWithStateInPandas(EventProcessor(**options), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def batch_events(rows: DataFrame, **options) -> DataFrame:
    """The same over whole keys at once, in linear time for keys of any length."""

    def run(found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(found["key"].iat[0], *e) for e in _steps(Fusion(**options), found)], columns=[c.split()[0] for c in EVENTS.split(", ")])

    return rows.groupBy("key").applyInPandas(run, EVENTS)
