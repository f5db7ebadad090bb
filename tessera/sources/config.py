"""Configuration with the checks that pipelines rely on. Mappings come from any parser."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field


def odd(value: int) -> int:
    if value < 1 or value % 2 == 0:
        raise ValueError(f"{value} must be odd")
    return value


def bounded(value: float, low: float = 0.0, high: float = 1.0) -> float:
    if not low <= value <= high:
        raise ValueError(f"{value} must be from {low} to {high}")
    return float(value)


def gamma(value) -> float | str:
    """scale, auto, or a number."""
    return value if value in ("scale", "auto") else float(value)


@dataclass(frozen=True)
class SourceOptions:
    name: str
    format: str
    class_map: Mapping
    missing_label_is_negative: bool = False

    def __post_init__(self):
        if self.format not in ("yolo", "voc"):
            raise ValueError(f"unknown format {self.format}")
        keys = {int(k): int(v) for k, v in self.class_map.items()} if self.format == "yolo" else {str(k).lower(): int(v) for k, v in self.class_map.items()}
        object.__setattr__(self, "class_map", keys)


@dataclass(frozen=True)
class CurationOptions:
    """Defaults of curation."""

    classes: Mapping[int, str] = field(default_factory=lambda: {0: "fire", 1: "smoke"})
    least_width: int = 32
    least_height: int = 32
    repair: bool = True
    drop_unknown: bool = True
    least_box_pixels: int = 4
    most_distance: int = 4
    ratios: Mapping[str, float] = field(default_factory=lambda: {"train": 0.70, "val": 0.15, "test": 0.15})
    seed: int = 42

    def __post_init__(self):
        if sorted(self.classes) != list(range(len(self.classes))):
            raise ValueError("class ids must run from 0 without gaps")
        if not math.isclose(sum(self.ratios.values()), 1.0, abs_tol=1e-6):
            raise ValueError("ratios must sum to 1")


@dataclass(frozen=True)
class FusionOptions:
    """Defaults of temporal fusion."""

    window: int = 8
    fire_hits: int = 3
    smoke_hits: int = 4
    alpha: float = 0.40
    least_confidence: float = 0.25
    levels: tuple[float, float, float] = (0.30, 0.60, 0.80)
    fallback_rate: float = 25.0
    weights: Mapping[str, float] = field(default_factory=lambda: {"confidence": 0.35, "persistence": 0.20, "motion": 0.15, "area": 0.15, "growth": 0.15})

    def __post_init__(self):
        bounded(self.alpha)
        bounded(self.least_confidence)
        if not max(self.fire_hits, self.smoke_hits) <= self.window:
            raise ValueError("hits can't exceed the window")
        if list(self.levels) != sorted(set(self.levels)):
            raise ValueError("levels must rise")
        if min(self.weights.values()) < 0 or not math.isclose(sum(self.weights.values()), 1.0, abs_tol=1e-6):
            raise ValueError("weights must be 0 or more and sum to 1")
        if self.fallback_rate <= 0:
            raise ValueError("the fallback rate must be above 0")


@dataclass(frozen=True)
class DetectorOptions:
    """Defaults of the detector's grid."""

    image_sizes: tuple[int, ...] = (512, 640)
    confidences: tuple[float, ...] = (0.15, 0.20, 0.25, 0.30)
    ious: tuple[float, ...] = (0.45, 0.55)
    most: int = 100

    def __post_init__(self):
        if not self.image_sizes or any(size <= 0 or size % 32 for size in self.image_sizes):
            raise ValueError("image sizes must be multiples of 32")
        for value in (*self.confidences, *self.ious):
            bounded(value)


@dataclass(frozen=True)
class PatchOptions:
    """Defaults of patches."""

    size: int = 96
    context: float = 0.12
    least_box: int = 12
    normals_per_image: int = 1
    crop_fraction: tuple[float, float] = (0.35, 0.75)
    most_overlap: float = 0.02
    caps: Mapping[str, int] = field(default_factory=lambda: {"train": 1500, "val": 400, "test": 600})

    def __post_init__(self):
        bounded(self.most_overlap)
        low, high = self.crop_fraction
        if not 0 < low <= high <= 1:
            raise ValueError("crop fractions must rise from above 0 to 1 at most")


#: What a split adds to the seed of its draws.
_SPLIT_SEEDS = {"train": 1, "val": 2, "test": 3}


def draw_seed(seed: int, class_id: int, split: str) -> int:
    """The seed of a split's and class's draw; the same on every machine."""
    return seed + 1009 * class_id + _SPLIT_SEEDS[split]


def read_yaml(text: str) -> dict:
    """The mapping of a YAML document, where PyYAML is installed."""
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration is a mapping")
    return found


def curation_options(raw: Mapping) -> tuple[CurationOptions, list[SourceOptions]]:
    """Options and sources of a mapping; unknown keys raise."""
    raw = dict(raw)
    sources = [SourceOptions(**s) for s in raw.pop("sources", [])]
    if "classes" in raw:
        raw["classes"] = {int(k): str(v) for k, v in raw["classes"].items()}
    return CurationOptions(**raw), sources
