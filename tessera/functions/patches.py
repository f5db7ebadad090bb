"""Hand-made features of colour patches: oriented gradients in blocks, colour histograms and moments, texture, edge outlines.

Patches come as binary columns of 8-bit red, green and blue, pixel by pixel, with their height and width. Each kind of
feature can be left out; `dimension` and `names` follow the options.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import pixels

OUTLINE = ("area_ratio", "largest_area_ratio", "largest_perimeter_ratio", "largest_aspect_ratio", "largest_solidity", "largest_extent", "component_count", "centroid_x", "centroid_y")
CHANNELS = ("hue", "saturation", "value", "luma", "cr", "cb")


@dataclass(frozen=True)
class PatchFeatures:
    """What is computed: side of the square a patch is brought to, kinds of features, and their settings."""

    side: int = 64
    gradients: bool = True
    texture: bool = True
    colour: bool = True
    cooccurrence: bool = True
    outlines: bool = True
    orientations: int = 9
    cell: int = 8
    block: int = 2
    bins: int = 16
    distances: tuple[int, ...] = (1, 2)
    angles: tuple[int, ...] = (0, 45, 90, 135)
    levels: int = 256

    def __post_init__(self):
        if not (self.gradients or self.texture or self.colour or self.cooccurrence or self.outlines):
            raise ValueError("at least one kind of feature must be on")
        if self.side < max(3, self.cell * self.block if self.gradients else 0):
            raise ValueError("the side must hold a block of cells")

    @property
    def names(self) -> list[str]:
        out, cells = [], self.side // self.cell
        if self.gradients:
            at = range(cells - self.block + 1)
            out += [f"gradient_{y}_{x}_{r}_{c}_{o}" for y in at for x in at for r in range(self.block) for c in range(self.block) for o in range(self.orientations)]
        if self.texture:
            out += [f"pattern_{i}" for i in range(10)]
        if self.colour:
            out += [f"{c}_bin_{i}" for c in CHANNELS for i in range(self.bins)] + [f"{c}_{m}" for c in CHANNELS for m in ("mean", "std")]
        if self.cooccurrence:
            out += [f"{p}_{d}_{a}" for p in ("contrast", "homogeneity", "energy", "correlation") for d in self.distances for a in self.angles]
        if self.outlines:
            out += [f"outline_{n}" for n in OUTLINE]
        return out

    @property
    def dimension(self) -> int:
        return len(self.names)

    def metadata(self) -> dict:
        """The settings with the dimension, as written beside extracted features."""
        return {"dimension": self.dimension} | asdict(self)


def resized(image: np.ndarray, side: int) -> np.ndarray:
    """A square of 8-bit values: area means if a side is longer than the square's, else linear between pixel centres."""
    if max(image.shape[:2]) > side:
        planes = [pixels.area_resize(image[..., c], side, side) for c in range(image.shape[2])]
        return np.rint(np.stack(planes, -1)).astype(np.uint8)

    def weights(source: int) -> np.ndarray:
        at = np.clip((np.arange(side) + 0.5) * source / side - 0.5, 0, source - 1)
        return np.clip(1 - np.abs(at[:, None] - np.arange(source)[None]), 0, None)

    held = np.einsum("ys,sxc->yxc", weights(image.shape[0]), image.astype(float))
    return np.rint(np.einsum("xs,ysc->yxc", weights(image.shape[1]), held)).astype(np.uint8)


def channels(image: np.ndarray) -> dict[str, np.ndarray]:
    """Hue in half degrees, saturation, value, luma, red and blue difference, as whole numbers up to 255."""
    r, g, b = (image[..., c].astype(float) for c in range(3))
    high, spread = np.maximum(np.maximum(r, g), b), np.ptp(image.astype(float), axis=-1)
    by = np.where(spread > 0, spread, 1)
    hue = np.select([high == r, high == g], [60 * (g - b) / by, 120 + 60 * (b - r) / by], 240 + 60 * (r - g) / by) * (spread > 0)
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    difference = lambda c, share: np.clip(np.rint((c - luma) * share + 128), 0, 255)
    return {
        "hue": np.rint(hue % 360 / 2) % 180, "saturation": np.rint(255 * spread / np.where(high > 0, high, 1)) * (high > 0), "value": high,
        "luma": np.rint(luma), "cr": difference(r, 0.713), "cb": difference(b, 0.564),
    }


def block_gradients(grey: np.ndarray, orientations: int, cell: int, block: int) -> np.ndarray:
    """Mean gradient magnitude by unsigned orientation in cells; blocks of cells are normalised, held at 0.2, normalised again."""
    grey = grey.astype(float)
    gy, gx = np.zeros_like(grey), np.zeros_like(grey)
    gy[1:-1], gx[:, 1:-1] = grey[2:] - grey[:-2], grey[:, 2:] - grey[:, :-2]
    size, angle = np.hypot(gy, gx), np.degrees(np.arctan2(gy, gx)) % 180
    slot = np.minimum((angle * orientations / 180).astype(int), orientations - 1)
    ny, nx = grey.shape[0] // cell, grey.shape[1] // cell
    inside = (slice(ny * cell), slice(nx * cell))
    rows, columns = np.arange(ny * cell)[:, None] // cell, np.arange(nx * cell)[None] // cell
    cells = np.bincount(((rows * nx + columns) * orientations + slot[inside]).ravel(), size[inside].ravel(), ny * nx * orientations)
    cells = cells.reshape(ny, nx, orientations) / cell**2
    views = np.lib.stride_tricks.sliding_window_view(cells, (block, block), axis=(0, 1)).transpose(0, 1, 3, 4, 2)
    unit = lambda v: v / np.sqrt((v**2).sum((2, 3, 4), keepdims=True) + 1e-10)
    return unit(np.minimum(unit(views), 0.2)).ravel()


def edges(grey: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Pixels on edges: Sobel gradients (|x| + |y|), greatest across the edge, over `high` or linked to such through `low`."""
    h, w = grey.shape[-2:]
    border = [(0, 0)] * (grey.ndim - 2) + [(1, 1)] * 2
    p = np.pad(grey.astype(int), border, mode="edge")
    at = lambda y, x: p[..., 1 + y : 1 + y + h, 1 + x : 1 + x + w]
    gx = (at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))
    gy = (at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1))
    size = np.abs(gx) + np.abs(gy)
    around = np.pad(size, border)
    beside = lambda y, x: around[..., 1 + y : 1 + y + h, 1 + x : 1 + x + w]
    flat, steep = np.tan(np.pi / 8), np.tan(3 * np.pi / 8)
    level, upright = np.abs(gy) < flat * np.abs(gx), np.abs(gy) > steep * np.abs(gx)
    falling = (gx < 0) == (gy < 0)  # the gradient points along the main diagonal
    greatest = np.select(
        [level, upright, falling],
        [(size > beside(0, -1)) & (size >= beside(0, 1)), (size > beside(-1, 0)) & (size >= beside(1, 0)), (size > beside(-1, -1)) & (size > beside(1, 1))],
        (size > beside(-1, 1)) & (size > beside(1, -1)),
    )
    weak = greatest & (size > low)
    label = pixels.regions(weak)
    strong = np.unique(label[weak & (size > high)])
    return weak & np.isin(label, strong[strong > 0])


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: whatever background can't be reached from outside over sides of pixels."""
    free = ~np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(1, 1)] * 2)
    reached = np.zeros_like(free)
    reached[..., [0, -1], :] = reached[..., [0, -1]] = True
    by_row, by_column = (lambda v: np.moveaxis(v, -2, 0)), (lambda v: np.moveaxis(v, -1, 0))
    views = [(turn(reached)[::way], turn(free)[::way]) for way in (1, -1) for turn in (by_row, by_column)]  # sweeps in four directions
    while True:
        before = np.count_nonzero(reached)
        for turned, open_ in views:
            for y in range(1, len(turned)):
                turned[y] |= turned[y - 1] & open_[y]
        if np.count_nonzero(reached) == before:
            return ~reached[..., 1:-1, 1:-1]


def outline_statistics(mask: np.ndarray, least_ratio: float = 0.0001, label: np.ndarray | None = None) -> dict[str, float]:
    """The covered share, and of outer outlines of at least that share of the area their number and the largest one's measures.

    An outline runs through the centres of a region's border pixels, holes are part of it. Its area and length are sums over
    squares of four pixels (`label`: the filled mask's regions, if they are known): one with all four inside counts 1, one with three is half a square cut by a diagonal, one with two
    holds a stretch of line that is passed on this side. Of outlines of equal area the first from the top left counts.
    """
    h, w = mask.shape
    whole, label = float(max(1, h * w)), pixels.regions(filled(mask)) if label is None else label
    count = label.max(initial=0)
    out = dict.fromkeys(OUTLINE, 0.0) | {"area_ratio": float(mask.sum()) / whole, "centroid_x": 0.5, "centroid_y": 0.5}
    if not count:
        return out
    wide = np.pad(label, 1)  # squares also reach over the patch's border
    squares = np.stack([wide[:-1, :-1], wide[:-1, 1:], wide[1:, :-1], wide[1:, 1:]])
    name = squares.max(0)  # two regions never meet in a square
    held = squares > 0
    n = held.sum(0)
    share = np.where(n == 4, 1.0, np.where(n == 3, 0.5, 0.0))
    area = np.bincount(name.ravel(), share.ravel(), count + 1)
    area[0] = 0
    kept = np.flatnonzero((area / whole >= least_ratio) & (np.arange(count + 1) > 0))
    if not len(kept):
        return out
    best = kept[np.argmax(area[kept])]
    own = name == best
    diagonal = (n == 2) & ((held[0] & held[3]) | (held[1] & held[2]))
    length = np.where(n == 3, 2**0.5, np.where(diagonal, 2 * 2**0.5, np.where(n == 2, 1.0, 0.0)))[own].sum()
    ys, xs = np.nonzero(label == best)
    hull = hull_area(xs, ys)
    box_w, box_h = int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
    if area[best] > 0:
        y, x = np.mgrid[-1:h, -1:w]
        corners = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
        mean = lambda c: (held * c[:, None, None]).sum(0) / np.maximum(n, 1)
        cy, cx = ((((base + mean(c)) * share)[own]).sum() / area[best] for base, c in ((y, corners[0]), (x, corners[1])))
    else:
        cy, cx = ys.min() + box_h / 2, xs.min() + box_w / 2
    return out | {
        "largest_area_ratio": float(area[best] / whole), "largest_perimeter_ratio": float(length / max(1.0, 2.0 * (w + h))), "largest_aspect_ratio": box_w / box_h,
        "largest_solidity": float(area[best] / hull) if hull > 0 else 0.0, "largest_extent": float(area[best] / (box_w * box_h)), "component_count": float(len(kept)),
        "centroid_x": float(cx / w), "centroid_y": float(cy / h),
    }


def hull_area(xs: np.ndarray, ys: np.ndarray) -> float:
    """Area of the convex hull of points, from the ends of their rows."""
    order = np.lexsort((xs, ys))
    xs, ys = xs[order], ys[order]
    ends = np.r_[True, np.diff(ys) != 0] | np.r_[np.diff(ys) != 0, True]
    points = sorted({(int(x), int(y)) for x, y in zip(xs[ends], ys[ends], strict=True)})
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(some: list) -> list:
        out: list = []
        for q in some:
            while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = half(points) + half(points[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def patch_features(image: np.ndarray, options: PatchFeatures) -> np.ndarray:
    """The features of one patch (height, width, 3), in the order of the options' names."""
    return patches_features([image], options)[0]


def patches_features(images: list[np.ndarray], options: PatchFeatures) -> np.ndarray:
    """A row for each patch; once brought to one side, they are measured as a stack."""
    stack = np.stack([resized(i, options.side) for i in images])
    held = channels(stack)
    grey, out = held["luma"].astype(np.uint8), []
    if options.gradients:
        out.append(np.stack([block_gradients(g, options.orientations, options.cell, options.block) for g in grey]))
    if options.texture:
        out.append(pixels.uniform_lbp(grey))
    if options.colour:
        flat = {name: np.ascontiguousarray(plane).reshape(len(images), -1) for name, plane in held.items()}
        for name, plane in flat.items():
            reach = 180 if name == "hue" else 256
            out.append(pixels.counts((plane * options.bins / reach).astype(int), options.bins) / plane.shape[1])
        out.append(np.stack([v / 255 for plane in flat.values() for v in (plane.mean(1), plane.std(1))], 1))
    if options.cooccurrence:
        out.append(pixels.glcm_properties(grey, options.distances, options.angles, options.levels))
    if options.outlines:
        mask = edges(grey)
        label = pixels.regions(filled(mask))
        first = np.where(label > 0, label, label.size + 1).min((1, 2))[:, None, None]  # numbers go on from patch to patch
        own = np.where(label > 0, label - first + 1, 0)
        out.append(np.array([list(outline_statistics(m, label=k).values()) for m, k in zip(mask, own, strict=True)]))
    return np.concatenate(out, 1)


#: Patches that are measured together.
TOGETHER = 64


def extract(options: PatchFeatures, data: Column, height: Column, width: Column) -> Column:
    """Features of patches as array<float>; a null or empty patch, or one whose bytes don't fit its size, gives null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def answer(data: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        out, held = np.full(len(data), None, object), []
        for place, (raw, h, w) in enumerate(zip(data, heights, widths, strict=True)):
            if raw is not None and not pd.isna(h) and not pd.isna(w) and h > 0 and w > 0 and len(raw) == h * w * 3:
                held.append((place, np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3)))
        for some in (held[i : i + TOGETHER] for i in range(0, len(held), TOGETHER)):
            for (place, _), row in zip(some, patches_features([i for _, i in some], options).astype(np.float32).tolist(), strict=True):
                out[place] = row
        return pd.Series(out, dtype="object")

    return answer(data, height, width)
