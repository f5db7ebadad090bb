"""Kernels on small images (numpy) behind Arrow UDFs: perceptual hash, texture, edges, morphology, regions.

Images come as binary columns of 8-bit grey values with their height and width. Kernels whose images may have leading axes
take a stack of images of one size and give a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Most pixels of a stack (one image at least), so that its planes stay in a core's cache.
STACK = 1 << 17


def stacks(data: pd.Series, heights: pd.Series, widths: pd.Series, depth: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, images) of a batch: images of one size, `depth` bytes a pixel, and where they stand; null ones are left out."""
    raw, h, w = data.to_numpy(), heights.to_numpy(float, na_value=np.nan), widths.to_numpy(float, na_value=np.nan)
    there = np.flatnonzero(data.notna().to_numpy() & ~np.isnan(h) & ~np.isnan(w))
    sizes, which = np.unique(np.stack([h[there], w[there]], 1).astype(int), axis=0, return_inverse=True)
    order = there[np.argsort(which, kind="stable")]
    for (height, width), own in zip(sizes.tolist(), np.split(order, np.cumsum(np.bincount(which.ravel(), minlength=len(sizes)))[:-1]), strict=True):
        most = max(1, STACK // max(1, height * width * depth))
        for places in (own[i : i + most] for i in range(0, len(own), most)):
            images = np.frombuffer(b"".join(raw[places]), np.uint8)
            yield places, images.reshape(len(places), height, width) if depth == 1 else images.reshape(len(places), height, width, depth)


def _filled(data: pd.Series, heights: pd.Series, widths: pd.Series, kernel) -> pd.Series:
    """The kernel's rows at their places, null elsewhere."""
    out = np.full(len(data), None, object)
    for places, images in stacks(data, heights, widths):
        for place, row in zip(places, kernel(images), strict=True):
            out[place] = row
    return pd.Series(out, dtype="object")


@lru_cache(256)
def _area_weights(source: int, target: int) -> np.ndarray:
    edges = np.linspace(0, source, target + 1)
    low, high = edges[:-1, None], edges[1:, None]
    cells = np.arange(source)[None]
    share = np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None)
    return share / share.sum(1, keepdims=True)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the source area of each target pixel."""
    return _area_weights(image.shape[-2], height) @ image.astype(float) @ _area_weights(image.shape[-1], width).T


@lru_cache(8)
def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    basis = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    basis[0] /= np.sqrt(2)
    return basis


def low_cosines(image: np.ndarray, size: int = 8, factor: int = 4) -> np.ndarray:
    """Whether each of the low DCT coefficients is over their median, which leaves the mean out."""
    basis = _cosines(size * factor)
    low = (basis @ area_resize(image, size * factor, size * factor) @ basis.T)[..., :size, :size]
    low = low.reshape(*low.shape[:-2], size * size)
    return low > np.median(low[..., 1:], -1)[..., None]


def perceptual_bits(image: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """64 bits of low DCT coefficients; the first bit counts most."""
    return int("".join("1" if b else "0" for b in low_cosines(image, size, factor)), 2)


@F.pandas_udf(T.LongType())
def perceptual_hash(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """As a signed number with the same 64 bits."""
    return _filled(data, height, width, lambda images: np.packbits(low_cosines(images), axis=-1).view(">i8")[:, 0].tolist())


def counts(codes: np.ndarray, kinds: int) -> np.ndarray:
    """How often each code below `kinds` stands in each row."""
    return np.bincount((codes + np.arange(len(codes))[:, None] * kinds).ravel(), minlength=len(codes) * kinds).reshape(len(codes), kinds)


def uniform_lbp(image: np.ndarray) -> np.ndarray:
    """Shares of the ten rotation-invariant uniform patterns of the eight neighbours (at least as bright counts)."""
    centre = image[..., 1:-1, 1:-1]
    h, w = centre.shape[-2:]
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    bits = [image[..., y : y + h, x : x + w] >= centre for y, x in ring]
    bright, changes = np.zeros(centre.shape, np.uint8), np.zeros(centre.shape, np.uint8)
    for k in range(8):
        bright += bits[k]
        changes += bits[k] != bits[k - 1]
    code = np.where(changes <= 2, bright, 9).reshape(-1, h * w)
    return (counts(code, 10) / max(h * w, 1)).reshape(*image.shape[:-2], 10)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def lbp_histogram(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return _filled(data, height, width, lambda images: uniform_lbp(images).tolist())


def glcm_properties(image: np.ndarray, distances=(1, 2), angles=(0, 45, 90, 135), levels: int = 16) -> np.ndarray:
    """Contrast, homogeneity, energy and correlation of symmetric, normalised co-occurrences, by property, distance, angle."""
    many = image.reshape(-1, *image.shape[-2:])
    most = max(1, (1 << 18) // levels**2)  # images whose co-occurrences are held at once
    found = [_cooccurrences((many[i : i + most].astype(int) * levels) >> 8, distances, angles, levels) for i in range(0, max(len(many), 1), most)]
    return np.concatenate(found).reshape(*image.shape[:-2], -1)


def _cooccurrences(grey: np.ndarray, distances, angles, levels: int) -> np.ndarray:
    at = np.arange(levels)
    i, j = (x.ravel() for x in np.meshgrid(at, at, indexing="ij"))
    off, (n, h, w), out = (i - j) ** 2, grey.shape, []
    near = 1 + off
    for d in distances:
        for angle in angles:
            dy, dx = {0: (0, d), 45: (-d, d), 90: (-d, 0), 135: (-d, -d)}[angle]
            a = grey[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
            b = grey[:, max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
            p = counts((a * levels + b).reshape(n, -1), levels * levels).reshape(n, levels, levels).astype(float)
            p = (p + p.transpose(0, 2, 1)).reshape(n, -1)
            p /= np.maximum(p.sum(1, keepdims=True), 1)
            di, dj = (x - (x * p).sum(1, keepdims=True) for x in (i, j))
            spread = np.sqrt((di**2 * p).sum(1)) * np.sqrt((dj**2 * p).sum(1))
            told = spread > 1e-15
            correlation = np.where(told, (di * dj * p).sum(1) / np.where(told, spread, 1), 1.0)
            out.append([(off * p).sum(1), (p / near).sum(1), np.sqrt((p**2).sum(1)), correlation])
    return np.array(out).transpose(2, 1, 0).reshape(n, -1)


def orientation_histogram(image: np.ndarray, cell: int = 8, bins: int = 9) -> np.ndarray:
    """Gradient orientation histograms of cells, weighted by magnitude and L2-normalised over the image."""
    gy, gx = np.gradient(image.astype(float))
    magnitude, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180
    h, w = image.shape[0] // cell, image.shape[1] // cell
    at = np.minimum((angle * bins / 180).astype(int), bins - 1)
    cells = (np.arange(image.shape[0]) // cell)[:, None] * w + (np.arange(image.shape[1]) // cell)[None]
    inside = np.zeros(image.shape, bool)
    inside[: h * cell, : w * cell] = True
    out = np.bincount((cells * bins + at)[inside], magnitude[inside], h * w * bins)
    return out / (np.linalg.norm(out) + 1e-12)


def ellipse(size: int) -> np.ndarray:
    if size < 1 or size % 2 == 0:
        raise ValueError("the kernel's size must be odd")
    r = size // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return (x / max(r, 1)) ** 2 + (y / max(r, 1)) ** 2 <= 1.0 + 1e-9


def _extreme(mask: np.ndarray, kernel: np.ndarray, grow: bool) -> np.ndarray:
    r, (h, w) = kernel.shape[0] // 2, mask.shape[-2:]
    padded = np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(r, r)] * 2, constant_values=not grow)
    out = np.full(mask.shape, not grow)
    for y, x in zip(*np.nonzero(kernel), strict=True):
        (np.logical_or if grow else np.logical_and)(out, padded[..., y : y + h, x : x + w], out=out)
    return out


def opened(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return _extreme(_extreme(mask, ellipse(size), False), ellipse(size), True)


def closed(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return _extreme(_extreme(mask, ellipse(size), True), ellipse(size), False)


def blurred(image: np.ndarray, size: int = 5) -> np.ndarray:
    """Gaussian blur, the deviation following the kernel's size; edges are mirrored."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    padded = np.pad(image.astype(float), size // 2, mode="reflect")
    rows = np.apply_along_axis(np.convolve, 1, padded, k, "valid")
    return np.apply_along_axis(np.convolve, 0, rows, k, "valid")


def letterbox(height: int, width: int, size: int) -> tuple[float, int, int]:
    """Scale and the left and top margins that centre an image in a square."""
    scale = size / max(height, width)
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    return scale, (size - w) // 2, (size - h) // 2


def undistorted(x: np.ndarray, y: np.ndarray, camera: np.ndarray, distortion: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Pixel positions without lens distortion (k1, k2, p1, p2, k3), by fixed-point rounds."""
    fx, fy, cx, cy = camera[0, 0], camera[1, 1], camera[0, 2], camera[1, 2]
    k1, k2, p1, p2, k3 = np.pad(np.ravel(distortion), (0, 5))[:5]
    u0, v0 = (np.asarray(x) - cx) / fx, (np.asarray(y) - cy) / fy
    u, v = u0.copy(), v0.copy()
    for _ in range(rounds):
        r = u * u + v * v
        radial = 1 + r * (k1 + r * (k2 + r * k3))
        u, v = (u0 - 2 * p1 * u * v - p2 * (r + 2 * u * u)) / radial, (v0 - p1 * (r + 2 * v * v) - 2 * p2 * u * v) / radial
    return u * fx + cx, v * fy + cy


def regions(mask: np.ndarray) -> np.ndarray:
    """Numbers of 8-connected regions, 0 outside, by repeated minimum over neighbours and pointer jumps.

    The images of a stack are told apart by an empty row; numbers go on from one to the next.
    """
    h, w = mask.shape[-2:]
    if mask.ndim > 2:
        tall = np.pad(mask.reshape(-1, h, w), ((0, 0), (0, 1), (0, 0)))
        return regions(tall.reshape(-1, w)).reshape(-1, h + 1, w)[:, :h].reshape(mask.shape)
    outside = h * w + 1
    own = np.arange(1, outside, dtype=np.int64).reshape(h, w)
    label = np.where(mask, own, outside)
    while True:
        across = label.copy()
        np.minimum(across[:, 1:], label[:, :-1], out=across[:, 1:])
        np.minimum(across[:, :-1], label[:, 1:], out=across[:, :-1])
        least = across.copy()
        np.minimum(least[1:], across[:-1], out=least[1:])
        np.minimum(least[:-1], across[1:], out=least[:-1])
        fresh = np.where(mask, least, outside)
        fresh = np.append(fresh.ravel(), outside)[fresh - 1]
        if (fresh == label).all():
            break
        label = fresh
    rank = np.append(np.cumsum(mask & (label == own)), 0)
    return rank[label - 1]


REGION_SCHEMA = T.StructType(
    [T.StructField("area_ratio", T.DoubleType()), T.StructField("component_count", T.IntegerType()), T.StructField("largest_ratio", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")]
    + [T.StructField(c, T.DoubleType()) for c in ("centroid_x", "centroid_y")]
)


def region_summaries(masks: np.ndarray, least_ratio: float = 0.0) -> dict[str, np.ndarray]:
    """Of each mask of a stack: covered share, number of regions of the least share, and the largest one's share, frame and centroid (0.5 without any)."""
    n, h, w = masks.shape
    label = regions(masks)
    sizes = np.bincount(label.ravel())[1:]
    last = np.maximum.accumulate(label.reshape(n, -1).max(1, initial=0)) if n else np.zeros(0, int)
    image = np.repeat(np.arange(n), np.diff(last, prepend=0))
    kept = np.flatnonzero(sizes / max(1, h * w) >= least_ratio)
    held = image[kept]
    out = {"area_ratio": np.bincount(held, sizes[kept], n) / max(1, h * w), "component_count": np.bincount(held, minlength=n), "largest_ratio": np.zeros(n)}
    out |= {c: np.zeros(n, int) for c in ("x1", "y1", "x2", "y2")} | {"centroid_x": np.full(n, 0.5), "centroid_y": np.full(n, 0.5)}
    order = np.lexsort((kept, -sizes[kept], held))
    firsts = order[np.flatnonzero(np.diff(held[order], prepend=-1))]  # of equal regions the first
    some, best = held[firsts], np.zeros(n, int)
    best[some] = kept[firsts] + 1
    out["largest_ratio"][some] = sizes[kept[firsts]] / max(1, h * w)
    at, ys, xs = np.nonzero((label == best[:, None, None]) & (label > 0))
    if len(at):
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        count = np.diff(starts, append=len(at))
        for c, v, size in (("x", xs, w), ("y", ys, h)):
            out[f"{c}1"][some], out[f"{c}2"][some] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts) + 1
            out[f"centroid_{c}"][some] = (np.add.reduceat(v, starts) / count + 0.5) / size
    return out


def region_summary(mask: np.ndarray, least_ratio: float = 0.0) -> dict:
    """The same of one mask."""
    return {c: v[0].item() for c, v in region_summaries(mask[None], least_ratio).items()}


@F.pandas_udf(REGION_SCHEMA)
def region_statistics(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Of masks: any value over 0 is inside. A null image gives nulls."""
    out = {f.name: pd.array([None] * len(data), "Int32" if isinstance(f.dataType, T.IntegerType) else "Float64") for f in REGION_SCHEMA}
    for places, images in stacks(data, height, width):
        for c, v in region_summaries(images > 0).items():
            out[c][places] = v
    return pd.DataFrame(out)


@F.pandas_udf(T.BinaryType())
def opened_mask(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return _filled(data, height, width, lambda images: [m.tobytes() for m in opened(images > 0).astype(np.uint8) * 255])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def texture_features(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """LBP shares, then co-occurrence properties: 42 numbers."""
    return _filled(data, height, width, lambda images: np.concatenate([uniform_lbp(images), glcm_properties(images)], -1).astype(np.float32).tolist())
