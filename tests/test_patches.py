"""Patch features against plain loops, known figures and traced borders."""

import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import patches
from tessera.functions.patches import PatchFeatures
from tessera.sources import io


def blobs(seed, h=30, w=34, share=0.5):
    noise = np.random.default_rng(seed).random((h + 4, w + 4))
    smooth = sum(noise[y : y + h, x : x + w] for y in range(5) for x in range(5)) / 25
    return smooth > np.quantile(smooth, 1 - share)


def traced(region):
    """Border pixels of one region in turn, by following its outer border (8 neighbours, clockwise)."""
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    inside = lambda y, x: 0 <= y < region.shape[0] and 0 <= x < region.shape[1] and region[y, x]
    start = tuple(int(v) for v in np.argwhere(region)[0])
    here, back, path, seen = start, 4, [], set()
    while (here, back) not in seen:
        seen.add((here, back))
        for turn in range(1, 9):
            d = (back + turn) % 8
            step = (here[0] + ring[d][0], here[1] + ring[d][1])
            if inside(*step):
                path.append(here)
                here, back = step, (d + 4) % 8
                break
        else:
            return [start]
    return path


def first_turn(path):
    """One way around: the walk up to where it begins again with the same step."""
    for i in range(1, len(path)):
        if path[i] == path[0] and path[(i + 1) % len(path)] == path[1]:
            return path[:i]
    return path


def flooded(mask):
    """Names of regions (8 neighbours) after holes are filled from outside (4 neighbours), by stacks."""
    h, w = mask.shape
    free, stack = {(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1) if not (0 <= y < h and 0 <= x < w and mask[y, x])}, [(-1, -1)]
    while stack:
        y, x = stack.pop()
        if (y, x) in free:
            free.remove((y, x))
            stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    left = {(y, x) for y in range(h) for x in range(w) if mask[y, x] or (y, x) in free}
    out = []
    while left:
        stack, own = [min(left)], set()
        while stack:
            y, x = stack.pop()
            if (y, x) in left:
                left.remove((y, x))
                own.add((y, x))
                stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        region = np.zeros(mask.shape, bool)
        region[tuple(zip(*own, strict=True))] = True
        out.append(region)
    return out


@pytest.mark.parametrize(("seed", "share"), [(s, q) for s in range(8) for q in (0.15, 0.5, 0.8)])
def test_outlines_are_those_of_traced_borders(seed, share):
    mask = blobs(seed, share=share)
    found = []
    for region in flooded(mask):
        path = first_turn(traced(region))
        y, x = np.array(path).T
        area = abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2
        length = np.hypot(x - np.roll(x, -1), y - np.roll(y, -1)).sum()
        cross = x * np.roll(y, -1) - y * np.roll(x, -1)
        centre = [((c + np.roll(c, -1)) * cross).sum() / (3 * cross.sum()) if cross.sum() else 0 for c in (x, y)]
        found.append((area, length, np.ptp(x) + 1, np.ptp(y) + 1, *centre))
    kept = [f for f in found if f[0] / mask.size >= 0.001]
    area, length, w, h, cx, cy = max(kept, key=lambda f: f[0])
    got = patches.outline_statistics(mask, 0.001)
    assert got["component_count"] == len(kept)
    np.testing.assert_allclose(got["area_ratio"], mask.mean())
    want = (area / mask.size, length / (2 * sum(mask.shape)), w / h, area / (w * h), cx / mask.shape[1], cy / mask.shape[0])
    np.testing.assert_allclose([got[k] for k in ("largest_area_ratio", "largest_perimeter_ratio", "largest_aspect_ratio", "largest_extent", "centroid_x", "centroid_y")], want)
    assert 0 < got["largest_solidity"] <= 1


def test_outlines_of_known_shapes():
    box = np.zeros((20, 30), bool)
    box[5:15, 10:26] = True
    ring = box.copy()
    ring[7:13, 12:24] = False
    for mask in (box, ring):  # a hole does not change an outline
        got = patches.outline_statistics(mask)
        assert (got["largest_area_ratio"], got["largest_perimeter_ratio"]) == (15 * 9 / 600, 2 * 24 / 100)
        assert (got["largest_solidity"], got["largest_aspect_ratio"], got["centroid_x"]) == (1.0, 1.6, 17.5 / 30)
    line = np.eye(20, dtype=bool)
    assert patches.outline_statistics(line)["component_count"] == 0  # a line has no area
    kept = patches.outline_statistics(line, 0.0)
    assert kept["largest_area_ratio"] == 0 and kept["centroid_x"] == 0.5 and abs(kept["largest_perimeter_ratio"] - 38 * 2**0.5 / 80) < 1e-12
    assert patches.outline_statistics(np.zeros((5, 5), bool))["centroid_y"] == 0.5
    assert patches.hull_area(np.array([0, 4, 4, 0, 2]), np.array([0, 0, 3, 3, 1])) == 12


def plain_edges(grey, low, high):
    h, w = grey.shape
    at = lambda y, x: int(grey[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    gx, gy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            gx[y, x] = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy[y, x] = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    size = lambda y, x: abs(gx[y, x]) + abs(gy[y, x]) if 0 <= y < h and 0 <= x < w else 0
    weak = set()
    for y in range(h):
        for x in range(w):
            angle, m = np.degrees(np.arctan2(gy[y, x], gx[y, x])) % 180, size(y, x)
            if angle < 22.5 or angle > 157.5:
                peak = m > size(y, x - 1) and m >= size(y, x + 1)
            elif 67.5 < angle < 112.5:
                peak = m > size(y - 1, x) and m >= size(y + 1, x)
            else:
                s = 1 if angle < 90 else -1
                peak = m > size(y - 1, x - s) and m > size(y + 1, x + s)
            if peak and m > low:
                weak.add((y, x))
    out, stack = np.zeros((h, w), bool), [p for p in weak if size(*p) > high]
    while stack:
        y, x = stack.pop()
        if (y, x) in weak:
            weak.remove((y, x))
            out[y, x] = True
            stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_edges_are_those_of_plain_loops(seed):
    grey = (blobs(seed, 24, 26) * 120 + np.random.default_rng(seed).integers(0, 40, (24, 26))).astype(np.uint8)
    np.testing.assert_array_equal(patches.edges(grey), plain_edges(grey, 50, 150))


def test_block_gradients_are_those_of_plain_loops():
    grey, cell, block, bins = np.random.default_rng(3).integers(0, 256, (26, 18)), 4, 2, 9
    cells = np.zeros((6, 4, bins))
    for y in range(24):
        for x in range(16):
            gy = float(grey[y + 1, x] - grey[y - 1, x]) if 0 < y < 25 else 0.0
            gx = float(grey[y, x + 1] - grey[y, x - 1]) if 0 < x < 17 else 0.0
            cells[y // cell, x // cell, int(np.degrees(np.arctan2(gy, gx)) % 180 // 20)] += np.hypot(gy, gx) / 16
    want = []
    for y in range(5):
        for x in range(3):
            v = cells[y : y + 2, x : x + 2].ravel()
            v = np.minimum(v / np.sqrt((v**2).sum() + 1e-10), 0.2)
            want += list(v / np.sqrt((v**2).sum() + 1e-10))
    np.testing.assert_allclose(patches.block_gradients(grey, bins, cell, block), want)


def test_channels_and_sizes():
    image = np.random.default_rng(1).integers(0, 256, (6, 7, 3)).astype(np.uint8)
    image[0, 0], image[0, 1] = 0, 255
    held = patches.channels(image)
    for (y, x), value in np.ndenumerate(held["value"]):
        hue, saturation, high = colorsys.rgb_to_hsv(*(image[y, x] / 255))
        assert abs((held["hue"][y, x] - hue * 180 + 90) % 180 - 90) <= 0.5 + 1e-9 and abs(held["saturation"][y, x] - saturation * 255) <= 0.5 + 1e-9 and round(high * 255) == value
    assert patches.resized(image, 12).shape == (12, 12, 3)
    np.testing.assert_array_equal(patches.resized(np.full((40, 9, 3), 77, np.uint8), 16), np.full((16, 16, 3), 77))
    step = np.repeat(np.array([[[0], [100]]], np.uint8), 3, 2)
    assert patches.resized(step, 4)[0, :, 0].tolist() == [0, 25, 75, 100]


def test_options_name_every_feature():
    image = np.random.default_rng(2).integers(0, 256, (50, 40, 3)).astype(np.uint8)
    kinds = ("gradients", "texture", "colour", "cooccurrence", "outlines")
    whole = patches.patch_features(image, PatchFeatures(side=32))
    assert len(whole) == PatchFeatures(side=32).dimension == 3 * 3 * 36 + 10 + 6 * 16 + 12 + 32 + 9
    parts = [patches.patch_features(image, PatchFeatures(side=32, **{k: k == one for k in kinds})) for one in kinds]
    np.testing.assert_array_equal(np.concatenate(parts), whole)
    assert abs(parts[2][:16].sum() - 1) < 1e-12
    with pytest.raises(ValueError):
        PatchFeatures(**dict.fromkeys(kinds, False))
    with pytest.raises(ValueError):
        PatchFeatures(side=8)


def test_extraction_by_split(spark, tmp_path):
    image = np.random.default_rng(4).integers(0, 256, (20, 24, 3)).astype(np.uint8)
    rows = [("a", "train", 0, bytearray(image.tobytes()), 20, 24), ("b", "train", 1, None, 20, 24), ("c", "val", 1, bytearray(b"xy"), 20, 24)]
    df = spark.createDataFrame(rows, "path string, split string, label int, data binary, height int, width int")
    options = PatchFeatures(side=16, cooccurrence=False)
    got = {r.path: r.v for r in df.select("path", patches.extract(options, F.col("data"), F.col("height"), F.col("width")).alias("v")).collect()}
    np.testing.assert_allclose(got["a"], patches.patch_features(image, options), rtol=1e-6)
    assert got["b"] is None and got["c"] is None
    io.write_split_features(df.filter("path = 'a'"), "train", options, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/features/split=train")).collect()
    assert [(r.path, r.label, len(r.features)) for r in back] == [("a", 0, options.dimension)]
    assert spark.read.json(str(tmp_path / "out/metadata")).first().dimension == options.dimension
    for frame, split in ((df, "val"), (df, "test")):  # a patch that can't be read, then no patch at all
        with pytest.raises(Exception, match="patch"):
            io.write_split_features(frame, split, options, str(tmp_path / "none"))


def test_texts_as_patches(spark, sf):
    from tessera.plans import features

    raw = {r.doc_id: r for r in features.text_patches(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for i, text in texts.items():
        assert bytes(raw[i].data).rstrip(b"\0") == text.encode().rstrip(b"\0") and len(raw[i].data) == raw[i].height * 48
    got = features.patch_vectors(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got[::25]:
        image = np.frombuffer(raw[r.doc_id].data, np.uint8).reshape(-1, 16, 3)
        np.testing.assert_allclose(r.features, patches.patch_features(image, PatchFeatures(side=32, levels=16)), rtol=1e-5, atol=1e-7)
