"""Image kernels over stacks against the same kernel image by image, and how their queries deal images out."""

import numpy as np
import pandas as pd
import pytest

from tessera.functions import pixels
from tessera.plans import features

RNG = np.random.default_rng(3)
IMAGES = [RNG.integers(0, 256, (11, 9)).astype(np.uint8), RNG.integers(0, 3, (6, 14)).astype(np.uint8) * 100, None, RNG.integers(0, 2, (11, 9)).astype(np.uint8) * 255, np.zeros((6, 14), np.uint8)]
COLUMNS = (
    pd.Series([None if i is None else i.tobytes() for i in IMAGES], dtype=object),
    pd.Series([None if i is None else i.shape[0] for i in IMAGES], dtype="float"),
    pd.Series([None if i is None else i.shape[1] for i in IMAGES], dtype="float"),
)
SINGLE = {
    "texture_features": lambda i: np.concatenate([pixels.uniform_lbp(i), pixels.glcm_properties(i)]).astype(np.float32).tolist(),
    "perceptual_hash": lambda i: (pixels.perceptual_bits(i) + (1 << 63)) % (1 << 64) - (1 << 63),
    "lbp_histogram": lambda i: pixels.uniform_lbp(i).tolist(),
    "opened_mask": lambda i: (pixels.opened(i > 0) * 255).astype(np.uint8).tobytes(),
}


@pytest.mark.parametrize("name", sorted(SINGLE))
@pytest.mark.parametrize("most", [1, 1 << 17])
def test_stacks_of_any_size_equal_single_images(monkeypatch, name, most):
    monkeypatch.setattr(pixels, "STACK", most)
    assert getattr(pixels, name).func(*COLUMNS).tolist() == [None if i is None else SINGLE[name](i) for i in IMAGES]


def test_regions_of_a_stack_are_those_of_its_images():
    masks = RNG.random((40, 7, 8)) < 0.35
    masks[3] = False
    for least in (0.0, 0.06):
        found = pixels.region_summaries(masks, least)
        assert [{c: v[k].item() for c, v in found.items()} for k in range(40)] == [pixels.region_summary(m, least) for m in masks]
    got = pixels.region_statistics.func(*COLUMNS)
    assert got.isna().all(axis=1).tolist() == [i is None for i in IMAGES] and got.component_count[4] == 0


@pytest.mark.parametrize("name", ["texture_features", "phash_udf", "lbp_hist", "morph_open", "patch_vectors"])
def test_a_single_small_file_is_dealt_to_all_cores(spark, sf, name):
    assert getattr(features, name)(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_patches_of_a_stack_equal_single_ones():
    from tessera.functions import patches

    some = [RNG.integers(0, 256, (h, w, 3)).astype(np.uint8) for h, w in [(40, 16), (3, 16), (90, 50), (7, 7)]] + [np.full((20, 20, 3), 9, np.uint8)]
    ring = np.zeros((40, 40, 3), np.uint8)
    ring[8:30, 8:30], ring[14:24, 14:24] = 250, 0
    some += [ring, ring[::-1, ::-1]]
    options = patches.PatchFeatures(side=32, levels=16)
    assert np.array_equal(patches.patches_features(some, options), np.stack([patches.patch_features(i, options) for i in some]))
    masks = RNG.random((30, 12, 9)) < 0.5
    assert np.array_equal(patches.filled(masks), np.stack([patches.filled(m) for m in masks]))
    grey = RNG.integers(0, 256, (5, 20, 20)).astype(np.uint8)
    assert np.array_equal(patches.edges(grey), np.stack([patches.edges(g) for g in grey]))
