"""Region sums against plain loops over pixels."""

import numpy as np

from tessera.operators import features


def test_boxes_hold_what_their_pixels_hold(spark):
    rng = np.random.default_rng(2)
    pixels = [(f, x, y, float(rng.normal(0, 2)), float(rng.normal(0, 2)), bool(rng.random() < 0.4)) for f in range(2) for y in range(3, 15) for x in range(2, 20) if rng.random() < 0.9]
    pixels += [pixels[4], pixels[40], (0, 5, 5, None, 1.0, True), (0, 6, 6, 1.0, 1.0, None), (1, 12, 9, float("nan"), 0.0, True), (3, None, 1, 1.0, 1.0, True)]
    boxes = [(f, b, *c) for f in range(4) for b, c in enumerate([(0, 0, 30, 30), (2, 3, 3, 4), (5, 5, 11, 9), (10, 8, 14, 11), (-4, -4, 2, 3), (19, 14, 25, 25), (7, 7, 7, 12), (50, 50, 60, 60), (0, 9, 8, 40), (9, 5, 4, 12)])]
    frames = spark.createDataFrame(pixels, "frame int, x int, y int, u double, v double, foreground boolean")
    got = features.region_motion(frames, spark.createDataFrame(boxes, "frame int, box int, x1 int, y1 int, x2 int, y2 int"), ["frame"], "box").collect()
    assert len(got) == len(boxes)
    for r in got:
        _, _, x1, y1, x2, y2 = next(b for b in boxes if b[:2] == (r.frame, r.box))
        own = [p for p in pixels if p[0] == r.frame and p[1] is not None and x1 <= p[1] < x2 and y1 <= p[2] < y2]
        flow = [(p[3], p[4]) for p in own if p[3] is not None]
        sizes = [np.hypot(*f) for f in flow]
        moving = [f for f, m in zip(flow, sizes, strict=True) if m >= 1 or m != m]
        mean = lambda values: float(np.mean(values)) if len(values) else 0.0
        want = [mean(sizes), mean([m >= 1 or m != m for m in sizes]), mean([v < 0 for _, v in moving]), mean([p[5] for p in own if p[5] is not None]), mean([u for u, _ in moving]), mean([v for _, v in moving])]
        if any(m != m for m in sizes):
            want[0] = want[4] = want[5] = float("nan")
        np.testing.assert_allclose([r.mean_magnitude, r.moving_ratio, r.upward_ratio, r.foreground_ratio, r.dx, r.dy], want, atol=1e-9, err_msg=str((r.frame, r.box)))
