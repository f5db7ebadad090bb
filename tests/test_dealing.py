"""Streams pass through tasks in batches: results don't depend on where a batch is cut, nor on arrays or plain numbers."""

import numpy as np
import pytest

from tessera.operators import tracking
from tessera.plans import features, streams

RNG = np.random.default_rng(11)


def moving(spark):
    """Streams of up to 30 frames with up to five boxes each, some frames without any."""
    rows = []
    for s in range(9):
        for n in range(3 * s + 1):
            boxes = [(40.0 * k + n, 5.0, 40.0 * k + n + 30, 45.0, k % 2, 0.5 + k / 10) for k in range((s + n) % 6)]
            rows += [(f"s{s}", n, *b) for b in boxes] or [(f"s{s}", n, None, None, None, None, 0, 0.0)]
    return spark.createDataFrame(rows, "stream string, frame_index long, x1 double, y1 double, x2 double, y2 double, class_id int, confidence double")


def test_tracks_over_batches_of_any_size(spark):
    found = []
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append(sorted(map(repr, tracking.track(moving(spark)).collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    short = sorted(map(repr, tracking.track(moving(spark), history=False).collect()))
    assert found[0] == found[1] and len(found[0]) > 100
    assert [r.split(", center_history")[0] + ")" for r in found[0]] == short


def test_plain_overlaps_equal_arrays():
    a, b = RNG.random((3, 4)) * 50, RNG.random((5, 4)) * 50
    b[0] = a[0]
    assert np.array_equal(tracking.overlaps(a.tolist(), b.tolist()), tracking.iou_matrix(a, b))
    assert tracking.assign([[3.0, 1.0, 1.0]]) == [(0, 1)] and tracking.assign([[3.0], [1.0], [1.0]]) == [(1, 0)] and tracking.assign(np.zeros((0, 3))) == []


def test_sort_tracker_takes_no_call_for_each_stream(spark, sf):
    rows = features.sort_tracker(spark, sf)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fused_frames", "fused_events"])
def test_fused_streams_over_batches_of_any_size(spark, sf, name):
    rows, found = getattr(streams, name)(spark, sf), []
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert not any("array" in line.lower() for line in plan.split("\n") if "Exchange" in line)  # planes are drawn after the shuffle
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append(sorted(map(repr, getattr(streams, name)(spark, sf).collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and found[0]


def test_rows_of_a_stream_are_quickly_made():
    """A few rows take no pass over all columns with types of their own."""
    from time import perf_counter

    from tessera.streaming import frames

    rows = [{"rec": "late", "frame_index": n} for n in range(3)]
    frames._frame(rows, "a")
    began = perf_counter()
    for _ in range(50):
        found = frames._frame(rows, "a")
    assert perf_counter() - began < 50 * 0.004
    assert found["stream"].tolist() == ["a"] * 3 and found["frame_index"].tolist() == [0, 1, 2] and found["track_id"].isna().all()
