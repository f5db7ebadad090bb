"""The fused frame stream against known scenarios and its batch form, and the data sources of frames and label trees."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.tracking import TrackerOptions
from tessera.plans import streams
from tessera.sources import frame_source
from tessera.sources.config import FusionOptions
from tessera.streaming import frames

QUICK = FusionOptions(window=5, fire_hits=3, smoke_hits=4, alpha=0.4, least_confidence=0.25)
LOOSE = TrackerOptions(min_iou=0.2, max_age=3, min_hits=1)


def feed(engine, places, label="fire", size=(120, 100), planes=(None, None, None)):
    rows = []
    for i, x in enumerate(places):
        boxes = np.array([] if x is None else [x, 20, x + 30, 60], float).reshape(-1, 4)
        n = len(boxes)
        rows += engine.frame(i, i / 10, *size, boxes, np.zeros(n, int), [label] * n, np.full(n, 0.8), planes)
    return rows


def test_one_event_of_a_moving_object():
    engine = frames.Engine(QUICK, LOOSE)
    rows = feed(engine, [10, 12, 14, 16])
    assert [r["state"] for r in rows] == ["POSSIBLE_FIRE"] * 2 + ["CONFIRMED_FIRE"] * 2 and {r["track_id"] for r in rows} == {1}
    (event,) = engine.finish()
    assert (event["start_frame"], event["end_frame"], event["label"], event["event_id"]) == (2, 4, "fire", 1)
    assert event["peak_confidence"] == pytest.approx(0.8) and event["end_seconds"] == pytest.approx(0.4)
    assert all(set(frames._names(frames.FRAME)) <= set(r) for r in rows) and len(frames._names(frames.FRAME)) == 25


def test_known_risk():
    assert frames.risk_of(0.8, 1.0, 0.5, 0.1, 0.2, FusionOptions()) == (pytest.approx(0.715), "HIGH")
    assert frames.risk_of(0.0, 0.0, 0.0, 0.0, -3.0, FusionOptions())[1] == "LOW"


def test_unreported_track_starts_a_new_segment():
    engine = frames.Engine(QUICK, TrackerOptions(min_iou=0.2, max_age=3, min_hits=2))
    rows = feed(engine, [10, None, 10, 10, 10, None, None])
    assert [(r["frame_index"], r["observed"], r["persistence"]) for r in rows if r["rec"] == "frame"] == [(0, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 0, 0.75), (6, 0, 0.6)]
    assert engine.memory[1].event.start_frame == 4 and engine.next_event == 2
    rows = feed(frames.Engine(QUICK, LOOSE), [10, 10, 10, None, None, None, None, 10])
    assert [r["track_id"] for r in rows if r["rec"] == "frame"] == [1] * 6 + [2]
    (event,) = [r for r in rows if r["rec"] == "event"]
    assert (event["start_frame"], event["end_frame"]) == (2, 5) and rows[-1]["growth_ratio"] == 0


def test_motion_is_that_of_whole_pixels():
    rng = np.random.default_rng(8)
    for _ in range(200):
        u, v, foreground = rng.normal(0, 2, (3, 9, 12))
        box = rng.uniform(-4, 16, 4)
        got = frames.motion_in(box, u, v, foreground)
        x1, x2 = (int(min(max(round(c), 0), 12)) for c in box[::2])
        y1, y2 = (int(min(max(round(c), 0), 9)) for c in box[1::2])
        pixels = [(u[y, x], v[y, x], foreground[y, x]) for y in range(y1, y2) for x in range(x1, x2)]
        if not pixels:
            assert got == frames.Motion()
            continue
        moving = [p for p in pixels if np.hypot(p[0], p[1]) >= 1]
        assert got.mean == pytest.approx(np.mean([np.hypot(p[0], p[1]) for p in pixels])) and got.moving == pytest.approx(len(moving) / len(pixels))
        assert got.upward == pytest.approx(np.mean([p[1] < 0 for p in moving]) if moving else 0) and got.foreground == pytest.approx(np.mean([p[2] > 0 for p in pixels]))
    assert frames.motion_in(np.array([0, 0, 2.5, 3.5]), np.full((4, 4), 3.0), np.full((4, 4), -4.0), None).score == pytest.approx(0.35 + 0.35 + 0.15)


def test_a_state_that_is_kept_changes_nothing():
    rng = random.Random(3)
    places = [None if rng.random() < 0.3 else 10 + i / 2 + rng.random() for i in range(60)]
    whole = frames.Engine(QUICK, LOOSE)
    want = feed(whole, places)
    engine, got = frames.Engine(QUICK, LOOSE), []
    for i, x in enumerate(places):
        again = frames.Engine(QUICK, LOOSE)
        again.set_clock(engine.clock())
        for number, row in engine.kept():
            again.restore(number, row)
        boxes = np.array([] if x is None else [x, 20, x + 30, 60], float).reshape(-1, 4)
        got += again.frame(i, i / 10, 120, 100, boxes, np.zeros(len(boxes), int), ["fire"] * len(boxes), np.full(len(boxes), 0.8), (None,) * 3)
        engine = again
    drop = lambda rows: [{k: v for k, v in r.items() if not k.startswith("processing")} for r in rows]
    assert drop(got + engine.finish()) == drop(want + whole.finish()) and any(r["rec"] == "event" for r in got)


T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def frame(stream, index, seen=True):
    one = ([0.0, 0.0, 4.0, 3.0], [0], ["fire"], [0.9]) if seen else (None,) * 4
    return (stream, index, T0 + dt.timedelta(seconds=index), float(index), 8, 6, *one, None, None, None)


def test_quiet_streams_close_and_late_frames_show(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, frames.INPUT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        own = spark.newSession()
        own.conf.set("spark.sql.streaming.stateStore.providerClass", streams.PROVIDER)
        own.conf.set("spark.sql.shuffle.partitions", "2")
        found = frames.stream_frames(own.readStream.schema(frames.INPUT).parquet(f"{tmp_path}/in"), quiet_seconds=20, late="5 seconds")
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(frames.OUTPUT).parquet(f"{tmp_path}/out")

    found = run([frame("a", i) for i in (0, 1, 3, 2)] + [frame("b", 0)])
    assert found.filter("rec = 'event'").count() == 0 and found.filter("rec = 'frame'").count() == 5
    # `a` goes quiet; frame 3 of it comes once more, and frame 40 of `b` moves the watermark past its end.
    found = run([frame("a", 3), frame("b", 40)])
    (event,) = frames.event_rows(found).collect()
    assert (event.stream, event.start_frame, event.end_frame, event.end_seconds) == ("a", 2, 4, 4.0)
    assert [(r.stream, r.frame_index) for r in found.filter("rec = 'late'").collect()] == [("a", 3)]
    # Frames of `a` after that begin a new track; frame 20 lies behind the watermark and is dropped.
    found = run([frame("a", i) for i in (20, 50, 51)])
    assert [(r.frame_index, r.track_id) for r in frames.frame_rows(found).filter("stream = 'a' AND frame_index > 3").orderBy("frame_index").collect()] == [(50, 2), (51, 2)]
    shown = {r.stream: (r.events_total, r.evidence_rows, r.late_frames, r.events_by_class) for r in frames.summary(found).collect()}
    assert shown["a"] == (1, 6, 1, {"fire": 1}) and shown["b"][0] == 0


def lines(stream, indexes):
    return "".join(json.dumps({"stream": stream, "frame_index": i, "rate": [30, None, 0][i % 3], "width": 8, "height": 6, "boxes": [[0, 0, 4, 3]], "classes": [0], "labels": ["fire"], "confidences": [0.9]}) + "\n" for i in indexes)


def test_frames_are_read_once_across_restarts(spark, tmp_path):
    frame_source.register(spark)
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)

    def run():
        stream = spark.readStream.format("frames").option("range_bytes", 100).option("max_frames", 90).load(str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.stream, r.frame_index) for r in spark.read.schema(frames.INPUT).parquet(f"{tmp_path}/out").collect())

    half = lines("a", range(31))
    (folder / "a.jsonl").write_text(half[:-25])  # its last line isn't finished
    (tmp_path / "in" / "b.jsonl").write_text(lines("b", range(5)))
    assert run() == [("a", i) for i in range(30)] + [("b", i) for i in range(5)]
    (folder / "a.jsonl").write_text(half + lines("a", range(31, 100)))
    (folder / "c.jsonl").write_text("\n" + lines("c", range(2)))
    want = [("a", i) for i in range(90)] + [("b", i) for i in range(5)] + [("c", i) for i in range(2)]
    assert run() == want == run()
    whole = spark.read.format("frames").option("range_bytes", 77).option("fallback_rate", 20).option("start", T0.timestamp()).load(str(tmp_path / "in"))
    found = {(r.stream, r.frame_index): r for r in whole.collect()}
    assert len(found) == whole.count() == 107 and found["a", 3].seconds == 0.1 and found["a", 4].seconds == 0.2 and found["a", 5].boxes == [0, 0, 4, 3]
    assert whole.filter("stream = 'a' AND frame_index = 40").select(F.unix_seconds("at")).first()[0] == int(T0.timestamp()) + 2
    with pytest.raises(Exception, match="above 0"):
        spark.read.format("frames").option("fallback_rate", 0).load(str(tmp_path / "in")).count()


def test_label_trees_are_whole_or_absent(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", "0 0.5 0.5 1 1\n"), ("train", "b b", None), ("val", "a", "é")], "split string, name string, text string").repartition(3)
    path = str(tmp_path / "tree")
    frame_source.write_label_tree(rows, path)
    shown = lambda: sorted(map(tuple, frame_source.read_label_tree(spark, path).collect()))
    want = [("train", "a", "0 0.5 0.5 1 1\n"), ("val", "a", "é")]
    assert [r for r in shown() if r[2]] == want and (tmp_path / "tree/train/labels/b b.txt").read_text() == ""
    with pytest.raises(Exception, match="exists already"):
        frame_source.write_label_tree(rows, path)
    broken = rows.union(spark.createDataFrame([("train", "../x", "y")], rows.schema))
    with pytest.raises(Exception, match="slash"):
        frame_source.write_label_tree(broken, path, overwrite=True)
    assert [r for r in shown() if r[2]] == want and [p.name for p in tmp_path.iterdir()] == ["tree"]
    frame_source.write_label_tree(rows.filter("split = 'val'"), path, overwrite=True)
    assert shown() == [("val", "a", "é")] and [p.name for p in tmp_path.iterdir()] == ["tree"]


def test_label_trees_are_written_and_read_by_all_cores(spark, tmp_path, monkeypatch):
    """Files of one split are dealt out, in the writer and in the reader; names are read as they stand, texts in batches."""
    monkeypatch.setattr(frame_source, "BATCH_BYTES", 30)
    rows = [(s, n, f"{s} {n} é\n" * (i % 9)) for s in ("train", "val") for i, n in enumerate([*map(str, range(200)), "a+b", "50%25", "_x", "d.txt"])]
    path = str(tmp_path / "tree")
    frame_source.write_label_tree(spark.createDataFrame(rows, "split string, name string, text string").coalesce(1), path)
    tree = frame_source.read_label_tree(spark, path)
    assert sorted(map(tuple, tree.collect())) == sorted(rows)
    sizes = [len(part) for part in tree.rdd.glom().collect()]
    assert sum(n > 0 for n in sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < len(rows) / 2
    assert "binaryFile" not in tree._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "none").mkdir()
    assert frame_source.read_label_tree(spark, str(tmp_path / "none")).collect() == []
