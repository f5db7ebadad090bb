import datetime as dt
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import valid_time as v

DAY0, HOUR = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, status string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double"


def batch(day):
    return max(0, min(9, (day - 19723) * 10 // 152))


def days(t):
    return (t - dt.datetime(1970, 1, 1)).days


def brute(sales, changes):
    """The contract, row by row. sales: (id, client, sold, arrived); changes: (id, client, seq, op, valid, balance)."""
    changes = [c for c in dict.fromkeys(changes) if c[4] is not None]
    came = defaultdict(lambda: ([], []))
    for s in sales:
        came[9 if s[3] is None else batch(days(s[3]))][0].append(s)
    for c in changes:
        came[batch(days(c[4]) + (zlib.crc32(str(c[0]).encode()) % 4 if c[0] is not None else 0))][1].append(c)
    top, out, waiting, held = [None, None], [], [], defaultdict(list)
    order = lambda c: (c[4], -(2**63) if c[2] is None else c[2], -(2**63) if c[0] is None else c[0])

    def emit(s, b):
        own = held[s[1]] if s[1] is not None else []
        fits = [c for c in own if s[2] is not None and c[4] <= s[2]]
        c = max(fits, key=order, default=None)
        cents = None if c is None or c[5] is None else int(np.floor(100 * c[5] + 0.5))
        out.append(("sale", s[0], b, len(own), c and c[0], cents, c and c[3]))

    for b in range(10):
        marks = [None if t is None else t - 36 * HOUR for t in top]
        horizon = None if None in marks else min(marks)
        new_sales, new_changes = came[b]
        for c in new_changes:
            if marks[1] is not None and c[4] < marks[1]:
                out.append(("late", c[0], b, None, None, None, None))
            else:
                held[c[1]].append(c)
        go = lambda s: s[2] is None or (horizon is not None and s[2] < horizon)  # noqa: B023, E731
        for s in [s for s in waiting + new_sales if go(s)]:
            emit(s, b)
        waiting = [s for s in waiting + new_sales if not go(s)]
        for client, own in held.items():
            below = sorted([c for c in own if horizon is not None and c[4] <= horizon], key=order)
            held[client] = [c for c in own if c not in below[:-1]]
        top = [max([t for t in (old, *new) if t is not None], default=None) for old, new in zip(top, ([s[2] for s in new_sales], [c[4] for c in new_changes]), strict=True)]
    for s in waiting:
        emit(s, 10)
    return sorted(out, key=repr)


def case(seed=1, n=900):
    rng = random.Random(seed)
    moment = lambda: DAY0 + dt.timedelta(seconds=rng.randrange(150 * 24) * 3600 + rng.choice([0, 0, 1, 1799]))
    client = lambda: rng.choice([7, 7, 7, 1, 2, 3, None, *range(10, 30)])
    sales, changes = [], []
    for i in range(n):
        sold = moment()
        arrived = sold + dt.timedelta(hours=rng.choice([0, 1, 30, 60, 500]))
        sales.append((rng.choice([i, i, None]), client(), rng.choice([sold] * 20 + [None]), rng.choice([arrived] * 30 + [None])))
        changes.append((i, client(), rng.choice([i, 5, None]), rng.choice("IUD"), rng.choice([moment()] * 20 + [None]), rng.choice([rng.randrange(-10**6, 10**6) / 100, None, 0.005])))
    sales += sales[:5]
    changes += changes[:50] + [(None, 7, None, None, moment(), 1.0)]
    return sales, changes


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.values = defaultdict(Value)

    def getValueState(self, name, schema):  # noqa: N802
        return self.values[name]


def whole(x):
    return v.NONE if x is None else x


def micros(t):
    return v.NONE if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def played(sales, changes, grid=1):
    """The two processors run by hand, over one gate and a grid of cells for all clients."""
    changes = [c for c in dict.fromkeys(changes) if c[4] is not None]
    columns = v._names(v._ROWS)
    s = pd.DataFrame([(0, v.SALE, i, whole(x[0]), whole(x[1]), micros(x[2]), v.NONE, v.NONE, None, True, 9 if x[3] is None else batch(days(x[3]))) for i, x in enumerate(sales)], columns=[*columns, "batch"])
    cents = lambda b: v.NONE if b is None else int(np.floor(100 * b + 0.5))
    c = pd.DataFrame([(0, v.CHANGE, v.NONE, whole(x[0]), whole(x[1]), micros(x[4]), whole(x[2]), cents(x[5]), x[3], True, batch(days(x[4]) + (zlib.crc32(str(x[0]).encode()) % 4 if x[0] is not None else 0))) for x in changes], columns=[*columns, "batch"])
    largest = [[int(f.loc[f["batch"] == b, "at"].max()) if (f["batch"] == b).any() else v.NONE for b in range(10)] for f in (s, c)]
    marks = [v._watermarks(x) for x in largest]
    horizons = [min(p) for p in zip(*marks, strict=True)]
    gate, cells, said = Handle(), defaultdict(Handle), []
    for b in range(11):
        own = v.Gate(horizons[b] if b < 10 else v.ALL)
        own.init(gate)
        out = pd.concat([*own.handleInputRows((0,), iter([s[s["batch"] == b]]), None)])
        asked = out.assign(key=0, kind=v.SALE, seq=v.NONE, cents=v.NONE, op=None, first=True)[columns]
        new = c.loc[c["batch"] == b, columns]
        for i in range(grid):
            for j in range(grid):
                stage = v.Versions(b, horizons[b - 1] if b else v.NONE, horizons[b] if b < 10 else v.ALL, marks[1][b] if b < 10 else v.NONE)
                stage.init(cells[i, j])
                mine = new[new["at"] // 1_000_000 // 1800 % grid == i].assign(first=j == 0)
                said += stage.handleInputRows((0,), iter([mine, asked[asked["uid"] % grid == j]]), None)
    return pd.concat(said, ignore_index=True)


def shown(rows):
    return sorted((tuple(r[c] for c in ("rec", "id", "batch", "n_held", "change_id", "balance_cents", "op")) for r in rows), key=repr)


@pytest.mark.parametrize("grid", [1, 3])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stages_follow_the_contract(spark, grid, seed):
    sales, changes = case(seed)
    said = spark.createDataFrame(played(sales, changes, grid), v._ANSWERS)
    assert shown(v.merged(said).collect()) == brute(sales, changes)


def test_stream_matches_brute_force(spark):
    sales, changes = case(4, 700)
    frame = spark.createDataFrame([(*s, "x") for s in sales], SALES).withColumn("key", F.lit(1)).withColumn("batch", F.lit(2)).withColumn("uid", F.lit(3))
    rows = v.enrich(frame, spark.createDataFrame(changes, CHANGES), v.Layout(3, 4, {7: (2, 3), 1: (2, 2)})).collect()
    assert shown(rows) == brute(sales, changes)


def test_layout_and_empty_tables(spark, monkeypatch):
    sales, changes = (spark.createDataFrame(rows, schema) for rows, schema in zip(case(), ("sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz", CHANGES), strict=True))
    monkeypatch.setattr(v, "BUCKET_ROWS", 100)
    plan = v.layout(sales, changes, 400)
    assert set(plan.hot) >= {7, 1, 2, 3} and plan.hot[7][0] > plan.hot[1][0] >= 2 and plan.gates == 16 and plan.buckets == 18
    staged = [f.filter(f.kind != v.TICK) for f in v._staged(spark, sales, changes, plan)]
    keys = staged[1].groupBy("id", "at", "seq").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("firsts"), F.first("client").alias("client")).filter("id >= 0").collect()
    assert all(r.firsts * plan.hot.get(r.client, (1, 1))[1] == r.n for r in keys)
    assert v._staged(spark, sales.limit(0), changes.limit(0), plan)[0].count() == 16 * 11
    micros_of = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30, 1, 5),), (dt.datetime(1969, 12, 31, 23, 0),), (None,)], "t timestamp_ntz").select(v._micros("t")).collect()
    assert [r[0] for r in micros_of] == [micros(dt.datetime(2024, 3, 31, 2, 30, 1, 5)), -3_600_000_000, v.NONE]


def test_a_start_opens_one_store_for_a_partition_and_reads_few_files(spark, tmp_path):
    """Spark keeps native memory for every store that was opened, so the gate and the versions share one."""
    sales, changes = (spark.createDataFrame(rows, schema) for rows, schema in zip(case(), ("sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz", CHANGES), strict=True))
    plan, own = v.Layout(3, 4, {7: (2, 3)}), spark.newSession()
    for name, value in {**v.SETTINGS, "spark.sql.shuffle.partitions": "5"}.items():
        own.conf.set(name, value)
    v._stage(spark, sales.repartition(40), changes.repartition(40), plan, f"{tmp_path}/in")
    assert all(len([*(tmp_path / "in" / name / "batch=0").glob("*.parquet")]) <= max(10, spark.sparkContext.defaultParallelism) for name in ("sales", "changes"))
    v._start(own, str(tmp_path), plan, 0, v.NONE, v.NONE, v.NONE)
    assert [p.name for p in (tmp_path / "state" / "state").iterdir() if p.is_dir()] == ["0"]


def test_a_cell_is_its_gate_and_its_versions():
    ask = dict.fromkeys(v._names(v._ROWS), v.NONE) | {"op": None, "first": True, "key": 0}
    rows = [ask | {"kind": v.CHANGE, "id": 5, "client": 1, "at": 10, "seq": 2**62 + 1, "cents": 7, "op": "U"}, *(ask | {"kind": v.SALE, "uid": n, "id": n, "client": 1, "at": at} for n, at in enumerate((12, 40, v.NONE)))]
    handle, found = Handle(), []
    for horizon, came in ((20, rows), (50, [ask | {"kind": v.TICK}])):
        cell = v.Cell(v.Gate(horizon), v.Versions(0, v.NONE, horizon, v.NONE))
        cell.init(handle)
        found.append(pd.concat([*cell.handleInputRows((0,), iter([pd.DataFrame(came)]), None)]))
    assert [f["uid"].tolist() for f in found] == [[0, 2], [1]]
    assert found[0]["new_seq"].tolist() == [2**62 + 1, v.NONE] and found[1]["new_cents"].tolist() == [7] and found[1]["new_op"].tolist() == ["U"]


@pytest.mark.parametrize("heap_rows, kind", [(v.HEAP_ROWS, "delta"), (0, "changelog")])
def test_only_large_state_opens_native_stores(spark, monkeypatch, heap_rows, kind):
    """Spark keeps native memory for every RocksDB that was opened; both stores hold the same rows."""
    monkeypatch.setattr(v, "HEAP_ROWS", heap_rows)
    sales, changes = case(5, 200)
    folder = Path(v.shared_dir(spark).removeprefix("file://"))
    before = {*folder.glob("valid-time-*")}
    rows = v.enrich(spark.createDataFrame([(*s, "x") for s in sales], SALES), spark.createDataFrame(changes, CHANGES)).collect()
    (root,) = {*folder.glob("valid-time-*")} - before
    assert shown(rows) == brute(sales, changes)
    assert {f.suffix[1:] for f in (root / "state" / "state").rglob("[0-9]*.*")} & {"delta", "changelog", "zip"} == {kind}


def test_layout_counts_the_rows_that_grids_repeat(spark, monkeypatch):
    monkeypatch.setattr(v, "BUCKET_ROWS", 100)
    sales, changes = (spark.createDataFrame([(*r, *[None] * n) for r in rows], schema) for rows, n, schema in (([(i, 7 if i < 50 else None) for i in range(100)], 3, SALES), ([(i, i) for i in range(20)], 4, CHANGES)))
    assert v.layout(sales, changes, 72).hot == {7: (3, 3)} and v.layout(sales, changes, 72).rows == 120 + 60 * 2


class State:
    exists, removed = False, False

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists, self.removed = False, True


def test_fields_of_a_bucket_are_one_row():
    state = State()
    for waiting, versions in ((None, None), (pd.DataFrame({"a": [2**62 + 1]}), None), (None, pd.DataFrame({"b": ["x", None]}))):
        fields = v._Fields(state)
        for name, frame in zip(v._Fields.NAMES, (waiting, versions), strict=True):
            v._Kept(fields, name).put(pd.DataFrame() if frame is None else frame)
        fields.save()
        again = v._Fields(state)
        found = [v._Kept(again, name).frames() for name in v._Fields.NAMES]
        assert [[f.to_dict("list") for f in fs] for fs in found] == [[] if f is None else [f.to_dict("list")] for f in (waiting, versions)]
        assert state.exists == (waiting is not None or versions is not None)
    v._Kept(again, "versions").put(pd.DataFrame())
    again.save()
    assert state.removed and not state.exists
