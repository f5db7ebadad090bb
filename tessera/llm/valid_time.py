"""Sales enriched with the version of their client that was valid when they were sold, by a stateful stream fed in batches.

One stage with state (applyInPandasWithState), keyed by the client, of two steps on one store. The gate holds sales until the
horizon H has passed their sold_at. The versions take a batch's changes, answer the sales that the gate lets go, and only then
are pruned up to H but for every client's last one. The query is started anew for each batch on one checkpoint; H and the
changes' watermark, which earlier batches settle, are parameters of a start.

Every start opens a store for each partition, and Spark frees the native counters of a closed RocksDB (some 0.5 MB on 8 cores)
only with its process. So state lies in the executors' heap as long as all rows that could become state fit there (HEAP_ROWS),
and in RocksDB beyond that, where partitions are full and few to a core. Rows and results are the same.

A key is a bucket of clients: its rows lie packed in one field for each step, and every batch, empty or not, brings each
bucket a tick, so that waiting sales leave and versions are pruned without new rows. The number of buckets is a parameter and
follows the rows. A client with a large share of the rows is dealt over a grid of cells: its versions are
spread over the grid's rows (and repeated in each column), its sales over the columns (and repeated in each row). A cell
answers from its own versions; what it says is merged by sale: counts are added, the later version wins, and of the versions
that outlived pruning in their cells only the last one counts, as pruning of the whole client would have left that one only.

Times are microseconds since 1970 without a zone. Defined cases: rows of sales may repeat, each is a sale of its own; equal
rows of changes count once, changes without valid_at not at all; a null client has no versions (its changes can be late); a
null seq or change_id comes before all others; a null or infinite balance gives null cents; a null arrived_at belongs to the
last batch and days before the first to batch 0, so every row has a batch; empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.llm.scratch import shared_dir

BATCHES, FIRST_DAY, DAYS, LAG_HOURS = 10, 19723, 152, 36
#: Rows of a table that a bucket stands for, and the fewest buckets of a stage.
BUCKET_ROWS, LEAST_BUCKETS = 16_384, 16
#: A client with a larger share of either table's rows than this gets a grid of cells; so there are 128 such clients at most.
HOT_SHARE = 1 / 64
#: Stands for null among whole numbers, and for minus infinity among times; ALL is plus infinity.
NONE, ALL = -(1 << 63), (1 << 63) - 1
CHANGE, SALE, TICK = range(3)
#: State lies in the heap up to this many rows of both tables a core, a grid's repeated rows included: were all of them state
#: at once, they would take some 50 MB (about 50 bytes each before they are compressed).
HEAP_ROWS = 1 << 20
_STORE, _PROVIDER = "spark.sql.streaming.stateStore", "org.apache.spark.sql.execution.streaming.state.{}StateStoreProvider"
#: With RocksDB a batch adds its changes instead of whole snapshots, and files take the room that they need only; an executor's
#: stores share one bounded cache and write buffer; rows of state are not counted, as that would read each value before it is
#: written. In the heap only the last version of the state is held.
SETTINGS = {
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "128",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{_STORE}.maintenanceInterval": "10s",
    "spark.sql.streaming.maxBatchesToRetainInMemory": "1",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.parquet.compression.codec": "zstd",
}

_ROWS = "key long, kind int, uid long, id long, client long, at long, seq long, cents long, op string, first boolean"
_NUMBERS = ("uid", "id", "client", "at")
_VERSION = ("client", "at", "seq", "id", "cents", "op")
_ANSWERS = "rec string, batch long, uid long, id long, at long, n_new long, old_at long, old_seq long, old_id long, old_cents long, old_op string, new_at long, new_seq long, new_id long, new_cents long, new_op string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pack(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_all().to_pandas()


class _Field:
    """One field of a bucket's state."""

    def __init__(self, row: dict[str, bytes | None], name: str):
        self.row, self.name = row, name

    def exists(self) -> bool:
        return self.row[self.name] is not None

    def get(self) -> tuple[bytes | None]:
        return (self.row[self.name],)

    def update(self, value: tuple[bytes]) -> None:
        self.row[self.name] = value[0]

    def clear(self) -> None:
        self.row[self.name] = None


class _Fields:
    """A bucket's state, one row of the store with a field for each step; no row if all are empty."""

    NAMES = ("waiting", "versions")
    SCHEMA = ", ".join(f"{name} binary" for name in NAMES)

    def __init__(self, state: GroupState):
        self.state, self.row = state, dict(zip(self.NAMES, state.get if state.exists else (None, None), strict=True))

    def getValueState(self, name: str, schema: str) -> _Field:  # noqa: N802
        return _Field(self.row, name)

    def save(self) -> None:
        if any(value is not None for value in self.row.values()):
            self.state.update(tuple(self.row.values()))
        elif self.state.exists:
            self.state.remove()


class _Kept:
    """A frame in one field of a bucket's state; nothing is stored for an empty one."""

    def __init__(self, handle: _Fields, name: str):
        self.state = handle.getValueState(name, "rows binary")

    def frames(self) -> list[pd.DataFrame]:
        return [_unpack(bytes(self.state.get()[0]))] if self.state.exists() else []

    def put(self, frame: pd.DataFrame) -> None:
        if len(frame):
            self.state.update((_pack(frame),))
        elif self.state.exists():
            self.state.clear()


class Gate:
    """Holds a bucket's sales until their sold_at lies below the horizon; those without one never wait."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: _Fields) -> None:
        self.waiting = _Kept(handle, "waiting")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        came = [r.loc[r["kind"] == SALE, list(_NUMBERS)] for r in rows]
        sales = pd.concat(self.waiting.frames() + came, ignore_index=True)
        go = (sales["at"] < self.horizon) | (sales["at"] == NONE)
        self.waiting.put(sales[~go])
        yield sales[go]


def _last(versions: pd.DataFrame) -> np.ndarray:
    """Whether each of the versions, in order, is its client's last."""
    client = versions["client"].to_numpy()
    return np.append(client[1:] != client[:-1], True) if len(client) else np.empty(0, bool)


def answers(versions: pd.DataFrame, old: np.ndarray, sales: pd.DataFrame) -> pd.DataFrame:
    """What a cell knows of each sale: the number of its client's versions that are not old, the old one, and of the others
    the last that was valid. versions: in order of client, valid_at, seq and change_id; old: which of them pruning spared."""
    new, spared = versions[~old], versions[old]
    columns = {"rec": np.full(len(sales), "sale", object), "batch": np.full(len(sales), NONE), "uid": sales["uid"].to_numpy(), "id": sales["id"].to_numpy(), "at": sales["at"].to_numpy()}
    client, at = sales["client"].to_numpy(), sales["at"].to_numpy()
    low = np.searchsorted(new["client"].to_numpy(), client)
    columns["n_new"] = np.searchsorted(new["client"].to_numpy(), client, "right") - low

    def fill(prefix: str, frame: pd.DataFrame, place: np.ndarray, there: np.ndarray) -> None:
        for name in _VERSION[1:]:
            values = frame[name].to_numpy()
            if name == "op":
                out = np.full(len(place), None, object)
                out[there] = values[place[there]]
            else:
                out = np.full(len(place), NONE, np.int64)
                out[there] = values[place[there]]
            columns[f"{prefix}_{name}"] = out

    known = spared["client"].to_numpy()
    place = np.searchsorted(known, client)
    there = place < len(known)
    there[there] = known[place[there]] == client[there]
    fill("old", spared, place, there)
    # Sales are sorted among the versions; the last version before each, if it is of the same client, is its answer.
    owner = np.concatenate([new["client"].to_numpy(), client])
    order = np.lexsort((np.arange(len(owner)), np.concatenate([new["at"].to_numpy(), at]), owner))
    seen = np.maximum.accumulate(np.where(order < len(new), order, -1)) if len(order) else order
    place = np.empty(len(sales), np.int64)
    mine = order >= len(new)
    place[order[mine] - len(new)] = seen[mine]
    there = (place >= 0) & (at != NONE)
    there[there] = new["client"].to_numpy()[place[there]] == client[there]
    fill("new", new, place, there)
    return pd.DataFrame(columns)[_names(_ANSWERS)]


class Versions:
    """Keeps the versions of a bucket's clients (or of one cell of one client), answers sales, then prunes.

    before and horizon: H of the batch before and of this one; watermark: that of the changes.
    """

    def __init__(self, batch: int, before: int, horizon: int, watermark: int):
        self.batch, self.before, self.horizon, self.watermark = batch, before, horizon, watermark

    def init(self, handle: _Fields) -> None:
        self.versions = _Kept(handle, "versions")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        came = pd.concat(list(rows), ignore_index=True)
        changes, sales = came[came["kind"] == CHANGE], came[came["kind"] == SALE]
        late = changes["at"] < self.watermark
        told = changes[late & changes["first"]]
        fresh = changes[~late & (changes["client"] != NONE)]
        kept = [f.assign(held=True) for f in self.versions.frames()]
        versions = pd.concat([*kept, fresh[list(_VERSION)].assign(held=False)], ignore_index=True).astype({"held": bool})
        versions = versions.iloc[np.lexsort([versions[c].to_numpy() for c in ("cents", "id", "seq", "at", "client")])]
        old = (versions["held"] & (versions["at"] <= self.before)).to_numpy()
        versions = versions[list(_VERSION)]
        if len(sales):
            yield answers(versions, old, sales).assign(batch=self.batch)
        if len(told):
            blank = {name: np.full(len(told), *((None, object) if kind == "string" else (NONE, np.int64))) for name, kind in map(str.split, _ANSWERS.split(", "))}
            yield pd.DataFrame(blank).assign(rec="late", batch=self.batch, id=told["id"].to_numpy())
        below = (versions["at"] <= self.horizon).to_numpy()
        spared = np.zeros(len(versions), bool)
        spared[np.flatnonzero(below)[_last(versions[below])]] = True
        self.versions.put(versions[~below | spared])


class Cell:
    """A bucket's gate and its versions: the sales that the gate lets go are asked of the versions in the same batch."""

    def __init__(self, gate: Gate, versions: Versions):
        self.gate, self.versions = gate, versions

    def init(self, handle: _Fields) -> None:
        self.gate.init(handle)
        self.versions.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        came = list(rows)
        others = [r[r["kind"] != SALE] for r in came]
        for go in self.gate.handleInputRows(key, iter(came), timerValues):
            others += [go.assign(kind=SALE, seq=NONE, cents=NONE, op=None, first=True)] if len(go) else []
        yield from self.versions.handleInputRows(key, iter(others), timerValues)

    def __call__(self, key, rows, state: GroupState) -> Iterator[pd.DataFrame]:
        fields = _Fields(state)
        self.init(fields)
        yield from self.handleInputRows(key, rows, None)
        fields.save()


def _micros(at: str) -> Column:
    """Microseconds since 1970 of a time without a zone; NONE for null."""
    seconds = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60
    return F.coalesce(seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{at}`)") * 1_000_000).cast("long"), F.lit(NONE))


def _batch(day: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS))), F.lit(BATCHES - 1)).cast("int")


def _day(at: str) -> Column:
    return F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date"))


@dataclass
class Layout:
    """How rows are dealt: parts of the sales as they are staged, buckets of clients, the grid (rows, columns) of each hot
    client, and about how many rows there are with those that grids repeat."""

    gates: int = LEAST_BUCKETS
    buckets: int = LEAST_BUCKETS
    hot: dict[int, tuple[int, int]] = field(default_factory=dict)
    rows: int = 0

    def keys(self) -> int:
        return self.buckets + sum(r * c for r, c in self.hot.values())

    def _of(self, client: Column, pick: dict[int, int], usual: int) -> Column:
        out = F.lit(usual)
        for name, value in pick.items():
            out = F.when(client == name, value).otherwise(out)
        return out

    def dealt(self, rows: DataFrame, over_rows: bool) -> DataFrame:
        """Rows with their key, and whether it is the first of a row's keys. over_rows: versions, which a hash puts into one
        row of their client's grid and all of its columns; else sales, which go to one column and all rows."""
        client, starts, at = F.col("client"), {}, self.buckets
        for name, (r, c) in self.hot.items():
            starts[name], at = at, at + r * c
        columns = self._of(client, {n: c for n, (_, c) in self.hot.items()}, 1)
        lines = self._of(client, {n: r for n, (r, _) in self.hot.items()}, 1)
        copies, among = (columns, lines) if over_rows else (lines, columns)
        row = F.xxhash64("id", "at", "uid")
        own = F.pmod(row, among.cast("long"))
        rows = rows.withColumn("_own", own).withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        cell = (F.col("_own") * columns + F.col("_copy")) if over_rows else (F.col("_copy") * columns + F.col("_own"))
        # Rows without a client meet nothing, so they need not meet each other.
        usual = F.pmod(F.when(client == NONE, row).otherwise(F.xxhash64("client")), F.lit(self.buckets).cast("long"))
        start = self._of(client, starts, -1)
        return rows.withColumn("key", F.when(start < 0, usual).otherwise(start + cell)).withColumn("first", F.col("_copy") == 0).drop("_own", "_copy")


def layout(sales: DataFrame, changes: DataFrame, partitions: int) -> Layout:
    """Buckets by the number of rows; a client of a share s gets a square grid of about s * partitions / 4 cells, as each side of
    the grid repeats the other's rows."""
    n_sales, n_changes = sales.count(), changes.count()
    hot: dict[int, float] = {}
    for rows, n in ((sales, n_sales), (changes, n_changes)):
        for r in rows.filter("client_id IS NOT NULL").groupBy("client_id").count().filter(F.col("count") > max(n * HOT_SHARE, BUCKET_ROWS // 4)).collect():  # 1 / HOT_SHARE at most
            hot[r[0]] = max(hot.get(r[0], 0.0), r[1] / n)
    sides = {c: int(np.clip(np.ceil(np.sqrt(s * partitions / 4)), 2, 64)) for c, s in sorted(hot.items())}
    n = n_sales + n_changes
    rows = n + int(sum(n * hot[c] * (k - 1) for c, k in sides.items()))
    return Layout(max(LEAST_BUCKETS, n_sales // BUCKET_ROWS), max(LEAST_BUCKETS, n // BUCKET_ROWS), {c: (k, k) for c, k in sides.items()}, rows)


def _ticks(spark: SparkSession, keys: int) -> DataFrame:
    """A row for each key and batch, that of what still waits after the last one included."""
    each = spark.range(keys).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(BATCHES))).alias("batch"))
    none = F.lit(NONE)
    return each.select("key", F.lit(TICK).alias("kind"), *(none.alias(c) for c in (*_NUMBERS, "seq", "cents")), F.lit(None).cast("string").alias("op"), F.lit(True).alias("first"), "batch")


def _staged(spark: SparkSession, sales: DataFrame, changes: DataFrame, plan: Layout) -> tuple[DataFrame, DataFrame]:
    """Both tables' rows with their batches and all ticks; changes have their cells, sales get theirs when they are read."""
    none, names = F.lit(NONE), [*_names(_ROWS), "batch"]
    whole = lambda c: F.coalesce(F.col(c).cast("long"), none)
    sold = sales.select(
        F.lit(SALE).alias("kind"), F.monotonically_increasing_id().alias("uid"), whole("sale_id").alias("id"), whole("client_id").alias("client"), _micros("sold_at").alias("at"),
        none.alias("seq"), none.alias("cents"), F.lit(None).cast("string").alias("op"), F.lit(True).alias("first"), _batch(_day("arrived_at")).alias("batch"),
    ).withColumn("key", F.pmod(F.xxhash64("uid"), F.lit(plan.gates).cast("long")))
    cents = F.floor(100 * F.col("balance") + 0.5)
    finite = ~F.isnan("balance") & (F.abs("balance") < 9e16)
    changed = changes.select(
        F.lit(CHANGE).alias("kind"), none.alias("uid"), whole("change_id").alias("id"), whole("client_id").alias("client"), _micros("valid_at").alias("at"), whole("seq").alias("seq"),
        F.coalesce(F.when(finite, cents), none).alias("cents"), F.col("op"), _batch(_day("valid_at") + F.coalesce(F.pmod(F.crc32(F.col("change_id").cast("string")), F.lit(4)), F.lit(0))).alias("batch"),
    )
    return sold.select(names).union(_ticks(spark, plan.gates).select(names)), plan.dealt(changed, True).select(names).union(_ticks(spark, plan.keys()).select(names))


def _stage(spark: SparkSession, sales: DataFrame, changes: DataFrame, plan: Layout, folder: str) -> None:
    """Writes both by batch; a task writes a file for each batch, so there are no more tasks than the rows or the cores call for."""
    for name, rows, n in zip(("sales", "changes"), _staged(spark, sales, changes, plan), (plan.gates, plan.keys()), strict=True):
        rows.coalesce(max(n, spark.sparkContext.defaultParallelism)).write.option("compression", "zstd").partitionBy("batch").parquet(f"{folder}/{name}")


def _largest(staged: DataFrame) -> list[int]:
    """The largest time of each batch, NONE where it has none."""
    found = dict(staged.filter(F.col("kind") != TICK).groupBy("batch").agg(F.max("at")).collect())  # a row for each batch
    return [found.get(b, NONE) for b in range(BATCHES)]


def _watermarks(largest: list[int]) -> list[int]:
    """Of each batch: the largest time of the batches before it, less LAG_HOURS."""
    before = np.maximum.accumulate([NONE, *largest])[:BATCHES].tolist()
    return [b - LAG_HOURS * 3_600_000_000 if b != NONE else NONE for b in before]


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Puts a written batch where the stream looks, in one step."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"{source} can't be moved to {target}")


def _drop(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def _start(spark: SparkSession, root: str, plan: Layout, batch: int, before: int, horizon: int, watermark: int) -> None:
    """One start of the query: all that has been fed since the last one, as one micro-batch."""
    stream = lambda name: spark.readStream.schema(f"{_ROWS}, batch int").parquet(f"{root}/in/{name}")
    sold = plan.dealt(stream("sales").filter(F.col("kind") == SALE), False)
    met = stream("changes").select(_names(_ROWS)).union(sold.select(_names(_ROWS)))
    cell = Cell(Gate(horizon), Versions(batch, before, horizon, watermark))
    said = met.groupBy("key").applyInPandasWithState(lambda key, rows, state: cell(key, rows, state), _ANSWERS, _Fields.SCHEMA, "Append", GroupStateTimeout.NoTimeout)
    query = said.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def enrich(sales: DataFrame, changes: DataFrame, plan: Layout | None = None) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op): each sale with its client's version, and each late change.

    sales: sale_id, client_id, sold_at, arrived_at; changes: change_id, client_id, seq, op, valid_at, balance.
    """
    spark = sales.sparkSession
    own = spark.newSession()  # the stream's settings stay its own
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    for name, value in SETTINGS.items():
        own.conf.set(name, value)
    root = f"{shared_dir(spark)}/valid-time-{uuid.uuid4().hex}"
    changes = changes.distinct().filter("valid_at IS NOT NULL")
    plan = plan or layout(sales, changes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fits = plan.rows <= HEAP_ROWS * spark.sparkContext.defaultParallelism
    own.conf.set(f"{_STORE}.providerClass", _PROVIDER.format("HDFSBacked" if fits else "RocksDB"))
    _stage(spark, sales, changes, plan, f"{root}/staged")
    schema = f"{_ROWS}, batch int"
    marks = [_watermarks(_largest(spark.read.schema(schema).parquet(f"{root}/staged/{name}"))) for name in ("sales", "changes")]
    horizons = [min(pair) for pair in zip(*marks, strict=True)]
    for b in range(BATCHES + 1):
        for name in ("sales", "changes"):
            _move(spark, f"{root}/staged/{name}/batch={b}", f"{root}/in/{name}/batch={b}")
        last = b == BATCHES  # what waits leaves, and no change comes
        _start(own, root, plan, b, horizons[b - 1] if b else NONE, ALL if last else horizons[b], NONE if last else marks[1][b])
        if b:  # a start looks at the last committed batch once more, not at those before
            for name in ("sales", "changes"):
                _drop(spark, f"{root}/in/{name}/batch={b - 1}")
    return merged(spark.read.schema(_ANSWERS).parquet(f"{root}/out"))


def merged(said: DataFrame) -> DataFrame:
    """What the cells said of each sale as one row, and the late changes."""
    part = lambda p: F.struct(*(F.col(f"{p}_{c}").alias(c) for c in ("at", "seq", "id", "cents", "op")))
    there = lambda c: F.when(F.col(c) != NONE, F.col(c))
    sales = said.filter("rec = 'sale'").groupBy("uid").agg(
        F.first("id").alias("id"), F.first("batch").alias("batch"), F.first("at").alias("at"), F.sum("n_new").alias("n_new"),
        F.max(F.when(F.col("old_at") != NONE, part("old"))).alias("old"), F.max(F.when(F.col("new_at") != NONE, part("new"))).alias("new"),
    )
    found = sales.withColumn("version", F.greatest("new", F.when(F.col("old.at") <= F.col("at"), F.col("old"))))
    found = found.select(
        F.lit("sale").alias("rec"), there("id").alias("id"), "batch", (F.col("n_new") + F.col("old").isNotNull().cast("long")).alias("n_held"),
        there("version.id").alias("change_id"), there("version.cents").alias("balance_cents"), F.col("version.op").alias("op"),
    )
    null = lambda name, kind="long": F.lit(None).cast(kind).alias(name)
    return found.union(said.filter("rec = 'late'").select("rec", there("id").alias("id"), "batch", null("n_held"), null("change_id"), null("balance_cents"), null("op", "string")))


def op13_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales and client changes."""
    return enrich(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


_DAY = "datediff('day', DATE '1970-01-01', {}::DATE)"
_BATCH = f"greatest(0, least({BATCHES - 1}, floor(({{}} - {FIRST_DAY}) * {BATCHES} / {DAYS})))::BIGINT"
_CRC = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(change_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_concat([xor(a, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
_ORDER = "{'at': valid_at, 'seq': seq, 'id': change_id}"
ORACLE = f"""
WITH s AS MATERIALIZED (SELECT row_number() OVER () AS u, sale_id, client_id, sold_at, {_BATCH.format(_DAY.format("arrived_at"))} AS b FROM sales),
c AS MATERIALIZED (SELECT *, {_BATCH.format(_DAY.format("valid_at") + f" + coalesce(xor({_CRC}, 4294967295) % 4, 0)")} AS b FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL)),
w AS (SELECT n, (SELECT max(sold_at) FROM s WHERE b < n) - INTERVAL {LAG_HOURS} HOUR AS ws, (SELECT max(valid_at) FROM c WHERE b < n) - INTERVAL {LAG_HOURS} HOUR AS wc FROM range({BATCHES}) r(n)),
h AS MATERIALIZED (SELECT n, wc, CASE WHEN ws < wc THEN ws WHEN wc <= ws THEN wc END AS h FROM w),
v AS MATERIALIZED (SELECT c.*, {_ORDER} AS o, coalesce(valid_at < wc, false) AS late FROM c JOIN h ON n = b),
e AS MATERIALIZED (SELECT s.*, coalesce((SELECT min(n) FROM h WHERE n >= b AND (sold_at IS NULL OR sold_at < h)), {BATCHES}) AS e FROM s),
g AS MATERIALIZED (SELECT client_id, n + 1 AS e, max(o) AS g FROM v JOIN h ON NOT late AND b <= n AND valid_at <= h GROUP BY ALL),
a AS (SELECT u, count(o) AS n_held, max(CASE WHEN valid_at <= sold_at THEN {{'o': o, 'cents': floor(100 * balance + 0.5)::BIGINT, 'op': op}} END) AS r
  FROM e LEFT JOIN g USING (client_id, e) JOIN v ON v.client_id = e.client_id AND NOT late AND v.b <= e.e AND NOT coalesce(v.b < e.e AND o < g, false) GROUP BY u)
SELECT 'sale' AS rec, sale_id AS id, e AS batch, coalesce(n_held, 0) AS n_held, r.o.id AS change_id, r.cents AS balance_cents, r.op AS op FROM e LEFT JOIN a USING (u)
UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM v WHERE late
"""
