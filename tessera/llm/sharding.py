"""Sharding by sampled splitters, with DataFrame operations only.

Keys are (hash of the text, hash of the id, id). A size-weighted key sample gives quantile boundaries, which cut the
key space into many ranges of nearly equal bytes; ranges that turn out overfull are sampled again and subdivided. Exact
running sizes within and over the ranges then say which shard a record belongs to.

Law `bytes`: shard sizes are nearly equal. Equal texts have adjacent keys, so copies share a shard. Where a shard's end
falls inside a group of copies, the group stays whole if it holds at most KEEP_WHOLE of a shard, and is cut at the shard's
end if it is larger (one text may hold a third of all rows).

Defined cases: a null text has size 16 and crc 0; an empty table gives no rows; repeated ids are separate records; any
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: Bytes that a record costs besides its text.
OVERHEAD = 16
#: Ranges: one for so many rows, between these bounds. The upper one bounds the broadcast table of boundaries (about 3 MB).
ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES = 20_000, 320, 65_536
#: Sampled keys for each range.
SAMPLES = 24
#: A range with more than so many times its share of the bytes is subdivided, in at most so many rounds.
OVERFULL, ROUNDS = 3, 3
#: The share of a shard up to which copies of a text stay together.
KEEP_WHOLE = 0.005


def _records(docs: DataFrame, key: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("id"),
        (F.octet_length(content) + OVERHEAD).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("crc"),
        F.xxhash64(content).alias("k1"),
        F.xxhash64(F.lit(5), F.col(key)).alias("k2"),
    )


def _key() -> Column:
    return F.struct("k1", "k2")


def _cell(k1: str | Column) -> Column:
    """The top bits of a key, by which boundaries are looked up."""
    return F.shiftright(F.col(k1) if isinstance(k1, str) else k1, 52)


def _splitters(records: DataFrame, total: int, ranges: int, round_no: int) -> DataFrame:
    """Boundary keys: every SAMPLES-th key of a sample of about SAMPLES * ranges keys, drawn with weights by size."""
    draw = (F.xxhash64(F.lit(1000 + round_no), "k1", "k2").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).cast("double")
    sample = records.filter(draw < F.col("size") * (SAMPLES * ranges / max(total, 1))).select("k1", "k2")
    place = F.row_number().over(Window.orderBy("k1", "k2"))  # over the bounded sample alone
    return sample.withColumn("place", place).filter(F.col("place") % SAMPLES == 0).select("k1", "k2")


def _locate(records: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Adds rng: the number of boundaries at or below the key. Only the boundaries of a key's own cell are compared."""
    cells = boundaries.groupBy(_cell("k1").alias("cell")).agg(F.sort_array(F.collect_list(F.struct("k1", "k2"))).alias("own"))
    before = F.coalesce(F.sum(F.size("own")).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before)
    grid = records.sparkSession.range(-2048, 2048).select(F.col("id").alias("cell"))
    grid = grid.join(F.broadcast(cells), "cell", "left")
    filled = F.coalesce(F.col("before"), F.last("upto", True).over(Window.orderBy("cell")), F.lit(0))
    grid = grid.withColumn("upto", F.col("before") + F.size("own")).select("cell", "own", filled.cast("int").alias("before"))
    located = records.withColumn("cell", _cell("k1")).join(F.broadcast(grid), "cell")
    inside = F.when(F.col("own").isNull(), 0).otherwise(F.size(F.filter("own", lambda b: b <= _key())))
    return located.withColumn("rng", F.col("before") + inside).drop("cell", "own", "before")


def shard_by_bytes(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each record: key, size, text_crc32, shard, and slot (gapless from 0 within the shard, in key order)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    records = scratch.save(_records(docs, key, text), "records")
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(max(rows // ROWS_A_RANGE, LEAST_RANGES), MOST_RANGES))

    boundaries = scratch.save(_splitters(records, total, ranges, 0), "boundaries0")
    for round_no in range(1, ROUNDS + 1):
        located = _locate(records, boundaries)
        full = located.groupBy("rng").agg(F.sum("size").alias("held"), F.count("*").alias("n"), F.max("size").alias("largest"))
        full = full.filter((F.col("held") > OVERFULL * total / ranges) & (F.col("n") > 1) & (F.col("held") > 2 * F.col("largest"))).select("rng")
        if full.isEmpty():
            break
        again = located.join(F.broadcast(full), "rng", "left_semi")  # at most `ranges` / OVERFULL ranges
        finer = _splitters(again, total, 4 * ranges, round_no)
        boundaries = scratch.save(boundaries.union(finer).distinct(), f"boundaries{round_no}")

    in_range = Window.partitionBy("rng").orderBy("k1", "k2", "id", "crc")
    placed = scratch.save(
        _locate(records, boundaries)
        .withColumn("upto", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0))),
        "placed",
    )
    over_ranges = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    bases = placed.groupBy("rng").agg(F.max("upto").alias("held")).select("rng", F.coalesce(F.sum("held").over(over_ranges), F.lit(0)).alias("base"))
    started = placed.join(F.broadcast(bases), "rng").withColumn("at", F.col("base") + F.col("upto") - F.col("size") / 2)  # its middle
    quota = max(total, 1) / shards
    shard_of = lambda at: F.least(F.floor(at / F.lit(quota)), F.lit(shards - 1)).cast("int")
    # Groups of copies over a shard's end: at most shards - 1 of them.
    cut = (
        started.groupBy("k1")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("size").alias("held"))
        .filter((shard_of(F.col("first")) != shard_of(F.col("last"))) & (F.col("held") <= KEEP_WHOLE * quota))
        .select("k1", shard_of((F.col("first") + F.col("last")) / 2).alias("whole"))
    )
    sharded = started.join(F.broadcast(cut), "k1", "left").withColumn("shard", F.coalesce("whole", shard_of(F.col("at"))))
    sharded = scratch.save(sharded.select("id", "size", "crc", "k1", "k2", "rng", "shard"), "sharded")
    scratch.drop("records", "placed")
    counts = sharded.groupBy("shard", "rng").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "rng", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("rng", "shard").orderBy("k1", "k2", "id", "crc")
    return sharded.join(F.broadcast(counts), ["shard", "rng"]).select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("before") + F.row_number().over(within) - 1).cast("long").alias("slot"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `bytes`."""
    sharded = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
