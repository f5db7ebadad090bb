"""Global ranks without gathering all rows in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import cut


def with_rank(df: DataFrame, name: str, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Adds a rank from 0 in the given total order: places within range partitions, plus the rows of those before."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = sorted_rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")


def running_sums(df: DataFrame, keys: Sequence[str], order: Column, sums: Mapping[str, str]) -> DataFrame:
    """Adds each named sum of a column over all earlier rows of the key, 0 at first, without one task for a key.

    Range partitions hold a stretch of a key each; their totals, a row for each key and partition, give what comes before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = cut(df.repartitionByRange(n, *keys, order).withColumn("_part", F.spark_partition_id()))
    totals = parted.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    own = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parted.join(F.broadcast(before), [*keys, "_part"])
    out = joined.select("*", *[(F.col(f"_{name}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(name) for name, c in sums.items()])
    return out.drop("_part", *[f"_{name}" for name in sums])


def beside(df: DataFrame, keys: Sequence[str], order: str, value: str, before: str, after: str | None = None, falling: bool = False) -> DataFrame:
    """Adds the nearest earlier, and later if asked for, value of the key that is not null, without one task for a key.

    A row's own value does not count; rows of a key differ in `order`. Range partitions hold a stretch of a key each; what
    their neighbours end and begin with, a row for each key and partition, reaches over their edges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = lambda back: F.col(order).desc() if back else F.col(order).asc()
    parted = cut(df.repartitionByRange(n, *keys, along(falling)).withColumn("_part", F.spark_partition_id()))
    there = F.when(F.col(value).isNotNull(), F.col(order))
    low, high = F.min_by(value, there), F.max_by(value, there)
    ends = parted.groupBy(*keys, "_part").agg((high if falling else low).alias("_first"), (low if falling else high).alias("_last"))
    out, wanted = parted, [(before, "_last", falling, F.asc("_part"))] + ([(after, "_first", not falling, F.desc("_part"))] if after else [])
    reach = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = [F.last(end, ignorenulls=True).over(reach(Window.partitionBy(*keys).orderBy(parts))).alias(f"_{name}") for name, end, _, parts in wanted]
    out = out.join(F.broadcast(ends.select(*keys, "_part", *over)), [*keys, "_part"])  # a row for each key and partition
    own = [F.last(value, ignorenulls=True).over(reach(Window.partitionBy(*keys, "_part").orderBy(along(back)))) for _, _, back, _ in wanted]
    found = [F.coalesce(near, F.col(f"_{name}")).alias(name) for near, (name, *_) in zip(own, wanted, strict=True)]
    return out.select("*", *found).drop("_part", *[f"_{name}" for name, *_ in wanted])
