"""Group-aware stratified splits and per-class draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import hash_order
from tessera.operators.ranking import with_rank


def group_signatures(df: DataFrame, group: str, signature: str, classes: str) -> DataFrame:
    """(group, signature, size): a group's own signature where all rows agree, else that of all its classes together."""
    from tessera.functions.boxes import class_signature

    return df.groupBy(group).agg(
        F.when(F.min(signature) == F.max(signature), F.min(signature)).otherwise(class_signature(F.array_distinct(F.flatten(F.collect_set(classes))))).alias("signature"), F.count("*").alias("size")
    )


def fill_splits(sizes: list[tuple[int, int]], ratios: Mapping[str, float]) -> list[tuple[int, dict[str, int]]]:
    """How many units of each size, largest first, go to each split; sizes: (size, units).

    Each unit goes to the split with the largest absolute, then relative, deficit (then in the order of ratios). Units of
    one size go together: splits are filled down to a common deficit first, and the few that are left one by one.
    """
    total = sum(size * n for size, n in sizes)
    deficit = {name: total * ratio for name, ratio in ratios.items()}
    target, out = dict(deficit), []
    for size, n in sorted(sizes, reverse=True):
        given = dict.fromkeys(ratios, 0)
        if n > 64:
            low, high = min(deficit.values()) - size * n, max(deficit.values())
            for _ in range(200):
                level = (low + high) / 2
                taken = {k: max(0, int((d - level) // size)) for k, d in deficit.items()}
                low, high = (level, high) if sum(taken.values()) > n - len(ratios) else (low, level)
            given = {k: max(0, int((d - high) // size)) for k, d in deficit.items()}
            deficit = {k: d - size * given[k] for k, d in deficit.items()}
        for _ in range(n - sum(given.values())):
            best = max(ratios, key=lambda k: (deficit[k], deficit[k] / max(target[k], 1e-9)))
            given[best] += 1
            deficit[best] -= size
        out.append((size, given))
    return out


def assign_splits(units: DataFrame, group: str, ratios: Mapping[str, float], seed: int = 42) -> DataFrame:
    """(group, split) for units (group, signature, size): groups stay whole, each signature keeps the ratios.

    Only the histogram of unit sizes is gathered (its rows grow with the square root of the units at most); which units of a
    size go where follows their rank in a seeded hash order, which is made without a single task.
    """
    histogram = units.groupBy("signature", "size").agg(F.count("*").alias("n")).collect()
    rows = []
    for signature in sorted({r.signature for r in histogram}):
        for size, given in fill_splits([(r["size"], r.n) for r in histogram if r.signature == signature], ratios):
            start = 0
            for split, n in given.items():
                rows.append((signature, size, start, start + n, split))
                start += n
    ranked = with_rank(units.withColumn("_k", hash_order(F.lit(str(seed)), F.col(group).cast("string"))), "_rank", [F.col("signature"), F.col("size"), F.col("_k"), F.col(group)])
    bases = ranked.groupBy("signature", "size").agg(F.min("_rank").alias("_base"))
    spans = units.sparkSession.createDataFrame(rows, "signature string, size long, _from long, _to long, split string")
    placed = ranked.join(F.broadcast(bases), ["signature", "size"]).withColumn("_place", F.col("_rank") - F.col("_base"))
    spans = spans.groupBy("signature", "size").agg(F.collect_list(F.struct("_from", "_to", "split")).alias("_spans"))
    found = F.filter("_spans", lambda s: (F.col("_place") >= s["_from"]) & (F.col("_place") < s["_to"]))[0]["split"]
    return placed.join(F.broadcast(spans), ["signature", "size"]).select(group, found.alias("split"))


def cap_per_class(df: DataFrame, classes: list[str], cap: int | Column, order: list[Column]) -> DataFrame:
    """The first `cap` rows of each class in the given order; a null cap keeps all. Spark limits each task's groups first."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*classes).orderBy(*order)))
    most = cap if isinstance(cap, Column) else F.lit(cap)
    return ranked.filter(most.isNull() | (F.col("_rn") <= most)).drop("_rn")


def sample_two_stage(df: DataFrame, keys: Sequence[str], each: int, whole: int, order: Sequence[Column]) -> DataFrame:
    """At most `each` rows of every key, then at most `whole` of those, both the first in the order (a top-k, not a sort)."""
    return cap_per_class(df, keys, each, order).orderBy(*order).limit(whole)
