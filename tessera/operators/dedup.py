"""Exact duplicates: one keeper for each content digest, and an audit of what was removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_digest(content: str | Column) -> Column:
    """SHA-256 of a string or binary column, lowercase hex."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def rank_copies(df: DataFrame, digest: str, prefer: Sequence[Column]) -> DataFrame:
    """Adds copy_rank (1 for the keeper) within each digest, by the given preference order.

    Rows without a digest are nobody's copy: each gets rank 1.
    """
    window = Window.partitionBy(digest).orderBy(*prefer)
    return df.withColumn("copy_rank", F.when(F.col(digest).isNull(), F.lit(1)).otherwise(F.row_number().over(window)))


def keep_first_copies(df: DataFrame, digest: str, prefer: Sequence[Column]) -> DataFrame:
    """The keeper of each digest."""
    return rank_copies(df, digest, prefer).filter("copy_rank = 1").drop("copy_rank")


def audit_copies(df: DataFrame, digest: str, key: str, prefer: Sequence[Column], compare: Column | None = None) -> DataFrame:
    """A row for each removed copy: (kept, removed, digest, conflict).

    conflict says whether `compare` differs between the copy and its keeper; false without `compare`.
    """
    window = Window.partitionBy(digest).orderBy(*prefer)
    value = F.lit(True) if compare is None else compare
    ranked = (
        df.filter(F.col(digest).isNotNull())
        .withColumn("_value", value)
        .select(
            F.col(digest).alias("digest"),
            F.first(key).over(window).alias("kept"),
            F.col(key).alias("removed"),
            (~F.col("_value").eqNullSafe(F.first("_value").over(window))).alias("conflict"),
            F.row_number().over(window).alias("_rank"),
        )
    )
    return ranked.filter("_rank > 1").select("kept", "removed", "digest", "conflict")
