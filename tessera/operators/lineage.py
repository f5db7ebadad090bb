"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where a session on a single machine has none, as in tests, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/") if named else _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tessera-"))


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
