"""Exact-copy queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dedup
from tessera.session import table


def _digested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", dedup.content_digest("text").alias("sha256"))


def exact_dedup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.keep_first_copies(_digested(spark, sf_dir), "sha256", [F.col("n_chars").desc(), F.col("doc_id")])
    return kept.select("doc_id", "source", "lang", "n_chars", "sha256")


def exact_dedup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = dedup.audit_copies(_digested(spark, sf_dir), "sha256", "doc_id", [F.col("n_chars").desc(), F.col("doc_id")], F.col("source"))
    return audit.select("kept", "removed", F.col("digest").alias("sha256"), F.col("conflict").alias("source_conflict"))


QUERIES = {"exact_dedup_keep": exact_dedup_keep, "exact_dedup_audit": exact_dedup_audit}
_RANKED = """
    SELECT doc_id, source, lang, n_chars, sha256(text) AS sha256,
           row_number() OVER w AS rn, first_value(doc_id) OVER w AS kept, first_value(source) OVER w AS kept_source
    FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id)
"""
ORACLES = {
    "exact_dedup_keep": f"SELECT doc_id, source, lang, n_chars, sha256 FROM ({_RANKED}) WHERE rn = 1",
    "exact_dedup_audit": f"SELECT kept, doc_id AS removed, sha256, source IS DISTINCT FROM kept_source AS source_conflict FROM ({_RANKED}) WHERE rn > 1",
}
