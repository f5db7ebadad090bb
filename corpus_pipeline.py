"""From raw documents to packed training sequences: quality, near copies, repeated passages, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and reread as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, packing, quality, substring_dedup
from tessera.llm.scratch import Scratch


#: Bytes of a repeated passage that goes: over 50 words, at six bytes a word with its space. (The query op2 keeps to its 400.)
PASSAGE = 300


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that Jaccard links connect, the one with the least doc_id stays."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes that start more than once are cut out of the texts; n_chars follows."""
    cut = substring_dedup.remove_repeated(docs, PASSAGE)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontamination.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing_into_sequences),
]
#: SQL can't tokenise, nor find maximal repeats; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a written table between each two."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before:
            scratch.drop(before)
        before = name.replace(" ", "_")
    return STAGES[-1][1](spark, docs, sf_dir)
