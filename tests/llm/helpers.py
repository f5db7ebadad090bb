"""Small tables with the cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def clashing(df):
    """With further columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    for name in ("rows", "shard", "size", "id", "key", "hash", "count", "n_words", "kept", "component_id", "start", "length", "batch", "bucket", "set_id"):
        df = df.withColumn(name, F.lit(1))
    return df


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_texts():
    rng = random.Random(7)
    base = prose(rng, 300)
    return [None, "", " \n\t ", "one", "one", "Ünïcode 漢字 <b>", base, base, base + " tail", prose(rng, 30_000), "same " * 900, "a\nb\n\na\nb"]
