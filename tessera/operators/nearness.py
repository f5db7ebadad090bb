"""Near duplicates by 64-bit fingerprints: Hamming joins by banding, components, numbered groups."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.lineage import cut
from tessera.operators.ranking import with_rank


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Texts and words whose votes are counted at once, and rows of fingerprints with their keys that a task of the join takes.
TEXTS, VOTES, JOINED = 4096, 1 << 16, 1 << 18


def _votes(texts: pa.StringArray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its different words, and for each bit how many more of them set it than not. Every word is hashed once."""
    words = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(texts)), words.value_lengths().fill_null(0).to_numpy())
    flat = words.flatten()
    there = pc.not_equal(flat, "")
    named = flat.filter(there).dictionary_encode()
    # A text's words, each once and text by text: the owner in the upper half of a number, the word in the lower.
    owned = pd.unique(owner[there.to_numpy(zero_copy_only=False)] << 32 | named.indices.to_numpy())
    owner, codes = owned >> 32, owned & 0xFFFFFFFF
    digests = b"".join(md5(w, usedforsecurity=False).digest()[:8] for w in named.dictionary.cast(pa.binary()).to_pylist())
    order = np.frombuffer(digests, ">u8").astype(np.uint64) >> np.uint64(4)  # as boxes.hash_order
    ones = np.unpackbits(order.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]  # on machines of little end
    signs = ones.astype(np.int8) * 2 - 1
    out = np.zeros((len(texts), bits), np.int64)
    for at in range(0, len(codes), VOTES):
        own = owner[at : at + VOTES]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[starts]] += np.add.reduceat(signs[codes[at : at + VOTES]], starts, axis=0, dtype=np.int64)
    return np.bincount(owner, minlength=len(texts)), out


def simhash(df: DataFrame, key: str, text: str, bits: int = 60) -> DataFrame:
    """(key, fingerprint): the bits that most of a text's different words set. No words: null.

    Votes are counted in batches of texts, so that no row is made for a word; only the counts are shuffled.
    """
    names = [f"_v{i}" for i in range(bits)]

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                n, votes = _votes(part.column(1), bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *map(pa.array, np.ascontiguousarray(votes.T))], [key, "_n", *names])

    schema = T.StructType([df.schema[key], *(T.StructField(c, T.LongType()) for c in ("_n", *names))])
    votes = df.select(key, F.lower(F.col(text)).alias("_text")).mapInArrow(voted, schema)
    counted = votes.groupBy(key).agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in names])
    # Halves keep the generated code of each expression small.
    value = None
    for i in range(bits):
        bit = F.when(F.col(f"_v{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        value = bit if value is None else value + bit
    return counted.select(key, F.when(F.col("_n") > 0, value).alias("fingerprint"))


def hamming_pairs(df: DataFrame, fingerprint: str, most: int, bits: int = 64, blocks: int | None = None) -> DataFrame:
    """(hash_a, hash_b, distance): pairs of different fingerprints, read as numbers a < b, at most `most` bits apart.

    The bits are cut into blocks; two such fingerprints agree in all but `most` of them, so an equi-join on each choice of
    blocks - most blocks finds all. A pair is kept only in the first choice in which it agrees, so no distinct is needed.
    Equal fingerprints count once. More blocks make longer keys and more choices; unless given, there are as many as it
    takes for a key to hold about one fingerprint if they were spread evenly, from the count of fingerprints. Both sides are
    dealt to tasks by that count, as adaptive plans judge by bytes, and so few of them would be joined by one task.
    """
    hashes = cut(df.select(F.col(fingerprint).alias("h")).filter("h IS NOT NULL").distinct())
    n = hashes.count()
    if blocks is None:
        blocks = most + 1
        while blocks < min(bits, most + 4) and n >> (bits * (blocks - most) // blocks):
            blocks += 1
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - most))
    masks = [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in own) for own in choices]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "value")
    parts = max(3 * df.sparkSession.sparkContext.defaultParallelism, n * len(masks) // JOINED)
    held = hashes.select("h", keys).repartition(parts, "choice", "value")
    a, b = held.select(F.col("h").alias("hash_a"), "choice", "value"), held.select(F.col("h").alias("hash_b"), "choice", "value")
    off = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    first = F.coalesce(*[F.when(off.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    distance = hamming(F.col("hash_a"), F.col("hash_b")).cast("long")
    joined = a.join(b, ["choice", "value"]).filter("hash_a < hash_b")
    return joined.filter((distance <= most) & (F.col("choice") == first)).select("hash_a", "hash_b", distance.alias("distance"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the least node that each node of the edges reaches.

    Each round hangs every node's neighbours, then its lower neighbours, under its least neighbour; paths halve, so rounds
    grow with the logarithm of their length. Minimums are aggregated before they meet the edges.
    """
    edges = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = cut(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = state


def near_groups(df: DataFrame, key: str, fingerprint: str, most: int, bits: int = 64) -> DataFrame:
    """(key, representative, group): groups that links of at most `most` bits connect, named dup_000000 and on by least key.

    Rows without a fingerprint are groups of their own.
    """
    rows = df.select(key, F.col(fingerprint).alias("h"))
    first = rows.filter("h IS NOT NULL").groupBy("h").agg(F.min(key).alias("first"))
    pairs = hamming_pairs(df, fingerprint, most, bits)
    a, b = first.select(F.col("h").alias("hash_a"), F.col("first").alias("u")), first.select(F.col("h").alias("hash_b"), F.col("first").alias("v"))
    roots = connected_components(pairs.join(a, "hash_a").join(b, "hash_b").select("u", "v"))
    named = rows.join(first, "h", "left").withColumn("first", F.coalesce("first", key)).join(roots.withColumnRenamed("node", "first"), "first", "left")
    named = named.select(key, F.coalesce("root", "first").alias("representative"))
    numbers = with_rank(named.select("representative").distinct(), "number", [F.col("representative")])
    return named.join(numbers, "representative").select(key, "representative", F.format_string("dup_%06d", "number").alias("group"))
