"""Removal of word windows that start more than once, by seeds that are extended both ways.

Seeds are winnowed: of the WINDOW - GRAM + 1 grams (GRAM words each) in a window of WINDOW words, the one with the least hash
(the rightmost of equals) is the window's anchor. Equal windows have equal anchors at equal places, so repeats are looked
for only where documents join on an anchor. The windows of one anchor are neighbours; together they cover its stretch, from
the start of the first to the end of the last.

1. Anchors are counted, and joined with those that occur more than once. If all occurrences of an anchor have the same
   stretch, all its windows are repeats: the match extends over the whole of it, both ways.
2. Elsewhere each distinct stretch is extended once, whatever the number of its occurrences: the match of two occurrences
   takes in a window if as many words before and after their anchors are equal as the window has there, which is an equal
   hash of the anchor and of the window. Windows are counted by these hashes, so no pairs of occurrences are formed.
3. Overlapping windows join to maximal repeats, which are cut out.

All groups are counted with partial sums and joined by their keys, where adaptive execution splits what is heavy. Texts are
named by the 128 bits of their MD5, so copies share what is found of them. Anchors and stretches, and anchors and windows,
are told apart by 128 bits, the words in them by 64.

Defined cases: a null or empty text has no words, and keeps the digest of nothing; texts of fewer than WINDOW words keep all
words; repeated rows are texts that start again, so all of theirs go if they have WINDOW words; keys may be null or shared;
an empty table gives no rows; long texts are read whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arrow, hashing
from tessera.llm.scratch import Scratch

WINDOW, GRAM = 35, 8
#: Text bytes that are looked at together.
SLICE = 1 << 20
#: A second base, so that windows and stretches are hashed apart from their anchors.
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
SETTLED, OPEN, SHOWN = range(3)


def least_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least hash, the rightmost of equals, in each run of `width` hashes; by doubling."""
    size = len(hashes) - width + 1
    if size <= 0:
        return np.empty(0, np.int64)
    best, span = np.arange(len(hashes)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        span += step
    return best


class Slice:
    """The words of some texts end to end, and their anchors.

    Of each anchor: its word's place `at`, its text, its first and last window (`low`, `high`), and its gram's hash.
    """

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self.window = window
        words, counts = hashing.word_hashes(texts, lower=False)
        self.counts, self.starts = counts, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.sums = self._sums(words, _BASE)
        grams = np.arange(max(len(words) - gram + 1, 0))
        keys = hashing.mixed((self._sums(words, hashing.BASE)[grams + gram] - self._sums(words, hashing.BASE)[grams]) * hashing.power(hashing.INVERSE, len(words) + 1)[grams], gram) if len(grams) else np.empty(0, np.uint64)
        own = least_of(keys, window - gram + 1)
        owner = np.repeat(np.arange(len(texts)), counts)[: len(own)]
        fits = np.flatnonzero(np.arange(len(own)) + window <= self.starts[owner + 1])
        anchor = own[fits]
        begins = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[fits][1:] != owner[fits][:-1]))) if len(fits) else fits
        ends = np.append(begins[1:], len(fits)) if len(fits) else begins
        self.at, self.text, self.low, self.high = anchor[begins], owner[fits[begins]], fits[begins], fits[ends - 1]
        self.keys = keys[self.at]

    @staticmethod
    def _sums(words: np.ndarray, base: int) -> np.ndarray:
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * hashing.power(base, len(words)), out=sums[1:])
        return sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return hashing.mixed((self.sums[ends] - self.sums[starts]) * hashing.power(_INVERSE, len(self.sums))[starts], ends - starts)

    def stretches(self) -> np.ndarray:
        """A hash of each anchor's stretch and of its place in it."""
        return self.hashes(self.low, self.high + self.window) ^ ((self.at - self.low).astype(np.uint64) * np.uint64(hashing.BASE))

    def places(self) -> np.ndarray:
        return (self.at - self.starts[self.text]).astype(np.int32)

    def removed(self, starts: np.ndarray) -> np.ndarray:
        """Whether each word lies in a window that starts at one of the given places."""
        marks = np.zeros(len(self.sums) + self.window, np.int32)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + self.window, -1)
        return np.cumsum(marks)[: len(self.sums) - 1] > 0


def _windows(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from low to high, and whose they are."""
    held = high - low + 1
    owner = np.repeat(np.arange(len(low)), held)
    return low[owner] + np.arange(len(owner)) - (np.cumsum(held) - held)[owner], owner


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _chosen(texts: Slice, column: pa.Array, kinds: set[int]) -> np.ndarray:
    """Which of the slice's anchors the facts (lists of place and state) put among the given states."""
    found = np.zeros(len(texts.at), bool)
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    place, state = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    at = place + np.repeat(texts.starts[:-1], lengths)
    found[np.searchsorted(texts.at, at[np.isin(state, list(kinds))])] = True
    return found


_FACTS = "array<struct<place:int,state:int>>"


def _facts(docs: DataFrame, scratch: Scratch, window: int, gram: int) -> DataFrame:
    """(name, facts): for each text, its anchors that occur more than once, with their states. docs: (name, content)."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content", SLICE):
            texts = Slice(arrow.octets(batch.column("content")), window, gram)
            yield pa.RecordBatch.from_arrays([_signed(texts.keys), _signed(texts.stretches()), batch.column("name").take(pa.array(texts.text)), pa.array(texts.places())], ["anchor", "stretch", "name", "place"])

    every = docs.mapInArrow(anchors, "anchor long, stretch long, name binary, place int")
    every = scratch.save(every, "anchors")
    # Counts are written before they meet what they count: both sides of a join then come straight from an exchange, and
    # adaptive execution can split the rows of a heavy key over tasks.
    counted = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("first"), F.max("stretch").alias("last")).filter("n > 1")
    counted = scratch.save(counted.select("anchor", (F.col("first") != F.col("last")).alias("several")), "counted")
    met = scratch.save(every.join(counted, "anchor"), "met")
    scratch.drop("anchors", "counted")
    mixed = met.filter("several")
    # Of the occurrences of one stretch, the least stands for all where windows are compared.
    shown = mixed.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("name", "place")).alias("shown"))
    shown = scratch.save(shown, "stretches")
    is_shown = F.struct("name", "place") == F.col("shown")
    state = F.when(F.col("n") == 1, OPEN).when(is_shown, SHOWN).otherwise(SETTLED)
    # Where a text's copies hold one stretch, each of their rows may be the shown one; facts of a text are kept once.
    facts = met.filter("NOT several").select("name", "place", F.lit(SETTLED).alias("state"))
    facts = facts.union(mixed.join(shown, ["anchor", "stretch"]).select("name", "place", state.alias("state")))
    return facts.groupBy("name").agg(F.collect_set(F.struct("place", "state")).alias("facts"))


def _repeated_windows(known: DataFrame, scratch: Scratch, window: int, gram: int) -> DataFrame:
    """(name, windows): starts of windows that repeat although their anchors' stretches differ."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content", SLICE):
            texts = Slice(arrow.octets(batch.column("content")), window, gram)
            chosen = np.flatnonzero(_chosen(texts, batch.column("facts"), {OPEN, SHOWN}))
            at, owner = _windows(texts.low[chosen], texts.high[chosen])
            owner = chosen[owner]
            start = (at - texts.starts[texts.text[owner]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_signed(texts.keys[owner]), _signed(texts.hashes(at, at + window)), batch.column("name").take(pa.array(texts.text[owner])), pa.array(start)], ["anchor", "window", "name", "start"])

    # Rows of one text show the same windows; one row of each text does.
    shown = known.filter("shows").select("name", "content", "facts").mapInArrow(show, "anchor long, window long, name binary, start int")
    shown = scratch.save(shown, "windows")
    twice = scratch.save(shown.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "window"), "twice")
    return shown.join(twice, ["anchor", "window"]).groupBy("name").agg(F.collect_set("start").alias("windows"))


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256, and spans: the maximal repeats as (first word, words), for each document."""
    scratch, kind = Scratch(docs.sparkSession, "seeds"), dict(docs.dtypes)[key]
    named = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))
    named = named.withColumn("name", F.unhex(F.md5("content")))
    facts = scratch.save(_facts(named.select("name", "content"), scratch, window, gram), "facts")
    scratch.drop("met", "stretches")
    schema = "n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,words:int>>"

    def result(column: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))]
        return pa.RecordBatch.from_arrays([column, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc", "n_words", "n_removed", "kept_sha256", "spans"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content", SLICE):
            contents = arrow.octets(batch.column("content"))
            texts = Slice(contents, window, gram)
            settled = _chosen(texts, batch.column("facts"), {SETTLED, SHOWN})
            found = [_windows(texts.low[settled], texts.high[settled])[0]]
            column = batch.column("windows")
            lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            found.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(texts.starts[:-1], lengths))
            gone = texts.removed(np.concatenate(found))
            rows = []
            for i, content in enumerate(contents):
                own = gone[texts.starts[i] : texts.starts[i + 1]]
                edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
                kept = content.split() if not len(edges) else compress(content.split(), (~own).tolist())
                spans = [{"first": a, "words": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                rows.append((len(own), int(own.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
            yield result(batch.column("doc"), rows)

    # One row of each text shows its windows: the least of the numbers that the written rows have.
    known = scratch.save(named.join(facts.hint("merge"), "name", "left").withColumn("row", F.monotonically_increasing_id()), "known")
    scratch.drop("facts")
    first = known.filter(F.exists("facts", lambda f: f["state"] != SETTLED)).groupBy("name").agg(F.min("row").alias("row")).withColumn("shows", F.lit(True))
    shows = known.join(first.select("row", "shows"), "row")
    windows = scratch.save(_repeated_windows(shows, scratch, window, gram), "repeated")
    scratch.drop("windows", "twice")
    every = known.join(windows.hint("merge"), "name", "left").select("doc", "content", "facts", "windows")
    return every.mapInArrow(finish, f"doc {kind}, {schema}").withColumnRenamed("doc", key)


def op12_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


# Pieces hold the windows that start in 500 words; windows are compared as strings.
_PIECE = 500
_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STARTS = f"range(1, len(piece) - {WINDOW - 2})"
ORACLE = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_W} AS w FROM documents),
y AS MATERIALIZED (SELECT d, o, w[o + 1:o + {_PIECE + WINDOW - 1}] AS piece FROM (SELECT d, w, unnest(range(0, greatest(len(w) - {WINDOW - 1}, 0), {_PIECE})) AS o FROM t)),
p AS MATERIALIZED (SELECT d, o + unnest({_STARTS}) AS i, unnest(list_transform({_STARTS}, lambda i: sha256(array_to_string(piece[i:i + {WINDOW - 1}], ' ')))) AS h FROM y),
c AS (SELECT d, i FROM (SELECT d, i, count(*) OVER (PARTITION BY h) AS n FROM p) WHERE n > 1),
g AS (SELECT DISTINCT d, unnest(range(i, i + {WINDOW})) AS j FROM c),
r AS (SELECT d, count(*) AS n_removed FROM g GROUP BY d),
x AS (SELECT d, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM t),
k AS (SELECT d, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN g USING (d, j) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN r USING (d) LEFT JOIN k USING (d)
"""
