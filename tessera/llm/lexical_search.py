"""Ranked lexical search: the best documents of each query, by sort-based accumulation of integer impacts.

Queries come in blocks of bounded size. A block's inverted index (term to the queries that hold it, with repeats) goes to the
executors, which read all documents twice at most:

1. Documents become postings: for each, the number of its terms and the block's terms in it with their frequencies. Their
   partial counts are added up to the number of documents, of all terms, and of the documents that hold each term.
2. Each task concatenates the arrays of (query, document, impact) that its postings match, sorts the packed (query,
   document) keys by radix, sums equal keys' impacts with reduceat, and keeps every query's best in a heap. The heaps'
   rows are range-partitioned by query and rank, where the last choice is made.

So a document's sums never leave its task, memory is bounded by a slice of postings, and what is shuffled is a few rows for
each query and task. Terms are found by hash and compared byte by byte.

Defined cases: a null text has no terms (a document without terms isn't counted, a query without terms gets no rows); equal
queries and queries with shared or null ids are ranked each by itself; documents with shared ids, or null ones, which come
after all others, are documents of their own; tables may be empty; long texts are read whole; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import arrow, hashing
from tessera.llm.scratch import Scratch

TOP = 20
#: A block's bytes of query texts, and (query, document) keys that are sorted together.
BLOCK_BYTES, SORTED = 1 << 20, 1 << 22
SLICE = 4 << 20
_LAST = (1 << 63) - 1  # a null id's place among others

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of keys of so many bits, digit by digit of 16 bits (numpy sorts those by radix)."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort(((keys[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")]
    return order


def summed(keys: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = radix_order(keys, bits)
    keys, values = keys[order], values[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begins], np.add.reduceat(values, begins)


class Terms:
    """The terms of some texts: their lower-cased bytes, where each term is, and its hash."""

    def __init__(self, texts: list[bytes]):
        raw, begins = hashing.joined(texts)
        self.starts, self.ends = hashing.spans(_APART[raw])
        self.raw = _LOWER[raw]
        self.hashes = hashing.Bytes(self.raw).hashes(self.starts, self.ends)
        self.counts = np.diff(np.searchsorted(self.starts, begins))


class Index:
    """Terms of a block of queries, numbered, each with the queries (numbers) that hold it and how often they do."""

    def __init__(self, queries: list[bytes]):
        terms = Terms(queries)
        owner = np.repeat(np.arange(len(queries)), terms.counts)
        words = [terms.raw[a:b].tobytes() for a, b in zip(terms.starts, terms.ends, strict=True)]
        self.words = sorted(set(words))
        number = {w: i for i, w in enumerate(self.words)}
        held = Counter(zip(map(number.get, words), owner.tolist(), strict=True))
        pairs = np.array(sorted(held), np.int64).reshape(-1, 2)
        self.queries, self.times = pairs[:, 1], np.array([held[t, q] for t, q in pairs.tolist()], np.int64)
        self.begins = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))
        self.bytes, self.offsets = np.frombuffer(b"".join(self.words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.n_queries = len(queries)
        own = Terms(self.words)  # each word is one term
        self.table = hashing.Table(max(len(self.words), 1))
        first = np.unique(own.hashes, return_index=True)[1]
        self.table.add(own.hashes[first], first)
        #: Terms whose hash another term has, by their bytes; hardly ever any.
        self.odd = {self.words[i]: i for i in set(range(len(self.words))) - set(first.tolist())}

    def find(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are in the index, and their numbers."""
        number, hit = self.table.find(terms.hashes)
        at = np.flatnonzero(hit)
        number = number[at]
        size = terms.ends[at] - terms.starts[at]
        same = size == self.offsets[number + 1] - self.offsets[number]
        left, k = np.flatnonzero(same), 0
        while len(left):
            differ = terms.raw[terms.starts[at[left]] + k] != self.bytes[self.offsets[number[left]] + k]
            same[left[differ]] = False
            k += 1
            left = left[~differ & (size[left] > k)]
        if self.odd:
            for i in np.flatnonzero(~same):
                own = self.odd.get(terms.raw[terms.starts[at[i]] : terms.ends[at[i]]].tobytes())
                if own is not None:
                    number[i], same[i] = own, True
        return at[same], number[same]

    def postings(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[bytes, bytes]]]:
        """Each text's number of terms, and its terms in the index with their frequencies (as int32)."""
        terms = Terms(texts)
        at, number = self.find(terms)
        owner = np.searchsorted(np.cumsum(terms.counts), at, "right").astype(np.uint64)
        bits = max(len(self.words).bit_length(), 1)
        keys, n = summed(owner << np.uint64(bits) | number.astype(np.uint64), np.ones(len(at), np.int64), bits + len(texts).bit_length())
        begins = np.searchsorted(keys >> np.uint64(bits), np.arange(len(texts) + 1, dtype=np.uint64))
        own, n = (keys & np.uint64((1 << bits) - 1)).astype(np.int32), n.astype(np.int32)
        return terms.counts, [(own[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(begins, begins[1:], strict=False)]


class Heaps:
    """The best (score, least document) of each query so far."""

    def __init__(self, n: int, top: int):
        self.top, self.heaps, self.least = top, [[] for _ in range(n)], np.zeros(n, np.int64)

    def offer(self, queries: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """queries in order; scores above 0."""
        good = scores >= np.maximum(self.least[queries], 1)
        queries, docs, scores = queries[good], docs[good], scores[good]
        begins = np.flatnonzero(np.append(True, queries[1:] != queries[:-1])) if len(queries) else queries
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(queries)], strict=False):
            heap, own = self.heaps[queries[a]], np.arange(a, b)
            if b - a > 2 * self.top:  # the slice's own best, with all that equal the last of them
                own = own[scores[own] >= np.partition(scores[a:b], b - a - self.top)[b - a - self.top]]
            for score, doc in zip(scores[own].tolist(), docs[own].tolist(), strict=True):
                if len(heap) < self.top:
                    heapq.heappush(heap, (score, -doc))
                elif (score, -doc) > heap[0]:
                    heapq.heapreplace(heap, (score, -doc))
            if len(heap) == self.top:
                self.least[queries[a]] = heap[0][0]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(q, -doc, score) for q, heap in enumerate(self.heaps) for score, doc in heap]


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)


def _matches(index: Index, weight: np.ndarray, n_docs: int, n_terms: int, lengths: np.ndarray, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, docs, scores) of some postings, sorted and summed in runs of whole documents. docs: numbers from 0, in order."""
    m = 75 + (25 * lengths * n_docs) // max(n_terms, 1)
    impact = weight[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m[docs]))
    held = np.diff(index.begins)[terms]
    upto = np.cumsum(held)
    starts = np.searchsorted(docs, np.arange(len(lengths) + 1))
    bits = max(len(lengths).bit_length(), 1)
    a = 0
    while a < len(lengths):
        base = upto[starts[a] - 1] if starts[a] else 0
        b = max(a + 1, int(np.searchsorted(np.append(0, upto)[starts], base + SORTED, "right")) - 1)
        own = slice(starts[a], starts[b])
        n = held[own]
        posting = np.repeat(np.arange(starts[a], starts[b]), n)
        entry = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + index.begins[terms[posting]]
        keys = index.queries[entry].astype(np.uint64) << np.uint64(bits) | docs[posting].astype(np.uint64)
        keys, scores = summed(keys, impact[posting] * index.times[entry], bits + index.n_queries.bit_length())
        yield (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64), scores
        a = b


_POSTINGS = "doc long, n long, terms binary, times binary"


def _search(docs: DataFrame, items: list[tuple[int, bytes]], scratch: Scratch, top: int, name: str) -> DataFrame:
    """(item, doc, score): candidates of a block of queries, given as (number, text). docs: (doc, content)."""
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(Index([t for _, t in items]))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content", SLICE):
            counts, found = index.value.postings(arrow.octets(batch.column("content")))
            terms, times = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(counts.astype(np.int64)), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], ["doc", "n", "terms", "times"])

    posted = scratch.save(docs.mapInArrow(post, _POSTINGS).filter("n > 0"), f"postings{name}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, length = np.zeros(len(index.value.words), np.int64), 0, 0
        for batch in batches:
            n, length = n + batch.num_rows, length + (pa.compute.sum(batch.column("n")).as_py() or 0)
            own = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
            held += np.bincount(own, minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([n, length, *held[some].tolist()], pa.int64())], ["term", "n"])

    held = np.zeros(len(index.value.words), np.int64)
    totals = {r.term: r.n for r in posted.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the block's terms, at most
    n_docs, n_terms = totals.pop(-1, 0), totals.pop(-2, 0)
    held[list(totals)] = list(totals.values())
    weight = weights(n_docs, held)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(index.value.n_queries, top)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).astype(np.int64) for c in ("terms", "times")]
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.binary_length(batch.column("terms")).to_numpy() // 4)
            ids = batch.column("doc").fill_null(_LAST).to_numpy()
            for queries, docs, scores in _matches(index.value, weight, n_docs, n_terms, batch.column("n").to_numpy(), owner, *found):
                heaps.offer(queries, ids[docs], scores)
        rows = heaps.rows()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item", "doc", "score"])
        arrow.release()

    numbers = [i for i, _ in items]
    found = posted.mapInArrow(rank, "item long, doc long, score long")
    return scratch.save(found.withColumn("item", F.element_at(F.lit(numbers), (F.col("item") + 1).cast("int")) if len(numbers) > 1 else F.lit(numbers[0])), f"found{name}")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, rank, key and score: each item's best documents with a score above 0; equal scores by the (whole) key."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))
    items = items.select(F.col(item).alias("name"), F.col(item_text).cast("binary").alias("content"), F.monotonically_increasing_id().alias("item"))
    items = scratch.save(items.filter("length(content) > 0"), "items")
    held = items.agg(F.coalesce(F.sum(F.length("content") + 16), F.lit(0))).first()[0]
    blocks = -(-held // block_bytes)  # a hash deals the items to blocks of about block_bytes
    names = items.select("item", "name")
    found = spark.createDataFrame([], "item long, doc long, score long")
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "content").collect()
        if own:
            found = found.union(_search(docs, [(r.item, bytes(r.content)) for r in own], scratch, top, str(b)))
            scratch.drop(f"postings{b}")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc"))
    best = found.repartitionByRange("item").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    doc = F.when(F.col("doc") != _LAST, F.col("doc")).alias(key)
    return best.join(names, "item").select(F.col("name").alias(item), "rank", doc, "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_T = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_T} AS w FROM documents),
q AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {_T} AS w FROM benchmark),
k AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM q) GROUP BY q, t),
p AS MATERIALIZED (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM k) GROUP BY d, t),
s AS MATERIALIZED (SELECT count(*) AS n, coalesce(sum(len(w)), 0)::BIGINT AS l FROM d WHERE len(w) > 0),
f AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, n),
m AS (SELECT d, doc_id, 75 + (25 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
r AS (SELECT q, d, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM k JOIN p USING (t) JOIN f USING (t) JOIN m USING (d) GROUP BY q, d, doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM b JOIN q USING (q) WHERE rank <= {TOP}
"""
