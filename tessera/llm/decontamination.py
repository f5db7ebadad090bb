"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is WINDOW consecutive words of a
benchmark item. Both sides are winnowed: of every WINDOW - GRAM + 1 consecutive GRAM-word hashes the least (rightmost of
equals) is kept as a fingerprint, so every shared span of WINDOW words holds a fingerprint that both sides keep. Fingerprints
that meet are extended: each window around the meeting point is compared with the item's windows, by hash and then word for
word. An item of fewer than WINDOW words is one window, and its own fingerprint.

The items' fingerprints and windows go to the executors as a broadcast if the items' texts hold at most BROADCAST_BYTES;
beyond that, fingerprints of documents and items are joined as rows, and each document is then compared with the items it
met. There both are found again by row numbers from written tables, as ids may be null or shared. Both ways give the same
result.

Defined cases: a null or empty text has no words, is hit by nothing and not contaminated; an item without words has no
window; repeated documents each give a row; equal items each count; an empty table of either kind gives no rows or no hits;
long texts are read whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arrow
from tessera.llm.scratch import Scratch

WINDOW, GRAM = 13, 7
BROADCAST_BYTES = 32 << 20
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word values."""
    size = len(values) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = values[:size].copy()
    for i in range(1, n):
        out *= _FACTOR
        out += values[i : i + size]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of each window's least hash, the rightmost of equals."""
    size = len(hashes) - width + 1
    if size <= 0:
        return np.empty(0, np.int64)
    least = hashes[:size].copy()
    for i in range(1, width):
        np.minimum(least, hashes[i : i + size], out=least)
    kept, open_ = np.zeros(len(hashes), bool), np.ones(size, bool)
    for i in range(width - 1, -1, -1):
        here = open_ & (hashes[i : i + size] == least)
        kept[i : i + size] |= here
        open_ &= ~here
    return np.flatnonzero(kept)


class ItemIndex:
    """Fingerprints and windows of items, given as (item id, text bytes)."""

    def __init__(self, items: Iterable[tuple[object, bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.items, self.vocabulary = [], {}
        windows: dict[int, dict[tuple[int, ...], set[int]]] = {}
        fingerprints: set[int] = set()
        for item, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not numbers:
                continue
            self.items.append(item)
            n = min(window, len(numbers))
            own = windows.setdefault(n, {})
            for i in range(len(numbers) - n + 1):
                own.setdefault(tuple(numbers[i : i + n]), set()).add(len(self.items) - 1)
        self.values = np.zeros(len(self.vocabulary) + 1, np.uint64)
        for word, number in self.vocabulary.items():
            self.values[number] = xxhash.xxh3_64_intdigest(word)
        #: by length: sorted window hashes, the windows' words, and each window's items
        self.windows = {}
        for n, own in windows.items():
            table = np.array(list(own), np.int32).reshape(len(own), n)
            hashes = gram_hashes(self.values[table].ravel(), n)[::n]
            order = np.argsort(hashes, kind="stable")
            lists = list(own.values())
            self.windows[n] = (hashes[order], table[order], [sorted(lists[i]) for i in order])
        if window in self.windows:
            table = self.windows[window][1]
            for row in table:
                hashes = gram_hashes(self.values[row], gram)
                fingerprints.update(hashes[winnow(hashes, window - gram + 1)].tolist())
        self.fingerprints = np.array(sorted(fingerprints), np.uint64)

    def compare(self, docs: list[list[bytes]]) -> list[tuple[int, list[object]]]:
        """For each document (its words): the number of hit words, and the items with windows in it."""
        get = self.vocabulary.get
        numbers = np.zeros(sum(map(len, docs)) + len(docs), np.int32)
        starts, at = [], 0
        for words in docs:
            numbers[at : at + len(words)] = [get(w, 0) for w in words]  # 0, also after each document, is in no item
            starts.append(at)
            at += len(words) + 1
        values = self.values[numbers]
        hit = np.zeros(len(numbers) + 1, np.int32)
        met: list[set[int]] = [set() for _ in docs]
        starts_array = np.array(starts, np.int64)
        for n, (hashes, table, lists) in self.windows.items():
            if len(numbers) < n:
                continue
            if n == self.window:
                grams = gram_hashes(values, self.gram)
                prints = winnow(grams, n - self.gram + 1)
                prints = prints[np.isin(grams[prints], self.fingerprints)]
                near = (prints[:, None] - np.arange(n - self.gram + 1)).ravel()
                near = np.unique(near[(near >= 0) & (near <= len(numbers) - n)])
                spans = values[near[:, None] + np.arange(n)].ravel()
                found = gram_hashes(spans, n)[::n] if len(near) else np.empty(0, np.uint64)
            else:
                near = np.arange(len(numbers) - n + 1)
                found = gram_hashes(values, n)
            places = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            ok = hashes[places] == found
            near, places = near[ok], places[ok]
            ok = (numbers[near[:, None] + np.arange(n)] == table[places]).all(1)
            near, places = near[ok], places[ok]
            np.add.at(hit, near, 1)
            np.add.at(hit, near + n, -1)
            owners = np.searchsorted(starts_array, near, "right") - 1
            for owner, place in set(zip(owners.tolist(), places.tolist(), strict=True)):
                met[owner].update(lists[place])
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
        bounds = np.append(starts_array, len(numbers))
        counts = covered[bounds[1:]] - covered[bounds[:-1]]
        return [(int(c), [self.items[i] for i in m]) for c, m in zip(counts, met, strict=True)]


def _verdict(n_words: int, n_hit: int, items: list[object]) -> tuple:
    names = ",".join(sorted(map(str, set(items))))
    return n_words, n_hit, len(items), hashlib.sha256(names.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


_COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def _rows(keys: pa.Array, key: str, verdicts: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*verdicts, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([keys, *columns], [key, *_COLUMNS])


def _small_index(items: DataFrame, broadcast_bytes: int):
    """The items' index as a broadcast if their texts hold at most broadcast_bytes, else None. items: (item, content)."""
    held = items.agg(F.coalesce(F.sum(F.length("content") + 16), F.lit(0))).first()[0]
    if held > broadcast_bytes:
        return None
    return items.sparkSession.sparkContext.broadcast(ItemIndex((r.item, bytes(r.content)) for r in items.collect()))


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    items = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("content")).filter("content IS NOT NULL")
    kind = dict(docs.dtypes)[key]
    index = _small_index(items, broadcast_bytes)
    if index is None:
        scratch = Scratch(docs.sparkSession, "decontamination")
        rows = scratch.save(docs.select(F.col(key).alias("doc"), F.col(text).alias("content"), F.monotonically_increasing_id().alias("row")), "docs")
        return _joined(rows, items, scratch, kind).select(F.col("doc").alias(key), *_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, text):
            words = [words_of(x) for x in arrow.octets(batch.column(text))]
            found = index.value.compare(words)
            yield _rows(batch.column(key), key, [_verdict(len(w), *f) for w, f in zip(words, found, strict=True)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_SCHEMA}")


def _prints(texts: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Fingerprints of each text: winnowed grams, and the hashes of all windows of the given shorter lengths."""
    out = []
    for text in texts:
        values = np.array([xxhash.xxh3_64_intdigest(w) for w in words_of(text)], np.uint64)
        grams = gram_hashes(values, GRAM)
        own = [grams[winnow(grams, WINDOW - GRAM + 1)], *(gram_hashes(values, n) + np.uint64(n) for n in lengths)]
        out.append(np.unique(np.concatenate(own)))
    return out


def _joined(docs: DataFrame, items: DataFrame, scratch: Scratch, kind: str) -> DataFrame:
    """row, doc and the verdict's columns: the way for items that are too large to broadcast, where fingerprints meet in an equi-join.

    docs: (row, doc, content), a written table in which each row has a number of its own.
    """
    items = scratch.save(items.withColumn("item_row", F.monotonically_increasing_id()), "items")

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, prints, sizes = [], [], []
            for i, content in enumerate(arrow.octets(batch.column("content"))):
                n = len(words_of(content))
                own = _prints([content], [n] if 0 < n < WINDOW else [])[0]
                owners += [i] * len(own)
                sizes += [min(n, WINDOW)] * len(own)
                prints.append(own)
            rows = [batch.column("item_row").take(pa.array(owners, pa.int64())), pa.array(np.concatenate([np.empty(0, np.uint64), *prints]).view(np.int64)), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(rows, ["item_row", "print", "size"])

    known = items.mapInArrow(item_prints, "item_row long, print long, size int")
    lengths = sorted(r.size for r in known.filter(F.col("size") < WINDOW).select("size").distinct().collect())  # at most WINDOW - 1

    def doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content"):
            prints = _prints(arrow.octets(batch.column("content")), lengths)
            owners = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
            rows = [batch.column("row").take(pa.array(owners)), pa.array(np.concatenate([np.empty(0, np.uint64), *prints]).view(np.int64))]
            yield pa.RecordBatch.from_arrays(rows, ["row", "print"])

    met = docs.select("row", "content").mapInArrow(doc_prints, "row long, print long").join(known.select("item_row", "print"), "print").select("row", "item_row").distinct()
    near = met.join(items, "item_row").groupBy("row").agg(F.collect_list(F.struct("item", "content")).alias("near"))
    joined = docs.select("row", "doc", "content").join(near, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content"):
            verdicts = []
            for content, own in zip(arrow.octets(batch.column("content")), batch.column("near").to_pylist(), strict=True):
                words = words_of(content)
                found = ItemIndex((x["item"], x["content"]) for x in own).compare([words])[0] if own else (0, [])
                verdicts.append(_verdict(len(words), *found))
            found = _rows(batch.column("doc"), "doc", verdicts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *found.columns], ["row", *found.schema.names])

    return joined.mapInArrow(run, f"row long, doc {kind}, {_SCHEMA}")


_ROW = "_decontamination_row"


def keep_uncontaminated(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns; without a shuffle if the items are broadcast."""
    own = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("content")).filter("content IS NOT NULL")
    index = _small_index(own, broadcast_bytes)
    if index is None:
        scratch = Scratch(docs.sparkSession, "decontamination")
        rows = scratch.save(docs.withColumn(_ROW, F.monotonically_increasing_id()), "docs")
        found = _joined(rows.select(F.col(_ROW).alias("row"), F.col(key).alias("doc"), F.col(text).alias("content")), own, scratch, dict(docs.dtypes)[key])
        return rows.join(found.filter("contaminated").select(F.col("row").alias(_ROW)), _ROW, "left_anti").select(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, text):
            words = [words_of(x) for x in arrow.octets(batch.column(text))]
            yield batch.filter(pa.array([not _verdict(len(w), *f)[-1] for w, f in zip(words, index.value.compare(words), strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_spans = lambda n: f"{n} AS n, unnest(range(1, len(w) - {n} + 2)) AS i, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS s"
_OF_ITEMS = " UNION ALL ".join(f"SELECT item, {_spans(n)} FROM b WHERE len(w) {'>=' if n == WINDOW else '='} {n}" for n in range(1, WINDOW + 1))
_OF_DOCS = " UNION ALL ".join(f"SELECT d, {_spans(n)} FROM w WHERE len(w) >= {n} AND EXISTS (SELECT 1 FROM v WHERE v.n = {n})" for n in range(1, WINDOW + 1))
ORACLE = f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_W} AS w FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, {_W} AS w FROM benchmark),
v AS MATERIALIZED (SELECT DISTINCT item, n, s FROM ({_OF_ITEMS})),
f AS MATERIALIZED (SELECT * FROM ({_OF_DOCS}) x WHERE EXISTS (SELECT 1 FROM v WHERE v.n = x.n AND v.s = x.s)),
h AS (SELECT d, count(DISTINCT j) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS j FROM f) GROUP BY d),
m AS (SELECT DISTINCT d, item, item_id FROM f JOIN v USING (n, s) JOIN b USING (item)),
g AS (SELECT d, count(*) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS names FROM m GROUP BY d),
r AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256 FROM w LEFT JOIN h USING (d) LEFT JOIN g USING (d))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM r
"""
