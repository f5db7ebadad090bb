"""Removal of byte strings of LENGTH bytes that start more than once, after difference-cover suffix sorting.

Suffixes are sampled at the positions p of each text with p mod 273 in a perfect difference cover of 17 residues. Whatever
two positions i and j two equal strings of LENGTH bytes start at, some k < 273 puts both i + k and j + k into the cover; so
equal strings always hold a pair of aligned cover suffixes with equal first PREFIX = LENGTH - 272 bytes. (Strings of under
372 bytes take a cover modulo 183 of 14 residues, and all below with 182 for 272.) The other suffixes
need no place of their own in the order: their strings are settled by the cover suffix inside them.

1. Cover suffixes are bucketed by their prefix and sorted, one bucket at a time; prefixes that occur once are done with.
   What is left goes out as a filter of bounded size, by which texts without any are passed on as they are.
2. Ties, suffixes with equal prefixes, are sorted by their ranks in the wide context, the bytes from 272 before to LENGTH
   after. All strings inside a context that occurs twice occur twice. Where one prefix has several contexts, the strings
   inside them are unsettled; a context that occurs often is stood for by one of its places.
3. Unsettled strings are bucketed by their hashes, sorted, and found to occur once or more often.

Equal texts count as one in steps 2 and 3: what they send is merged by the text's name and place. Memory is bounded by a bucket or a slice of texts. Prefixes,
contexts and strings are told apart by 64-bit hashes (prefixes by 32 bits and the bucket, which the later steps make good).

Defined cases: a null text has no bytes; texts shorter than LENGTH keep everything; repeated rows are texts that start
again, so all of theirs goes if they are LENGTH bytes or longer; an empty table gives no rows; long texts are read whole;
further columns are carried with their row or ignored; no row is found again by its key, so repeated rows come out as often
as they went in, and null and shared keys are as any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arrow
from tessera.llm.jaccard_join import _Keys, _pack, _unpack
from tessera.llm.scratch import Scratch

LENGTH = 400
#: Perfect difference covers by their period; every residue is the difference of one pair.
COVERS = {
    273: [1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256],
    183: [0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175],
}
#: Bits of the filter of repeated prefixes (16 MB), and marks a key; if it fills up, more is compared, with the same result.
FILTER_BITS, MARKS = 27, 4
#: Text bytes that are looked at together; each takes some 50 bytes of memory.
SLICE = 1 << 20
ONCE, SETTLED, SETTLED_AND_SHOWN, UNSETTLED = range(4)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(271828).integers(0, 1 << 64, 256, dtype=np.uint64)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def period_of(length: int) -> int:
    """The longest period that leaves prefixes of 100 bytes at least, which tell strings apart well."""
    fitting = [p for p in COVERS if length - p + 1 >= 100]
    if not fitting:
        raise ValueError(f"strings have {min(COVERS) + 99} bytes at least")
    return max(fitting)


class Slice:
    """Some texts (bytes) laid end to end."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.length, self.period = length, period_of(length)
        self.prefix = length - self.period + 1
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_byte_values()[raw] * _power(_BASE, len(raw)), out=self.sums[1:])

    def hashes(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the bytes from at to ends."""
        out = (self.sums[ends] - self.sums[at]) * _power(_INVERSE, len(self.sums))[at]
        out += (ends - at).astype(np.uint64)
        out ^= out >> np.uint64(29)
        out *= _MIX
        return out ^ (out >> np.uint64(32))

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of cover suffixes that have a whole prefix, and their texts."""
        place, text = [], []
        long = np.flatnonzero(self.sizes >= self.length)
        if not len(long):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pattern = np.array(COVERS[self.period])
        for i in long.tolist():
            room = int(self.sizes[i]) - self.prefix + 1
            own = (np.arange(-(-room // self.period))[:, None] * self.period + pattern).ravel()
            own = own[own < room]
            place.append(own + self.starts[i])
            text.append(np.full(len(own), i))
        return np.concatenate(place), np.concatenate(text)

    def prefixes(self, at: np.ndarray) -> np.ndarray:
        return self.hashes(at, at + self.prefix)

    def contexts(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Hashes of the wide contexts; a text's start or end inside one is part of it."""
        low = np.maximum(at - self.period + 1, self.starts[text])
        high = np.minimum(at + self.length, self.starts[text + 1])
        own = self.hashes(low, high)
        return (own ^ (at - low).astype(np.uint64)) * _MIX

    def strings(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Starts of all strings around the given samples: sorted, each once."""
        low = np.maximum(at - self.period + 1, self.starts[text])
        high = np.minimum(at, self.starts[text + 1] - self.length)
        marks = np.zeros(len(self.sums) + 1, np.int32)
        ok = high >= low
        np.add.at(marks, low[ok], 1)
        np.add.at(marks, high[ok] + 1, -1)
        return np.flatnonzero(np.cumsum(marks) > 0)


PART = 1 << (FILTER_BITS - 8)


def _bits(keys: np.ndarray) -> list[np.ndarray]:
    """A key's places in the filter."""
    mixed = keys * _MIX
    mixed ^= mixed >> np.uint64(31)
    step = (mixed * np.uint64(_BASE)) | np.uint64(1)
    return [(mixed + np.uint64(i) * step) >> np.uint64(64 - FILTER_BITS) for i in range(MARKS)]


def _repeated_prefixes(docs: DataFrame, keys: _Keys, length: int) -> DataFrame:
    """(part, offsets): places in the filter of prefixes that occur twice, by the filter's 256 parts."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content", SLICE):
            texts = Slice(arrow.octets(batch.column("content")), length)
            found, n = np.unique(keys.of(texts.prefixes(texts.samples()[0])), return_counts=True)
            rows = [(b, _pack((found[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), np.packbits(n[s] > 1).tobytes()) for b, s in keys.split(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "places", "twice"])

    def sort(group: tuple, table: pa.Table) -> pa.Table:
        places, twice = [], []
        for own, flags in zip(table.column("places").to_pylist(), table.column("twice").to_pylist(), strict=True):
            places.append(_unpack(own))
            twice.append(np.unpackbits(np.frombuffer(flags, np.uint8))[: len(places[-1])])
        places, twice = np.concatenate(places), np.concatenate(twice)
        order = np.argsort(places, kind="stable")
        places, twice = places[order], twice[order]
        begins = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        often = np.add.reduceat(twice.astype(np.int64) + 1, begins) > 1
        full = (np.uint64(group[0].as_py()) << np.uint64(32)) | places[begins][often].astype(np.uint64)
        bits = arrow.distinct(np.concatenate(_bits(full))).astype(np.uint32)
        parts, starts = np.unique(bits // np.uint32(PART), return_index=True)
        offsets = [_pack(inside % np.uint32(PART)) for inside in np.split(bits, starts[1:])] if len(bits) else []
        return pa.table({"part": pa.array(parts.astype(np.int64)), "offsets": pa.array(offsets, pa.binary())})

    packed = docs.select("content").mapInArrow(sample, "bucket long, places binary, twice binary")
    return packed.groupBy("bucket").applyInArrow(arrow.released(sort), "part long, offsets binary")


def _filter(found: DataFrame) -> np.ndarray:
    """The filter as packed bits: 2**FILTER_BITS of them come to the driver, whatever the input."""

    def merge(table: pa.Table) -> pa.Table:
        marks = np.zeros(PART, np.uint8)
        for own in table.column("offsets").to_pylist():
            marks[_unpack(own)] = 1
        return pa.table({"part": table.column("part")[:1], "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    packed = np.zeros((256, PART // 8), np.uint8)
    for r in found.groupBy("part").applyInArrow(arrow.released(merge), "part long, marks binary").collect():
        packed[r.part] = np.frombuffer(r.marks, np.uint8)
    return packed.ravel()


def _passes(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for bits in _bits(keys):
        found &= (marks[bits >> np.uint64(3)] >> (np.uint64(7) - (bits & np.uint64(7))).astype(np.uint8)) & 1 > 0
    return found


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch's rows with each text once."""
    _, first = np.unique(batch.column("content_id").to_numpy(), return_index=True)
    return batch.take(pa.array(np.sort(first)))


def _hex(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _settle(met: DataFrame, keys: _Keys, marks, length: int) -> DataFrame:
    """(content_id, places, states): what contexts say of the cover suffixes of each text, as int64 and uint8."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, arrow.slices(batches, "content", SLICE)):
            texts = Slice(arrow.octets(batch.column("content")), length)
            at, text = texts.samples()
            prefix = keys.of(texts.prefixes(at))
            kept = _passes(marks.value, prefix)
            at, text, prefix = at[kept], text[kept], prefix[kept]
            context = texts.contexts(at, text)
            place = at - texts.starts[text]
            order = np.lexsort((context, prefix))
            at, text, prefix, context, place = at[order], text[order], prefix[order], context[order], place[order]
            names = batch.column("content_id").to_numpy().astype(np.int64)
            rows = []
            for bucket, s in keys.split(prefix):
                used, index = np.unique(text[s], return_inverse=True)
                rows.append((bucket, _pack((prefix[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), context[s].tobytes(), index.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), names[used].tobytes(), place[s].astype(np.uint32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "prefixes", "contexts", "texts", "names", "places"])

    def sort(table: pa.Table) -> pa.Table:
        prefixes, contexts, names, places = [], [], [], []
        for row in table.to_pylist():
            own = _unpack(row["prefixes"])
            ids = np.frombuffer(row["names"], np.int64)
            prefixes.append(own)
            contexts.append(np.frombuffer(row["contexts"], np.uint64))
            names.append(ids[np.frombuffer(row["texts"], np.uint16 if len(ids) < 65536 else np.uint32)])
            places.append(np.frombuffer(row["places"], np.uint32))
        prefixes, contexts, names, places = map(np.concatenate, (prefixes, contexts, names, places))
        order = np.lexsort((places, names, contexts, prefixes))
        order = order[np.append(True, (np.diff(names[order]) != 0) | (np.diff(places[order].astype(np.int64)) != 0))]
        prefixes, contexts, names, places = prefixes[order], contexts[order], names[order], places[order]
        fresh = np.append(True, prefixes[1:] != prefixes[:-1])  # a prefix begins
        wide = fresh | np.append(True, contexts[1:] != contexts[:-1])  # a context begins
        begins, wides = np.flatnonzero(fresh), np.flatnonzero(wide)
        group = np.cumsum(fresh) - 1
        n_contexts = np.add.reduceat(wide.astype(np.int64), begins)[group]
        held = np.diff(np.append(wides, len(wide)))[np.cumsum(wide) - 1]
        state = np.where(held > 1, np.where(wide & (n_contexts > 1), SETTLED_AND_SHOWN, SETTLED), np.where(n_contexts > 1, UNSETTLED, ONCE))
        kept = state != ONCE
        names, places, state = names[kept], places[kept], state[kept].astype(np.uint8)
        order = np.argsort(names, kind="stable")
        names, places, state = names[order], places[order], state[order]
        begins = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.empty(0, np.int64)
        ends = np.append(begins[1:], len(names)) if len(begins) else begins
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())
        return pa.table({"content_id": pa.array(names[begins], pa.int64()), "places": cut(places), "states": cut(state)})

    packed = met.select("content_id", "content").mapInArrow(sample, "bucket long, prefixes binary, contexts binary, texts binary, names binary, places binary")
    return packed.groupBy("bucket").applyInArrow(arrow.released(sort), "content_id long, places binary, states binary")


def _suffixes(row_places: list, row_states: list, start: int) -> tuple[np.ndarray, np.ndarray]:
    if not row_places:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    places = np.concatenate([np.frombuffer(x, np.uint32) for x in row_places]).astype(np.int64) + start
    return places, np.concatenate([np.frombuffer(x, np.uint8) for x in row_states])


def _known(batch: pa.RecordBatch, length: int) -> tuple[Slice, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's texts, and its cover suffixes' places, texts and states."""
    texts = Slice(arrow.octets(batch.column("content")), length)
    at, text, state = [], [], []
    for i, (p, s) in enumerate(zip(batch.column("places").to_pylist(), batch.column("states").to_pylist(), strict=True)):
        own, states = _suffixes(p or [], s or [], int(texts.starts[i]))
        at.append(own)
        state.append(states)
        text.append(np.full(len(own), i))
    return texts, *map(np.concatenate, (at, text, state))


def _wide(batch: pa.RecordBatch, length: int) -> tuple[Slice, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's texts, and the starts, texts and hashes of the strings that are shown."""
    texts, at, text, state = _known(batch, length)
    shown = state >= SETTLED_AND_SHOWN
    starts = texts.strings(at[shown], text[shown])
    settled = texts.strings(at[state != UNSETTLED], text[state != UNSETTLED])
    ask = ~np.isin(starts, settled, assume_unique=True)
    return texts, starts, ask, texts.hashes(starts, starts + length) >> np.uint64(_DROPPED)


#: Strings are told apart by 64 - _DROPPED bits: the bucket, 32 and 24.
_DROPPED = 4


def _unsettled(known: DataFrame, keys: _Keys, length: int) -> DataFrame:
    """(content_id, strings): hashes of unsettled strings that turn out to occur twice."""
    low_bits = np.uint64(64 - _DROPPED - 32 - keys.bits)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, arrow.slices(batches, "content", SLICE)):
            texts, starts, ask, own = _wide(batch, length)
            text = np.searchsorted(texts.starts, starts, "right") - 1
            order = np.lexsort((text, own))
            own, text, ask = own[order], text[order], ask[order]
            begins = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1]))) if len(own) else np.empty(0, np.int64)
            twice = np.diff(np.append(begins, len(own))) > 1  # inside one text
            flags = twice + 2 * (np.maximum.reduceat(ask, begins) if len(begins) else ask)
            own, text, flags = own[begins], text[begins], flags.astype(np.uint8)
            names = batch.column("content_id").to_numpy().astype(np.int64)
            high = own >> low_bits
            rows = []
            for bucket, s in keys.split(high):
                used, index = np.unique(text[s], return_inverse=True)
                low = (own[s] & ((np.uint64(1) << low_bits) - np.uint64(1))).astype(np.uint32)
                planes = np.ascontiguousarray(low.view(np.uint8).reshape(-1, 4).T).tobytes()
                packed_index = index.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes()
                rows.append((bucket, _pack((high[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), planes, packed_index, names[used].tobytes(), np.packbits(flags[s] & 1).tobytes(), np.packbits(flags[s] >> 1).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "highs", "lows", "texts", "names", "twice", "ask"])

    def sort(group: tuple, table: pa.Table) -> pa.Table:
        own, names, twice, ask = [], [], [], []
        for row in table.to_pylist():
            high = _unpack(row["highs"]).astype(np.uint64) | np.uint64(group[0].as_py()) << np.uint64(32)
            low = np.ascontiguousarray(np.frombuffer(row["lows"], np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            own.append(high << low_bits | low)
            ids = np.frombuffer(row["names"], np.int64)
            names.append(ids[np.frombuffer(row["texts"], np.uint16 if len(ids) < 65536 else np.uint32)])
            for to, column in ((twice, "twice"), (ask, "ask")):
                to.append(np.unpackbits(np.frombuffer(row[column], np.uint8))[: len(high)].astype(bool))
        own, names, twice, ask = map(np.concatenate, (own, names, twice, ask))
        order = np.lexsort((names, own))
        own, names, twice, ask = own[order], names[order], twice[order], ask[order]
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        held = np.diff(np.append(begins, len(own)))
        several = np.append(False, (names[1:] != names[:-1]) & (own[1:] == own[:-1]))
        often = np.logical_or.reduceat(twice | several, begins)
        found = np.repeat(often, held) & ask
        names, own = names[found], own[found]
        order = np.argsort(names, kind="stable")
        names, own = names[order], own[order]
        begins = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.empty(0, np.int64)
        ends = np.append(begins[1:], len(names)) if len(begins) else begins
        return pa.table({"content_id": pa.array(names[begins], pa.int64()), "strings": pa.array([own[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())})

    packed = known.select("content_id", "content", "places", "states").mapInArrow(show, "bucket long, highs binary, lows binary, texts binary, names binary, twice binary, ask binary")
    return packed.groupBy("bucket").applyInArrow(arrow.released(sort), "content_id long, strings binary")


def _removed(texts: Slice, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether each byte is inside a string that starts at one of the given places."""
    marks = np.zeros(len(texts.sums) + length, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + length, -1)
    return np.cumsum(marks)[: len(texts.sums) - 1] > 0


def _cut(text: bytes, removed: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and their runs."""
    kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
    runs = int(np.count_nonzero(removed[1:] & ~removed[:-1]) + bool(len(removed) and removed[0]))
    return kept, int(removed.sum()), runs


def _digest(kept: bytes, n_removed: int, n_spans: int) -> tuple:
    return len(kept) + n_removed, n_removed, n_spans, _hex(kept)


def _clean(kept: bytes, n_removed: int, n_spans: int) -> tuple:
    """The text that stays; bytes of a character that was cut in two are dropped with it."""
    return (kept.decode("utf-8", "ignore"),)


def _apply(docs: DataFrame, own: Column, text: str, length: int, schema: str, make) -> DataFrame:
    """doc, the value of `own`, and the columns `make` derives from (kept bytes, bytes removed, runs removed) of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.select(own.alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))
    kind = dict(docs.dtypes)["doc"]
    held = docs.agg(F.coalesce(F.sum(F.length("content").cast("long")), F.lit(0))).first()[0]
    keys = _Keys(int(np.clip(np.log2(max(held, 1) / (24 << 20)), 3, 26)))
    marks = spark.sparkContext.broadcast(_filter(_repeated_prefixes(docs, keys, length)))
    names = [f.split()[0] for f in schema.split(", ")]

    def route(untouched: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arrow.slices(batches, "content", SLICE):
                contents = arrow.octets(batch.column("content"))
                texts = Slice(contents, length)
                at, text = texts.samples()
                met = np.zeros(len(contents), bool)
                met[text[_passes(marks.value, keys.of(texts.prefixes(at)))]] = True
                if untouched:
                    rows = [make(c, 0, 0) for c, m in zip(contents, met, strict=True) if not m]
                    if rows:
                        yield pa.RecordBatch.from_arrays([batch.column("doc").filter(pa.array(~met)), *map(pa.array, zip(*rows, strict=True))], ["doc", *names])
                else:
                    yield batch.filter(pa.array(met))

        return run

    passed = docs.mapInArrow(route(True), f"doc {kind}, {schema}")
    met = docs.mapInArrow(route(False), f"doc {kind}, content binary").withColumn("content_id", F.xxhash64("content")).withColumn("digest", F.md5("content"))
    met = scratch.save(met, "met")
    # Equal texts share what is found of them; only equal 192 bits of two hashes make texts copies, which lose all they hold.
    # Facts are kept by content_id alone and written first: each join then moves the contents once, and as both of its sides
    # come straight from an exchange, adaptive execution can split the rows of a text with very many copies over tasks.
    counted = met.groupBy("content_id", "digest").agg(F.count("*").alias("copies"))
    counted = counted.groupBy("content_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "copies"))).alias("copies"))
    settled = _settle(met, keys, marks, length).groupBy("content_id").agg(F.collect_list("places").alias("places"), F.collect_list("states").alias("states"))
    facts = scratch.save(counted.join(settled, "content_id", "left"), "facts")
    known = met.join(facts.hint("merge"), "content_id").withColumn("copies", F.col("copies")[F.col("digest")]).drop("digest")
    known = scratch.save(known, "known")
    scratch.drop("met", "facts")
    # Each text gets a row from each bucket that holds strings of it, so this step has half as many, larger buckets.
    strings = _unsettled(known, _Keys(max(keys.bits - 1, 3)), length).groupBy("content_id").agg(F.collect_list("strings").alias("strings"))
    strings = scratch.save(strings, "strings")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content", SLICE):
            contents = arrow.octets(batch.column("content"))
            texts, at, text, state = _known(batch, length)
            found = [texts.strings(at[state != UNSETTLED], text[state != UNSETTLED])]
            _, starts, _, own = _wide(batch, length)
            begins = np.searchsorted(starts, texts.starts)
            for i, strings in enumerate(batch.column("strings").to_pylist()):
                if strings:
                    mine = slice(begins[i], begins[i + 1])
                    found.append(starts[mine][np.isin(own[mine], np.concatenate([np.frombuffer(x, np.uint64) for x in strings]))])
            gone = _removed(texts, arrow.distinct(np.concatenate(found)), length)
            rows = []
            for i, (content, copies) in enumerate(zip(contents, batch.column("copies").to_pylist(), strict=True)):
                removed = gone[texts.starts[i] : texts.starts[i + 1]]
                if copies > 1 and len(content) >= length:
                    removed = np.ones(len(content), bool)
                rows.append(make(*_cut(content, removed)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *map(pa.array, zip(*rows, strict=True))], ["doc", *names])

    every = known.join(strings.hint("merge"), "content_id", "left").select("doc", "content", "copies", "places", "states", "strings")
    touched = every.mapInArrow(finish, f"doc {kind}, {schema}")
    return passed.union(touched)


def repeated_substrings(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 for each document."""
    return _apply(docs, F.col(key), text, length, _RESULT, _digest).withColumnRenamed("doc", key)


def remove_repeated(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """The documents with what repeats cut out of their texts; documents of which nothing is left stay, with empty texts.

    A row's other columns travel with its text, so no key is needed: null, shared and repeated keys are rows like others.
    """
    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}
    own = F.struct(F.col(text).isNull().alias("empty"), *(F.col(c).alias(alias) for c, alias in others.items()))
    kept = _apply(docs, own, text, length, "_kept string", _clean)
    back = F.when(~F.col("doc.empty"), F.col("_kept")).alias(text)
    return kept.select(*(back if c == text else F.col(f"doc.{others[c]}").alias(c) for c in docs.columns))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Bytes are two hexadecimal digits each; every string of LENGTH bytes is hashed. Pieces hold the strings that start in 1,000 bytes.
_PLACES = f"range(0, length(piece) // 2 - {LENGTH - 1})"
ORACLE = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
y AS MATERIALIZED (SELECT d, o, x[2 * o + 1:2 * (o + {1000 + LENGTH - 1})] AS piece FROM (SELECT d, x, unnest(range(0, greatest(length(x) // 2 - {LENGTH - 1}, 0), 1000)) AS o FROM t)),
p AS (SELECT d, o + unnest({_PLACES}) AS i, unnest(list_transform({_PLACES}, lambda i: hash(piece[2 * i + 1:2 * i + {2 * LENGTH}]))) AS h FROM y),
c AS (SELECT d, i FROM (SELECT d, i, count(*) OVER (PARTITION BY h) AS n FROM p) WHERE n > 1),
g AS (SELECT d, i, sum(fresh) OVER (PARTITION BY d ORDER BY i) AS run FROM (SELECT d, i, CASE WHEN i <= lag(i) OVER (PARTITION BY d ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM c)),
r AS (SELECT d, run, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY d, run),
s AS (SELECT d, a, b, coalesce(lag(b) OVER (PARTITION BY d ORDER BY a), 0) AS past, x FROM r JOIN t USING (d)),
k AS (SELECT d, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(x[2 * past + 1:2 * a], '' ORDER BY a) AS kept, max(b) AS last FROM s GROUP BY d)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || x[2 * coalesce(last, 0) + 1:])) AS kept_sha256 FROM t LEFT JOIN k USING (d)
"""
