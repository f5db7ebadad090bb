"""Exact n-gram Jaccard join in the metric space of shingle sets, with the components and numbers of its links.

Distance is 1 - Jaccard; two sets link within EPSILON = 1/4. Equal sets are at distance 0 and count as one point.

Coarse regions. Pivots are the one-shingle sets: all of a set's own shingles are equally near pivots, and one global order
(frequent shingles last) breaks the tie, which makes each set's Voronoi region that of its first shingle. Where x and y
lie within EPSILON, at most EPSILON * |x| shingles of x are missing from y, so the first shingle that both hold is among the
first EPSILON * |x| + 1 of x, and likewise of y. That is the window over whose regions a set is replicated: every link
meets in some region. (Whole documents make no useful coarse pivots: nearly all pairs of texts are at distance 1, so that
their triangle-inequality windows would replicate everything.) Windows are a little longer than that, which by the same
argument demands EXTRA common shingles and so drops sets that share a passage only.

Fine regions. Sets that meet form candidate clusters; each cluster is joined by document pivots: distances to the first
pivots give triangle-inequality windows | d(x,p) - d(y,p) | <= EPSILON, and all pairs inside all windows are compared.
Every set is a pivot in turn against the sets after it, so the join is exact and counts each link once. Links leave a call
as each set's number, equal sets weighted by their copies, and as the few that connect its sets. Clusters too large for a
task are cut into blocks, and pairs of blocks joined.

Frequent shingles. All shingles of all documents are counted. Those in more than DENSE documents come last in the order,
rarest first; if they exceed MOST_DENSE, the bound of the table that is broadcast, the threshold is doubled until they fit
(any order gives exact results, the order only saves work). Only sets of which three quarters are frequent shingles
replicate over regions of frequent shingles; there each set meets the region's first set instead of all, as the cluster
that results is joined exactly anyway.

Shuffled entries are packed: a row holds the entries of some thousand documents for a bucket of shingle hashes.

Defined cases: a null or empty text has an empty set, links with nothing and is a component of its own; a text of one to
four words has one shingle, its whole sequence; repeated rows are equal sets; an empty table gives no rows; long texts are
read whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arrow, hashing
from tessera.llm.components import components
from tessera.llm.scratch import Scratch

SHINGLE = 5
#: Similarity of a link, as a fraction.
LIKE = (75, 100)
#: Documents of a shingle from which on it counts as frequent, and the most frequent shingles that are told apart (12 bytes each).
DENSE, MOST_DENSE = 32, 2_000_000
#: The share of a set by which windows are longer than the least.
EXTRA = 0.08
#: Shingles in a block of a cluster (8 bytes each).
BLOCK = 2_000_000
#: Document pivots whose distances are kept.
PIVOTS = 8
_FACTOR, _MIX, _ALL = np.uint64(hashing.BASE), hashing.MIX, (1 << 64) - 1
#: Text bytes that are looked at together, and text bytes for each bucket. A pair comes from each bucket in which it
#: meets, so buckets are as large as memory allows. Pairs that a bucket holds before it merges them.
SLICE, BUCKET, PAIRS = 3 << 20, 16 << 20, 2 << 20


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    words, sizes = hashing.word_hashes(texts)
    whole = max(0, len(words) - n + 1)
    runs = words[:whole].copy()  # of n words, wherever they begin
    for i in range(1, n):
        runs *= _FACTOR
        runs += words[i : i + whole]
    sets = []
    for start, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        if size >= n:
            hashes = runs[start : start + size - n + 1] + np.uint64(n)
        elif size:
            value = 0
            for word in words[start : start + size].tolist():
                value = value * int(_FACTOR) + word
            hashes = np.array([(value + size) & _ALL], np.uint64)
        else:
            hashes = words[:0].copy()
        hashes ^= hashes >> np.uint64(29)
        hashes *= _MIX
        hashes ^= hashes >> np.uint64(32)
        sets.append(arrow.distinct(hashes))
    return sets


def set_id(own: np.ndarray) -> int:
    """Signed 64-bit name of a set; equal for equal sets."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _pack(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit values as differences, byte planes apart, so that the shuffle's compression works."""
    steps = np.diff(sorted_values, prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


class _Keys:
    """A shingle hash's key: `bits` leading bits name its bucket, the next 32 its place there."""

    def __init__(self, bits: int):
        self.bits = bits

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(32 - self.bits)

    def split(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Sorted keys by bucket."""
        if not len(keys):
            return
        buckets = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
            yield int(buckets[a]), slice(a, b)


def _frequent(docs: DataFrame, text: str, keys: _Keys, dense: int) -> DataFrame:
    """(key, n): shingle keys in more than `dense` documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, text, SLICE):
            sets = shingle_sets(arrow.octets(batch.column(text)))
            found, n = np.unique(keys.of(np.concatenate([np.empty(0, np.uint64), *sets])), return_counts=True)
            rows = [(b, _pack((found[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), np.minimum(n[s], 1 << 30).astype(np.uint32).tobytes()) for b, s in keys.split(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "places", "counts"])

    def merge(group: tuple, table: pa.Table) -> pa.Table:
        places = np.concatenate([_unpack(x) for x in table.column("places").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
        both = np.sort(places.astype(np.uint64) << np.uint64(32) | n)
        places, n = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begins = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        totals = np.add.reduceat(n, begins)
        kept = totals > dense
        full = (np.uint64(group[0].as_py()) << np.uint64(32)) | places[begins][kept].astype(np.uint64)
        return pa.table({"key": pa.array(full.view(np.int64)), "n": pa.array(totals[kept])})

    packed = docs.select(text).mapInArrow(count, "bucket long, places binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(arrow.released(merge), "key long, n long")


def _order_table(frequent: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent keys, sorted, and their counts: all, or those over a doubled threshold if they are more than `most`."""
    scales = {r.scale: r["count"] for r in frequent.groupBy(F.floor(F.log2("n")).alias("scale")).count().collect()}  # 64 rows at most
    least = min(scales, default=0)
    while sum(n for s, n in scales.items() if s >= least) > most:
        least += 1
    table = frequent.filter(F.col("n") >= (1 << least if least > min(scales, default=0) else 0)).toArrow()
    found, n = table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def least_common(n: np.ndarray | int) -> np.ndarray | int:
    """The fewest shingles that a set of n shares with any that it links with."""
    return -(-n * LIKE[0] // LIKE[1])


def _demand(n: np.ndarray) -> np.ndarray:
    return 1 + (EXTRA * n).astype(np.int64)


class _Window:
    """The regions of sets, given the frequent shingles."""

    def __init__(self, keys: _Keys, frequent: np.ndarray, counts: np.ndarray):
        self.keys, self.frequent = keys, hashing.Table(len(frequent))
        self.frequent.add(frequent + np.uint64(1), counts.astype(np.int64))

    def entries(self, sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(key, set index, whether frequent) of each replica, and for each set its size and its frequent shingles in the window."""
        sizes = np.array([len(s) for s in sets], np.int64)
        own = self.keys.of(np.concatenate([np.empty(0, np.uint64), *sets]))
        owner = np.repeat(np.arange(len(sets)), sizes)
        rank, dense = self.frequent.find(own + np.uint64(1))
        n_all = np.bincount(owner[dense], minlength=len(sets))
        n_rare = sizes - n_all
        least = sizes - least_common(sizes)  # in the order, a link's first common shingle is at this place at most
        window = least + _demand(sizes)
        rare = np.flatnonzero(~dense)  # a set's rare shingles come first, by key, as they are
        place = np.arange(len(rare)) - np.repeat(np.cumsum(n_rare) - n_rare, n_rare)
        kept = rare[place < window[owner[rare]]]
        late = np.flatnonzero(dense & (n_rare < window)[owner])  # then its frequent ones, rarest first
        late = late[np.lexsort((own[late], rank[late], owner[late]))]
        held = np.bincount(owner[late], minlength=len(sets))
        place = n_rare[owner[late]] + np.arange(len(late)) - np.repeat(np.cumsum(held) - held, held)
        late = late[place < window[owner[late]]]
        n_dense = np.bincount(owner[late], minlength=len(sets))
        kept = np.concatenate([kept, late[((n_rare <= least) & (n_all > 0))[owner[late]]]])
        return own[kept], owner[kept], dense[kept], sizes, n_dense


def _counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their counts; parts without counts count one for each."""
    ones = np.sort(np.concatenate([np.empty(0, np.uint64), *codes[len(counts) :]]))
    begins = np.flatnonzero(np.append(True, ones[1:] != ones[:-1])) if len(ones) else np.empty(0, np.int64)
    found, n = ones[begins], np.diff(np.append(begins, len(ones)))
    if not counts:
        return found, n
    found, n = np.concatenate([*codes[: len(counts)], found]), np.concatenate([*counts, n])
    order = np.argsort(found)
    found, n = found[order], n[order]
    begins = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.empty(0, np.int64)
    return found[begins], np.add.reduceat(n, begins) if len(found) else n


def _candidates(docs: DataFrame, text: str, keys: _Keys, window, dense: int) -> DataFrame:
    """(u, v): pairs of set ids that must be in one cluster."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, text, SLICE):
            sets = {set_id(s): s for s in shingle_sets(arrow.octets(batch.column(text))) if len(s)}
            ids = np.array(list(sets), np.int64)
            own, owner, frequent, sizes, n_dense = window.value.entries(list(sets.values()))
            room = np.uint64(len(ids).bit_length() + 1)
            if 32 + keys.bits + int(room) <= 64:  # sorted as one number, which is several times faster
                both = np.sort(own << room | (owner.astype(np.uint64) << np.uint64(1) | frequent))
                own, owner, frequent = both >> room, ((both & ((np.uint64(1) << room) - np.uint64(1))) >> np.uint64(1)).astype(np.int64), (both & np.uint64(1)).astype(bool)
            else:
                order = np.argsort(own)
                own, owner, frequent = own[order], owner[order], frequent[order]
            rows = []
            for bucket, s in keys.split(own):
                used, index = np.unique(owner[s], return_inverse=True)
                about = ids[used].tobytes() + sizes[used].astype(np.int32).tobytes() + n_dense[used].astype(np.int32).tobytes()
                rows.append((bucket, _pack((own[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), index.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), np.packbits(frequent[s]).tobytes(), about))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "places", "sets", "frequent", "about"])

    def meet(group: tuple, table: pa.Table) -> pa.Table:
        about = [np.frombuffer(x, np.int64, len(x) // 16) for x in table.column("about").to_pylist()]
        names, first, index = np.unique(np.concatenate(about), return_index=True, return_inverse=True)
        sizes, n_dense = (np.concatenate([np.frombuffer(x, np.int32, len(x) // 16, at * (len(x) // 16)) for x in table.column("about").to_pylist()])[first].astype(np.int64) for at in (8, 12))
        codes, marked, at = [], [], 0
        for places, own, frequent, ids in zip(*(table.column(c).to_pylist() for c in ("places", "sets", "frequent")), about, strict=True):
            places = _unpack(places)
            own = np.frombuffer(own, np.uint16 if len(ids) < 65536 else np.uint32)
            marked.append(places[np.unpackbits(np.frombuffer(frequent, np.uint8))[: len(places)].astype(bool)])
            codes.append(places.astype(np.uint64) << np.uint64(32) | index[at : at + len(ids)].astype(np.uint64)[own])
            at += len(ids)
        codes = arrow.distinct(np.concatenate(codes))  # a set may come from several slices
        places, ids = (codes >> np.uint64(32)).astype(np.uint32), (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        begins = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        held = np.diff(np.append(begins, len(places)))
        often = np.isin(places[begins], arrow.distinct(np.concatenate(marked))) | (held > dense)
        region = np.repeat(np.arange(len(begins), dtype=np.int32), held)
        first, ends = begins[region], (begins + held)[region]
        # Regions of frequent shingles: each set meets the first.
        star = np.flatnonzero(often[region])
        star = star[star > first[star]]
        stars = arrow.distinct(ids[first[star]].astype(np.uint64) << np.uint64(32) | ids[star])
        # All pairs inside the other regions, of at most `dense` sets; as codes of their two names.
        a = np.flatnonzero(~often[region])
        found, counts, waiting = [], [], 0
        for step in range(1, dense):
            a = a[a + step < ends[a]]
            if not len(a):
                break
            for part in np.array_split(a, -(-len(a) // PAIRS)):
                u, v = ids[part], ids[part + step]
                small, large = np.minimum(sizes[u], sizes[v]), np.maximum(sizes[u], sizes[v])
                near = LIKE[1] * small >= LIKE[0] * large
                found.append(u[near].astype(np.uint64) << np.uint64(32) | v[near])
                waiting += len(found[-1])
                if waiting > PAIRS:
                    merged, n = _counted(found, counts)
                    found, counts, waiting = [merged], [n], 0
        found, counts = _counted(found, counts)
        pairs = np.concatenate([stars, found])
        u, v = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        wanted = np.maximum(_demand(np.minimum(sizes[u], sizes[v])) - np.minimum(n_dense[u], n_dense[v]), 1)
        wanted[: len(stars)] = 1
        return pa.table({"u": names[u], "v": names[v], "n": np.concatenate([np.full(len(stars), 1 << 20), counts]).astype(np.int64), "wanted": wanted})

    packed = docs.select(text).mapInArrow(replicate, "bucket long, places binary, sets binary, frequent binary, about binary")
    met = packed.groupBy("bucket").applyInArrow(arrow.released(meet), "u long, v long, n long, wanted long")
    return met.groupBy("u", "v").agg(F.sum("n").alias("n"), F.min("wanted").alias("wanted")).filter("n >= wanted").select("u", "v")


def link_cluster(sets: list[np.ndarray], side: np.ndarray | None = None, copies: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect what is connected (pairs of indices), and the copies that each set links with.

    Exact by document pivots and windows. side: if given, a number for each set, and only pairs from different sides are
    joined. copies: how many rows each set stands for, 1 if not given.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    copies = np.ones(n, np.int64) if copies is None else copies
    numbers, shingles = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marks = np.zeros(len(numbers), np.int32)
    # The sets of each shingle: read instead of the sets themselves where they are fewer.
    owners = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(shingles, kind="stable")]
    posts = np.concatenate([[0], np.cumsum(np.bincount(shingles, minlength=len(numbers)))])
    label = np.arange(n)
    epsilon = 1 - LIKE[0] / LIKE[1]
    kept: list[np.ndarray] = []
    links = []
    n_links = np.zeros(n, np.int64)

    def runs(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())

    def common(pivot: int, others: np.ndarray) -> np.ndarray:
        own = shingles[starts[pivot] : starts[pivot + 1]]
        held = posts[own + 1] - posts[own]
        if held.sum() < sizes[others].sum():
            return np.bincount(owners[runs(posts[own], held)], minlength=n)[others]
        marks[own] = 1
        found = np.add.reduceat(marks[shingles[runs(starts[others], sizes[others])]], np.cumsum(sizes[others]) - sizes[others])
        marks[own] = 0
        return found.astype(np.int64)

    everyone = np.arange(n)
    for pivot in range(n):
        near = everyone > pivot  # earlier ones were joined when those were pivots
        if side is not None:
            near &= side != side[pivot]
        near &= (LIKE[1] * sizes >= LIKE[0] * sizes[pivot]) & (LIKE[1] * sizes[pivot] >= LIKE[0] * sizes)
        for distances in kept:
            near &= np.abs(distances - distances[pivot]) <= epsilon + 1e-9
        near = np.flatnonzero(near)
        if len(kept) < PIVOTS:
            both = common(pivot, everyone)
            kept.append(1 - both / (sizes + sizes[pivot] - both))
            both = both[near]
        elif len(near):
            both = common(pivot, near)
        if not len(near):
            continue
        linked = near[LIKE[1] * both >= LIKE[0] * (sizes[near] + sizes[pivot] - both)]
        n_links[pivot] += copies[linked].sum()
        n_links[linked] += copies[pivot]
        for other in linked[label[linked] != label[pivot]].tolist():
            if label[other] != label[pivot]:
                links.append((pivot, other))
                label[label == label[other]] = label[pivot]
    return links, n_links


def join_cluster(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The connecting links of link_cluster."""
    return link_cluster(sets, side)[0]


def _fine_links(members: DataFrame, block: int) -> DataFrame:
    """(u, v, n_links): links that connect a cluster's sets, and rows without v that give copies that u links with.

    members: (cluster, set_id, copies, content), content being the set's hashes. Each pair of a cluster's sets is compared in
    one call only, so a set's rows without v add up to all it links with.
    """
    blocks = (F.floor(F.sum(F.length("content").cast("long")) / (8 * block)) + 1).cast("int")
    sized = members.groupBy("cluster").agg(blocks.alias("blocks"))
    # Clusters of one block share calls, each of about a block: a call for each would cost more than the join.
    calls = (members.agg(F.coalesce(F.sum(F.length("content").cast("long")), F.lit(0))).first()[0] // (8 * block) + 1) * 4
    placed = members.join(sized, "cluster").withColumn("i", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster",
        F.when(F.col("blocks") > 1, F.xxhash64("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(calls))).alias("call"),
        F.least("i", "j").alias("a"),
        F.greatest("i", "j").alias("b"),
        "i",
        "set_id",
        "copies",
        "content",
    )

    def join(table: pa.Table) -> pa.Table:
        u, v, n = [], [], []
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("cluster", "set_id", "i", "a", "b", "copies")), range(table.num_rows), strict=True))
        content = table.column("content")
        start = 0
        while start < len(rows):
            end = start
            while end < len(rows) and rows[end][0] == rows[start][0]:
                end += 1
            part = rows[start:end]
            if end - start > 1:
                sets = [np.frombuffer(content[r[6]].as_py(), np.uint64) for r in part]
                side = np.array([r[2] for r in part]) if part[0][3] != part[0][4] else None
                links, found = link_cluster(sets, side, np.array([r[5] for r in part], np.int64))
                for x, y in links:
                    u.append(part[x][1])
                    v.append(part[y][1])
                    n.append(None)
                for x in np.flatnonzero(found).tolist():
                    u.append(part[x][1])
                    v.append(None)
                    n.append(int(found[x]))
            start = end
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n_links": pa.array(n, pa.int64())})

    return pairs.groupBy("call", "a", "b").applyInArrow(arrow.released(join), "u long, v long, n_links long")


def _classes(docs: DataFrame, scratch: Scratch, dense: int, most_dense: int, block: int) -> DataFrame:
    """(row, doc, n_shingles, point, n_links) for each of docs (row, doc, content); rows of one component share a point, null for empty sets.

    docs must be a written table in which each row has a number of its own: rows are found again by that, not by doc.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc"]
    held = docs.agg(F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0))).first()[0]
    keys = _Keys(int(np.clip(np.log2(max(held, 1) / BUCKET), 3, 26)))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content", SLICE):
            sets = shingle_sets(arrow.octets(batch.column("content")))
            ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), ids, pa.array([len(s) for s in sets], pa.int64())], ["row", "doc", "set_id", "n_shingles"])

    named = scratch.save(docs.select("row", "doc", "content").mapInArrow(name, f"row long, doc {kind}, set_id long, n_shingles long"), "named")
    frequent = scratch.save(_frequent(docs, "content", keys, dense), "frequent")
    window = spark.sparkContext.broadcast(_Window(keys, *_order_table(frequent, most_dense)))
    met = scratch.save(_candidates(docs, "content", keys, window, dense), "met")
    clusters = components(met, scratch, "clusters").select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    chosen = named.join(clusters, "set_id").groupBy("set_id", "cluster").agg(F.min("row").alias("row"), F.count("*").alias("copies"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "content", SLICE):
            sets = [s.tobytes() for s in shingle_sets(arrow.octets(batch.column("content")))]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("set_id"), batch.column("copies"), pa.array(sets, pa.binary())], ["cluster", "set_id", "copies", "content"])

    members = docs.join(chosen, "row").select("cluster", "set_id", "copies", "content").mapInArrow(load, "cluster long, set_id long, copies long, content binary")
    links = scratch.save(_fine_links(scratch.save(members, "members"), block), "links")
    scratch.drop("members", "met")
    roots = components(links.filter("v IS NOT NULL"), scratch, "roots").withColumnRenamed("node", "set_id")
    # Rows with one set link with each other, and each with all that the set links with.
    copies = named.filter("set_id IS NOT NULL").groupBy("set_id").agg((F.count("*") - 1).alias("copies"))
    counted = links.filter("v IS NULL").groupBy(F.col("u").alias("set_id")).agg(F.sum("n_links").alias("others"))
    sets = copies.join(roots, "set_id", "left").join(counted, "set_id", "left").select("set_id", "root", (F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_links"))
    joined = named.join(sets, "set_id", "left")
    return joined.select("row", "doc", "n_shingles", F.coalesce("root", "set_id").alias("point"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", dense: int = DENSE, most_dense: int = MOST_DENSE, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id (the least key of the component), n_links (other rows it links with) for each document."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), F.col(text).alias("content"))
    found = _classes(scratch.save(rows, "rows"), scratch, dense, most_dense, block)
    least = found.filter("point IS NOT NULL").groupBy("point").agg(F.min("doc").alias("least"))
    return found.join(least, "point", "left").select(F.col("doc").alias(key), "n_shingles", F.coalesce("least", "doc").alias("component_id"), "n_links")


_ROW = "_jaccard_row"


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all columns: its least key, null last; of rows that share it any one. Empty sets all stay."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.save(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    found = _classes(rows.select(F.col(_ROW).alias("row"), F.col(key).alias("doc"), F.col(text).alias("content")), scratch, DENSE, MOST_DENSE, BLOCK)
    first = found.filter("point IS NOT NULL").groupBy("point").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "row"))["row"].alias("first"))
    gone = found.join(first, "point").filter("row != first").select(F.col("row").alias(_ROW))
    return rows.join(gone, _ROW, "left_anti").select(docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_W = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_W}, []::VARCHAR[]) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::UBIGINT[] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
p AS MATERIALIZED (SELECT doc_id, len(s) AS n, s, hash(list_sort(s)) AS h FROM s),
rep AS MATERIALIZED (SELECT h, min(doc_id) AS doc_id, any_value(n) AS n FROM p WHERE n > 0 GROUP BY h),
e AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS t FROM p WHERE doc_id IN (SELECT doc_id FROM rep)),
l AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
u AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l UNION ALL SELECT r.doc_id, p.doc_id FROM p JOIN rep r USING (h) WHERE p.n > 0 AND p.doc_id <> r.doc_id
  UNION ALL SELECT p.doc_id, r.doc_id FROM p JOIN rep r USING (h) WHERE p.n > 0 AND p.doc_id <> r.doc_id),
r(node, root) AS (SELECT doc_id, doc_id FROM p UNION SELECT u.v, r.root FROM r JOIN u ON r.node = u.u WHERE r.root < u.v),
c AS (SELECT h, count(*) AS copies FROM p WHERE n > 0 GROUP BY h), k AS (SELECT rep.doc_id, h, copies FROM rep JOIN c USING (h)),
m AS (SELECT k.h, sum(o.copies) AS n FROM (SELECT u, v FROM l UNION ALL SELECT v, u FROM l) x JOIN k ON k.doc_id = x.u JOIN k o ON o.doc_id = x.v GROUP BY k.h)
SELECT p.doc_id, p.n::BIGINT AS n_shingles, min(root) AS component_id, CASE WHEN p.n > 0 THEN any_value(copies) - 1 + coalesce(any_value(m.n), 0) ELSE 0 END::BIGINT AS n_links
FROM r JOIN p ON r.node = p.doc_id LEFT JOIN c USING (h) LEFT JOIN m USING (h) GROUP BY p.doc_id, p.n
"""
