"""Language-model scores: a word unigram base, and prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER bytes long, pretrained on the training documents. A byte's probability
comes from the longest context that was seen, with escapes to shorter ones: method C (an escape is as likely as the number
of different symbols seen there), with symbol exclusion (symbols of a longer context no longer count in a shorter one), and
at last all bytes that were never seen, each alike. Texts are lower-cased (A-Z) UTF-8; an end symbol closes each, and each
begins in a context of end symbols.

The trie is kept as the counts of (context, symbol) at full order, from which those of shorter contexts are sums. It is
never in one place: documents are dealt into batches, each batch sends its distinct (context, symbol) pairs with their
training counts to buckets by the two nearest context bytes, a bucket merges the counts of all batches, works out the
probability of each pair, and answers each batch for the pairs it sent; the batch then adds up its texts. Words for the base
go the same way. Only the counts of the two lowest orders (65,536 at most) are gathered and broadcast.

Defined cases: a null text is empty, its end token and end symbol alone; long texts are read whole; repeated rows train and
score again; without training documents the model is uniform and the base has N = V = 0; an empty table gives no rows;
further columns are ignored. Training documents are those whose crc32(key as text) mod FOLDS is not HELD_OUT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import arrow, hashing
from tessera.llm.scratch import Scratch

ORDER = 5
FOLDS, HELD_OUT = 7, 2
#: Text bytes in a batch, and pair bytes that a bucket is planned for.
BATCH, BUCKET = 16 << 20, 8 << 20
END = 255
GRAMS, WORDS, TOTALS = 0, 1, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END_WORD = 0x5EED
#: Pairs that are worked on together.
PART = 2 << 20


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end token, and the tokens of each text."""
    hashes, sizes = hashing.word_hashes(texts)
    keys, words = np.full(len(hashes) + len(sizes), _END_WORD, np.uint64), np.ones(len(hashes) + len(sizes), bool)
    words[np.cumsum(sizes + 1) - 1] = False
    keys[words] = hashes
    return keys, sizes + 1


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all (context, symbol) pairs, the nearest context byte first and the symbol last, and the text of each.

    Some at a time, so that a long text takes no more memory than many short ones.
    """
    pad = bytes([END]) * ORDER
    raw = np.frombuffer(b"".join([pad + t + b"\xff" for t in texts]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)])
    for low in range(0, len(raw), PART):
        text = np.searchsorted(starts, np.arange(low, min(low + PART, len(raw))), "right") - 1
        at = np.arange(low, low + len(text))
        kept = at - starts[text] >= ORDER
        at, text = at[kept], text[kept]
        keys = raw[at].astype(np.uint64)
        for i in range(1, ORDER + 1):
            keys |= raw[at - i].astype(np.uint64) << np.uint64(8 * (ORDER + 1 - i))
        yield keys, text


def _counted(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how many of each train."""
    found, trained = arrow.distinct(keys), np.sort(keys[trains])
    return found, np.searchsorted(trained, found, "right") - np.searchsorted(trained, found)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[begins], np.add.reduceat(counts[order], begins) if len(keys) else counts


def _planes(values: np.ndarray) -> bytes:
    """Unsigned values as byte planes, which compress better than the values."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(packed: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(width, -1).T).view(kind).ravel()


class Trie:
    """Log10 probabilities of (context, symbol) pairs that share their two nearest context bytes with all that is given."""

    def __init__(self, lowest: np.ndarray):
        """lowest: training counts by nearest context byte and symbol, 256 x 256."""
        self.one = lowest.astype(np.float64)
        self.zero = self.one.sum(0)

    def scores(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n_keys = len(keys)
        if not n_keys:
            return np.empty(0)
        symbol = (keys & np.uint64(255)).astype(np.int64)
        nearest = (keys >> np.uint64(8 * ORDER)).astype(np.int64)
        # By order: the pair's count, its context's sum and different symbols, and what the next longer context excludes.
        levels = []
        longer = None
        for order in range(ORDER, -1, -1):
            if order >= 2:
                pair = ((keys >> np.uint64(8 * (ORDER + 1 - order))) << np.uint64(8)) | symbol.astype(np.uint64)
                _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
                n = np.bincount(inverse, counts, len(first))
                context = pair[first] >> np.uint64(8)
                begins = np.append(True, context[1:] != context[:-1])
                place = np.cumsum(begins) - 1
                begins = np.flatnonzero(begins)
                total, kinds = np.add.reduceat(n, begins)[place][inverse], np.add.reduceat((n > 0).astype(np.float64), begins)[place][inverse]
                own = n[inverse]
            elif order == 1:
                own, total, kinds = self.one[nearest, symbol], self.one.sum(1)[nearest], (self.one > 0).sum(1).astype(np.float64)[nearest]
                first = place = begins = None
            else:
                own, total, kinds = self.zero[symbol], np.full(n_keys, self.zero.sum()), np.full(n_keys, float((self.zero > 0).sum()))
            if order == 0:
                excluded = ((self.one > 0) * self.zero).sum(1)[nearest]
            elif longer is None:
                excluded = np.zeros(n_keys)
            else:
                l_first, l_n, l_place, l_begins, l_inverse = longer
                excluded = np.add.reduceat(own[l_first] * (l_n > 0), l_begins)[l_place][l_inverse]
            levels.append((own, total, kinds, excluded))
            longer = (first, n, place, begins, inverse) if order >= 2 else None
        score, open_ = np.zeros(n_keys), np.ones(n_keys, bool)
        used = np.zeros(n_keys)  # different symbols excluded so far
        for own, total, kinds, excluded in levels:
            seen = total > 0
            longer_seen = used > 0
            weight = np.where(longer_seen, total - excluded, total)
            fresh = kinds - used
            whole = weight + fresh
            ends = open_ & seen & (own > 0)
            score[ends] += np.log10(own[ends] / whole[ends])
            open_ &= ~ends
            escapes = open_ & seen & (whole > 0)
            score[escapes] += np.log10(fresh[escapes] / whole[escapes])
            used = np.where(seen, kinds, used)
        score[open_] -= np.log10(256 - used[open_])
        return score


def _buckets(kind: int, keys: np.ndarray, n: int) -> np.ndarray:
    """Pairs with the same two nearest context bytes, or a word, go to one bucket."""
    near = keys >> np.uint64(8 * (ORDER - 1)) if kind == GRAMS else keys
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n


def _texts_of(table: pa.Table, most: int = 1 << 20) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Lower-cased texts and whether they train, some at a time."""
    for batch in arrow.slices(iter(table.combine_chunks().to_batches()), "content", most):
        yield [t.translate(_LOWER) for t in arrow.octets(batch.column("content"))], ~batch.column("held_out").to_numpy(zero_copy_only=False)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    fold = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS
    docs = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"), (fold == HELD_OUT).alias("held_out"))
    kind = dict(docs.dtypes)["doc"]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held = np.zeros(65536, np.int64), 0
        for batch in batches:
            for texts, trains in _texts_of(pa.Table.from_batches([batch])):
                held += sum(map(len, texts))
                for keys, text in grams(texts):
                    keys = keys[trains[text]]
                    pairs += np.bincount((keys >> np.uint64(8 * ORDER) << np.uint64(8) | keys & np.uint64(255)).astype(np.int64), minlength=65536)
        used = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(pairs[used], held))], ["pair", "n"])

    found = {r.pair: r.n for r in docs.mapInArrow(survey, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    held = found.pop(-1, 0)
    lowest = np.zeros(65536, np.int64)
    lowest[list(found)] = list(found.values())
    trie = spark.sparkContext.broadcast(Trie(lowest.reshape(256, 256)))
    n_batches, n_buckets = held // BATCH + 1, max(12, held // BUCKET + 1)
    docs = docs.withColumn("batch", F.pmod(F.xxhash64("doc", F.length("content")), F.lit(n_batches)))

    def ask(group: tuple, table: pa.Table) -> pa.Table:
        rows = []
        for what in (GRAMS, WORDS):
            keys, counts, pending = [], [], 0
            for texts, trains in _texts_of(table):
                if what == GRAMS:
                    parts = ((own, trains[text]) for own, text in grams(texts))
                else:
                    own, sizes = word_keys(texts)
                    parts = ((own, np.repeat(trains, sizes)),)
                for own, training in parts:
                    own, n = _counted(own, training)
                    keys.append(own)
                    counts.append(n)
                    pending += len(own)
                if pending > 4 * PART:
                    own, n = _merge(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, pending = [own], [n], 0
            own, n = _merge(np.concatenate(keys), np.concatenate(counts))
            to = _buckets(what, own, n_buckets)
            order = np.argsort(to, kind="stable")
            own, n, to = own[order], n[order], to[order]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            rows += [(what, int(to[a]), group[0].as_py(), _planes(own[a:b]), _planes(n[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=True)]
        return pa.table(dict(zip(("kind", "bucket", "batch", "keys", "counts"), map(pa.array, zip(*rows, strict=True)), strict=True)))

    def answer(group: tuple, table: pa.Table) -> pa.Table:
        what = group[0].as_py()
        asked = [_from_planes(x, np.uint64) for x in table.column("keys").to_pylist()]
        keys, counts = _merge(np.concatenate(asked), np.concatenate([_from_planes(x, np.int64) for x in table.column("counts").to_pylist()]))
        values = trie.value.scores(keys, counts.astype(np.float64)) if what == GRAMS else counts
        rows = [(what, b, k, _planes(values[np.searchsorted(keys, own)])) for b, k, own in zip(table.column("batch").to_pylist(), table.column("keys").to_pylist(), asked, strict=True)]
        if what == WORDS:
            rows.append((TOTALS, -1, None, np.array([counts.sum(), (counts > 0).sum()], np.int64).tobytes()))
        columns = list(zip(*rows, strict=True))
        return pa.table({"kind": pa.array(columns[0], pa.int64()), "batch": pa.array(columns[1], pa.int64()), "keys": pa.array(columns[2], pa.binary()), "values": pa.array(columns[3], pa.binary())})

    asked = docs.groupBy("batch").applyInArrow(ask, "kind long, bucket long, batch long, keys binary, counts binary")
    answers = scratch.save(asked.groupBy("kind", "bucket").applyInArrow(answer, "kind long, batch long, keys binary, values binary"), "answers")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.array([np.frombuffer(x, np.int64) for x in batch.column("values").to_pylist()], np.int64).reshape(-1, 2).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:1]), pa.array(both[1:])], ["n", "v"])

    n_train, n_kinds = answers.filter(F.col("kind") == TOTALS).select("values").mapInArrow(totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def add_up(group: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        known = {}
        for what, number in ((GRAMS, np.float64), (WORDS, np.int64)):
            mine = told.filter(pc.equal(told.column("kind"), what))
            known[what] = hashing.Table(sum(len(x) // 8 for x in mine.column("keys").to_pylist()), number)
            for keys, values in zip(mine.column("keys").to_pylist(), mine.column("values").to_pylist(), strict=True):
                known[what].add(_from_planes(keys, np.uint64) + np.uint64(what == GRAMS), _from_planes(values, number))
        out = [[] for _ in range(4)]
        for texts, _ in _texts_of(table):
            score = np.zeros(len(texts))
            for keys, text in grams(texts):
                score += np.bincount(text, known[GRAMS].find(keys + np.uint64(1))[0], len(texts))
            keys, n = word_keys(texts)
            c = known[WORDS].find(keys)[0]
            begins = np.concatenate([[0], np.cumsum(n)])[:-1]
            base = np.add.reduceat(np.log10(c + 1), begins) - n * np.log10(n_train + n_kinds + 1)
            for to, column in zip(out, (n, np.add.reduceat((c > 0).astype(np.int64), begins), base, score), strict=True):
                to.append(column)
        n, n_known, base, score = map(np.concatenate, out)
        return pa.table({key: table.column("doc"), "held_out": table.column("held_out"), "n_tokens": n, "n_known": n_known, "train_tokens": np.full(len(n), n_train), "base_score": base, "score": score})

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("batch").cogroup(answers.filter(F.col("kind") != TOTALS).groupBy("batch")).applyInArrow(add_up, schema)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
