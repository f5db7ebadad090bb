"""Order-preserving packing of tokenised documents into fixed-length sequences by dynamic programming.

Documents keep the order in which their partition holds them. A cut may stand after a document (no penalty), after a
sentence (SENTENCE_CUT) or, inside sentences of more than LONGEST_SEGMENT tokens, after each LONGEST_SEGMENT tokens
(FORCED_CUT). With S the running token count at the candidate cuts, a window from cut i to cut j holds S[j] - S[i] tokens,
at most `length`, and

    cost[j] = penalty[j] + min over i of (cost[i] + length - (S[j] - S[i])),

where the minimum of cost[i] + S[i] over the allowed i is taken from a monotone queue, so the work is linear in the
candidates. Each partition is packed by itself in blocks of about BLOCK tokens; what is open at a block's end goes on into
the next block, and only a partition's last window can be short. That tail is split at powers of two, which need no
padding.

Tokenising goes by words parted by space or line feed, which the tokenizer drops and across which it never joins; each
distinct word is encoded by the library once for a worker, in tables of bounded size (or of one text's words, if more), by
64-bit hashes.

Defined cases: a null or empty text is its end token alone; repeated rows are packed again; an empty table gives no rows;
long texts are cut over many sequences, nothing is dropped; of equally good cuts the later one is taken; documents with
the same key or none are packed as any others; further columns are ignored; length is 1 at least.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import arrow, hashing

LENGTH, END_ID = 2048, 1
SENTENCE_CUT, FORCED_CUT, LONGEST_SEGMENT = 2.0, 6.0, 32
BLOCK = 500_000
#: Words whose ids a worker remembers before it starts afresh, and text bytes that are looked at together.
REMEMBERED, SLICE = 2_000_000, 4 << 20


def _plain(raw: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a letter of ASCII or of U+00C0 to U+00FF in UTF-8."""
    pair = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    plain = _LETTER[raw]
    plain[:-1] |= pair
    plain[1:] |= pair
    return plain


_APART, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_APART[[10, 32]] = True
_LETTER[65:91] = _LETTER[97:123] = True


def _first(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """One place of each key."""
    among = among[np.argsort(keys[among])]
    return among[np.append(True, keys[among][1:] != keys[among][:-1])]


class WordIds:
    """The ids of texts, of which each distinct word is encoded by the library once.

    Letters, and a full stop or comma after them, are pre-tokens of their own, so those words need their letters only; and
    A-Z count as a-z there, as the tokenizer lower-cases. Anything else is left to the library as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        stops = [i for i in (self.tokenizer.token_to_id(c + "</w>") for c in ".!?") if i is not None]
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.ends_word, self.stops = np.zeros(size, bool), np.zeros(size, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stops[stops] = True
        self._forget(REMEMBERED)

    def _forget(self, capacity: int) -> None:
        """Words 0, 1 and 2 are the end token, a full stop and a comma."""
        self.known = hashing.Table(capacity, np.int32)
        few = [np.array([END_ID], "<u4"), *(np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4") for c in ".,")]
        self.sizes, self.ids = np.array([len(x) for x in few]), np.concatenate(few)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _encode(self, words: list[str]) -> tuple[list[int], list[np.ndarray]]:
        encoded = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [len(e) for e in encoded], encoded

    def _encode_letters(self, words: list[bytes]) -> tuple[list[int], list[np.ndarray]]:
        """Words that are one pre-token each: many go as one text, and their last tokens tell them apart."""
        sizes, found = [], []
        for start in range(0, len(words), 2000):
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words[start : start + 2000]).decode()], add_special_tokens=False)[0].ids, "<u4")
            sizes += np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1).tolist()
            found.append(ids)
        return sizes, found

    def _learn(self, hashes: np.ndarray, words: list[bytes], letters: np.ndarray) -> None:
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        n = int(letters.sum())
        sizes, ids = self._encode_letters([words[i] for i in order[:n].tolist()])
        more, others = self._encode([words[i].decode("utf-8", "replace") for i in order[n:].tolist()])
        sizes = np.array(sizes + more, np.int64)
        if len(sizes) != len(words):
            raise ValueError("the tokenizer doesn't keep words apart")
        first = len(self.sizes)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, *ids, *others])
        self.known.add(hashes[order], np.arange(first, first + len(order)))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, an end token after each; the number of ids of each text)."""
        raw, begins = hashing.joined(texts)
        starts, ends = hashing.spans(_APART[raw])
        plain = np.concatenate([[0], np.cumsum(_plain(raw))])
        dotted = (ends - starts > 1) & ((raw[ends - 1] == 46) | (raw[ends - 1] == 44))
        dotted &= plain[ends - 1] - plain[starts] == ends - 1 - starts
        core = ends - dotted
        letters = plain[core] - plain[starts] == core - starts
        tail = np.where(dotted, np.where(raw[ends - 1] == 46, 1, 2), 0)
        hashes = hashing.Bytes(raw).hashes(starts, core)
        folded = np.flatnonzero(letters)
        hashes[folded] = hashing.Bytes(raw, True).hashes(starts[folded], core[folded])
        _, hit = self.known.find(hashes)
        if not hit.all():
            own = _first(hashes, np.flatnonzero(~hit))
            if self.known.held + len(own) > REMEMBERED:
                own = _first(hashes, np.arange(len(hashes)))
                self._forget(max(REMEMBERED, len(own)))
            text = raw.tobytes()
            self._learn(hashes[own], [text[a:b] for a, b in zip(starts[own].tolist(), core[own].tolist(), strict=True)], letters[own])
        word = self.known.find(hashes)[0].astype(np.int64)
        # Each word is one piece or two, and each text ends with the end token's.
        pieces = np.zeros((len(word), 2), np.int64)
        pieces[:, 0], pieces[:, 1] = word, tail
        kept = np.ones((len(word), 2), bool)
        kept[:, 1] = dotted
        words = np.diff(np.searchsorted(starts, begins))
        held = np.concatenate([[0], np.cumsum(kept.sum(1))])[np.cumsum(words)]
        pieces = np.insert(pieces[kept], held, 0)
        sizes = self.sizes[pieces]
        to = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[pieces] - (to - sizes), sizes) + np.arange(to[-1] if len(to) else 0)]
        return ids, np.diff(to[held + np.arange(len(held))], prepend=0)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def candidates(ids: np.ndarray, sizes: np.ndarray, stops: np.ndarray, longest: int = LONGEST_SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts of documents laid end to end (the tokens before each) and their penalties; stops: ids that end sentences."""
    stop, ends = stops[ids], np.cumsum(sizes)
    stop[ends - 1] = True
    cuts = np.flatnonzero(stop) + 1
    gaps = np.diff(cuts, prepend=0)
    penalty = np.full(len(cuts), SENTENCE_CUT)
    penalty[np.searchsorted(cuts, ends)] = 0.0
    extra = (gaps - 1) // longest  # cuts inside each sentence
    forced = np.repeat(cuts - gaps, extra) + longest * (np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    all_cuts = np.concatenate([cuts, forced])
    order = np.argsort(all_cuts)  # no two are alike
    return all_cuts[order], np.concatenate([penalty, np.full(len(forced), FORCED_CUT)])[order]


def best_cuts(at: list[int], penalty: list[float], length: int) -> list[int]:
    """Indices of the chosen cuts, the first (0) and the last among them; at: running token counts, from 0."""
    n = len(at)
    cost, came, queue = [0.0] * n, [0] * n, deque([(0.0 + at[0], 0)])
    for j in range(1, n):
        here = at[j]
        while at[queue[0][1]] < here - length:
            queue.popleft()
        value, i = queue[0]
        cost[j] = value + length - here + penalty[j]
        came[j] = i
        value = cost[j] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(came[chosen[-1]])
    return chosen[::-1]


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs one partition's documents; add() and finish() yield pieces."""

    def __init__(self, first_sequence: int, length: int, stops: np.ndarray):
        self.sequence, self.length, self.stops = first_sequence, length, stops
        self.docs: list[tuple[object, np.ndarray, int, int]] = []  # key, ids, tokens of it packed before, all its tokens
        self.cuts, self.penalties, self.held = [0], [0.0], 0

    def add(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
        """Documents laid end to end."""
        ends = np.cumsum(sizes)
        start = 0
        while start < len(keys):  # up to a block at a time, or one longer document
            low = int(ends[start] - sizes[start])
            stop = max(start + 1, int(np.searchsorted(ends, low + BLOCK - self.held, "right")))
            high = int(ends[stop - 1])
            cuts, penalties = candidates(ids[low:high], sizes[start:stop], self.stops, min(LONGEST_SEGMENT, self.length))
            self.docs += [(key, ids[b - n : b], 0, n) for key, b, n in zip(keys[start:stop], ends[start:stop].tolist(), sizes[start:stop].tolist(), strict=True)]
            self.cuts += (cuts + self.held).tolist()
            self.penalties += penalties.tolist()
            self.held += high - low
            if self.held >= BLOCK:
                yield from self._flush(False)
            start = stop

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._flush(True)

    def _flush(self, last: bool) -> Iterator[tuple]:
        chosen = best_cuts(self.cuts, self.penalties, self.length)
        bounds = [self.cuts[i] for i in chosen]
        if last:
            tail = bounds[-1] - bounds[-2]
            if tail < self.length:
                bounds[-1:] = (bounds[-2] + np.cumsum(powers_of_two(tail))).tolist()
        else:
            chosen = chosen[:-1]  # the last window stays open
            bounds = bounds[:-1]
        yield from self._pieces(bounds)
        done = bounds[-1]
        rest, start = [], 0
        for key, ids, before, total in self.docs:
            end = start + len(ids)
            if end > done:
                skip = max(0, done - start)
                rest.append((key, ids[skip:], before + skip, total))
            start = end
        self.docs = rest
        self.cuts, self.penalties = ([0], [0.0]) if last else ([c - done for c in self.cuts[chosen[-1] :]], self.penalties[chosen[-1] :])
        self.held -= done

    def _pieces(self, bounds: list[int]) -> Iterator[tuple]:
        ends = np.cumsum([len(d[1]) for d in self.docs])
        doc, at = 0, 0
        for start, end in zip(bounds, bounds[1:], strict=False):
            at = start
            while at < end:
                key, ids, before, total = self.docs[doc]
                doc_start = int(ends[doc]) - len(ids)
                to = min(end, int(ends[doc]))
                piece = ids[at - doc_start : to - doc_start]
                yield key, before + at - doc_start, to - at, zlib.crc32(piece), total, self.sequence, at - start
                at = to
                doc += at == ends[doc]
            self.sequence += 1


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 36, length, encoder.stops)
        kind, names = None, [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in arrow.slices(batches, text, SLICE):
            kind = batch.column(key).type
            if pieces := list(packer.add(batch.column(key).to_pylist(), *encoder.encode(arrow.octets(batch.column(text))))):
                yield rows(pieces)
        if pieces := list(packer.finish()):
            yield rows(pieces)

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens of word_bpe_49k.json."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
