"""Token counts by compiled finite-state transducers.

A byte-level BPE file is compiled into two deterministic transducers.

The first reads code points by class and marks where pre-tokens begin. It has twelve states, so the effect of a chunk of
text is a map from twelve entry states to twelve exit states. Chunks of CHUNK code points run in lockstep from all entry
states, their maps compose by a parallel prefix scan, and so every chunk's true entry state is known without reading the
text in sequence; a second lockstep run then marks the beginnings. A separator that resets every state stands between
texts, so that one scan serves a whole batch.

The second reads pre-tokens, each distinct one of a batch once, in lockstep, a byte at a time. Its state after a prefix is
the prefix's last token, and a transition carries the tokens emitted, which are negative where bytes merge into earlier
tokens: the last token of the longer prefix is the one token t at its end for which (last token of what is before, t) is
a pair that BPE leaves apart, so the count is that of what is before plus one. Tokens, merges and compiled transitions are
in hash tables of fixed size, looked up for whole arrays. The counts of the pre-tokens compose by a prefix sum, of which
each text takes its part. Hashes of 64 bits tell tokens and pre-tokens apart.

Strings of added special tokens inside a text count as one token and part the text, as in the library.

Defined cases: null counts as empty, and an empty text has 0 tokens; a long text is read whole, and so is a long run of letters, in memory in
proportion to it; repeated rows each give
their own row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import arrow, hashing

#: Code points in a chunk.
CHUNK = 192
#: Pre-tokens that a worker remembers before it starts afresh, and pairs of tokens (a power of two).
REMEMBERED, PAIRS = 2_000_000, 1 << 20
#: Bytes of a pre-token that is read in lockstep with others, pre-tokens that are, and bytes of a longer one that are looked at together.
SHORT, LOCKSTEP, LONG_PART = 48, 1 << 16, 1 << 16

# Classes of code points.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, STMD, R_V, L, E, END = range(11)
# States: nothing open; runs of letters, numbers, others; one space; one other blank; longer blanks ending in either;
# a quote that begins a pre-token; that and r or v; that and l; a finished contraction.
START, WORD, DIGITS, MARKS, SPACE1, BLANK1, SPACES, BLANKS, QUOTED, QUOTED_RV, QUOTED_L, DONE = range(12)
STATES = 12
#: The characters that the library's \s takes.
BLANK_CHARACTERS = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point; one past the last is the separator."""
    table = np.full(0x110001, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[BLANK_CHARACTERS] = BLANK
    for characters, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("rv", R_V), ("l", L), ("e", E)):
        for c in characters:
            table[ord(c)] = kind
    table[0x110000] = END
    return table


@lru_cache(1)
def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state times 16, and marks: 1 if a pre-token begins at the code point read, 2 if one begins at the one before it."""
    follow, marks = np.zeros((STATES, 16), np.uint8), np.zeros((STATES, 16), np.uint8)
    letters = {LETTER, STMD, R_V, L, E}
    fresh = {NUMBER: DIGITS, SPACE: SPACE1, BLANK: BLANK1, OTHER: MARKS, QUOTE: QUOTED, END: START} | dict.fromkeys(letters, WORD)
    for state in range(STATES):
        for kind in range(11):
            to, mark = fresh[kind], 1
            if kind == END:
                mark = 3 if state in (QUOTED_RV, QUOTED_L) else 1
            elif state == WORD and kind in letters or state == DIGITS and kind == NUMBER:
                mark = 0
            elif state == MARKS and kind in (OTHER, QUOTE):
                to, mark = MARKS, 0
            elif state in (SPACE1, SPACES):
                if kind in (SPACE, BLANK):
                    to, mark = (SPACES if kind == SPACE else BLANKS), 0
                else:  # the last space opens the next pre-token
                    to, mark = (MARKS if kind == QUOTE else to), (2 if state == SPACES else 0)
            elif state in (BLANK1, BLANKS):
                if kind in (SPACE, BLANK):
                    to, mark = (SPACES if kind == SPACE else BLANKS), 0
                else:  # the last blank stands alone
                    mark = 3 if state == BLANKS else 1
            elif state == QUOTED:
                if kind == STMD:
                    to, mark = DONE, 0
                elif kind in (R_V, L):
                    to, mark = (QUOTED_RV if kind == R_V else QUOTED_L), 0
                elif kind in (OTHER, QUOTE):
                    to, mark = MARKS, 0
            elif state == QUOTED_RV or state == QUOTED_L:
                if kind == (E if state == QUOTED_RV else L):
                    to, mark = DONE, 0
                else:  # no contraction: the letter begins a word
                    mark = 2 if kind in letters else 3
            follow[state, kind], marks[state, kind] = to, mark
    return follow.ravel().astype(np.intp) << 4, marks.ravel()


def beginnings(codes: np.ndarray) -> np.ndarray:
    """Where pre-tokens (and separators) begin in code points that end with a separator."""
    follow, marks = _transducer()
    chunks = -(-len(codes) // CHUNK)
    kinds = np.full(chunks * CHUNK, END, np.uint8)
    kinds[: len(codes)] = _classes()[codes]
    kinds = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T)  # one row for each step
    maps = np.repeat(np.arange(STATES, dtype=np.intp)[:, None] << 4, chunks, 1)  # states are kept times 16
    for step in kinds:
        maps += step
        np.take(follow, maps, out=maps, mode="clip")
    maps = np.ascontiguousarray(maps.T.astype(np.uint8) >> 4)
    reach = 1
    while reach < chunks:  # prefix scan: maps[i] becomes the effect of chunks 0 to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
        reach *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.intp) << 4
    found = np.empty((CHUNK, chunks), np.uint8)
    for i, step in enumerate(kinds):
        state += step
        np.take(marks, state, out=found[i], mode="clip")
        np.take(follow, state, out=state, mode="clip")
    found = found.T.ravel()[: len(codes)]
    begins = (found & 1).astype(bool)
    begins[:-1] |= found[1:] >= 2
    begins[0] = True
    return np.flatnonzero(begins)


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenTransducer:
    """Counts the tokens of pre-tokens, many at a time.

    Token numbers: a byte's value, then 256 + rank of the merge that makes it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        number = {bytes([b]): b for b in range(256)}
        halves = [(b, b) for b in range(256)]
        joins: dict[int, int] = {}
        for merge in spec["model"]["merges"]:
            left, right = map(plain, merge.split(" ") if isinstance(merge, str) else merge)
            a, b = number[left], number[right]
            joins[a << 17 | b] = len(halves)
            number.setdefault(left + right, len(halves))
            halves.append((a, b))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.halves = np.array(halves, np.int64).T
        self.lengths = sorted({len(t) for t in number})
        raw, begins = hashing.joined(list(number))
        self.tokens = hashing.Table(len(number), np.int32)
        self.tokens.add(hashing.Bytes(raw).hashes(begins[:-1], begins[1:] - 1), np.fromiter(number.values(), np.int32, len(number)))
        self.joins = hashing.Table(len(joins), np.int64)
        self.joins.add(np.fromiter(joins, np.uint64, len(joins)) + np.uint64(1), np.fromiter(joins.values(), np.int64, len(joins)))
        self.join_of, self.parts, self.apart = joins, self.halves.tolist(), {}
        self.pairs, self.fits = np.zeros(PAIRS, np.uint64), np.zeros(PAIRS, bool)
        self.known = hashing.Table(REMEMBERED, np.int32)

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each two tokens as they are when they stand side by side.

        Merges are undone latest first; while two pieces touch, a merge across the border that is due before the one
        just undone would have come first. Of equal merges the one further left comes first.
        """
        out, rest = np.ones(len(left), bool), np.arange(len(left))
        due = np.full(len(left), 1 << 60)
        while len(rest):
            across, joins = self.joins.find((left << 17 | right).astype(np.uint64) + np.uint64(1))
            broken = joins & (across < due)
            out[rest[broken]] = False
            undo_left = (left > 255) & ((left > right) | (right <= 255))
            undo_right = ~undo_left & (right > 255)
            due = np.where(undo_left, left, right + 1)
            left, right = np.where(undo_left, self.halves[1][left], left), np.where(undo_right, self.halves[0][right], right)
            going = ~broken & (undo_left | undo_right)
            rest, left, right, due = rest[going], left[going], right[going], due[going]
        return out

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same, remembered for the last pairs that fell to each of PAIRS places."""
        pair = (left << 17 | right).astype(np.uint64) + np.uint64(1)
        at = (pair * np.uint64(hashing.BASE)) >> np.uint64(64 - PAIRS.bit_length() + 1)
        new = np.flatnonzero(self.pairs[at] != pair)
        found = self.fits[at]
        if len(new):
            found[new] = self._stay_apart(left[new], right[new])
            self.pairs[at[new]] = pair[new]
            self.fits[at[new]] = found[new]
            wrong = self.pairs[at[new]] != pair[new]  # two pairs fell to one place
            self.pairs[at[new[wrong]]] = 0
        return found

    def read(self, text: hashing.Bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of pre-tokens of at most SHORT bytes, read in lockstep, a byte at a time.

        The last token of each prefix is the one token t at its end for which (last token of what is before, t) stay
        apart; the transition adds one to the tokens emitted up to there.
        """
        order = np.argsort(-sizes)
        starts, sizes = starts[order], sizes[order]
        n, most = len(starts), int(sizes[0])
        reading = np.searchsorted(-sizes, -np.arange(most + 1), "right")  # pre-tokens that have so many bytes
        sums = np.zeros((most + 1, n), np.uint64)
        inverse = hashing.power(hashing.INVERSE, len(text.sums))
        for end in range(1, most + 1):
            own = starts[: reading[end]]
            sums[end, : len(own)] = (text.sums[own + end] - text.sums[own]) * inverse[own]
        last, emitted = np.zeros((most + 1, n), np.int32), np.zeros((most + 1, n), np.uint8)
        for end in range(1, most + 1):
            rest = np.arange(reading[end])
            for size in range(end, 0, -1):
                if not len(rest):
                    break
                begin = end - size
                token, hit = self.tokens.find(hashing.mixed((sums[end][rest] - sums[begin][rest]) * inverse[begin], size))
                if begin:
                    hit = np.flatnonzero(hit)
                    hit = hit[self.stay_apart(last[begin][rest[hit]].astype(np.int64), token[hit].astype(np.int64))]
                    fits = np.zeros(len(rest), bool)
                    fits[hit] = True
                else:
                    fits = hit
                done = rest[fits]
                last[end, done] = token[fits]
                emitted[end, done] = emitted[begin, done] + 1
                rest = rest[~fits]
        out = np.empty(n, np.int64)
        out[order] = emitted[sizes, np.arange(n)]
        return out

    def read_long(self, text: hashing.Bytes, start: int, size: int) -> int:
        """Tokens of one long pre-token: the tokens that may end at each byte are found for many bytes together."""
        last, emitted = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for low in range(0, size, LONG_PART):
            ends = np.arange(low + 1, min(low + LONG_PART, size) + 1)
            found = []
            for length in self.lengths:
                own = ends[ends >= length] + start
                token, hit = self.tokens.find(text.hashes(own - length, own))
                found.append(np.stack([own[hit] - start, np.full(hit.sum(), length), token[hit]]))
            at, lengths, tokens = np.concatenate(found, 1)
            order = np.lexsort((-lengths, at))
            stop = 0
            for end, length, token in zip(at[order].tolist(), lengths[order].tolist(), tokens[order].tolist(), strict=True):
                begin = end - length
                if end != stop and (not begin or self._fits(int(last[begin]), token)):
                    last[end], emitted[end], stop = token, emitted[begin] + 1, end
        return int(emitted[size])

    def _fits(self, left: int, right: int) -> bool:
        """_stay_apart for one pair, remembered."""
        pair = left << 17 | right
        fits = self.apart.get(pair)
        if fits is not None:
            return fits
        due, (first, second), joins = 1 << 60, self.parts, self.join_of
        while True:
            if joins.get(left << 17 | right, due) < due:
                fits = False
                break
            if left > 255 and (left > right or right <= 255):
                due, left = left, second[left]
            elif right > 255:
                due, right = right + 1, first[right]
            else:
                fits = True
                break
        if len(self.apart) > PAIRS:
            self.apart.clear()
        self.apart[pair] = fits
        return fits

    def counts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token raw[start:end]."""
        text = hashing.Bytes(raw)
        keys = text.hashes(starts, ends)
        found, hit = self.known.find(keys)
        missing = np.flatnonzero(~hit)
        if len(missing):
            order = missing[np.argsort(keys[missing])]
            new = np.append(True, keys[order][1:] != keys[order][:-1])
            first = order[new]
            own = np.zeros(len(first), np.int64)
            sizes = ends[first] - starts[first]
            short = np.flatnonzero(sizes <= SHORT)
            for part in np.array_split(short, -(-len(short) // LOCKSTEP)) if len(short) else []:
                own[part] = self.read(text, starts[first[part]], sizes[part])
            for i in np.flatnonzero(sizes > SHORT).tolist():
                own[i] = self.read_long(text, int(starts[first[i]]), int(sizes[i]))
            found = found.copy()
            found[order] = own[np.cumsum(new) - 1]
            if self.known.held + len(first) > REMEMBERED:
                self.known = hashing.Table(REMEMBERED, np.int32)
            kept = slice(0, REMEMBERED)
            self.known.add(keys[first[kept]], own[kept])
        return found.astype(np.int64)


@lru_cache(2)
def transducer(path: str) -> TokenTransducer:
    return TokenTransducer(path)


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    machine = transducer(path)
    extra, parts, owners = np.zeros(len(texts), np.int64), [], []
    for i, text in enumerate(texts):
        pieces = [text]
        for special in machine.specials:
            if special in text:
                pieces = [q for piece in pieces for q in piece.split(special)]
                extra[i] = len(pieces) - 1
        parts += pieces
        owners += [i] * len(pieces)
    together = "\n".join(parts) + "\n"
    raw = np.frombuffer(together.encode("utf-8", "surrogatepass"), np.uint8)
    codes = np.frombuffer(together.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    codes[ends] = 0x110000
    begins = beginnings(codes)
    places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of code points among the bytes
    separators = np.isin(begins, ends, assume_unique=True)
    starts = places[begins]
    counts = np.zeros(len(begins), np.int64)
    words = np.flatnonzero(~separators)
    counts[words] = machine.counts(raw, starts[words], np.append(starts, len(raw))[words + 1])
    sums = np.concatenate([[0], np.cumsum(counts)])
    at = np.searchsorted(begins, ends)
    totals = np.diff(np.concatenate([[0], sums[at]]))
    return extra + np.bincount(owners, totals, len(texts)).astype(np.int64)


def with_token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row; tokenizer: the path of a byte-level BPE file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, text, 4 << 20):
            column = arrow.texts(batch.column(text))
            n_bytes = np.array([len(x) for x in arrow.octets(batch.column(text))], np.int64)
            counts = count_tokens(column, tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with byte_bpe_50k.json."""
    import public_tokenizers

    return with_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
