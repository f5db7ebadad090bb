"""Hashes of any spans of bytes, and hash tables, worked on in whole arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(2)
def byte_values(lower: bool = False) -> np.ndarray:
    """A fixed random number for each byte; lower: A-Z have those of a-z."""
    values = np.random.default_rng(271828).integers(0, 1 << 64, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(1 << (n - 1).bit_length(), 1 << 16), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def mixed(polynomials: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Polynomials of bytes and their lengths as hashes; none is 0, which tables keep for empty places."""
    out = polynomials + np.asarray(lengths).astype(np.uint64)
    out ^= out >> np.uint64(29)
    out *= MIX
    out ^= out >> np.uint64(32)
    out[out == 0] = 1
    return out


class Bytes:
    """Bytes of which any span can be hashed; equal spans (but for case, if lower) have equal hashes."""

    def __init__(self, raw: np.ndarray, lower: bool = False):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(byte_values(lower)[raw] * power(BASE, len(raw)), out=self.sums[1:])

    def polynomials(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * power(INVERSE, len(self.sums))[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.polynomials(starts, ends), ends - starts)


def spans(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between separators; apart: whether each byte is one, the last must be."""
    edges = np.flatnonzero(np.diff(apart, prepend=True))
    return edges[::2], edges[1::2]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a line feed after each, and where each begins."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return raw, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, A-Z as a-z if lower, and the number of words of each text); words part at ASCII white space."""
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    raw, begins = joined(texts)
    starts, ends = spans(_BLANK[raw])
    return Bytes(raw, lower).hashes(starts, ends), np.diff(np.searchsorted(starts, begins))


class Table:
    """A map from nonzero 64-bit keys to numbers by open addressing, filled to seven tenths at most."""

    def __init__(self, capacity: int, kind: type = np.int64):
        bits = max(4, int(capacity / 0.7).bit_length())
        self.held, self.shift, self.mask = 0, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, kind)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(BASE)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each key's number, or any where there is none; whether there is one)."""
        at = self._home(keys)
        there = self.keys[at]
        hit = there == keys
        rest = np.flatnonzero(~hit & (there != 0))
        while len(rest):
            to = (at[rest] + 1) & self.mask
            at[rest] = to
            there = self.keys[to]
            same = there == keys[rest]
            hit[rest[same]] = True
            rest = rest[~same & (there != 0)]
        return self.values[at], hit

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not held yet; the caller keeps to the capacity."""
        self.held += len(keys)
        at, rest = self._home(keys), np.arange(len(keys))
        while len(rest):
            to = at[rest]
            free = self.keys[to] == 0
            tried, to = rest[free], to[free]
            self.keys[to] = keys[tried]
            won = self.keys[to] == keys[tried]
            self.values[to[won]] = values[tried[won]]
            rest = np.concatenate([rest[~free], tried[~won]])
            at[rest] = (at[rest] + 1) & self.mask
