"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def release() -> None:
    """Gives memory that is free again back to the system; workers stay, and idle ones count as well."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def released(function: Callable) -> Callable:
    """A function of a group's rows, or of its key and rows, that releases memory after each group."""

    def of_rows(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            release()

    def of_key(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return function(key, table)
        finally:
            release()

    return of_key if function.__code__.co_argcount == 2 else of_rows


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts hold about most_bytes at most (a single longer text is a slice of its own).

    Memory is released after the last one.
    """
    for batch in batches:
        column = batch.column(text)
        if batch.num_rows == 0:
            continue
        if column.nbytes <= most_bytes:
            yield batch
            continue
        start, held = 0, 0
        for i, length in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
            if held and held + length > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length
        yield batch.slice(start)
    batch = column = None
    release()


def texts(column: pa.Array) -> list[str]:
    """Python strings, with "" for null."""
    return [x or "" for x in column.to_pylist()]


def octets(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes, with b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def distinct(values: np.ndarray) -> np.ndarray:
    """The values sorted, each once; sorting is several times faster here than numpy's own hashing."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values
