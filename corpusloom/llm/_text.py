"""Vectorised word access over Arrow string columns.

Words are maximal runs of bytes other than the six ASCII white-space bytes
(``[^\\x20\\x09-\\x0D]+``); no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa


def one_matrix_thread() -> None:
    """Let numpy's matrix products use one thread: Spark runs a task on every core, and waiting threads of small products would burn the others' time."""
    maps = Path("/proc/self/maps")
    for lib in {line.split()[-1] for line in maps.read_text().splitlines() if "openblas" in line} if maps.exists() else ():
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(loaded := ctypes.CDLL(lib), name):
                getattr(loaded, name)(1)
                break


one_matrix_thread()

#: Text bytes worked on at a time; one document is never split, so a longer one is a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of a block of documents: ``data[start[i]:end[i]]``; document d owns words ``first[d]:first[d+1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit name for each word, a function of its bytes alone."""
        n = len(self.start)
        h = np.full(n, seed, dtype=np.uint64)
        if not n:
            return h
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        size = self.end - self.start
        h ^= size.astype(np.uint64) * _M1
        keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
        todo, at, left = slice(None), self.start, size
        while True:
            h[todo] = mix((h[todo] ^ (eight[at] & keep[np.minimum(left, 8)])) + _M1)
            more = np.flatnonzero(left > 8)
            if not len(more):
                return h
            todo = more if isinstance(todo, slice) else todo[more]
            at, left = at[more] + 8, left[more] - 8

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    solid = ~_SPACE[data]
    begins, ends = solid.copy(), np.empty(n, dtype=bool)
    if n:
        begins[1:] &= ~solid[:-1]
        ends[:-1] = solid[:-1] & ~solid[1:]
        ends[-1] = solid[-1]
        edge = offsets[(offsets > 0) & (offsets < n)]  # documents lie side by side
        begins[edge] = solid[edge]
        ends[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches evenly into row ranges of about ``size`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        share = offsets[-1] / max(1, round(offsets[-1] / size))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + share, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
