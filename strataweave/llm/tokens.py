"""Vectorised words and 64-bit hashes over Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. All work is on the column's bytes with
numpy, in bounded slices, so that a very long text needs a few bytes a byte and no Python object
a word. Null texts count as empty.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SLICE = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), elementwise."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODE = mix((_LOWER.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))  # a random value a byte; A-Z as a-z
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        with np.errstate(over="ignore"):
            _POWERS[:] = [
                np.concatenate([[_U(1)], np.cumprod(np.full(size, _U(b)))])
                for b in (_BASE, pow(_BASE, -1, 1 << 64))
            ]
    return _POWERS[0], _POWERS[1]


class Words(NamedTuple):
    """The words of a column: ``hashes[bounds[i]:bounds[i + 1]]`` are those of text i."""

    hashes: np.ndarray
    bounds: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 offsets of its texts (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array) -> Words:
    """Hash every word of every text."""
    data, offsets = utf8(column)
    if not len(data):
        return Words(np.zeros(0, _U), np.zeros(len(offsets), np.int64))
    solid = ~_SPACE[data]
    first = solid.copy()  # a word starts here
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()  # a word ends here
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    ends = np.flatnonzero(last) + 1
    return Words(_hash_spans(data, starts, ends), np.searchsorted(starts, offsets))


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        at, s, e = starts[i], starts[i:j] - starts[i], ends[i:j] - starts[i]
        up, down = _powers(int(e[-1]))
        with np.errstate(over="ignore"):
            sums = np.cumsum(_CODE[data[at : at + e[-1]]] * up[: e[-1]])
            value = sums[e - 1] - np.where(s > 0, sums[np.maximum(s, 1) - 1], _U(0))
            out[i:j] = mix(value * down[s] + (e - s).astype(_U))
        i = j
    return out


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` in one sequence, in order."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    out = hashes[: len(hashes) - n + 1]
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k])
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Cut a batch into runs of rows with at most about ``limit`` bytes of ``column`` each (one row at least)."""
    at = batch.schema.get_field_index(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j
