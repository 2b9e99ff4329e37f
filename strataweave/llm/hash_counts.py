"""Exact counts of 64-bit hashes over a table, shuffled as sorted blobs.

Tasks turn their rows into sorted runs of (hash, count) and cut them by the hash's leading bits
into buckets; one group a bucket merges its runs. A bucket holds a fixed share of the hash space,
so a hash that a third of all rows carry still is one entry a run, and buckets stay even.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

RUNS = "bucket int, kind int, keys binary, counts binary"
FLUSH = 3_000_000


def bits_for(entries: float, per_bucket: int = 1_000_000, least: int = 3) -> int:
    """log2 of the number of buckets, for about ``per_bucket`` entries in each."""
    return max(least, int(np.ceil(np.log2(max(entries, 1) / per_bucket))))


def runs(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], bits: int) -> DataFrame:
    """Sorted runs of what ``hashes`` yields from each batch: pairs of a kind and an array of hashes."""

    def flush(parts: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, arrays in sorted(parts.items()):
            keys, counts = np.unique(np.concatenate(arrays), return_counts=True)
            cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            counts = counts.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array(np.full(len(full), kind), pa.int32()),
                pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                pa.array([counts[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
            ], ["bucket", "kind", "keys", "counts"])
        parts.clear()

    def task(batches):
        parts: dict[int, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for kind, found in hashes(batch):
                if len(found):
                    parts.setdefault(kind, []).append(found)
                    held += len(found)
                if held >= FLUSH:
                    yield from flush(parts)
                    held = 0
        yield from flush(parts)

    return df.mapInArrow(task, RUNS)


def merged(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a group's runs, ascending, and their summed counts."""
    if not len(group):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in group["keys"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"]]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts
