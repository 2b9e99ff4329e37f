"""Nearest vectors by blocks: chunks of queries meet chunks of vectors, a matrix product rules out most pairs, and the rest is measured pair by pair.

The measure of what is left adds up a dimension at a time in double precision, as ``resolve.cosine`` does, so that equal vectors have equal measures wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and vectors of a chunk: some 4 and 1 MB of 64 floats.
QUERIES, VECTORS = 16_384, 4_096
#: Queries of a chunk that meet its vectors at once: a table of 256 x 4,096 doubles is 8 MB.
AT_ONCE = 256
MOST_TASKS = 10_000


def plain(column: str) -> Column:
    """Whether a vector is there and holds no null."""
    return F.col(column).isNotNull() & ~F.exists(column, lambda c: c.isNull())


def _chunks(rows: DataFrame, key: str, vector: str, by: Sequence[str], size: int, name: str) -> tuple[DataFrame, int, int]:
    """The rows of each block as arrays of about ``size``, dealt by a hash of their ids; the chunks of a block, and the blocks."""
    most, blocks = rows.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-most // size))
    held = F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v")))
    chunks = rows.groupBy(*by, F.size(vector).alias("_size"), F.pmod(F.xxhash64(key), F.lit(parts)).alias(f"_{name}")).agg(held.alias("_held"))
    return chunks.select(*by, "_size", f"_{name}", F.col("_held.id").alias(f"{name}_ids"), F.flatten("_held.v").alias(f"{name}_vectors")), parts, blocks


def _folded(x: np.ndarray, y: np.ndarray, term) -> np.ndarray:
    """The sum of the terms of each dimension, in their order."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += term(x[:, d], y[:, d])
    return total


def _close(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of cosine >= least, and it; rows of length 0 have none."""
    lengths = [np.sqrt(_folded(z, z, np.multiply)) for z in (x, y)]
    rough = (x @ y.T) / lengths[0][:, None] / lengths[1][None, :]
    i, j = np.nonzero(~(rough < least - 1e-9))
    across = lengths[0][i] * lengths[1][j]
    i, j, across = i[across != 0], j[across != 0], across[across != 0]
    score = _folded(x[i], y[j], np.multiply) / across
    kept = ~(score < least)
    return i[kept], j[kept], score[kept]


def _least(x: np.ndarray, y: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x the k rows of y of least squared distance, ties to the smaller id, and it."""
    own, other = (x * x).sum(1)[:, None], (y * y).sum(1)[None, :]
    rough = own + other - 2 * (x @ y.T)
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1:k] if rough.shape[1] > k else np.full((len(x), 1), np.inf)
    i, j = np.nonzero(~(rough > limit + 1e-11 * (own + other)))
    distance = _folded(x[i], y[j], lambda a, b: (a - b) * (a - b))
    order = np.lexsort((ids[j], distance, i))
    i, j, distance = i[order], j[order], distance[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], distance[first]


def _met(pairs: DataFrame, found, schema: str) -> DataFrame:
    """Rows (query id, vector id, measure) of ``found`` over pairs of chunks."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q, v = np.asarray(row.q_ids), np.asarray(row.v_ids)
                x, y = (np.asarray(z, dtype="f8").reshape(len(ids), row.width) for z, ids in ((row.q_vectors, q), (row.v_vectors, v)))
                for at in range(0, len(q), AT_ONCE):
                    with np.errstate(all="ignore"):
                        i, j, measure = found(x[at:at + AT_ONCE], y, v)
                    yield pd.DataFrame({names[0]: q[at:at + AT_ONCE][i], names[1]: v[j], names[2]: measure})

    return pairs.select("q_ids", "q_vectors", "v_ids", "v_vectors", F.col("_size").alias("width")).mapInPandas(run, schema)


def _paired(queries: DataFrame, vectors: DataFrame, key: tuple[str, str], vector: tuple[str, str], by: Sequence[str]) -> DataFrame:
    """Chunks of queries with the chunks of vectors of their block and size, each pair dealt out by itself."""
    (q, across, blocks), (v, down, _) = _chunks(queries, key[0], vector[0], by, QUERIES, "q"), _chunks(vectors, key[1], vector[1], by, VECTORS, "v")
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    on, tasks = [*by, "_size", "_q", "_v"], max(1, min(blocks * across * down, MOST_TASKS))
    q, v = (df.repartition(tasks, *on) for df in (q.select("*", every(down, "_v")), v.select("*", every(across, "_q"))))
    return q.join(v, on)


def close_pairs(queries: DataFrame, vectors: DataFrame, least: float, by: str) -> DataFrame:
    """(in_id, cand_id, score): cosine >= least of queries (in_id, x) and vectors (cand_id, y) of one block; what holds nulls has none."""
    q, v = (df.filter(plain(c) & F.col(by).isNotNull() & F.col(i).isNotNull()) for df, c, i in ((queries, "x", "in_id"), (vectors, "y", "cand_id")))
    return _met(_paired(q, v, ("in_id", "cand_id"), ("x", "y"), (by,)), lambda x, y, ids: _close(x, y, least), "in_id long, cand_id long, score double")


def nearest_candidates(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance): of each chunk of vectors the k of least squared distance, for queries (query_id, x) and vectors (vec_id, embedding) without nulls, of one size."""
    return _met(_paired(queries, vectors, ("query_id", "vec_id"), ("x", "embedding"), ()), lambda x, y, ids: _least(x, y, k, ids), "query_id long, vec_id long, distance double")
