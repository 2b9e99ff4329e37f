"""Approximate nearest neighbours with a forest of random-projection trees (operator 7).

Trees are fitted on a bounded sample: each node cuts at the median of a random projection. Every row is
indexed in one leaf of each tree. A query walks all trees through one priority queue: it descends to the near side
and queues the far side by the sum of squared margins on its path, and takes leaves until its share of all leaves is
visited. Leaves are stored in blocks of bounded size and joined with blocks of the queries that visit them; exact double-precision
cosines rank each block, and the best of all blocks are merged.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import by_length, cosines, element_type, matrix, norms, usable


@dataclass(frozen=True)
class Settings:
    trees: int = 3
    depth: int = 6
    sample: int = 8192
    least_leaf: int = 32
    #: Share of all leaves that a query visits; set for a recall of at least 0.9 on vectors without structure.
    visit: float = 0.3
    block: int = 2048
    seed: int = 7


@dataclass
class Tree:
    """A complete binary tree; node i has children 2i + 1 and 2i + 2."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        node = np.zeros(len(unit), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", unit, self.directions[node]) >= self.cuts[node]
            node = 2 * node + 1 + side
        return node - ((1 << self.depth) - 1)


class Forest:
    def __init__(self, sample: np.ndarray, settings: Settings):
        rng, n = np.random.default_rng(settings.seed), len(sample)
        unit = sample.astype(np.float64) / norms(sample)[:, None] if n else sample
        depth = int(np.clip(np.log2(max(n, 1) / settings.least_leaf), 0, settings.depth)) if n else 0
        self.trees, self.sizes = [], []
        for _ in range(settings.trees):
            inner = (1 << depth) - 1
            directions, cuts = np.zeros((inner, unit.shape[1] if n else 0)), np.zeros(inner)
            members = {0: np.arange(n)}
            for node in range(inner):
                own = members.pop(node)
                d = rng.normal(size=unit.shape[1])
                directions[node] = d / np.sqrt(d @ d)
                p = np.einsum("ij,j->i", unit[own], directions[node])
                cuts[node] = np.median(p) if len(own) else 0.0
                members[2 * node + 1], members[2 * node + 2] = own[p < cuts[node]], own[p >= cuts[node]]
            self.trees.append(Tree(directions, cuts, depth))
            self.sizes.append([len(members[i + inner]) for i in range(1 << depth)])
        self.visits = max(1, int(np.ceil(settings.visit * settings.trees * (1 << depth))))

    def search(self, unit: np.ndarray, least: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until enough leaves and sampled rows are visited."""
        queue, found, rows, serial = [(0.0, t, t, 0) for t in range(len(self.trees))], [], 0, len(self.trees)
        projections = [t.directions @ unit for t in self.trees]
        while queue and (len(found) < self.visits or rows < least):
            cost, _, number, node = heapq.heappop(queue)
            tree = self.trees[number]
            inner = (1 << tree.depth) - 1
            while node < inner:
                margin = projections[number][node] - tree.cuts[node]
                serial += 1
                heapq.heappush(queue, (cost + margin * margin, serial, number, 2 * node + 1 + (margin < 0)))
                node = 2 * node + 1 + (margin >= 0)
            found.append((number, node - inner))
            rows += self.sizes[number][node - inner]
        return found


def _blocks(rows: DataFrame, block: int, kind: str) -> DataFrame:
    """Rows (tree, leaf, vec_id, embedding) in blocks of about ``block``: ids and vectors as bytes."""
    sizes = rows.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / block).alias("parts"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        return pd.DataFrame({
            "tree": [group["tree"].iloc[0]], "leaf": [group["leaf"].iloc[0]],
            "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [matrix(group["embedding"].tolist(), kind).tobytes()],
        })

    # By what a row holds, so that a row that is computed again goes to the same block; rows are distinct, so no id or vector gathers in one.
    salted = rows.join(sizes, ["tree", "leaf"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "embedding"), "parts"))
    return salted.groupBy("tree", "leaf", "salt").applyInPandas(pack, "tree int, leaf int, ids binary, vectors binary")


def _best(q_ids, q, ids, x, k: int):
    """The k nearest ids of a block for each query; a fast product narrows, exact cosines decide."""
    _, first = np.unique(np.rec.fromarrays([ids, x.view(f"V{x.shape[1] * 8}").ravel()]), return_index=True) if len(np.unique(ids)) < len(ids) else (None, None)
    if first is not None:  # repeated rows count once; rows of one id with different vectors make room for others below
        ids, x = ids[first], x[first]
    wanted, k = k, k + len(ids) - len(np.unique(ids))
    unit_q, unit_x = q / norms(q)[:, None], x / norms(x)[:, None]
    for at in range(0, len(q), 256):
        near = unit_q[at : at + 256] @ unit_x.T
        near[q_ids[at : at + 256][:, None] == ids[None, :]] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
        for i, row in enumerate(near):
            some = np.flatnonzero((row >= least[i] - 1e-9) & (row > -np.inf))
            exact = cosines(np.broadcast_to(q[at + i], (len(some), q.shape[1])), x[some])
            order = np.lexsort((ids[some], -exact))
            order = order[np.sort(np.unique(ids[some[order]], return_index=True)[1])][:wanted]  # the best row of each id
            yield from ((int(q_ids[at + i]), int(ids[some[j]]), float(exact[j])) for j in order)


def nearest(table: DataFrame, queries: Column, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows that ``queries`` selects among all other ids.

    Ties go to the smaller id; equal rows are one, and repeated ids count once, by their best row. Rows that ``vectors.usable`` leaves out take no part, and vectors
    of different lengths are not compared. An empty table gives an empty result. Further columns are ignored.
    """
    parts = [_nearest(rows, queries, k, settings, element_type(table)) for rows in by_length(usable(table).distinct())]
    merged = reduce(DataFrame.union, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, queries: Column, k: int, settings: Settings, kind: str) -> DataFrame:
    """query_id, vec_id, score: the nearest of each block, for vectors of one length."""
    s = settings
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample).collect()  # bounded by the setting
    forest = Forest(matrix([r.embedding for r in sample], kind), s)
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # trees of fixed size
    schema = f"tree int, leaf int, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}"

    def index(frames):
        for frame in frames:
            x = matrix(frame["embedding"].tolist(), kind).astype(np.float64)
            if len(x):
                unit = x / norms(x)[:, None]
                for t, tree in enumerate(shared.value.trees):
                    yield pd.DataFrame({"tree": t, "leaf": tree.leaves(unit), "vec_id": frame["vec_id"], "embedding": frame["embedding"]})

    def visit(frames):
        for frame in frames:
            for vec_id, vector in zip(frame["vec_id"], frame["embedding"], strict=True):
                x = matrix([vector], kind)[0].astype(np.float64)
                found = shared.value.search(x / np.sqrt(x @ x), s.trees * (k + 1))
                yield pd.DataFrame({"tree": [f[0] for f in found], "leaf": [f[1] for f in found], "vec_id": vec_id, "embedding": [vector] * len(found)})

    stored = _blocks(rows.mapInPandas(index, schema), s.block, kind)
    asked = _blocks(rows.filter(queries).mapInPandas(visit, schema), s.block, kind).toDF("tree", "leaf", "query_ids", "queries")

    def rank(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.query_ids, np.int64)
                x, q = (np.frombuffer(v, kind).reshape(n, -1).astype(np.float64) for v, n in ((r.vectors, len(ids)), (r.queries, len(q_ids))))
                yield pd.DataFrame(_best(q_ids, q, ids, x, k), columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return stored.join(asked, ["tree", "leaf"]).select("ids", "vectors", "query_ids", "queries").mapInPandas(rank, "query_id long, vec_id long, score double")
