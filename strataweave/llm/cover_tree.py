"""Embedding near-duplicates by dual traversal of cover trees (operator 8).

Vectors are put on the unit sphere, where cosine c is distance sqrt(2 - 2c). Blocks of bounded size each
hold a cover tree: nested nets of radius 2, 1, 1/2, .. whose nodes know the true radius of what they cover. A pair of
blocks is traversed from the roots: node pairs further apart than the threshold distance plus both covering radii are
dropped, pairs that are within it with everything they cover are linked as a whole, and the rest is expanded down to small
buckets, where double-precision cosines decide. Results are exact.

Blocks whose own spheres are too far apart are never paired. Equal vectors are one point with a weight. A pair of
blocks returns link counts and a spanning forest of its links, at most one row a vector, so that a group of n near copies does not make
n * n rows. On data without clusters no bound can prune block pairs, and their number grows with the square of the
table; only their products of matrices do.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .vectors import by_length, cosines, element_type, matrix, norms, usable

SLACK = 1e-5  # single-precision products only ever keep more pairs than needed


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    block: int = 4096
    pivots: int = 512
    sample: int = 4096

    @property
    def distance(self) -> float:
        return float(np.sqrt(2 - 2 * self.threshold))

    @property
    def radii(self) -> list[float]:
        out = [2.0]
        while out[-1] > self.distance / 2:
            out.append(out[-1] / 2)
        return out


@dataclass
class Level:
    centers: np.ndarray  # points that are nodes here
    parent: np.ndarray  # position in the level above
    radius: np.ndarray  # greatest distance to a point below
    weight: np.ndarray  # rows below


@dataclass
class CoverTree:
    points: np.ndarray  # unit vectors
    levels: list[Level]
    bucket: np.ndarray  # the last level's node of each point


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def net(points: np.ndarray, start: np.ndarray, radius: float) -> np.ndarray:
    """``start`` and, in order, each point further than ``radius`` from all before it, but for rounding.

    Single precision is enough: the radius that nodes really cover is measured afterwards.
    """
    points = points.astype(np.float32)
    least = 1 - radius * radius / 2
    chosen, kept = list(start), [points[start]]
    for at in range(0, len(points), 512):
        chunk = np.arange(at, min(at + 512, len(points)))
        near = np.full(len(chunk), -2, np.float32)
        for block in kept:
            if len(block):
                near = np.maximum(near, (points[chunk] @ block.T).max(axis=1))
        chunk = chunk[near < least]
        inside = points[chunk] @ points[chunk].T >= least
        open_, new = np.ones(len(chunk), bool), []
        for i in range(len(chunk)):
            if open_[i]:
                new.append(int(chunk[i]))
                if inside[i, i + 1 :].any():
                    open_ &= ~inside[i]
        chosen += new
        kept.append(points[new])
        if len(kept) > 8:
            kept = [np.concatenate(kept)]
    return np.array(chosen, np.int64)


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    points, centers = points.astype(np.float32), centers.astype(np.float32)
    who = np.zeros(len(points), np.int64)
    for at in range(0, len(points), 512):
        who[at : at + 512] = (points[at : at + 512] @ centers.T).argmax(axis=1)
    return who


def build(points: np.ndarray, weights: np.ndarray, radii: list[float]) -> CoverTree:
    """Nested nets; a point belongs to its nearest last node, a node to the nearest node above."""
    nets = [np.zeros(min(len(points), 1), np.int64)]
    for r in radii[1:]:
        nets.append(net(points, nets[-1], r) if len(nets[-1]) < len(points) else nets[-1])
    whole = lambda k: len(nets[k]) == len(points)

    def owners(rows: np.ndarray, k: int) -> np.ndarray:
        if whole(k):
            place = np.empty(len(points), np.int64)
            place[nets[k]] = np.arange(len(points))
            return place[rows]
        return _nearest(points[rows], points[nets[k]])

    bucket = owners(np.arange(len(points)), len(nets) - 1)
    levels, owner = [], bucket
    for k in range(len(nets) - 1, -1, -1):
        gap = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", points, points[nets[k]][owner]), 0))
        radius, weight = np.zeros(len(nets[k])), np.zeros(len(nets[k]), np.int64)
        np.maximum.at(radius, owner, gap)
        np.add.at(weight, owner, weights)
        parent = owners(nets[k], k - 1) if k else np.zeros(len(nets[k]), np.int64)
        levels.append(Level(nets[k], parent, radius, weight))
        owner = parent[owner]
    return CoverTree(points, levels[::-1], bucket)


def _members(labels: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(labels, kind="stable")
    return np.split(order, np.cumsum(np.bincount(labels, minlength=n))[:-1]) if n else []


def node_pairs(a: CoverTree, b: CoverTree, distance: float):
    """Dual traversal: yields (level, i, j) of node pairs linked as a whole, then (-1, i, j) of last-level pairs to compare."""
    i = j = np.zeros(min(len(a.points), len(b.points), 1), np.int64)
    for k, (x, y) in enumerate(zip(a.levels, b.levels, strict=True)):
        if k:
            i, j = _children(a, b, k, i, j, distance)
        out = []
        for at in range(0, len(i), 1 << 16):
            ii, jj = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            gap = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a.points[x.centers[ii]], b.points[y.centers[jj]]), 0))
            reach = x.radius[ii] + y.radius[jj]
            full = gap + reach < distance - 1e-7
            yield from ((k, u, v) for u, v in zip(ii[full].tolist(), jj[full].tolist(), strict=True))
            open_ = (gap <= distance + 1e-7 + reach) & ~full
            out.append((ii[open_], jj[open_]))
        i, j = (np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in range(2))
    yield from ((-1, u, v) for u, v in zip(i.tolist(), j.tolist(), strict=True))


def _children(a: CoverTree, b: CoverTree, k: int, i: np.ndarray, j: np.ndarray, distance: float):
    """Pairs of children of the pairs (i, j) of level k - 1 that single precision does not rule out."""
    x, y = a.levels[k], b.levels[k]
    order_a, order_b = np.argsort(x.parent, kind="stable"), np.argsort(y.parent, kind="stable")
    n_a, n_b = (np.bincount(v.parent, minlength=len(w.levels[k - 1].centers)) for v, w in ((x, a), (y, b)))
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    count = n_a[i] * n_b[j]
    if count.sum() * 16 <= len(x.centers) * len(y.centers):  # few: listed
        pair = np.repeat(np.arange(len(i)), count)
        local = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        return order_a[first_a[i[pair]] + local // n_b[j[pair]]], order_b[first_b[j[pair]] + local % n_b[j[pair]]]
    alive = np.zeros((len(n_a), len(n_b)), bool)
    alive[i, j] = True
    px, py = a.points[x.centers].astype(np.float32), b.points[y.centers].astype(np.float32)
    out = []
    for at in range(0, len(px), 256):
        rows = slice(at, min(at + 256, len(px)))
        near = px[rows] @ py.T
        # First one bound for the row, then the pair's own for what is left.
        widest = distance + SLACK + x.radius[rows] + y.radius.max()
        u, v = np.nonzero(near >= (1 - widest * widest / 2 - SLACK).astype(np.float32)[:, None])
        reach = distance + SLACK + x.radius[rows][u] + y.radius[v]
        keep = (near[u, v] >= 1 - reach * reach / 2 - SLACK) & alive[x.parent[rows][u], y.parent[v]]
        out.append((u[keep] + at, v[keep]))
    return tuple(np.concatenate([o[n] for o in out]) for n in range(2))


def _forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The pairs that join two trees."""
    root, out = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in pairs:
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((u, v))
    return out


def linked(a: CoverTree, raw_a: np.ndarray, b: CoverTree, raw_b: np.ndarray, weights_a, weights_b, same: bool, s: Settings):
    """Rows linked with each point of a and of b, and a spanning forest of the links (points of b after those of a)."""
    counts_a, counts_b, pairs, n = np.zeros(len(a.points), np.int64), np.zeros(len(b.points), np.int64), [], len(a.points)
    shift = 0 if same else n
    groups = {}

    def below(tree, side, level):
        if (side, level) not in groups:
            labels = tree.bucket
            for k in range(len(tree.levels) - 1, level, -1):
                labels = tree.levels[k].parent[labels]
            groups[side, level] = _members(labels, len(tree.levels[level].centers))
        return groups[side, level]

    last = len(a.levels) - 1
    for level, i, j in node_pairs(a, b, s.distance):
        at = last if level < 0 else level
        x, y = below(a, 0, at)[i], below(b, 1, at)[j]
        if level >= 0:
            counts_a[x] += b.levels[at].weight[j]
            if not same:
                counts_b[y] += a.levels[at].weight[i]
            star = [*x.tolist(), *(y + shift).tolist()]
            pairs += [(star[0], z) for z in star[1:]]
            continue
        for lo in range(0, len(x), 1024):
            for hi in range(0, len(y), 1024):
                _bucket(a, raw_a, x[lo : lo + 1024], b, raw_b, y[hi : hi + 1024], weights_a, weights_b, counts_a, counts_b, pairs, shift, same, s)
    return counts_a, counts_b, _forest(pairs, n if same else n + len(b.points))


def _bucket(a, raw_a, x, b, raw_b, y, weights_a, weights_b, counts_a, counts_b, pairs, shift, same, s):
    near = a.points[x] @ b.points[y].T
    link = near >= s.threshold
    i, j = np.nonzero(np.abs(near - s.threshold) < 1e-9)
    if len(i):
        link[i, j] = cosines(raw_a[x[i]], raw_b[y[j]]) >= s.threshold
    if same:  # a point is linked with itself; its copies are counted apart
        link |= x[:, None] == y[None, :]
    counts_a[x] += link @ weights_b[y]
    if not same:
        counts_b[y] += link.T @ weights_a[x]
    rows = np.flatnonzero(link.any(axis=1))
    if not len(rows):
        return
    link, x = link[rows], x[rows]
    label, big = np.arange(len(rows)), len(rows)
    while True:  # smallest linked row, through columns and back
        through = np.where(link, label[:, None], big).min(axis=0)
        new = np.minimum(label, np.where(link, through[None, :], big).min(axis=1))
        if (new == label).all():
            break
        label = new
    hit = through < big
    pairs += list(zip(x[label[through[hit]]].tolist(), (y[hit] + shift).tolist(), strict=True))
    pairs += list(zip(x[label].tolist(), x.tolist(), strict=True))


def _pack(kind: str, s: Settings):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        raw = matrix(group["embedding"].tolist(), kind)
        unit = raw.astype(np.float64) / norms(raw)[:, None]
        weights = group["copies"].to_numpy(np.int64)
        tree = build(unit, weights, s.radii)
        top = tree.levels[0]
        return pd.DataFrame({
            "block": [int(group["block"].iloc[0])], "center": [unit[top.centers[0]].tobytes()], "radius": [float(top.radius[0])],
            "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "copies": [weights.tobytes()], "vectors": [raw.tobytes()],
            "tree": [pickle.dumps((tree.levels, tree.bucket))],
        })

    return pack


PACK = "block long, center binary, radius double, ids binary, copies binary, vectors binary, tree binary"


def _block_pairs(packs: DataFrame, s: Settings) -> DataFrame:
    """(i, j), i <= j, of blocks whose spheres are near enough; compared in chunks of 512 blocks against all chunks."""
    chunked = packs.select("block", "center", "radius").withColumn("chunk", F.floor(F.col("block") / 512))
    heads = chunked.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("block", "radius", "center"))).alias("blocks"))
    n = int(heads.agg(F.max("chunk")).first()[0] or 0) + 1
    left = heads.select(F.col("chunk").alias("i"), F.col("blocks").alias("x"), F.explode(F.sequence(F.col("chunk"), F.lit(n - 1).cast("long"))).alias("j"))
    right = heads.select(F.col("chunk").alias("j"), F.col("blocks").alias("y"))

    def compare(frames):
        for frame in frames:
            for x, y in zip(frame["x"], frame["y"], strict=True):
                ids = [np.array([r["block"] for r in z], np.int64) for z in (x, y)]
                centers = [np.stack([np.frombuffer(r["center"]) for r in z]) for z in (x, y)]
                radius = [np.array([r["radius"] for r in z]) for z in (x, y)]
                i, j = np.nonzero(_distance(*centers) <= s.distance + 1e-7 + radius[0][:, None] + radius[1][None, :])
                i, j = ids[0][i], ids[1][j]
                yield pd.DataFrame({"i": i[i <= j], "j": j[i <= j]})

    return left.join(right, "j").select("x", "y").mapInPandas(compare, "i long, j long")


def near_duplicates(table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    n_links: other rows with cosine >= threshold. component_id: smallest id reachable by links, itself included;
    kept: whether that is its own. Rows that ``vectors.usable`` leaves out link with nothing; a null id has a null
    component and is not kept. Equal vectors under one id are rows of their own in n_links. Vectors of different lengths do not link. An empty table
    gives an empty result. Further columns are ignored.
    """
    known = reduce(DataFrame.union, (_linked_rows(rows, settings, element_type(table)) for rows in by_length(usable(table))))
    known = known.groupBy("known_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = table.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, F.col("vec_id") == F.col("known_id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _linked_rows(rows: DataFrame, s: Settings, kind: str) -> DataFrame:
    """known_id, n_links, component_id of rows with vectors of one length."""
    spark = rows.sparkSession
    points = rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    points = materialize(points, "ct-points")
    count = points.count()
    sample = points.orderBy(F.xxhash64("vec_id")).limit(s.sample).collect()
    pivots = np.zeros((0, 0))
    if sample:
        raw = matrix([r.embedding for r in sample], kind)
        unit, chosen = raw / norms(raw)[:, None], np.zeros(1, np.int64)
        for r in s.radii[1:]:  # the finest net that is small enough: by this, near vectors share blocks
            finer = net(unit, chosen, r)
            if len(finer) > min(s.pivots, max(1, count // s.block)):
                break
            chosen = finer
        pivots = unit[chosen]
    shared = spark.sparkContext.broadcast(pivots)  # at most ``pivots`` vectors

    def assign(frames):
        for frame in frames:
            x = matrix(frame["embedding"].tolist(), kind).astype(np.float64)
            if len(x):
                yield frame.assign(pivot=_nearest(x / norms(x)[:, None], shared.value))

    vector = points.schema["embedding"].dataType.simpleString()
    placed = points.mapInPandas(assign, f"embedding {vector}, vec_id long, copies long, pivot long")
    placed = materialize(placed, "ct-placed")
    parts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / s.block).cast("int").alias("parts")).orderBy("pivot").collect()  # a row a pivot
    first, total = {}, 0
    for r in parts:
        first[r.pivot] = (total, r.parts)
        total += r.parts
    blocks = spark.createDataFrame([(p, a, n) for p, (a, n) in first.items()], "pivot long, first long, parts int")
    placed = placed.join(F.broadcast(blocks), "pivot").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts"))
    packs = materialize(placed.groupBy("block").applyInPandas(_pack(kind, s), PACK), "ct-packs")
    pairs = materialize(_block_pairs(packs, s), "ct-pairs")
    left, right = (packs.select(F.col("block").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("ids", "copies", "vectors", "tree"))) for x in "ij")

    def traverse(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                def read(ids, copies, vectors, tree):
                    ids = np.frombuffer(ids, np.int64)
                    raw = np.frombuffer(vectors, kind).reshape(len(ids), -1)
                    return ids, np.frombuffer(copies, np.int64), raw, CoverTree(raw.astype(np.float64) / norms(raw)[:, None], *pickle.loads(tree))

                a_ids, a_copies, a_raw, a = read(r.ids_i, r.copies_i, r.vectors_i, r.tree_i)
                b_ids, b_copies, b_raw, b = read(r.ids_j, r.copies_j, r.vectors_j, r.tree_j) if r.i != r.j else (a_ids, a_copies, a_raw, a)
                counts_a, counts_b, forest = linked(a, a_raw, b, b_raw, a_copies, b_copies, r.i == r.j, s)
                ids = a_ids if r.i == r.j else np.concatenate([a_ids, b_ids])
                counts = counts_a - a_copies if r.i == r.j else np.concatenate([counts_a, counts_b])
                some = counts > 0
                yield pd.DataFrame({"a": ids[some], "b": ids[some], "n": counts[some]})
                if forest:
                    ends = ids[np.array(forest)]
                    yield pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1], "n": 0})

    joined = pairs.join(left, "i").join(right, "j")
    found = materialize(joined.mapInPandas(traverse, "a long, b long, n long"), "ct-links")
    degrees = found.filter("n > 0").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("others"))
    classes = components(found.filter("n = 0")).withColumnRenamed("node", "point")
    weighed = points.select(F.col("vec_id").alias("point"), "embedding", "copies").join(degrees, "point", "left").join(classes, "point", "left")
    return rows.join(weighed, "embedding").select(
        F.col("vec_id").alias("known_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "point").alias("component_id"),
    )
