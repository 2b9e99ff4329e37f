"""Packing documents into as few sequences as possible with a grouping genetic algorithm (operator 12).

Texts become ids; only documents longer than a sequence are cut, the first piece taking what is over. The pieces are dealt by a hash into blocks
of bounded size. Each block is first packed by best fit with the largest first; where that misses the block's lower bound, islands evolve it
(Falkenauer 1996): crossover injects well-filled bins of one parent whole into the other, bins that hold their documents a second time are dissolved, and what
they held besides is put back by best fit. After every epoch an island's elite moves on to the next island of its block. A block is one row,
and islands are rows of their own, so that the work spreads over tasks. The emptiest bin of each block is given up and packed again with those of other blocks,
level by level, so that the last, part-filled bins of blocks do not add up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .packing import _encoder
from .tokens import slices

CAPACITY = 1024
END = 2


@dataclass(frozen=True)
class Settings:
    """items: pieces of a block on average; islands, epochs, generations an epoch and population an island of the genetic search."""

    items: int = 4096
    islands: int = 3
    epochs: int = 3
    generations: int = 12
    population: int = 6
    #: Share of the well-filled bins that crossover injects.
    share: float = 0.4
    #: Emptiest bins that a crossover dissolves as well.
    dissolved: int = 3


def cut(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents, written: key, doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 16 bits)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def task(batches):
        encode, last = _encoder(vocabulary).encode, np.array([end], "<u2").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + last
                    n = len(ids) // 2
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = ids[2 * a : 2 * b]
                        out.append((doc_id, k, a, b - a, zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes()), part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    pieces = docs.mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return materialize(pieces.withColumn("key", F.monotonically_increasing_id()), "genetic-pieces")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without (Martello and Toth's L2; its first term is the sum divided by the capacity)."""
    number = np.bincount(lengths, minlength=capacity + 1)
    upto, size = np.cumsum(number), np.cumsum(number * np.arange(capacity + 1))
    half = capacity // 2
    small = np.arange(half + 1)  # least size that still counts
    big = upto[capacity] - upto[capacity - small]
    middle, middle_size = upto[capacity - small] - upto[half], size[capacity - small] - size[half]
    below = np.maximum(small - 1, 0)
    rest = size[half] - np.where(small > 0, size[below], 0)
    more = rest - (middle * capacity - middle_size)
    return int((big + middle + np.maximum(0, -(-more // capacity))).max())


def best_fit(lengths: list[int], bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Put ``loose``, the longest first, into the fullest bin that has room; ``bins`` (-1: none) are numbered anew from 0.

    Bins are kept by their room, with one bit a room that occurs, so that the best bin is found at once.
    """
    held = np.flatnonzero(bins >= 0)
    out = bins.copy()
    numbers, out[held] = np.unique(bins[held], return_inverse=True)
    count = len(numbers)
    rooms: dict[int, list[int]] = {}
    bits = 0
    for b, room in enumerate((capacity - np.bincount(out[held], np.asarray(lengths)[held], count)).astype(int).tolist()):
        if room:
            rooms.setdefault(room, []).append(b)
            bits |= 1 << room
    placed = []
    for i in loose.tolist():
        size = lengths[i]
        fits = bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            found = rooms[room]
            b = found.pop()
            if not found:
                bits ^= 1 << room
        else:
            b, room, count = count, capacity, count + 1
        placed.append(b)
        room -= size
        if room:
            if bits >> room & 1:
                rooms[room].append(b)
            else:
                rooms[room] = [b]
                bits |= 1 << room
    out[loose] = placed
    return out


class Block:
    """The packings of one block."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.sizes = lengths.tolist()
        self.order = np.argsort(-lengths, kind="stable")
        self.place = np.empty(len(lengths), np.int64)
        self.place[self.order] = np.arange(len(lengths))

    def first(self) -> np.ndarray:
        return best_fit(self.sizes, np.full(len(self.sizes), -1), self.order, self.capacity)

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths)

    def merit(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then the larger mean square of fills: the smaller, the better."""
        fills = self.fills(bins) / self.capacity
        return len(fills), -float((fills * fills).mean())

    def repaired(self, bins: np.ndarray, loose: np.ndarray) -> np.ndarray:
        return best_fit(self.sizes, bins, loose[np.argsort(self.place[loose])], self.capacity)

    def crossed(self, one: np.ndarray, two: np.ndarray, rng: np.random.Generator, s: Settings) -> np.ndarray:
        fills = self.fills(two)
        chosen = (rng.random(len(fills)) < s.share) & (fills >= np.median(fills))
        injected = chosen[two]
        doubled = np.zeros(int(one.max()) + 1, bool)
        doubled[one[injected]] = True  # these bins of the first parent hold an injected document
        rest = np.where(doubled, np.inf, self.fills(one))
        doubled[np.argsort(rest, kind="stable")[: s.dissolved]] = True
        child = np.where(doubled[one], -1, one)
        child[injected] = len(doubled) + two[injected]
        return self.repaired(child, np.flatnonzero(child < 0))

    def shaken(self, bins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A start of its own: a third of the bins dissolved and filled in an order that is not quite by length."""
        gone = rng.random(int(bins.max()) + 1) < 1 / 3
        child = np.where(gone[bins], -1, bins)
        loose = np.flatnonzero(child < 0)
        order = np.argsort(-self.lengths[loose] * rng.uniform(0.8, 1.0, len(loose)), kind="stable")
        return best_fit(self.sizes, child, loose[order], self.capacity)

    def evolved(self, population: list[np.ndarray], bound: int, rng: np.random.Generator, s: Settings) -> list[np.ndarray]:
        """The population after an epoch, best first; it ends early at the bound."""
        ranked = sorted(((self.merit(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
        for born in range(s.generations):
            if ranked[0][0][0] <= bound:
                break
            for k in range(s.population // 2):
                one, two = (min(rng.integers(len(ranked), size=2)) for _ in range(2))  # the better of two, twice
                child = self.crossed(ranked[one][2], ranked[two][2], rng, s)
                ranked.append((self.merit(child), (born + 1) * s.population + k + len(population), child))
            merits = {}
            for entry in sorted(ranked, key=lambda x: x[:2]):
                merits.setdefault(entry[0], entry)  # equal merits are one
            ranked = list(merits.values())[: s.population]
        return [p for _, _, p in ranked]


def _tasks(blocks: int, df: DataFrame) -> int:
    return max(1, min(blocks, max(4 * df.sparkSession.sparkContext.defaultParallelism, blocks // 64)))


_BLOCK = "block long, keys binary, lengths binary, bins binary, n int, bound int"


def _problems(items: DataFrame, blocks: int, level: int, capacity: int) -> DataFrame:
    """A row a block with its first packing; ``items``: key, length."""
    hashed = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(blocks))
    rows = items.select(hashed.alias("block"), "key", "length").repartition(_tasks(blocks, items), "block")
    grouped = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "length"))).alias("items"))  # about Settings.items of them
    grouped = grouped.select("block", F.col("items.key").alias("keys"), F.col("items.length").alias("lengths"))

    def task(batches):
        for batch in batches:
            for block, keys, lengths in zip(batch.column("block").to_pylist(), batch.column("keys"), batch.column("lengths"), strict=True):
                keys, lengths = (np.asarray(x.values, np.int64) for x in (keys, lengths))
                bins = Block(lengths, capacity).first()
                yield pa.RecordBatch.from_pylist([{
                    "block": block, "keys": keys.tobytes(), "lengths": lengths.astype("<u4").tobytes(), "bins": bins.astype("<i4").tobytes(),
                    "n": int(bins.max()) + 1, "bound": lower_bound(lengths, capacity),
                }], pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary()), ("bins", pa.binary()), ("n", pa.int32()), ("bound", pa.int32())]))

    return materialize(grouped.mapInArrow(task, _BLOCK), "genetic-blocks")


_ISLAND = "block long, island int, lengths binary, bound int, population binary, n int, square double"


def _epoch(state: DataFrame, epoch: int, level: int, capacity: int, s: Settings, blocks: int) -> DataFrame:
    """Evolve each island by one epoch; ``population``: packings end to end, ``elite``: of the island before it (null: none)."""
    dealt = state.repartition(_tasks(blocks * s.islands, state), "block", "island")

    def task(batches):
        schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("bound", pa.int32()), ("population", pa.binary()), ("n", pa.int32()), ("square", pa.float64())])
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(np.frombuffer(row["lengths"], "<u4").astype(np.int64), capacity)
                population = list(np.frombuffer(row["population"], "<i4").astype(np.int64).reshape(-1, len(block.lengths)))
                if row["elite"] is not None:
                    population.append(np.frombuffer(row["elite"], "<i4", len(block.lengths)).astype(np.int64))
                rng = np.random.default_rng([level, epoch, row["block"], row["island"]])
                population += [block.shaken(population[0], rng) for _ in range(s.population - len(population))]
                population = block.evolved(population, row["bound"], rng, s)
                n, square = block.merit(population[0])
                out = {k: row[k] for k in ("block", "island", "lengths", "bound")} | {"population": np.concatenate(population).astype("<i4").tobytes(), "n": n, "square": square}
                yield pa.RecordBatch.from_pylist([out], schema)

    return materialize(dealt.mapInArrow(task, _ISLAND), "genetic-islands")


def evolved(problems: DataFrame, level: int, capacity: int, s: Settings) -> DataFrame:
    """(block, better): for the blocks above their lower bound, the best packing of all islands after all epochs."""
    above = problems.filter("n > bound")
    blocks = above.count()
    state = above.select("block", F.explode(F.sequence(F.lit(0), F.lit(s.islands - 1))).alias("island"), "lengths", "bound", F.col("bins").alias("population"), F.lit(None).cast("binary").alias("elite"))
    for epoch in range(s.epochs if blocks else 0):
        done = _epoch(state, epoch, level, capacity, s, blocks)
        settled = done.groupBy("block").agg(F.min("n").alias("least"), F.min("bound").alias("bound")).filter("least > bound")
        if epoch + 1 == s.epochs or not settled.count():
            break
        moved = done.select("block", F.pmod(F.col("island") + 1, F.lit(s.islands)).cast("int").alias("island"), F.col("population").alias("elite"))  # its first packing is the elite
        state = done.drop("n", "square").join(moved, ["block", "island"])
    if not blocks:
        return above.select("block", F.col("bins").alias("better"))
    best = done.groupBy("block").agg(F.min_by("population", F.struct("n", "square", "island")).alias("population"), F.min(F.octet_length("lengths")).alias("size"))
    return best.select("block", F.expr("substring(population, 1, size)").alias("better"))


_SPOTS = "key long, length int, block long, bin int, offset long, emptiest boolean"


def _spots(problems: DataFrame, better: DataFrame) -> DataFrame:
    """Each item's bin and offset in it, and whether the bin is its block's emptiest."""
    solved = problems.join(better, "block", "left").select("block", "keys", "lengths", F.coalesce("better", "bins").alias("bins"))

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, lengths = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                bins = np.frombuffer(row["bins"], "<i4")
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                starts = np.flatnonzero(np.concatenate([[True], np.diff(bins[order]) != 0]))
                offsets = before - np.repeat(before[starts], np.diff(starts, append=len(order)))
                emptiest = bins[order] == np.bincount(bins, lengths).argmin()
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[order]), pa.array(lengths[order], pa.int32()), pa.array(np.full(len(order), row["block"]), pa.int64()), pa.array(bins[order], pa.int32()),
                    pa.array(offsets, pa.int64()), pa.array(emptiest),
                ], ["key", "length", "block", "bin", "offset", "emptiest"])

    return materialize(solved.mapInArrow(task, _SPOTS), "genetic-spots")


def assign(items: DataFrame, capacity: int = CAPACITY, s: Settings = Settings()) -> DataFrame:
    """(key, sequence_id, offset) of items (key, length up to the capacity), in as few sequences as the search finds.

    Keys are unique. A sequence's number holds its level, block and bin.
    """
    out, level = None, 0
    while True:
        number = items.count()
        blocks = max(1, -(-number // s.items))
        problems = _problems(items, blocks, level, capacity)
        spots = _spots(problems, evolved(problems, level, capacity, s))
        done = spots if blocks == 1 else spots.filter(~F.col("emptiest"))
        part = done.select("key", (F.lit(level << 56) + F.col("block") * (1 << 24) + F.col("bin")).cast("long").alias("sequence_id"), "offset")
        out = part if out is None else out.union(part)
        if blocks == 1:
            return out
        items, level = spots.filter("emptiest").select("key", F.col("length").cast("long").alias("length")), level + 1


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END, s: Settings = Settings()) -> DataFrame:
    """Pieces of documents in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    Null and empty texts are their end token; null ids and repeated rows are packed like any row. Texts of any length are encoded whole; one longer than a
    sequence fills sequences of its own but for its first piece. Ties (equal lengths) go by the pieces' keys. An empty table gives an empty result.
    Further columns are ignored, whatever their names. ``sequences`` of module ``packing`` has the padded windows of such pieces.
    """
    pieces = cut(docs, vocabulary, capacity, end)
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    packed = rest.join(assign(rest.select("key", "length"), capacity, s), "key").select(*names)
    alone = full.withColumns({"sequence_id": F.col("key").bitwiseOR(F.lit(1 << 62)), "offset": F.lit(0).cast("long")}).select(*names)
    return packed.union(alone)
