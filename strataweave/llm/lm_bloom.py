"""Language-model scores from a log-frequency Bloom filter (operator 1).

After Talbot and Osborne, "Smoothed Bloom filter language models": an n-gram seen c times is
put into a Bloom filter under the keys (n-gram, 1) .. (n-gram, q), q = 1 + floor(log_b c); a count is
read by probing those keys in turn until one is missing. Exact unigram counts stand beside it. Tokens
are lower-cased words and an end; probabilities are smoothed recursively,

    p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

with k chosen from a grid by leave-one-out likelihood on all distinct training texts. Unigram
counts enter p quantised too (finely), and exactly into the base score. Each text is read once: its scores and its
leave-one-out likelihoods for every k of the grid are computed together, the likelihoods are summed, and the scores of the best k remain.

The counts, and so the filter, grow with the corpus. Filter and unigram table are cut into segments by the
hash's leading bits. Segments are broadcast only up to ``max_broadcast_mb`` at a time (by default a
sixth of the driver's memory); a model above it is read in several passes over the texts, each with its
own segments, and each hands on the levels it has found, so that results do not depend on the bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, megabytes
from .hash_counts import bits_for, merged, runs
from .tokens import mix, slices, words

BEGIN, END = np.uint64(0x0B5E55ED), np.uint64(0xE0D)
GRID = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0)
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    order: int = 2
    log_base: float = 1.5
    bits_per_entry: int = 10
    probes: int = 4
    unigram_base: float = 1.1
    max_broadcast_mb: int | None = None


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin w1 .. wn end of every text end to end, the text of each item, and the texts' bounds."""
    w = words(column)
    n = len(w.bounds) - 1
    counts = np.diff(w.bounds)
    bounds = w.bounds + 2 * np.arange(n + 1)
    items = np.empty(bounds[-1], _U)
    items[bounds[:-1]] = BEGIN
    items[bounds[1:] - 1] = END
    inner = np.ones(len(items), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    items[inner] = w.hashes
    return items, np.repeat(np.arange(n), counts + 2), bounds


def _grams(items: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams that end at each item, and whether they lie in one text."""
    out, ok = np.zeros(len(items), _U), np.zeros(len(items), bool)
    if len(items) >= k:
        with np.errstate(over="ignore"):
            h = items[: len(items) - k + 1]
            for j in range(1, k):
                h = mix(h * _U(0x9E3779B97F4A7C15) + items[j : len(items) - k + 1 + j])
            out[k - 1 :] = mix(h + _U(k))
        ok[k - 1 :] = text[k - 1 :] == text[: len(items) - k + 1]
    return out, ok


def quantised(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_b c)."""
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def level_counts(levels: int, base: float) -> np.ndarray:
    """The count that each level stands for: the mean of the integers it covers."""
    out = [0.0]
    for q in range(1, levels + 1):
        low, high = int(np.ceil(base ** (q - 1) - 1e-9)), int(np.ceil(base**q - 1e-9)) - 1
        out.append((low + high) / 2 if high >= low else out[-1])
    return np.array(out)


def _places(keys: np.ndarray, n_words: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word and the bits in it of each key (a Bloom filter blocked by words)."""
    h = mix(keys)
    place = ((h >> _U(32)) * n_words) >> _U(32)
    g, bits = mix(h + _U(1)), np.zeros(len(keys), _U)
    for t in range(probes):
        bits |= _U(1) << ((g >> _U(6 * t)) & _U(63))
    return place, bits


def _level_keys(grams: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return grams + _U((level * 0xD1B54A32D192ED03) % (1 << 64))


def _segment(settings: Settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Merges a bucket's runs into its unigram counts and its part of the filter."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        unigrams, counts = merged(group[group["kind"] == 1])
        keys, top = [], 0
        for k in range(2, settings.order + 1):
            grams, n = merged(group[group["kind"] == k])
            levels = quantised(n, settings.log_base) if len(n) else n
            for q in range(1, int(levels.max(initial=0)) + 1):
                keys.append(_level_keys(grams[levels >= q], q))
            top = max(top, int(levels.max(initial=0)))
        keys = np.concatenate(keys) if keys else np.zeros(0, _U)
        cells = np.zeros(-(-max(len(keys), 1) * settings.bits_per_entry // 64), _U)
        place, bits = _places(keys, _U(len(cells)), settings.probes)
        np.bitwise_or.at(cells, place.astype(np.int64), bits)
        kind = np.dtype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8")
        return pd.DataFrame({
            "bucket": [int(group["bucket"].iloc[0])], "keys": [unigrams.tobytes()], "counts": [counts.astype(kind).tobytes()],
            "cells": [cells.tobytes()], "types": [len(unigrams)], "tokens": [int(counts.sum())],
            "levels": [top], "size": [(8 + kind.itemsize) * len(unigrams) + 8 * len(cells)],
        })

    return build


SEGMENT = "bucket int, keys binary, counts binary, cells binary, types long, tokens long, levels int, size long"


@dataclass
class Part:
    """Some segments, as tasks read them."""

    bits: int
    owned: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    cells: np.ndarray
    start: np.ndarray
    length: np.ndarray
    levels: int
    probes: int

    def unigrams(self, hashes: np.ndarray) -> np.ndarray:
        """Exact counts; 0 for what is not in these segments."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(len(hashes), np.int64)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        return np.where(self.keys[at] == distinct, self.counts[at].astype(np.int64), 0)[inverse]

    def grams(self, hashes: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes; 0 for what is not in these segments."""
        out = np.zeros(len(hashes), np.uint8)
        bucket = (hashes >> _U(64 - self.bits)).astype(np.int64)
        alive = np.flatnonzero(ok & (self.length[bucket] > 0))
        for q in range(1, self.levels + 1):
            if not len(alive):
                break
            b = bucket[alive]
            place, bits = _places(_level_keys(hashes[alive], q), self.length[b], self.probes)
            alive = alive[(self.cells[(self.start[b] + place).astype(np.int64)] & bits) == bits]
            out[alive] = q
        return out


class BloomModel:
    """A model written to the shared folder, with the figures that scoring needs."""

    def __init__(self, segments: DataFrame, bits: int, settings: Settings):
        self.segments, self.bits, self.settings = segments, bits, settings
        rows = segments.select("bucket", "types", "tokens", "levels", "size").collect()  # a row a bucket, without its segment
        self.types, self.tokens = sum(r.types for r in rows), sum(r.tokens for r in rows)
        self.levels = max([0, *(r.levels for r in rows)])
        bound = settings.max_broadcast_mb or max(16, megabytes(segments.sparkSession.conf.get("spark.driver.memory", "1g")) // 6)
        self.passes: list[list[int]] = [[]]
        held = 0
        for r in sorted(rows, key=lambda r: r.bucket):
            if self.passes[-1] and held + r.size > bound << 20:
                self.passes.append([])
                held = 0
            self.passes[-1].append(r.bucket)
            held += r.size
        self.smoothing = GRID[len(GRID) // 2]
        self.texts = 0

    def _part(self, number: int) -> Part:
        """The segments of a pass; the first also answers for buckets without any."""
        owner = np.zeros(1 << self.bits, np.int64)
        for i, buckets in enumerate(self.passes):
            owner[buckets] = i
        buckets = sorted(self.passes[number])
        start, length = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, _U)
        whole = {"keys": bytearray(), "cells": bytearray()}
        counted = []
        for i in range(0, len(buckets), 8):  # a few at a time, so that the driver holds one copy
            rows = self.segments.filter(F.col("bucket").isin(buckets[i : i + 8])).select("bucket", "counts", *whole).collect()
            for r in sorted(rows, key=lambda r: r.bucket):
                start[r.bucket], length[r.bucket] = len(whole["cells"]) // 8, len(r.cells) // 8
                counted.append(np.frombuffer(r.counts, "<u4" if len(r.counts) * 2 == len(r["keys"]) else "<u8"))
                for column, held in whole.items():
                    held += r[column]
        keys, cells = (np.frombuffer(whole[c], _U) for c in whole)
        counts = np.concatenate(counted) if counted else np.zeros(0, np.uint32)  # 4 bytes a count where all fit
        return Part(self.bits, owner == number, keys, counts, cells, start, length, self.levels, self.settings.probes)

    def _read(self, texts: DataFrame, columns: list[str], finish: Callable, schema: str) -> DataFrame:
        """``finish`` applied to each batch with what the model has of its texts: bounds, known, base, levels by order."""
        settings, sc = self.settings, texts.sparkSession.sparkContext
        low, types, tokens = 0.1, self.types, self.tokens

        def looked_up(part: Part, column: pa.Array):
            items, text, bounds = _sequences(column)
            counts = part.unigrams(items)
            own = part.owned[(items >> _U(64 - part.bits)).astype(np.int64)]
            own[bounds[:-1]] = False  # a begin is no token
            levels = [np.where(counts > 0, quantised(np.maximum(counts, 1), settings.unigram_base), 0).astype(np.uint8)]
            levels += [part.grams(*_grams(items, text, k)) for k in range(2, settings.order + 1)]
            log = np.where(own, np.log10((counts + low) / (tokens + low * (types + 1))), 0.0) if types else np.zeros(len(items))
            sums = lambda a: np.add.reduceat(a, bounds[:-1]) if len(bounds) > 1 else a[:0]
            return bounds, sums((own & (counts > 0)).astype(np.int64)), sums(log), levels

        # Each hash is in one pass, so sums over passes are whole. A pass but the last writes its texts with what it has found in the shared
        # folder, which the next one reads: nothing is shuffled, and each task holds the segments of one pass.
        names = [f"_l{k}" for k in range(1, settings.order + 1)]
        held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", _known long, _base double" + "".join(f", {c} binary" for c in names)
        rows, last, given = texts, len(self.passes) - 1, texts.columns
        for number in range(len(self.passes)):
            shared = sc.broadcast(self._part(number))

            def read(batches, shared=shared, number=number):
                for whole in batches:
                    for batch in slices(whole, "text", 1 << 20):
                        bounds, known, base, levels = looked_up(shared.value, batch.column("text"))
                        if number:
                            known, base = known + batch.column("_known").to_numpy(zero_copy_only=False), base + batch.column("_base").to_numpy(zero_copy_only=False)
                            levels = [a + np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for a, c in zip(levels, names, strict=True)]
                        if number == last:
                            yield finish(batch, bounds, known, base, levels)
                            continue
                        cut = lambda a: [a[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), pa.array(known, pa.int64()), pa.array(base, pa.float64()), *(pa.array(cut(a), pa.binary()) for a in levels)], [*given, "_known", "_base", *names])

            if number == last:
                return rows.mapInArrow(read, schema)
            before, rows = rows, materialize(rows.mapInArrow(read, held), "lm-pass")
            shared.unpersist()
            if number:
                discard(before)

    def _log_probabilities(self) -> Callable:
        """log10 of each item's probability, and which items are tokens; ``less`` 1 leaves the item itself out."""
        s, low, types, tokens, top, texts = self.settings, 0.1, self.types, self.tokens, self.levels, self.texts
        ones, values = level_counts(255, s.unigram_base), level_counts(top, s.log_base)

        def compute(bounds, levels, less: int = 0):
            token = np.ones(len(levels[0]), bool)
            token[bounds[:-1]] = False
            c1 = ones[levels[0]]
            p = (np.maximum(c1 - less, 0) + low) / (tokens + low * (types + 1)) if types else np.full(len(c1), 1.0)
            seen = [np.concatenate([[0.0], c1[:-1]])[: len(c1)]]
            seen[0][bounds[:-1] + 1] = texts  # every training text has one begin
            seen += [np.concatenate([[0.0], values[level][:-1]])[: len(level)] for level in levels[1:-1]]
            parts = []
            for level, history in zip(levels[1:], seen, strict=True):
                c = np.maximum(values[level] - less, 0)
                parts.append((c, np.maximum(np.maximum(history - less, 0), c)))
            for k in GRID:
                q = p
                for c, history in parts:
                    q = (c + k * q) / (history + k)
                yield np.where(token, np.log10(q), 0.0)

        return compute

    def score(self, texts: DataFrame, columns: list[str], training: Column) -> DataFrame:
        """``columns`` of each row (numbers or strings) with n_tokens, n_known, train_tokens, base_score, score.

        The rows for which ``training`` holds choose the smoothing; equal texts, which copies predict anyway, count once.
        """
        compute, tokens = self._log_probabilities(), self.tokens
        grid = [f"{x}{i}" for x in "st" for i in range(len(GRID))]

        def finish(batch, bounds, known, base, levels):
            sums = [np.add.reduceat(p, bounds[:-1]) if len(bounds) > 1 else np.zeros(0) for less in (0, 1) for p in compute(bounds, levels, less)]
            return pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in (*columns, "_of", "_digest")), pa.array(np.diff(bounds) - 1, pa.int64()),
                pa.array(known, pa.int64()), pa.array(np.full(len(bounds) - 1, tokens), pa.int64()),
                pa.array(base, pa.float64()), *(pa.array(x, pa.float64()) for x in sums),
            ], [*columns, "_of", "_digest", "n_tokens", "n_known", "train_tokens", "base_score", *grid])

        # Two independent hashes stand for a text where equal ones are counted once.
        digest = F.concat_ws(" ", F.xxhash64("text"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
        chosen = texts.select(*columns, training.alias("_of"), digest.alias("_digest"), "text")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
        kinds += ", n_tokens long, n_known long, train_tokens long, base_score double, " + ", ".join(f"{c} double" for c in grid)
        read = materialize(self._read(chosen, [*columns, "_of", "_digest"], finish, kinds), "lm-scores")
        each = read.filter("_of").groupBy("_digest").agg(*(F.first(c).alias(c) for c in grid[len(GRID) :]))
        total = each.agg(*(F.sum(c) for c in grid[len(GRID) :])).first()
        if total[0] is not None:
            self.smoothing = GRID[max(range(len(GRID)), key=lambda i: (total[i], -i))]
        return read.select(*columns, "n_tokens", "n_known", "train_tokens", "base_score", F.col(f"s{GRID.index(self.smoothing)}").alias("score"))


def fit(training: DataFrame, settings: Settings = Settings()) -> BloomModel:
    """Count the n-grams of ``training.text`` (null: empty) and build the filter. An empty table gives an empty model."""
    training = training.select("text")
    figures = training.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    order, bits = settings.order, bits_for((figures.b or 0) / 6 * settings.order, 2_000_000)

    def hashes(whole):
        for batch in slices(whole, "text"):
            items, text, bounds = _sequences(batch.column("text"))
            token = np.ones(len(items), bool)
            token[bounds[:-1]] = False
            yield 1, items[token]
            for k in range(2, order + 1):
                grams, ok = _grams(items, text, k)
                yield k, grams[ok]

    counted = runs(training, hashes, bits)
    segments = materialize(counted.groupBy("bucket").applyInPandas(_segment(settings), SEGMENT), "lm-segments")
    model = BloomModel(segments, bits, settings)
    model.texts = figures.n
    return model


def held_out(column: str = "doc_id", modulus: int = 10, rest: int = 0) -> Column:
    """Whether crc32 of the id as text has this remainder (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Score every row's whole ``text`` with a model of the rows that are not held out.

    Nulls: a null text is empty (one end token); a null id counts as the empty text for the split and
    is returned. Repeated rows count as often as they occur. An empty table gives an empty result.
    Further columns are ignored.
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out())
    return fit(docs.filter(~F.col("held_out")), settings).score(docs, ["doc_id", "held_out"], ~F.col("held_out"))
