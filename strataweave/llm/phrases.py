"""Phrases that score as collocations, by language (operator 13).

Two passes. The first summarises all runs of one to four words: tasks count their hashes, cut them by leading bits into hash partitions, and each
partition merges its tasks' counts into one Misra-Gries summary whose capacity exceeds the partition's mass divided by the threshold, so that
every frequent run survives (Misra and Gries 1982; Agarwal et al., "Mergeable Summaries"). The survivors make a Bloom filter of bounded
size; the second pass counts exactly, by their words, the runs that it lets through, and what is below the threshold goes. False survivors thereby cost
time alone. Scores, cuts and containment are DataFrame expressions over the counted runs.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import tokens
from .tokens import mix, slices

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_SUM = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))  # a random value a byte, for a second look at a run
_SUM[65:91] = _SUM[97:123]


@dataclass(frozen=True)
class Settings:
    """longest: words of a phrase; least: occurrences of a candidate; scale: of the score; contained: per cent; top: phrases a language."""

    longest: int = 4
    least: int = 30
    scale: int = 2_000_000
    contained: int = 80
    top: int = 2000
    #: Occurrences of runs that a hash partition holds on average.
    per_partition: int = 4_000_000
    #: Occurrences that a task sorts at once.
    flush: int = 6_000_000
    #: Phrases that a task holds with their counts.
    held: int = 1_000_000
    #: Bound of the broadcast filter; beyond about 24 bits a survivor it only lets more runs through to the exact count.
    filter_mb: int = 32


class Runs(NamedTuple):
    """The words of some texts: their bytes, and each word's start, end, hash, piece and text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    text: np.ndarray


def words(texts: pa.Array, seeds: np.ndarray) -> Runs:
    """Words ``[^\\x20\\x09]+`` of the pieces between ``.,;:!?`` and line ends; ``seeds``: the hash of each text's language."""
    data, offsets = tokens.utf8(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Runs(data, none, none, none.astype(_U), none, none)
    solid = ~_GAP[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    first[inner] = solid[inner]
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_BREAK[data])[starts] + text  # both only rise, so that equal sums are one piece of one text
    with np.errstate(over="ignore"):
        hashes = mix(tokens._hash_spans(data, starts, ends) + seeds[text])
    return Runs(data, starts, ends, hashes, piece, text)


def runs_of(found: Runs, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, hashes, index of the first word) of all runs inside pieces."""
    hashes = found.hashes
    for n in range(1, longest + 1):
        if n > 1:
            if len(hashes) < 2:
                return
            with np.errstate(over="ignore"):
                hashes = mix(hashes[:-1] * _STEP + found.hashes[n - 1 :])
        inside = np.flatnonzero(found.piece[n - 1 :] == found.piece[: len(hashes)])
        yield n, hashes[inside], inside


_SEEDS: dict[str, np.uint64] = {}


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    names = pc.fill_null(column.cast(pa.string()), "und").to_pylist()
    for name in set(names) - _SEEDS.keys():
        _SEEDS[name] = _U(int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
    return names, np.array([_SEEDS[n] for n in names], _U)


def summaries(docs: DataFrame, bits: int, s: Settings) -> DataFrame:
    """(bucket, mass, keys, counts): each task's counts by hash partition.

    A key is 32 bits below the partition's, and counts stop at 255: both only leave further survivors, as long as ``least`` is smaller.
    """

    def flush(held: list[np.ndarray]):
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        keys >>= _U(32 - bits)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.minimum(np.diff(first, append=len(keys)), 255).astype(np.uint8)
        keys = keys[first]
        cuts = np.searchsorted(keys >> _U(32), np.arange((1 << bits) + 1, dtype=_U))
        keys = keys.astype(np.uint32)
        full = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_arrays([
            pa.array(full, pa.int32()), pa.array([int(counts[cuts[b] : cuts[b + 1]].sum(dtype=np.int64)) for b in full], pa.int64()),
            pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()), pa.array([counts[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
        ], ["bucket", "mass", "keys", "counts"])

    def task(batches):
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                _, seeds = _languages(batch.column("lang"))
                for _, hashes, _ in runs_of(words(batch.column("text"), seeds), s.longest):
                    held.append(hashes)
                    size += len(hashes)
                if size >= s.flush:
                    yield from flush(held)
                    size = 0
        if size:
            yield from flush(held)

    return docs.select("text", "lang").mapInArrow(task, "bucket int, mass long, keys binary, counts binary")


def merge(keys: np.ndarray, counts: np.ndarray, more_keys: np.ndarray, more_counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Two Misra-Gries summaries as one with at most ``capacity`` entries, and what was taken off its counts; keys ascend.

    Beyond the capacity the largest count that does not fit is taken off every entry, so each count falls short by at most mass / (capacity + 1)
    over all merges together.
    """
    both = np.concatenate([keys, more_keys])
    order = np.argsort(both, kind="stable")
    both, sums = both[order], np.concatenate([counts, more_counts])[order]
    if not len(both):
        return both, sums, 0
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    both, sums = both[first], np.add.reduceat(sums, first)
    if len(both) <= capacity:
        return both, sums, 0
    off = int(np.partition(sums, len(sums) - capacity - 1)[len(sums) - capacity - 1])
    left = sums > off
    return both[left], sums[left] - off, off


def survivors(parts: DataFrame, s: Settings) -> DataFrame:
    """(bucket, keys, n) of each hash partition: the keys of its merged summary whose counts, with all that was taken off, can reach ``least``."""

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        capacity = int(group["mass"].sum()) // s.least + 1
        keys, counts, short, waiting, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0, [], 0

        def take():
            more = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in waiting])
            number = np.concatenate([np.frombuffer(c, np.uint8) for _, c in waiting]).astype(np.int64)
            return merge(keys, counts, more, number, capacity)

        for row in zip(group["keys"], group["counts"], strict=True):
            waiting.append(row)
            size += len(row[1])
            if size >= s.per_partition:
                keys, counts, off = take()
                short, waiting, size = short + off, [], 0
        if waiting:
            keys, counts, off = take()
            short += off
        keys = keys[counts + short >= s.least]
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "keys": [keys.tobytes()], "n": [len(keys)]})

    return parts.groupBy("bucket").applyInPandas(merged, "bucket int, keys binary, n long")


def _places(codes: np.ndarray, bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and the four bits in it, for keys of ``bits`` + 32 bits; a hash partition has words of its own."""
    places = mix(codes + _U(1))
    masks = np.zeros(len(codes), _U)
    for k in range(4):
        masks |= _U(1) << ((places >> _U(6 * k)) & _U(63))
    return (codes >> _U(bits + 32 - size)).astype(np.int64), masks


def bloom(kept: DataFrame, bits: int, s: Settings) -> np.ndarray:
    """The survivors' filter: 2**size words of 64 bits, made a hash partition at a time, at most ``filter_mb``."""
    entries = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    most = (s.filter_mb << 20) // 8
    size = max(bits, min(int(np.ceil(np.log2(max(entries, 1) * 24 / 64 + 1))), int(np.log2(most))))

    def task(batches):
        for batch in batches:
            for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                codes = (_U(bucket) << _U(32)) | np.frombuffer(keys, np.uint32).astype(_U)
                at, masks = _places(codes, bits, size)
                own = np.zeros(1 << (size - bits), _U)
                np.bitwise_or.at(own, at - (bucket << (size - bits)), masks)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["bucket", "own"])

    out = np.zeros(1 << size, _U)
    for r in kept.select("bucket", "keys").mapInArrow(task, "bucket int, own binary").toLocalIterator():  # 2**size words in all
        out[r.bucket << (size - bits) : (r.bucket + 1) << (size - bits)] = np.frombuffer(r.own, _U)
    return out


_NAMES = ("lang", "order", "phrase", "f")
_KINDS = (pa.string(), pa.int32(), pa.string(), pa.int64())


class Counts:
    """Exact counts of the runs of one task, told apart by their words."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys, self.looks = np.zeros(0, _U), np.zeros(0, _U)
        self.counts, self.index = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.names: list[pa.RecordBatch] = []
        self.named = 0
        self.odd: Counter = Counter()

    def __len__(self) -> int:
        return self.named + len(self.odd)

    def add(self, hashes: np.ndarray, looks: np.ndarray, name) -> None:
        """Count hashes; ``looks``: a second value a run, ``name``: (language, words, phrase) of the run at a place."""
        keys, first, which, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, keys)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        expected = looks[first]
        expected[known] = self.looks[at[known]]
        other = np.flatnonzero(looks != expected[which])  # other white space between the words, or another phrase with this hash
        self.odd.update((int(hashes[i] >> _U(64 - self.bits)), *name(i)) for i in other.tolist())
        counts = counts - np.bincount(which[other], minlength=len(keys))
        self.counts[at[known]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            index = self.named + np.arange(len(new))
            self.names.append(pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*[name(i) for i in first[new].tolist()]), _KINDS)], _NAMES[:3]))
            self.named += len(new)
            put = at[new]
            self.keys, self.looks = np.insert(self.keys, put, keys[new]), np.insert(self.looks, put, expected[new])
            self.counts, self.index = np.insert(self.counts, put, counts[new]), np.insert(self.index, put, index)

    def parts(self) -> Iterator[pa.RecordBatch]:
        """(bucket, part): the counts of each hash partition as one compressed Arrow table."""
        if self.named:
            table = pa.Table.from_batches(self.names).take(pa.array(self.index)).append_column("f", pa.array(self.counts))
            cuts = np.searchsorted(self.keys >> _U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=_U)).tolist()
            yield from (_part(bucket, table.slice(i, j - i)) for bucket, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j)
        if self.odd:
            odd: dict[int, list] = {}
            for (bucket, *name), f in self.odd.items():
                odd.setdefault(bucket, []).append((*name, f))
            for bucket, rows in odd.items():
                yield _part(bucket, pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _KINDS, strict=True)], _NAMES))


def _part(bucket: int, table: pa.Table) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "part"])


def count(docs: DataFrame, passes: np.ndarray, bits: int, s: Settings) -> DataFrame:
    """(lang, order, phrase, f): exact counts of all frequent runs, and of all words of a language as order 0.

    Counts travel by hash partition as compressed tables, a few rows a task, and are summed by their words in the partition.
    """
    size = int(np.log2(len(passes)))
    shared = docs.sparkSession.sparkContext.broadcast(passes)
    least = s.least

    def task(batches):
        held, totals = Counts(bits), Counter()
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                names, seeds = _languages(batch.column("lang"))
                found = words(batch.column("text"), seeds)
                for t, number in zip(*np.unique(found.text, return_counts=True), strict=True):
                    totals[names[t]] += int(number)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([[_U(0)], np.cumsum(_SUM[found.data])])
                raw = found.data.tobytes()
                for n, hashes, at in runs_of(found, s.longest):
                    place, masks = _places(hashes >> _U(32 - bits), bits, size)
                    ok = np.flatnonzero(shared.value[place] & masks == masks)
                    if not len(ok):
                        continue
                    at = at[ok]
                    with np.errstate(over="ignore"):
                        looks = sums[found.ends[at + n - 1]] - sums[found.starts[at]]

                    def name(i, at=at, n=n):
                        w = at[i]
                        phrase = b" ".join(raw[found.starts[j] : found.ends[j]] for j in range(w, w + n)).lower()
                        return names[found.text[w]], n, phrase.decode("utf-8", "replace")

                    held.add(hashes[ok], looks, name)
                if len(held) >= s.held:
                    yield from held.parts()
                    held = Counts(bits)
        for lang, number in totals.items():
            held.odd[0, lang, 0, ""] += number
        yield from held.parts()

    def summed(group):
        tables = [pa.ipc.open_stream(part.as_buffer()).read_all() for part in group.column("part")]
        table = pa.concat_tables(tables).group_by(list(_NAMES[:3])).aggregate([("f", "sum")]).rename_columns(list(_NAMES))
        return table.filter(pc.or_(pc.equal(table["order"], 0), pc.greater_equal(table["f"], least)))

    parts = docs.select("text", "lang").mapInArrow(task, "bucket int, part binary")
    return parts.groupBy("bucket").applyInArrow(summed, "lang string, order int, phrase string, f long")


def scored(counts: DataFrame, s: Settings) -> DataFrame:
    """(lang, phrase, order, a, l, r, score) of all candidates, by their lowest cut."""
    phrases = counts.filter("order > 0")
    own = phrases.filter("order > 1").select("lang", "phrase", "order", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = own.select("lang", "phrase", "order", "a", "words", F.explode(F.sequence(F.lit(1), F.col("order") - 1)).alias("k"))
    ends = F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("part")),
        F.struct(F.lit("r").alias("side"), F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.col("order") - F.col("k"))).alias("part")),
    )).alias("end")
    parts = cuts.select("lang", "phrase", "order", "a", "k", ends).select("lang", "phrase", "order", "a", "k", "end.side", "end.part")
    joined = parts.join(phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    pick = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    wide = joined.groupBy("lang", "phrase", "order", "a").agg(*[pick(k, side) for k in range(1, s.longest) for side in "lr"])
    score = lambda k: F.expr(f"({s.scale} * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    options = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, s.longest)]
    best = F.array_min(F.array_compact(F.array(*options)))
    return wide.select("lang", "phrase", "order", "a", best.alias("best")).select("lang", "phrase", "order", "a", "best.l", "best.r", "best.score")


def contained(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer candidate that the phrase lies in."""
    longer = counts.filter("order > 2").select("lang", "f", "order", F.split("phrase", " ").alias("words"))
    inner = F.expr("explode(flatten(transform(sequence(2, order - 1), m -> transform(sequence(1, order - m + 1), i -> array_join(slice(words, i, m), ' ')))))")
    return longer.select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Each language's best phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Null texts are empty, a null language is ``und``; repeated rows count as often as they occur; texts of any length are read whole. Ties go to the
    larger count, then to the smaller phrase in the order of its UTF-8 bytes, so no two phrases share a rank. A language without candidates has no row; an empty table gives an
    empty result. Further columns are ignored, whatever their names. One language may hold all rows: counts are summed
    in tasks first, and only a task's best ``top`` meet in the language's ranking.
    """
    if s.least > 255:
        raise ValueError("least is at most 255: counts of the first pass stop there")
    docs = docs.select("text", "lang")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    bits = int(min(20, max(3, np.ceil(np.log2(max(size, 1) / 6 * s.longest / s.per_partition)))))
    kept = materialize(survivors(summaries(docs, bits, s), s), "phrase-survivors")
    counts = materialize(count(docs, bloom(kept, bits, s), bits, s), "phrase-counts")
    found = scored(counts, s).join(contained(counts), ["lang", "phrase"], "left")
    free = found.filter("longer is null or 100 * cast(longer as decimal(20,0)) < %d * cast(a as decimal(20,0))" % s.contained)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.top)
    totals = counts.filter("order = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang
), places AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (VALUES (1), (2), (3), (4)) AS sizes(m)
), counts AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 30
), own AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1
), cuts AS (
  SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM own
), rated AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS score FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
), lowest AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_sizes AS (
  SELECT lang, m, a, w, unnest(range(2, m)) AS k FROM own WHERE m > 2
), inner_places AS (
  SELECT lang, m, a, w, k, unnest(range(1, m - k + 2)) AS i FROM inner_sizes
), longer AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longest FROM inner_places GROUP BY ALL
), ranked AS (
  SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY o.score DESC, o.a DESC, o.phrase) AS rank, o.phrase, o.a, o.l, o.r, o.score
  FROM lowest o LEFT JOIN longer g ON g.lang = o.lang AND g.phrase = o.phrase WHERE g.longest IS NULL OR 100 * g.longest::HUGEINT < 80 * o.a::HUGEINT
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n::BIGINT AS n, k.score::BIGINT AS score FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000
"""
