"""Mixture-controlled packing into windows of tokens (operator 6).

Documents are tokenized and queued by source. Deficit round-robin serves the queues: in every round a
queue earns a quantum, its share of a window, and sends the whole tokens it has earned; what is
left of a token stays as its deficit. Rounds follow each other without a gap and are cut into windows, so that every
window but the last is full and holds the target proportions to within a token or so a queue.

The tokens that a queue has sent before a round have a closed form, so no state runs along the data: a
document's place follows from its place in its queue, which is a prefix sum over tasks of small
(task, queue) totals. Deficits thereby carry over windows and partitions alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import slices

WINDOW = 2048
END = 1
#: The added token of the public vocabulary.
ADDED, ADDED_ID = "<|endoftext|>", 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sources with a queue of their own; where there are more, the others share ``SHARED`` queues by hash.
OWN = 1024
SHARED = 1024
#: Rounds times queues that a task works on at once.
_CELLS = 4_000_000


class Encoder:
    """Byte-level BPE of a public vocabulary; ids as little-endian bytes.

    Texts are encoded whole. The vocabulary's one added token is its id wherever its string stands, as the tokenizer's own defaults have it.
    """

    def __init__(self, vocabulary: str):
        import base64

        import tiktoken

        if "/" not in vocabulary:
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        if vocabulary.endswith(".json"):  # the same vocabulary as ranks lies beside it
            vocabulary = vocabulary.removesuffix(".json") + ".tiktoken"
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if ADDED in text:
            return np.array([ADDED_ID], "<u2").tobytes().join(map(self._plain, text.split(ADDED)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


@dataclass
class Schedule:
    """How many tokens each queue has sent before a round.

    totals: tokens a queue; weights: target proportions. While all queues last, queue s earns
    window * weight_s / sum(weights) a round; when a queue is empty the others share by their weights, and queues without a weight share
    by their totals when all others are empty. All queues of weight w have then sent w * v tokens, or all that they hold, where v depends on
    the round alone, so what is kept is one curve and not a table of rates.
    """

    totals: np.ndarray
    weights: np.ndarray
    window: int = WINDOW

    def __post_init__(self):
        some = self.totals > 0
        served, idle = some & (self.weights > 0), some & ~(self.weights > 0)
        self.own = np.where(served, self.weights, 0.0)
        self.late = np.where(idle, self.totals, 0).astype(float)
        order = np.argsort(self.totals[served] / self.own[served], kind="stable")
        weight, total = self.own[served][order], self.totals[served][order].astype(float)
        ends, live = total / weight, np.cumsum(weight[::-1])[::-1]
        self.curve = np.concatenate([[0.0], ends])
        self.times = np.concatenate([[0.0], np.cumsum(np.diff(self.curve) * live) / self.window])
        self.served = self.times[-1]
        self.last = self.served + self.late.sum() / self.window
        self.rounds = int(np.ceil(self.last)) + 1
        # Where all queues end together and the largest earns enough, it also sends what the others' deficits
        # leave of a window, so that rounds and windows coincide.
        together = len(ends) > 0 and not idle.any() and ends[-1] <= ends[0] * (1 + 1e-12)
        largest = int(self.totals.argmax()) if len(self.totals) else 0
        self.filler = largest if together and self.window * self.own[largest] / live[0] >= len(self.totals) else None

    def _sent(self, rounds: np.ndarray, own: np.ndarray, late: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Whole tokens without what the filler adds; rounds and queues broadcast against each other."""
        done = np.clip((rounds - self.served) / max(self.last - self.served, 1e-300), 0.0, 1.0)
        out = np.floor(np.interp(rounds, self.times, self.curve) * own + done * late + 1e-9).astype(np.int64)
        return np.where(rounds >= self.rounds, totals, np.minimum(out, totals))

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue before each round: one row a round."""
        out = self._sent(rounds[:, None], self.own, self.late, self.totals)
        if self.filler is not None:
            most = self.totals[self.filler]
            filled = np.minimum(rounds * self.window - out.sum(axis=1) + out[:, self.filler], most)
            out[:, self.filler] = np.where(rounds >= self.rounds, most, filled)
        return out

    def _sent_of(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens of one queue before one round each; the filler alone needs the other queues."""
        out = self._sent(rounds, self.own[queue], self.late[queue], self.totals[queue])
        filler = np.flatnonzero(queue == self.filler) if self.filler is not None else ()
        if len(filler):
            needed, at = np.unique(rounds[filler], return_inverse=True)
            rows = max(1, _CELLS // len(self.totals))
            out[filler] = np.concatenate([self.sent(needed[i : i + rows])[:, self.filler] for i in range(0, len(needed), rows)])[at]
        return out

    def round_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The round that sends the token at this place of the queue, by bisection."""
        low, high = np.zeros(len(place), np.int64), np.full(len(place), self.rounds, np.int64)
        while (high - low > 1).any():
            mid = (low + high) // 2
            sent = self._sent_of(queue, mid)
            low, high = np.where(sent <= place, mid, low), np.where(sent <= place, high, mid)
        return low


def tokenized(docs: DataFrame, vocabulary: str, queues: DataFrame) -> DataFrame:
    """Ids of each text with the end, its queue, its task and its place among the task's tokens of the queue.

    Written to the shared folder, so that tasks and places stay as they are.
    """
    shared = queues.count() + F.pmod(F.xxhash64("source"), F.lit(SHARED)).cast("int")
    known = docs.join(F.broadcast(queues), docs["source"].eqNullSafe(queues["queue_source"]), "left")  # at most OWN rows, or one a given weight
    queued = known.select("doc_id", "text", F.coalesce("queue", shared).alias("queue"))

    def task(batches):
        encode, place, part = _encoder(vocabulary).encode, {}, TaskContext.get().partitionId()
        end = np.array([END], "<u2").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                starts, ids = [], []
                for queue, text in zip(batch.column("queue").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    got = encode(text or "") + end
                    starts.append(place.get(queue, 0))
                    place[queue] = starts[-1] + len(got) // 2
                    ids.append(got)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("queue"), pa.array(np.full(len(ids), part), pa.int32()),
                    pa.array(starts, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                ], ["doc_id", "queue", "part", "place", "doc_tokens", "ids"])

    return materialize(queued.mapInArrow(task, "doc_id long, queue int, part int, place long, doc_tokens long, ids binary"), "packing-ids")


def pack(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", weights: Mapping[str | None, float] | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """Pieces of documents in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``weights``: target proportions by source (missing: 0, served when the others are empty); by default each source's
    share of all tokens, so that all queues end together. Up to ``OWN`` sources are queues of their own. Of more, those that ``weights`` names are, or else those
    with the most bytes, and the others share ``SHARED`` queues by hash, each with the sum of their shares: such a source has less than two tokens a
    window. All windows are full but the last, which is to be padded. Null text: only
    the end token; null source: a source of its own; null ids and repeated rows are packed like any row. Texts of any length
    are cut at the ends of rounds and windows. An empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    names = {r.source for r in docs.select("source").distinct().limit(OWN + 1).collect()}
    more = SHARED if len(names) > OWN else 0
    if more and weights is not None:
        names = set(weights)
    elif more:
        sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n"))
        names = {r.source for r in sizes.orderBy(F.desc("n"), "source").limit(OWN).collect()}
    names = sorted(names, key=lambda s: (s is None, s or ""))
    queues = docs.sparkSession.createDataFrame(list(enumerate(names)), "queue int, queue_source string")
    ids = tokenized(docs, vocabulary, queues)
    parts = ids.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(parts.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))), "packing-bases")
    totals = np.zeros(len(names) + more, np.int64)
    for r in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # a row a queue
        totals[r.queue] = r.n
    shares = totals.astype(float) if weights is None else np.array([float(weights.get(s, 0)) for s in names] + [0.0] * more)
    schedule = Schedule(totals, shares, window)

    def task(batches):
        for whole in batches:
            for batch in slices(whole, "ids", 2 << 20):
                yield from _pieces(batch, schedule)

    joined = ids.join(bases.drop("n"), ["queue", "part"])
    joined = joined.select("doc_id", "queue", (F.col("base") + F.col("place")).alias("place"), "doc_tokens", "ids")
    return joined.mapInArrow(task, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def _pieces(batch: pa.RecordBatch, schedule: Schedule):
    """Cut documents at the ends of rounds and windows."""
    queue, place, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("queue", "place", "doc_tokens"))
    if not len(queue):
        return
    first, last = schedule.round_of(queue, place), schedule.round_of(queue, place + n - 1)
    count = last - first + 1
    limit = max(1, _CELLS // len(schedule.totals))
    if len(queue) > 1 and count.sum() > limit:  # many queues or rounds: fewer documents at a time
        half = len(queue) // 2
        yield from _pieces(batch.slice(0, half), schedule)
        yield from _pieces(batch.slice(half), schedule)
        return
    doc = np.repeat(np.arange(len(queue)), count)
    rounds = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    needed, at = np.unique(np.concatenate([rounds, rounds + 1]), return_inverse=True)
    sent = schedule.sent(needed)
    now, then = sent[at[: len(rounds)]], sent[at[len(rounds) :]]
    q, k = queue[doc], np.arange(len(doc))
    turn = np.cumsum(then - now, axis=1) - (then - now)
    a, b = np.maximum(place[doc], now[k, q]), np.minimum((place + n)[doc], then[k, q])
    spot = now.sum(axis=1) + turn[k, q] + a - now[k, q]
    start, length, window = a - place[doc], b - a, schedule.window
    keep = length > 0
    doc, spot, start, length = doc[keep], spot[keep], start[keep], length[keep]
    cuts = (spot + length - 1) // window - spot // window + 1
    again = np.repeat(np.arange(len(doc)), cuts)
    j = np.arange(len(again)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    low = np.maximum(spot[again], (spot[again] // window + j) * window)
    high = np.minimum((spot + length)[again], (spot[again] // window + j + 1) * window)
    doc, start, length, spot = doc[again], start[again] + low - spot[again], high - low, low
    texts = batch.column("ids").to_pylist()
    ids, sums = [], []
    for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
        part = np.frombuffer(texts[d], "<u2", m, 2 * s).astype("<u4").tobytes()
        ids.append(part)
        sums.append(zlib.crc32(part))
    yield pa.RecordBatch.from_arrays([
        batch.column("doc_id").take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()),
        batch.column("doc_tokens").take(pa.array(doc)), pa.array(spot // window, pa.int64()), pa.array(spot % window, pa.int64()), pa.array(ids, pa.binary()),
    ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 50256) -> DataFrame:
    """Whole windows: sequence_id, ids (array of ``window`` ids, padded), doc_ids (of its pieces, in order).

    A group is one window, so it is bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))

    def task(batches):
        for batch in batches:
            rows = [b"".join(p["ids"] for p in row) for row in batch.column("pieces").to_pylist()]
            arrays = [np.concatenate([x := np.frombuffer(r, "<u4").astype(np.int32), np.full(window - len(x), pad, np.int32)]) for r in rows]
            ids = [[p["doc_id"] for p in row] for row in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(arrays, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))], ["sequence_id", "ids", "doc_ids"])

    return pieces.groupBy("sequence_id").agg(ordered.alias("pieces")).mapInArrow(task, "sequence_id long, ids array<int>, doc_ids array<long>")
