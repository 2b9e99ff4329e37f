"""Quality classifier: a generalised additive model with pairwise interactions (operator 10).

Text statistics are cut into bins; cyclic boosting of shallow trees, one feature after another and
then one chosen pair of features after another, accumulates a lookup table a feature and a pair.
A score is the logistic function of a sum of table entries. Tables are fitted by numpy on a bounded sample of
labelled rows; the statistics and scores of all rows are computed in Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lm_bloom import held_out
from .tokens import ngrams, slices, utf8, words

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "exclaim", "bars", "stops", "commas", "lines",
    "other_ascii", "beyond_ascii", "distinct_words", "distinct_triples", "top_word", "words_a_line",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789",
    "marks": b"#$%&*@~^=+", "exclaim": b"!?", "bars": b"|\\/<>{}[]_", "stops": b".;:", "commas": b",", "lines": b"\n",
}
_CLASS = np.zeros((256, len(_CLASSES) + 2))
for _k, _chars in enumerate(_CLASSES.values()):
    _CLASS[list(_chars), _k] = 1
_CLASS[128:, -1] = 1
_CLASS[33:127, -2] = 1 - _CLASS[33:127, : len(_CLASSES)].sum(axis=1)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES a text, all of them of the whole text; zeros for an empty or null one."""
    data, offsets = utf8(column)
    w = words(column)
    n = len(offsets) - 1
    counts, repeats = np.zeros((n, _CLASS.shape[1])), np.zeros((n, 3))
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        if a == b:
            continue
        for c in range(a, b, 1 << 22):
            counts[i] += np.bincount(data[c : min(b, c + (1 << 22))], minlength=256) @ _CLASS
        own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
        if len(own):
            _, times = np.unique(own, return_counts=True)
            triples = ngrams(own, 3)
            repeats[i] = len(times) / len(own), len(np.unique(triples)) / len(triples) if len(triples) else 1, times.max() / len(own)
    size, n_words = np.diff(offsets), np.diff(w.bounds)
    by = dict(zip([*_CLASSES, "other_ascii", "beyond_ascii"], counts.T, strict=True))
    a_word = lambda x: x / np.maximum(n_words, 1)
    letters = np.maximum(by["upper"] + by["lower"], 1)
    out = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n_words), "word_length": a_word(size - by["lines"]), "upper": by["upper"] / letters,
        "distinct_words": repeats[:, 0], "distinct_triples": repeats[:, 1], "top_word": repeats[:, 2], "words_a_line": np.log1p(n_words / (by["lines"] + 1)),
        "beyond_ascii": by["beyond_ascii"] / np.maximum(size, 1),
    } | {k: a_word(by[k]) for k in ("digits", "marks", "exclaim", "bars", "stops", "commas", "lines", "other_ascii")}
    return np.column_stack([out[k] for k in FEATURES])


@dataclass(frozen=True)
class Settings:
    max_training_rows: int = 20000
    bins: int = 64
    pair_bins: int = 12
    pairs: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    leaf_weight: float = 2.0
    ridge: float = 1.0


@dataclass
class Model:
    """Lookup tables: bin edges and values a feature, and the same on coarser edges a pair."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Vectorised bin additions."""
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _gains(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """Gain of a cut after each position of the last axis."""
    gl, hl = np.cumsum(g, axis=-1)[..., :-1], np.cumsum(h, axis=-1)[..., :-1]
    gt, ht = g.sum(axis=-1, keepdims=True), h.sum(axis=-1, keepdims=True)
    gain = gl**2 / (hl + s.ridge) + (gt - gl) ** 2 / (ht - hl + s.ridge) - gt**2 / (ht + s.ridge)
    return np.where((hl >= s.leaf_weight) & (ht - hl >= s.leaf_weight), gain, -1.0)


def _tree(g: np.ndarray, h: np.ndarray, s: Settings, depth: int) -> np.ndarray:
    """Leaf value a bin of a tree of this depth over the axes of the gradient histogram."""
    if depth:
        best = None
        for axis in range(g.ndim):
            if g.shape[axis] < 2:
                continue
            others = tuple(k for k in range(g.ndim) if k != axis)
            gain = _gains(g.sum(axis=others), h.sum(axis=others), s)
            at = int(gain.argmax())
            if best is None or gain[at] > best[0]:
                best = (gain[at], axis, at + 1)
        if best and (best[0] > 1e-9 or g.ndim > 1 and best[0] > -1):
            (ga, gb), (ha, hb) = (np.split(v, [best[2]], axis=best[1]) for v in (g, h))
            return np.concatenate([_tree(ga, ha, s, depth - 1), _tree(gb, hb, s, depth - 1)], axis=best[1])
    return np.full(g.shape, -g.sum() / (h.sum() + s.ridge))


def fit_tables(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Model:
    """Cyclic boosting; without both labels the model is the smoothed share of label 1."""
    s = settings
    model = Model(bias=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if len(np.unique(y)) < 2:
        return model
    n_features = x.shape[1]
    model.edges, model.pair_edges = [_cuts(x[:, j], s.bins) for j in range(n_features)], [_cuts(x[:, j], s.pair_bins) for j in range(n_features)]
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.bias)

    def gradients():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    def histogram(index, shape):
        g, h = gradients()
        size = int(np.prod(shape))
        return np.bincount(index, g, size).reshape(shape), np.bincount(index, h, size).reshape(shape)

    for _ in range(s.rounds):
        for j in range(n_features):
            step = s.rate * _tree(*histogram(fine[j], (len(model.tables[j]),)), s, 2)
            model.tables[j] += step
            total += step[fine[j]]
    shapes = [len(e) + 1 for e in model.pair_edges]
    cell = lambda i, j: coarse[i] * shapes[j] + coarse[j]
    gain = {}
    for i, j in combinations(range(n_features), 2):
        g, h = histogram(cell(i, j), (shapes[i], shapes[j]))
        gain[i, j] = float((_tree(g, h, s, 3) ** 2 * h).sum())
    model.pairs = sorted(gain, key=lambda p: (-gain[p], p))[: s.pairs]
    model.pair_tables = [np.zeros((shapes[i], shapes[j])) for i, j in model.pairs]
    cells = [cell(i, j) for i, j in model.pairs]
    for _ in range(s.pair_rounds):
        for k, table in enumerate(model.pair_tables):
            step = s.rate * _tree(*histogram(cells[k], table.shape), s, 3)
            table += step
            total += step.ravel()[cells[k]]
    return model


def _with_features(docs: DataFrame) -> DataFrame:
    def task(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    return docs.select("doc_id", "label", "text").mapInArrow(task, "doc_id long, label double, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 3 is not 1, at most ``max_training_rows`` of them by hash order.

    Labels other than 0 and 1 are ignored; several labels of one id are averaged, and a tie counts as 1.
    """
    chosen = (
        labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out("doc_id", 3, 1))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_training_rows)
    )
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # bounded by the setting
    rows = _with_features(known).groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).select("r.*").collect()
    x, y = np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.label for r in rows])
    order = np.lexsort((y, *x.T))
    return fit_tables(x[order], y[order], settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) of each whole text; text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def task(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.append_column("score", pa.array(shared.value.scores(features(batch.column("text"))), pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(task, f"{kinds}, score double")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= 0.5).

    Null and empty texts get the score of zero features; null ids are scored and never learned
    from; repeated rows score alike. Without usable labels all scores are 0.5. Other columns pass through; a
    column that is named ``score`` or ``predicted`` is replaced.
    """
    docs = docs.drop("score", "predicted")
    return score(docs, fit(docs, labels, settings)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
