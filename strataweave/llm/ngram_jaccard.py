"""Exact Jaccard join on word shingles by size-aware heavy and light sets (operator 3).

After Deng, Tao and Li, "Overlap set similarity joins with theoretical guarantees". Two sets of sizes n
and m reach similarity t exactly if they share o(n, m) = ceil(t (n + m) / (1 + t)) elements. Light sets (up to a size)
enumerate their subsets of o(n, m) elements for every partner size m: a shared subset is a link, without
verification. Heavy sets scan inverted lists: with the elements in one global order, rare ones first, two
linked sets share an element among their first n - ceil(t n) + 1, so only those positions are listed. The
boundary is the size at which the summed cost of both ways is least for the sizes at hand.

Candidates are compared by their parity signatures first: the sets' shingles are counted modulo 2 in 512 places, and two
sets differ in at least as many shingles as their signatures do in places. Large sets have a second signature of 8192
places, read only for pairs that the first one leaves. What is left then is verified exactly, on the texts.

The result is each document's class: no pairs are expanded. Equal sets are one node from the start. If an element is the
first that two sets share, all before it in either set are differences, so the sum of its two places is at most the
difference that a link allows: members without such a partner leave a list, and pairs beyond it are not compared there.
Each list is compared with one hub first, the member with the fewest elements before the list's own (of a group of near copies, the
one with the fewest changes). Only members that are still in another component than their list's largest are compared on, with all
members of other components, so a group of n near copies costs about n verifications, and no link is lost.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .components import components
from .hash_counts import bits_for, merged, runs
from .tokens import mix, ngrams, slices, words

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    words: int = 3
    #: Similarity as a ratio of integers, so that no rounding decides a link.
    numerator: int = 90
    denominator: int = 100
    #: Texts whose shingles are counted to put frequent ones last; any order is exact, this one is fast.
    order_sample: int = 20000
    #: Cost of verifying an element of a heavy set, in units of a listed row.
    verify_cost: float = 1.0
    max_light: int = 64
    #: Nodes whose texts are fetched by a broadcast of their ids; more are fetched by a shuffle.
    broadcast_nodes: int = 1_000_000


def shared_least(n: int, m: int, s: Settings) -> int:
    """Least overlap of two linked sets of these sizes."""
    return -(-s.numerator * (n + m) // (s.numerator + s.denominator))


def partner_sizes(n: int, s: Settings) -> range:
    return range(-(-s.numerator * n // s.denominator), s.denominator * n // s.numerator + 1)


def prefix_length(n: int, s: Settings) -> int:
    return n - -(-s.numerator * n // s.denominator) + 1


def light_cost(n: int, s: Settings) -> int:
    """Subsets that a set of this size enumerates; equal sets are one node and need none."""
    return sum(comb(n, c) for m in partner_sizes(n, s) if (c := shared_least(n, m, s)) <= min(n, m) and not c == n == m)


def boundary(sizes: dict[int, int], s: Settings) -> int:
    """The largest light size, by summed cost over the numbers of sets of each size."""
    best = at = gain = 0
    for n in range(1, s.max_light + 1):
        gain += sizes.get(n, 0) * (light_cost(n, s) - prefix_length(n, s) - s.verify_cost * n)
        if gain < best or gain == best and light_cost(n, s) == 0:
            best, at = gain, n
    return at


def shingle_sets(column: pa.Array, n_words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; a text of fewer words is one shingle."""
    w = words(column)
    out = []
    for i in range(len(w.bounds) - 1):
        own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
        if 0 < len(own) < n_words:
            out.append(mix(ngrams(own, len(own)) + _U(len(own))))
        else:
            out.append(np.unique(ngrams(own, n_words)))
    return out


def _node(shingles: np.ndarray) -> int:
    """A 64-bit id of a set, from its whole content."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


PLACES, WIDE_PLACES, WIDE_FROM = 512, 8192, 700
SIGNATURE = [f"p{i}" for i in range(PLACES // 64)]


def _signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in each place, as 64-bit integers."""
    places = (mix(shingles + _U(0x51)) >> _U(64 - 9)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=PLACES).astype(np.uint8) & 1).view(np.int64)


def _wide(shingles: np.ndarray) -> bytes | None:
    """The same for large sets, as bytes."""
    if len(shingles) < WIDE_FROM:
        return None
    places = (mix(shingles + _U(0x77)) >> _U(64 - 13)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=WIDE_PLACES).astype(np.uint8) & 1).tobytes()


def _allowed(a: str, b: str, s: Settings) -> str:
    """SQL: how many shingles the sets of linked rows a and b may differ in."""
    total, both = f"({a}.n + {b}.n)", s.numerator + s.denominator
    return f"({total} - 2 * (({s.numerator} * {total} + {both - 1}) div {both}))"


def _may_link(a: str, b: str, s: Settings) -> str:
    """SQL: sizes, places in the list and signatures of the rows aliased a and b allow a link."""
    differ = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in SIGNATURE)
    fit = f"{s.denominator} * least({a}.n, {b}.n) >= {s.numerator} * greatest({a}.n, {b}.n)"
    return f"{fit} and {a}.place + {b}.place <= {_allowed(a, b, s)} and {differ} <= {_allowed(a, b, s)}"


def _subset_keys(shingles: np.ndarray, s: Settings):
    """(key, check, least, most size) for each enumerated subset; the key also tells the two sizes.

    Key and check are independent: a link is taken from 96 bits of agreement.
    """
    n = len(shingles)
    with np.errstate(over="ignore"):
        each = np.stack([mix(shingles * _U(3) + _U(1)), mix(shingles * _U(5) + _U(3))])
        whole = each.sum(axis=1, dtype=_U)[:, None]
        for m in partner_sizes(n, s):
            c = shared_least(n, m, s)
            if c > min(n, m) or c == n == m:
                continue
            left_out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
            keys = whole - each[:, left_out].sum(axis=2, dtype=_U)
            low, high = min(n, m), max(n, m)
            yield mix(keys[0] + _U(low * 1_000_003 + high)), (mix(keys[1]) >> _U(33)).astype(np.int32), low, high


def _order_hint(docs: DataFrame, count: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a bounded sample of texts, with their counts there."""
    share = max(1, -(-count // s.order_sample))
    sample = docs.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(share)) == 0)
    bits = bits_for(min(count, s.order_sample) * 800, 1_000_000, 2)

    def hashes(whole):
        for batch in slices(whole, "text"):
            sets = shingle_sets(batch.column("text"), s.words)
            if sets:
                yield 0, np.concatenate(sets)

    def frequent(group):
        import pandas as pd

        keys, counts = merged(group)
        keep = counts >= 3
        return pd.DataFrame({"keys": [keys[keep].tobytes()], "counts": [counts[keep].tobytes()]})

    rows = runs(sample, hashes, bits).groupBy("bucket").applyInPandas(frequent, "keys binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, _U), *(np.frombuffer(r["keys"], _U) for r in rows)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)])
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.uint32)


def _rare_first(shingles: np.ndarray, hint: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The first n shingles of the global order (frequency in the sample, then hash)."""
    keys, counts = hint
    if len(keys):
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        frequency = np.where(keys[at] == shingles, counts[at], 0)
        return shingles[np.argsort(frequency, kind="stable")[:n]]
    return shingles[:n]


def _verified(pairs: DataFrame, docs: DataFrame, described: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity; reads the texts of those nodes."""
    wide = described.filter("wide is not null").groupBy("node").agg(F.first("wide").alias("wide"), F.first("n_shingles").alias("n"))

    def narrow(batches):
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("wa", "wb", "na", "nb")), strict=True):
                differ = 0 if x is None or y is None else int(np.bitwise_count(np.frombuffer(x, _U) ^ np.frombuffer(y, _U)).sum())
                keep.append(n is None or m is None or differ <= n + m - 2 * shared_least(n, m, s))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    marked = pairs.join(wide.toDF("a", "wa", "na"), "a", "left").join(wide.toDF("b", "wb", "nb"), "b", "left").select("a", "b", "wa", "wb", "na", "nb")
    pairs = materialize(marked.mapInArrow(narrow, "a long, b long"), "nj-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(nodes.join(described.groupBy("node").agg(F.min("doc_id").alias("wanted_id")), "node"), "nj-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= s.broadcast_nodes else wanted

    def content(batches):  # an id may be on several rows: the row whose text has the node's set is kept
        for whole in batches:
            for batch in slices(whole, "text"):
                own = [_node(x) if len(x) else None for x in shingle_sets(batch.column("text"), s.words)]
                same = pa.array([x == y for x, y in zip(own, batch.column("node").to_pylist(), strict=True)], pa.bool_())
                yield batch.filter(same)

    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted_id"])).select("node", "text")
    texts = texts.mapInArrow(content, "node long, text string").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts, "nj-texts")  # read for both sides, and so that a hub's pairs can be dealt out
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")

    def compare(batches):
        for whole in batches:
            for batch in slices(whole, "tb", 2 << 20):
                keep = []
                for x, y in zip(*(shingle_sets(batch.column(c), s.words) for c in ("ta", "tb")), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(s.denominator * both >= s.numerator * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    linked = materialize(joined.mapInArrow(compare, "a long, b long"), "nj-links")
    discard(texts)
    return linked


def _ends():
    return [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]


def _partnered(lists: DataFrame, s: Settings) -> DataFrame:
    """The members (element, node, n, place) of lists whose place leaves room for some other member's."""
    least = lists.groupBy("element").agg(F.min(F.struct("place", "node")).alias("first"), F.count("*").alias("length")).filter("length > 1")
    # A partner has at most n * denominator / numerator elements, and the bound on the difference grows with its size.
    room = F.expr(f"(n + n * {s.denominator} div {s.numerator}) * {s.denominator - s.numerator} div {s.denominator + s.numerator}")
    fits = (F.col("node") == F.col("first.node")) | (F.col("place") + F.col("first.place") <= room)
    return lists.join(least, "element").filter(fits).select("element", "node", "n", "place")


def _heavy_components(lists: DataFrame, light_links: DataFrame, docs: DataFrame, described: DataFrame, s: Settings) -> DataFrame:
    """(node, component) by all links among the members (element, node, n, place, signature) of inverted lists, and ``light_links``.

    A list's hub is compared with all its members and leaves it; lists whose members are all in one component are done. Further hubs follow as
    long as that takes most members away; then those outside of their list's largest component are compared with all others.
    """
    member = F.struct("place", "node", "n", *SIGNATURE)

    def compared(x: DataFrame, y: DataFrame, apart: str) -> DataFrame:
        met = x.alias("x").join(y.alias("y"), F.expr(f"x.element = y.element and {apart} and {_may_link('x', 'y', s)}"))
        return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def unsettled(members: DataFrame, hubs: DataFrame) -> DataFrame:
        """Members that are no hub, with their components, of lists that still hold several."""
        rest = members.drop("component").join(hubs.filter("length > 2").select("element", F.col("node").alias("_hub")), "element").filter("node <> _hub").drop("_hub")
        rest = rest.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sides = rest.groupBy("element").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.count("*").alias("length")).filter("a <> z")
        return materialize(rest.join(sides.select("element", "length"), "element"), "nj-left")

    hubs = materialize(lists.groupBy("element").agg(F.min(member).alias("h"), F.count("*").alias("length")).select("element", "length", "h.*"), "nj-hubs")
    tried = materialize(compared(lists, hubs, "x.node <> y.node"), "nj-tried")
    found = materialize(components(_verified(tried, docs, described, s).union(light_links)), "nj-found")
    before, left, last = lists.count(), unsettled(lists, hubs), False
    while not last and (count := left.count()):
        last, before = 8 * count > before, count
        parts = left.groupBy("element", "component").count()
        major = parts.groupBy("element").agg(F.max_by("component", F.struct("count", "component")).alias("major"))
        others = left.join(major, "element").filter("component <> major").drop("major")
        if not last:
            one = others.groupBy("element").agg(F.min(F.struct("place", "node", "n", *SIGNATURE, "component", "length")).alias("h"))
            others = hubs = materialize(one.select("element", "h.*"), "nj-hubs")
        pairs = materialize(compared(left, others, "x.component <> y.component").join(tried, ["a", "b"], "left_anti"), "nj-tried")
        if pairs.limit(1).count():
            tried = tried.union(pairs)
            found = materialize(components(found.toDF("a", "b").union(_verified(pairs, docs, described, s))), "nj-found")
        if not last:
            left = unsettled(left.drop("length"), hubs)
    return found


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of every row.

    Null and empty texts and texts without words have no shingles and link with nothing. A row without an id is
    returned with its number of shingles and a null component unless documents with ids have its class; it is never
    a class's id. Repeated rows fall into one class. Rows of one id and different texts are classed each by its own text.
    An empty table gives an empty result. Further columns are ignored.
    """
    joined = materialize(_classes(docs, settings), "nj-classes")
    least = materialize(joined.filter("node is not null").groupBy("class").agg(F.min("doc_id").alias("least")), "nj-least")  # so that a hot class is dealt out
    return joined.join(least, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def _classes(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n_shingles, node, class) of every row; node and class are null without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def describe(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), s.words)
                signatures = np.array([_signature(x) for x in sets]).reshape(len(sets), len(SIGNATURE))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_node(x) if len(x) else None for x in sets], pa.int64()),
                    *(pa.array(signatures[:, i]) for i in range(len(SIGNATURE))), pa.array([_wide(x) for x in sets], pa.binary()),
                ], ["doc_id", "n_shingles", "node", *SIGNATURE, "wide"])

    described = materialize(docs.mapInArrow(describe, "doc_id long, n_shingles long, node long" + "".join(f", {c} long" for c in SIGNATURE) + ", wide binary"), "nj-nodes")
    sizes = {r.n_shingles: r.n for r in described.filter(f"n_shingles between 1 and {s.max_light}").select("n_shingles", "node").distinct().groupBy("n_shingles").agg(F.count("*").alias("n")).collect()}
    light = boundary(sizes, s)
    hint = docs.sparkSession.sparkContext.broadcast(_order_hint(docs, described.count(), s))  # at most a third of the sample's shingles
    listed = -(-s.numerator * (light + 1) // s.denominator)  # smaller light sets have only light partners

    def rows(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for x in shingle_sets(batch.column("text"), s.words):
                    n, node = len(x), _node(x) if len(x) else 0
                    found = list(_subset_keys(x, s)) if 0 < n <= light else []
                    if n >= max(listed, 1):
                        rare = _rare_first(x, hint.value, prefix_length(n, s))
                        found.append((rare, np.arange(len(rare)), 0, 0))
                    for keys, place, low, high in found:
                        for column, value in zip(out, (keys.view(np.int64), place, node, n, low, high), strict=True):
                            column.append(value if isinstance(value, np.ndarray) else np.full(len(keys), value, np.int64))
                columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
                kinds = [np.int64, np.int32, np.int64, np.int32, np.int32, np.int32]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], ["element", "place", "node", "n", "low", "high"])

    # Written before it is read twice; the shuffles below carry no text. A subset's place is its check.
    listed_rows = materialize(docs.mapInArrow(rows, "element long, place int, node long, n int, low int, high int"), "nj-listed")
    shared = listed_rows.groupBy("element").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("element")
    emitted = materialize(listed_rows.join(shared, "element").distinct(), "nj-lists")
    discard(listed_rows)

    # Light: in a list of sizes low and high every smaller set is linked with every larger one.
    subsets = emitted.filter("high > 0")
    sides = subsets.groupBy("element", "place").agg(F.min(F.when(F.col("n") == F.col("low"), F.col("node"))).alias("small"), F.min(F.when(F.col("n") == F.col("high"), F.col("node"))).alias("large"))
    light_links = subsets.join(sides, ["element", "place"]).select(
        F.col("node").alias("a"), F.when(F.col("n") == F.col("low"), F.col("large")).otherwise(F.col("small")).alias("b")
    ).filter("a <> b").distinct()

    # Heavy: members of fitting size share a band or are in neighbouring ones; who shares none has no partner.
    band = F.floor(F.log("n") / float(np.log(s.denominator / s.numerator)) + 1e-9)
    banded = emitted.filter("high = 0").select("element", "node", "n", "place", F.explode(F.array(band, band + 1)).alias("band"))
    busy = banded.groupBy("element", "band").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("element", "band")
    # From here a list is an element and a band: two members of one list may still share another.
    lists = banded.join(busy, ["element", "band"]).select(F.xxhash64("element", "band").alias("element"), "node", "n", "place")
    marks = described.groupBy("node").agg(*(F.first(c).alias(c) for c in SIGNATURE))
    lists = materialize(_partnered(lists, s).join(marks, "node"), "nj-heavy")
    found = _heavy_components(lists, light_links, docs, described, s)
    return described.join(found, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component", "node").alias("class"))


def representatives(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class, with the columns of ``docs``, whatever their names: a row whose id is the class's.

    Rows without words stay, one for each id. Of several rows with the kept id and set one stays. An empty table gives an empty result.
    """
    own, name = docs.columns, "_"
    while any(c.startswith(name) for c in own):
        name += "_"
    node, kept_id, kept_node = f"{name}node", f"{name}id", f"{name}kept"
    found = _classes(docs, settings).filter("node is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("kept"))
    found = found.select(F.col("kept.doc_id").alias(kept_id), F.col("kept.node").alias(kept_node))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def mark(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                nodes = [_node(x) if len(x) else None for x in shingle_sets(batch.column("text"), settings.words)]
                yield batch.append_column(node, pa.array(nodes, pa.int64()))

    marked = docs.mapInArrow(mark, f"{kinds}, `{node}` long")
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & F.col(node).eqNullSafe(F.col(kept_node))
    kept = marked.join(found, same, "left").filter(F.col(node).isNull() | F.col(kept_node).isNotNull())
    return kept.dropDuplicates(["doc_id", node]).select(*own)
