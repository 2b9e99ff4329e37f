"""Whitening, genetic packing and phrase mining against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataweave.llm import genetic_packing, license_scan, phrases, rp_forest, whitening
from strataweave.llm.queries import oracle_sql, queries


def whitened_plainly(vectors, most):
    """(n, {row: deviation}, values, explained) in numpy."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    centred = y / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    return n, [sum(int(v) ** 2 for v in row) for row in y], centred @ (vectors[:, order] / np.sqrt(values[order])), values[order] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    good = [(rng.normal(size=5) * [1, 2, 3, 4, 5]).tolist() for _ in range(300)]
    good += [[0.0] * 5, good[7], good[7]]
    rows = [(i if i != 9 else None, v, 1.0, "x") for i, v in enumerate(good)]
    rows += [(900, None, 0.0, "x"), (901, [1.0, None, 1.0, 1.0, 1.0], 0.0, "x"), (902, [1.0, float("nan"), 1.0, 1.0, 1.0], 0.0, "x"), (903, [float("inf")] * 5, 0.0, "x"), (904, [], 0.0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row double, centred string").repartition(5)
    got = whitening.whiten(table, components=3).toPandas()
    n, deviation, plain, explained = whitened_plainly(good, 3)
    assert len(got) == 3 * len(good) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    sign = {}
    for c in range(3):
        own = got[got["component"] == c + 1].dropna(subset=["vec_id"]).groupby("vec_id").first()
        ids = own.index.astype(int)
        sign[c] = np.sign((own["whitened"].to_numpy() * plain[ids, c]).sum())
        assert np.allclose(own["whitened"].to_numpy() * sign[c], plain[ids, c], atol=1e-9)
        assert np.allclose(own["explained"].to_numpy(), explained[c], rtol=1e-9)
        assert own["deviation"].tolist() == [deviation[i] for i in ids]
    assert got["vec_id"].isna().sum() == 3


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [2.0]), (5, [3e38, 1.0])], kind)).collect()
    assert {r.vec_id for r in two} == {1, 2, 3, 4, 5} and {r.n for r in two if r.vec_id in (3, 4)} == {2}
    assert all(r.deviation is None for r in two if r.vec_id == 5)


def test_hot_vector_is_whitened_exactly(spark):
    rng = np.random.default_rng(5)
    good = [rng.normal(size=4).tolist() for _ in range(100)] + [[1.0, -1.0, 0.5, 0.25]] * 50
    got = whitening.whiten(spark.createDataFrame(list(enumerate(good)), "vec_id long, embedding array<double>"), components=4).toPandas()
    n, deviation, _, _ = whitened_plainly(good, 4)
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviation
    assert got[got["vec_id"] >= 100].groupby("component")["whitened"].nunique().tolist() == [1] * 4


def ids_of(texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def test_genetic_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "naïve", "x1"], k=rng.randint(0, 120))) for _ in range(150)]
    texts += [None, "", "same words"] + ["same words"] * 40 + ["long text " * 3000]
    rows = [(i if i % 11 else None, t, 5, "b") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key int, block string").repartition(4)
    s = genetic_packing.Settings(items=40, epochs=2, generations=5)
    got = genetic_packing.pack(table, capacity=128, s=s).collect()
    sequences = defaultdict(list)
    for r in got:
        assert len(r.ids) == 2 * r.length and 0 < r.length <= 128
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    expected = Counter()
    for (doc_id, *_), ids in zip(rows, ids_of(texts, 2)):
        edges = [0, *range((len(ids) - 1) % 128 + 1, len(ids) + 1, 128)]
        expected.update((doc_id, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in got) == expected
    total = sum(r.length for r in got)
    assert len(sequences) <= math.ceil(total / 128) * 1.03 + 1
    assert genetic_packing.pack(table.limit(0), capacity=128).count() == 0


def fewest(lengths, capacity):
    """Least number of bins by trying everything."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= lengths[k]:
                place(k + 1, rooms[:i] + [room - lengths[k]] + rooms[i + 1 :])
        place(k + 1, rooms + [capacity - lengths[k]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_bounds_and_best_fit(lengths):
    block = genetic_packing.Block(np.array(lengths), 20)
    least = fewest(sorted(lengths, reverse=True), 20)
    assert genetic_packing.lower_bound(np.array(lengths), 20) <= least
    bins = block.first()
    assert block.fills(bins).max() <= 20 and least <= bins.max() + 1 and set(bins) == set(range(bins.max() + 1))
    for p in block.evolved([bins, block.shaken(bins, np.random.default_rng(1))], least, np.random.default_rng(2), genetic_packing.Settings(generations=3)):
        assert block.fills(p).max() <= 20 and len(p) == len(lengths) and p.max() <= bins.max() + 3


def test_search_improves_on_best_fit(spark):
    """Triplets that fill a bin exactly, where the largest first goes wrong."""
    rng = random.Random(7)
    lengths = []
    for _ in range(60):
        a = rng.randint(380, 490)
        b = rng.randint(260, 1000 - a - 200)
        lengths += [a, b, 1000 - a - b]
    table = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
    packed = genetic_packing.assign(table, 1000, genetic_packing.Settings(items=1000, epochs=4, generations=60)).collect()
    plain = genetic_packing.Block(np.array(lengths), 1000).first()
    assert len(packed) == len(lengths) and 60 <= len({r.sequence_id for r in packed}) < plain.max() + 1


def collocations_plainly(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts[lang].update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        own = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        free = []
        for p, a in own.items():
            if any(100 * g >= 80 * a for q, g in own.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            free.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(free)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrased():
    rng = random.Random(9)
    words = ["a", "B", "ç", "Dé", "e2", "\x1c", "f-g", "H"]
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", ","]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    return rows + [("en", None), ("en", ""), ("xx", " \t "), ("yy", "once only")] + [("en", "very very very often; so")] * 60 + [("de", "lang " * 3000)]


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 7), (1, 50)])
def test_phrases(spark, phrased, least, top):
    rows = [(lang, text, 1, "p") for lang, text in phrased]
    table = spark.createDataFrame(rows, "lang string, text string, n int, phrase string").repartition(6)
    s = phrases.Settings(least=least, top=top, per_partition=300, flush=200, held=50, filter_mb=1)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(table, s).collect())
    assert got == collocations_plainly(phrased, least, top)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


@given(st.lists(st.lists(st.integers(0, 12), max_size=60), max_size=6), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_merged_summaries_keep_every_frequent_item(parts, least):
    mass = sum(map(len, parts))
    keys, counts, short, capacity = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0, mass // least + 1
    for part in parts:
        own, number = np.unique(np.array(part, np.uint32), return_counts=True)
        keys, counts, off = phrases.merge(keys, counts, own, number, capacity)
        short += off
        assert len(keys) <= capacity
    assert short * (capacity + 1) <= mass
    true = Counter(x for part in parts for x in part)
    found = dict(zip(keys.tolist(), counts.tolist()))
    assert all(found.get(x, 0) + short >= n >= found.get(x, 0) for x, n in true.items())
    assert all(x in found for x, n in true.items() if n >= least)


def test_phrase_query_against_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert sorted(map(tuple, queries()["op13_phrases"](spark, SMALL).collect())) == sorted(duck.execute(oracle_sql()["op13_phrases"]).fetchall())


def test_licences_with_columns_of_any_name(spark):
    names = ["_near", "_dir", "_above", "_granted", "_own_dir", "near", "dir", "above", "granted", "own_dir", "kept_0", "kept_1", "a.b", "Score", "OWN"]
    mit = 'Licensed under the MIT License.'
    rows = [("r/LICENSE", mit, *names), ("r/a/x.txt", "code", *names), (None, None, *names)]
    table = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ["path", "text", *names]))
    plain = license_scan.scan(table.select("path", "text")).orderBy("path").collect()
    got = license_scan.scan(table)
    kept = ["path", *names[:-2]]
    assert got.columns == [*kept, "own", "score", "licence_file", "inherited_from", "licence"]
    found = got.orderBy("path").collect()
    assert [tuple(r)[len(kept):] for r in found] == [tuple(r)[1:] for r in plain] and all(tuple(r)[1 : len(kept)] == tuple(names[:-2]) for r in found)


def test_a_third_of_vectors_alike(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(500, [1.0] * 8)] * 60 + [(600 + i, [1.0] * 8) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    s = rp_forest.Settings(visit=1.0, block=16)
    got = {}
    for r in rp_forest.nearest(table, F.col("vec_id") % 50 == 0, settings=s).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    known = dict(rows)
    assert set(got) == {i for i in known if i % 50 == 0}
    for q, found in got.items():
        x = np.array(known[q])
        best = sorted((-round(float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), 9), i) for i, v in known.items() if i != q)[:5]
        assert sorted(found) == [(k, i, -score) for k, (score, i) in enumerate(best, 1)]
