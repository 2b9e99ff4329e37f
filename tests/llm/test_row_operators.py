"""Operators on rows and vectors: chat windows, packing, mixing, neighbours, near-duplicates, pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strataweave.llm import chat_format, cover_tree, mixing, packing, quality_gam, rp_forest
from strataweave.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def chats(spark):
    rng = random.Random(4)
    rows = []
    for c in range(12):
        n = 150 if c == 3 else rng.randint(1, 12)
        for t in range(n):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            text = rng.choice(["<|end|>", "\\<|x|>\n", "plain words " * rng.randint(1, 200), "", "é<|user|>\\", "</s>[INST]", "\\\\"])
            rows.append((c, t, role, text, "extra"))
    rows += [(None, 1, "user", "q", None), (None, 2, "assistant", "a", None), (20, 1, None, None, None), (20, None, "assistant", "late", None), (21, 1, "user", "same", None), (21, 1, "user", "same", None)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")


def by_conversation(chats):
    turns = defaultdict(list)
    for r in sorted(chats.collect(), key=lambda r: (r.turn is None, r.turn, r.role or "", r.text or "")):
        turns[r.conv_id].append((r.role or "", r.text or ""))
    return turns


@pytest.mark.parametrize("budget", [40, 500, 100000])
def test_chat_round_trip(chats, budget):
    s = chat_format.Settings(budget=budget, history_budget=budget // 4)
    windows = chat_format.windows(chats, s).cache()
    got = {r.conv_id: r for r in chat_format.digests(windows).collect()}
    turns = by_conversation(chats)
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    tokens = lambda t: len(t.split()) + len(t) // 4 + 4
    for w in windows.collect():
        parts = [w.text[p.start : p.start + p.length] for p in w.segments]
        assert all("<|" not in p for p in parts) and not any(p.loss and p.repeated for p in w.segments)
        rebuilt = "".join(f"<|{p.role}|>\n{t}<|end|>\n" for p, t in zip(w.segments, parts))
        assert rebuilt == w.text
        new = [p for p in w.segments if not p.repeated]
        assert new and (len(new) == 1 or sum(map(tokens, parts)) <= budget)
    assert budget > 40 or any(p.repeated and p.role == "system" for w in windows.collect() for p in w.segments)
    assert chat_format.windows(chats.limit(0)).count() == 0


def test_chat_is_native(chats):
    plan = chat_format.digests(chat_format.windows(chats))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@given(st.text(alphabet="<|\\>a\n ", max_size=12))
@settings(max_examples=40, deadline=None)
def test_chat_escape(text):
    escaped = text.replace("\\", "\\\\").replace("<|", "<\\|")
    assert "<|" not in escaped
    import re

    assert re.sub(r"(?s)\\(.)", r"\1", escaped) == text


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Gamma", "l'été", "x  y", "\n\nz", "12"], k=rng.randint(0, 80))), rng.choice(["a", "a", "a", "b", "c"]), "d") for i in range(200)]
    rows += [(203, "a <|endoftext|> b<|endoftext|>", "b", None), (200, None, None, None), (201, "", "b", None), (None, "no id", "z", None), (1007, "repeated row", "a", None), (1007, "repeated row", "a", None), (300, "word " * 9000, "b", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, part string")


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 5}])
def test_packing(documents, weights):
    rows = packing.pack(documents, weights=weights).collect()
    tokenizer = _tokenizer()
    expected = Counter()
    for r in documents.collect():
        expected[(r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]))] += 1
    total = sum(len(ids) * n for (_, ids), n in expected.items())
    seen, by_doc = {}, defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.offset + r.length <= 2048
        for k in range(r.offset, r.offset + r.length):
            assert seen.setdefault((r.sequence_id, k), r) is r
        by_doc[r.doc_id].append((r.sequence_id * 2048 + r.offset, r.start, ids.tolist(), r.doc_tokens))
    assert sorted(s * 2048 + k for s, k in seen) == list(range(total))
    for doc_id, pieces in by_doc.items():
        copies = sum(n for (d, _), n in expected.items() if d == doc_id)
        ids = next(list(i) for (d, i) in expected if d == doc_id)
        got = np.zeros(len(ids), int)
        for _, start, part, n in pieces:
            assert n == len(ids) and ids[start : start + len(part)] == part
            got[start : start + len(part)] += 1
        assert (got == copies).all()
    whole = packing.sequences(packing.pack(documents, weights=weights)).collect()
    assert {len(r.ids) for r in whole} == {2048} and len(whole) == -(-total // 2048)
    assert packing.pack(documents.limit(0)).count() == 0


def test_packing_proportions(documents):
    rows = packing.pack(documents).select("doc_id", "sequence_id", "length").collect()
    source = {r.doc_id: r.source for r in documents.collect()}
    total = Counter()
    for r in rows:
        total[source[r.doc_id]] += r.length
    share = {s: n / sum(total.values()) for s, n in total.items()}
    windows = defaultdict(Counter)
    for r in rows:
        windows[r.sequence_id][source[r.doc_id]] += r.length
    full = [w for w in windows.values() if sum(w.values()) == 2048]
    assert full and all(abs(w[s] - 2048 * share[s]) <= len(share) + 1 for w in full for s in share)


def test_schedule_serves_all():
    for totals, weights in (([5000, 3, 900], [1, 1, 1]), ([10, 20000], [9, 1]), ([7, 0, 4096], [0, 1, 2]), ([0], [1])):
        s = packing.Schedule(np.array(totals, np.int64), np.array(weights, float))
        sent = s.sent(np.arange(s.rounds + 2))
        assert (np.diff(sent, axis=0) >= 0).all() and (sent[0] == 0).all() and (sent[-1] == totals).all()


@given(st.lists(st.one_of(st.text(alphabet="aB1 \n\t.'sé\x1c  ", max_size=40), st.sampled_from(["<|endoftext|>", "<|endof", "text|>"])), max_size=5).map("".join))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_tokenizer(text):
    tokenizer = _tokenizer()
    ids = np.frombuffer(packing._encoder("byte_bpe_50k.json").encode(text), "<u2").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def _tokenizer(kept=[]):
    if not kept:
        kept.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))  # as it is, with its added token
    return kept[0]


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 10, "c": 0, "d": 1000, None: 50, "é": 7, "B": 30}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[k] for k in full)
        target = {k: 2.0 * sizes[k] if k in full else rest * weight[k] / sum(weight[j] for j in sizes if j not in full) for k in sizes}
        over = {k for k in sizes if k not in full and target[k] > 2 * sizes[k]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(target)


def test_mixing(spark, documents):
    planned = mixing.plan(documents).collect()
    assert len(planned) == documents.count() and all(r.copies <= 2 for r in planned)
    assert sum(r.copies for r in planned) == mixing.mix(documents).count() and mixing.mix(documents).columns == documents.columns
    assert [r.copies for r in sorted(planned, key=str)] == [r.copies for r in sorted(mixing.plan(documents.repartition(5)).collect(), key=str)]
    assert mixing.plan(documents.limit(0)).count() == 0
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    taken = mixing.plan(many).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) < 0.05 * r.t for r in taken)


def test_mixing_with_clashing_columns(spark, documents):
    plain = Counter((r.doc_id, r.copies) for r in mixing.plan(documents).collect())
    clash = documents.select("*", *(F.lit(99).alias(c) for c in ("size", "source_size", "target", "copies", "copy", "level", "weight", "_mix0")))
    assert Counter((r.doc_id, r.copies) for r in mixing.plan(clash).collect()) == plain
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns and {(r["size"], r.target, r["_mix0"]) for r in mixed.collect()} == {(99, 99, 99)}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in Counter(i for (i, c), m in plain.items() for _ in range(c * m)).items()})


def test_packing_of_many_sources(spark, monkeypatch):
    """Each source has its own share in every stretch; sources beyond ``OWN`` share queues, and none is left out."""
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"), F.col("id").cast("string").alias("source"))
    rows = packing.pack(docs, weights={str(i): 1 for i in range(1500)}).collect()
    first = Counter(r.doc_id for r in rows if r.sequence_id == 0 for _ in range(r.length))
    assert sum(r.length for r in rows) == 1500 * rows[0].doc_tokens and len(first) == 1500 and max(first.values()) <= 2
    monkeypatch.setattr(packing, "OWN", 20)
    monkeypatch.setattr(packing, "SHARED", 8)
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 5, None).otherwise(F.col("id").cast("string"))
    docs = spark.range(6000).repartition(7).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id").cast("string")).alias("text"), source.alias("source"))
    tokenizer = _tokenizer()
    for weights in (None, {"hot": 1.0, "7": 1.0, "not there": 2.0}):
        rows = packing.pack(docs, weights=weights, window=256).collect()
        places, ids = set(), defaultdict(dict)
        for r in rows:
            for k in range(r.length):
                assert (r.sequence_id, r.offset + k) not in places and r.start + k not in ids[r.doc_id]
                places.add((r.sequence_id, r.offset + k))
                ids[r.doc_id][r.start + k] = int(np.frombuffer(r.ids, "<u4")[k])
        assert sorted(s * 256 + o for s, o in places) == list(range(len(places))) and len(ids) == 6000
        assert all([ids[i][k] for k in sorted(ids[i])] == [*tokenizer.encode(f"one two three {i}", add_special_tokens=False).ids, 1] for i in range(0, 6000, 97))
        hot = Counter()
        for r in rows:
            hot[r.sequence_id] += r.length * (r.doc_id % 3 == 0)
        if weights is None:  # a third of every window
            assert all(abs(hot[w] - 256 / 3) <= 30 for w in range(max(hot)))
        else:  # the named sources first
            assert hot[2] == 256 and hot[max(r.sequence_id for r in rows)] == 0


def test_schedule_places_every_token_once():
    """Places by a queue's own curve agree with the table of all queues, whatever the weights."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        for kind in range(4):
            totals = rng.integers(0, 4000, n)
            weights = (totals.astype(float), rng.random(n), rng.integers(0, 3, n).astype(float), np.zeros(n))[kind]
            s = packing.Schedule(totals, weights, 128)
            sent = s.sent(np.arange(s.rounds + 1))
            queue = np.repeat(np.arange(n), totals)
            place = np.concatenate([np.arange(t) for t in totals])
            found = s.round_of(queue, place)
            assert (sent[found, queue] <= place).all() and (place < sent[found + 1, queue]).all()
            live = sent[1:-2].sum(axis=1) - 128 * np.arange(1, s.rounds - 1)
            assert (np.abs(live) <= n + 1).all()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    x[100:160] = x[100] + rng.normal(size=(60, 16)) * 0.05
    x[160:170] = x[160]
    x[170:200] = np.cumsum(rng.normal(size=(30, 16)) * 0.08, axis=0) + x[170]  # a chain
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None, *[1.0] * 15], 1), (904, [1.0, 2.0], 1), (905, [float("inf")] * 16, 1), (None, rows[0][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, tree int").repartition(3)


def usable_rows(vectors):
    rows = [r for r in vectors.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    rows.sort(key=lambda r: r.vec_id)
    x = np.array([r.embedding for r in rows], np.float32).astype(float)
    return np.array([r.vec_id for r in rows]), x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("block", [64, 4096])
def test_cover_tree_is_exact(vectors, block):
    got = {r.vec_id: r for r in cover_tree.near_duplicates(vectors, cover_tree.Settings(block=block)).collect()}
    ids, x = usable_rows(vectors)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.minimum(label, np.where(link, label[None, :], len(ids)).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert len(got) == vectors.count()
    for i, v in enumerate(ids):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (link[i].sum(), ids[label[i]], ids[label[i]] == v)
    for v in (900, 901, 902, 903, 904, 905):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (0, v, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert cover_tree.near_duplicates(vectors.limit(0)).count() == 0


def test_forest(vectors):
    query = F.col("vec_id") % 7 == 0
    rows = rp_forest.nearest(vectors, query, 5, rp_forest.Settings(block=50)).collect()
    ids, x = usable_rows(vectors)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.rank):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {v for v in ids.tolist() if v % 7 == 0}
    hits = 0
    for q, got in found.items():
        i = int(np.searchsorted(ids, q))
        assert len(got) == 5 and got == sorted(got, key=lambda p: (-p[1], p[0]))
        for v, score in got:
            assert score == pytest.approx(near[i, np.searchsorted(ids, v)], abs=1e-12)
        best = set(ids[np.lexsort((ids, -np.round(near[i], 12)))[:5]].tolist())
        hits += len(best & {v for v, _ in got})
    assert hits >= 0.9 * 5 * len(found)
    few = rp_forest.nearest(vectors.filter("vec_id < 4"), query, 5).collect()
    assert len(few) == 3
    assert rp_forest.nearest(vectors.limit(0), query).count() == 0


def test_vectors_of_lengths_repeats_and_extremes(spark):
    """Each length is compared with its own kind, a repeated id leaves room for others, and no magnitude is too far."""
    rng = np.random.default_rng(3)
    short, long_ = rng.normal(size=(40, 3)), rng.normal(size=(60, 5))
    short[1], long_[1] = short[0], long_[0] * 1e200
    long_[2] = long_[0] * 1e-200
    rows = [(i, v.tolist()) for i, v in enumerate(short)] + [(100 + i, v.tolist()) for i, v in enumerate(long_)] + [(101, long_[1].tolist())] * 30 + [(102, (-long_[0]).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in cover_tree.near_duplicates(frame).collect()}
    assert got[0].component_id == got[1].component_id == 0 and got[100].component_id == got[101].component_id == got[102].component_id == 100
    unit = lambda x: x / np.abs(x).max(axis=1)[:, None] / np.linalg.norm(x / np.abs(x).max(axis=1)[:, None], axis=1)[:, None]
    assert got[0].n_links == (unit(short) @ unit(short)[0] >= 0.95).sum() - 1
    assert got[100].n_links == (unit(long_) @ unit(long_)[0] >= 0.95).sum() - 1 + 30
    found = defaultdict(list)
    for r in sorted(rp_forest.nearest(frame, F.col("vec_id").isin(0, 100), 5, rp_forest.Settings(visit=1.0, block=16)).collect(), key=lambda r: r.rank):
        found[r.query_id].append((r.vec_id, round(r.score, 9)))
    for q, x in ((0, short), (100, long_)):
        near = unit(x) @ unit(x)[0]
        order = [i for i in np.lexsort((np.arange(len(x)), -np.round(near, 12))) if i][:5]
        assert found[q] == [(q + i, round(near[i], 9)) for i in order]


def test_forest_ties(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i % 2)], 0) for i in range(200)], "vec_id long, embedding array<double>, label int")
    rows = rp_forest.nearest(frame, F.col("vec_id") == 100, 5).collect()
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank)] == [0, 2, 4, 6, 8]


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixture", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        docs = after.cache()
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] > 0
    final = corpus_pipeline.run(spark, SMALL)
    assert final.agg(F.sum("length")).first()[0] > 0


def test_pipeline_near_duplicates(spark):
    """The stage against brute force, with near copies between five words at 0.8 and three words at 0.9."""
    rng, texts = random.Random(11), []
    for b in range(30):
        base = [f"w{b}x{i}" for i in range(rng.choice((12, 40, 150, 400)))]
        texts.append(base)
        for rate in (0.0, 0.005, 0.01, 0.015, 0.02, 0.022, 0.025, 0.03):
            edited = list(base)
            for at in rng.sample(range(len(base)), round(rate * len(base))):
                edited[at] = f"e{rng.random()}"
            texts.append(edited)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")

    def least_ids(n, share):
        sets = [frozenset(zip(*(t[k:] for k in range(n)), strict=False)) for t in texts]
        least = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= share * (len(sets[i]) + len(sets[j]) - both) and least[i] != least[j]:
                    a, b = sorted((least[i], least[j]))
                    least = [a if x == b else x for x in least]
        return sorted(set(least))

    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect())
    assert got == least_ids(5, 80)
    assert len(got) < len(least_ids(3, 90))


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties, repeats, and columns named like the stages' own; with labels."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=60)) + "." if i % 3 else "!!! $$$ " * 20, "en", "ab"[i % 2], i) for i in range(90)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n ", "en", None, 3), (None, "no id at all here", None, "a", 5), (203, " ".join(rng.choices(words, k=200_000)) + ".", "en", "b", 1)]
    rows += [(204, rows[1][1], "en", "a", 7), rows[2], rows[2], (205, "x" * 1_000_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(f"{c}!").alias(c) for c in ("score", "predicted", "_node", "class", "node", "size", "target", "copies", "queue", "ids"))).repartition(3)
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    return folder


def test_pipeline_of_odd_rows(spark, odd_documents):
    """Each stage against a brute-force version on the rows that the one before kept."""
    docs = spark.read.parquet(f"{odd_documents}/documents.parquet")
    key = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars, r["_node"], r.score)
    judged = quality_gam.classify(docs.drop("score", "predicted"), spark.read.parquet(f"{odd_documents}/labels.parquet")).collect()
    good = corpus_pipeline.keep_quality(spark, docs, odd_documents)
    assert good.columns == docs.columns
    kept = good.collect()
    assert Counter(map(key, kept)) == Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r["_node"], "score!") for r in judged if r.predicted)
    assert 30 < len(kept) < docs.count() and {r.doc_id % 3 for r in kept if r.doc_id is not None and r.doc_id < 90} == {1, 2}

    unique = corpus_pipeline.drop_near_duplicates(spark, good, odd_documents)
    sets = []
    for r in kept:
        w = (r.text or "").lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5)))))
    stays = Counter()
    for i, r in enumerate(kept):
        alike = [o for j, o in enumerate(kept) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
        if not sets[i] or (r.doc_id is None, r.doc_id or 0) == min((o.doc_id is None, o.doc_id or 0) for o in alike):
            stays[key(r)] = 1
    assert Counter(map(key, unique.collect())) == stays and unique.columns == docs.columns

    mixed = corpus_pipeline.mix_sources(spark, unique, odd_documents)
    assert mixed.columns == docs.columns
    copies = {key(r): r.copies for r in mixing.plan(unique.drop("copies")).collect()}
    assert Counter(map(key, mixed.collect())) == Counter({k: n for k, n in copies.items() if n})

    packed = corpus_pipeline.pack_windows(spark, mixed, odd_documents).collect()
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += len(_tokenizer().encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want and sorted(p for r in packed for p in range(r.sequence_id * 2048 + r.offset, r.sequence_id * 2048 + r.offset + r.length)) == list(range(sum(want.values())))


def test_pipeline_of_empty_tables(spark, odd_documents):
    assert corpus_pipeline.run(spark, f"{odd_documents}/none").count() == 0


def test_registered():
    names = set(queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in names}
    assert set(oracle_sql()) <= names
