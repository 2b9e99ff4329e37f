"""Operators on texts: language model, licences, pages, shingle join, classifier."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.llm import html_template, license_scan, lm_bloom, ngram_jaccard, quality_gam, tokens
from strataweave.llm.components import components

SCHEMA = "doc_id long, text string, source string, score double, node string"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\x0b\x1c ", max_size=30)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_the_pattern(texts):
    got = tokens.words(pa.array(texts, pa.string()))
    known = {}
    for i, text in enumerate(texts):
        own = got.hashes[got.bounds[i] : got.bounds[i + 1]].tolist()
        expected = plain_words(text)
        assert len(own) == len(expected)
        for h, w in zip(own, expected):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_words_of_long_text_in_slices():
    text = " ".join(f"w{i % 977}" for i in range(400_000))
    got = tokens.words(pa.array([text]))
    assert len(got.hashes) == 400_000 and len(np.unique(got.hashes)) == 977
    assert (got.hashes[:977] == got.hashes[977 * 3 : 977 * 4]).all()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 120))) for _ in range(60)]
    for i in range(20):  # near copies
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0]] * 30 + [None, "", "  \n ", "one", "one two", "ONE  two", "x" * 50_000, texts[1]]
    rows = [(i, t, f"s{i % 3}", 0.5, "n") for i, t in enumerate(texts)] + [(None, texts[2], None, None, None), (5, texts[5], "s1", 0.1, "z"), (5, texts[5], "s1", 0.1, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_language_model(spark, docs):
    rows = lm_bloom.score_documents(docs).collect()
    assert len(rows) == docs.count()
    counts, training = Counter(), 0
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 10:
            counts.update([*plain_words(r.text), ""])
            training += 1
    total, kinds = sum(counts.values()), len(counts)
    by_size = Counter()
    for r in rows:
        assert r.train_tokens == total and r.score <= 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 10 == 0)
        by_size[r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)] += 1
    expected = Counter()
    for r in docs.collect():
        w = [*plain_words(r.text), ""]
        expected[r.doc_id, len(w), sum(counts[x] > 0 for x in w), round(sum(np.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), 6)] += 1
    assert by_size == expected and texts
    learned = [r for r in rows if not r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in learned) > sum(r.base_score for r in learned)


def test_language_model_in_passes(docs, monkeypatch):
    whole = lm_bloom.score_documents(docs).collect()
    fits = lm_bloom.bits_for
    monkeypatch.setattr(lm_bloom, "bits_for", lambda n, p: min(fits(n, 1), 5))
    one = lm_bloom.score_documents(docs).collect()
    training = docs.select("doc_id", "text").withColumn("held_out", lm_bloom.held_out())
    model = lm_bloom.fit(training.filter("not held_out"))
    model.passes = [[b] for p in model.passes for b in p]
    many = model.score(training, ["doc_id", "held_out"], ~F.col("held_out")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6))
    assert sorted(map(key, one)) == sorted(map(key, many)) and len(whole) == len(many)


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_scores(docs, order):
    """Scores against quantised counts in dictionaries; the filter is wide enough for no false hit."""
    settings_ = lm_bloom.Settings(order=order, bits_per_entry=64)
    rows = docs.select("doc_id", "text").withColumn("held", lm_bloom.held_out()).collect()
    counts, begins = Counter(), 0
    for r in rows:
        if not r.held:
            items = [None, *plain_words(r.text), ""]
            begins += 1
            for k in range(1, order + 1):
                counts.update(tuple(items[i : i + k]) for i in range(len(items) - k + 1))
    del counts[(None,)]
    total, kinds = sum(n for g, n in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    ones, values = lm_bloom.level_counts(255, settings_.unigram_base), lm_bloom.level_counts(60, settings_.log_base)

    def seen(gram):
        if gram == (None,):
            return begins
        n = counts[gram]
        base, table = (settings_.unigram_base, ones) if len(gram) == 1 else (settings_.log_base, values)
        return table[int(lm_bloom.quantised(np.array([n]), base)[0])] if n else 0.0

    def score(text, k):
        items, out = [None, *plain_words(text), ""], 0.0
        for i in range(1, len(items)):
            p = (seen((items[i],)) + 0.1) / (total + 0.1 * (kinds + 1))
            for j in range(2, order + 1):
                if i - j + 1 >= 0:
                    gram = tuple(items[i - j + 1 : i + 1])
                    c = seen(gram)
                    p = (c + k * p) / (max(seen(gram[:-1]), c) + k)
            out += np.log10(p)
        return out

    model = lm_bloom.fit(docs.select("doc_id", "text").filter(~lm_bloom.held_out()), settings_)
    got = model.score(docs.select("doc_id", "text"), ["doc_id"], ~lm_bloom.held_out()).collect()
    want = Counter((r.doc_id, round(score(r.text, model.smoothing), 5)) for r in rows)
    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == want


def test_language_model_of_large_counts():
    """Counts beyond 32 bits are kept, in a segment of their own width."""
    import pandas as pd

    settings_ = lm_bloom.Settings()
    frame = pd.DataFrame({"bucket": [0, 0], "kind": [1, 1], "keys": [np.array([5, 9], np.uint64).tobytes()] * 2, "counts": [np.array([4_000_000_000, 7], np.uint32).tobytes()] * 2})
    out = lm_bloom._segment(settings_)(frame).iloc[0]
    assert np.frombuffer(out["counts"], "<u8").tolist() == [8_000_000_000, 14] and out["tokens"] == 8_000_000_014
    small = lm_bloom._segment(settings_)(frame.iloc[:1]).iloc[0]
    assert np.frombuffer(small["counts"], "<u4").tolist() == [4_000_000_000, 7]


def test_language_model_levels():
    values = lm_bloom.level_counts(12, 1.5)
    counts = np.arange(1, 80)
    q = lm_bloom.quantised(counts, 1.5)
    assert (np.diff(q) >= 0).all() and q[0] == 1 and (np.abs(values[q] - counts) <= counts * 0.5).all()


def test_language_model_tunes_on_all_texts(spark):
    """A large group of copies that comes first by hash does not choose the smoothing; all distinct texts do, as by brute force."""
    rng = random.Random(21)
    words_ = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words_, k=40)) for _ in range(400)]
    texts = [r.text for r in spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.xxhash64("text"), "text").collect()]
    rows = [texts[0]] * 600 + texts[1:]
    frame = spark.createDataFrame([(t,) for t in rows], "text string")
    model = lm_bloom.fit(frame)
    assert model.score(frame, [], F.lit(True)).count() == len(rows)
    ones, twos, total = Counter(), Counter(), 0
    for t in rows:
        w = [None, *t.split(), ""]
        ones.update(w)
        twos.update(zip(w, w[1:]))
        total += len(w) - 1
    kinds = len(ones) - 1

    def likelihood(k):
        out = 0.0
        for t in texts:
            w = [None, *t.split(), ""]
            for a, b in zip(w, w[1:]):
                p = (ones[b] - 1 + 0.1) / (total + 0.1 * (kinds + 1))
                out += np.log10((twos[a, b] - 1 + k * p) / (max(ones[a] - 1, twos[a, b] - 1) + k))
        return out

    assert model.smoothing == max(lm_bloom.GRID, key=likelihood) > lm_bloom.GRID[0]


def test_language_model_empty(spark, docs):
    assert lm_bloom.score_documents(docs.limit(0)).collect() == []


def test_shingle_join_is_exact(docs):
    got = ngram_jaccard.classes(docs).collect()
    rows = docs.collect()
    sets = []
    for r in rows:
        w = plain_words(r.text)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 3 else zip(w, w[1:], w[2:])))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    expected = Counter((r.doc_id, len(sets[i]), least.get(find(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


def test_shingle_join_of_sizes(spark):
    """Pairs at and just under the threshold, for light and heavy sets."""
    rows, n = [], 0
    for size in [*range(8, 45), 60, 95, 150, 400]:
        base = [f"t{size}x{i}" for i in range(size + 2)]
        for cut in range(0, size // 8 + 2):
            rows += [(n, " ".join(base)), (n + 1, " ".join(base[: len(base) - cut])), (n + 2, " ".join([*base, *(f"new{size}y{i}" for i in range(cut))]))]
            n += 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.classes(docs).collect()}
    sets = {i: frozenset(zip(w, w[1:], w[2:])) for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in sets}


def test_shingle_join_of_a_large_group(spark):
    """A hot list: near copies at all distances from one text, chains of them and a group apart, as by brute force on 3 words and 0.9 and on 5 and 0.8."""
    rng = random.Random(33)
    base, other = ([f"{k}{i}" for i in range(90)] for k in "ab")
    texts = [list(base), list(other)]
    for _ in range(150):  # up to twelve changes, some shared
        t = list(base)
        for at in rng.sample(range(90), rng.randint(0, 12)):
            t[at] = f"c{at}" if rng.random() < 0.5 else f"d{rng.random()}"
        texts.append(t)
    for i in range(40):  # a chain whose ends do not link
        t = list(texts[-1])
        t[(2 * i) % 90] = f"e{i}"
        texts.append(t)
    for _ in range(30):
        t = list(other)
        t[rng.randrange(90)] = f"f{rng.random()}"
        texts.append(t[: rng.randint(80, 90)] + base[:5])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for settings_ in (ngram_jaccard.Settings(), ngram_jaccard.Settings(words=5, numerator=80, denominator=100)):
        sets = [frozenset(zip(*(t[k:] for k in range(settings_.words)))) for t in texts]
        root = list(range(len(sets)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(sets[i] & sets[j])
            if settings_.denominator * both >= settings_.numerator * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        got = {r.doc_id: r.component_id for r in ngram_jaccard.classes(docs, settings_).collect()}
        assert got == {i: find(i) for i in range(len(sets))} and 2 < len(set(got.values())) < len(sets) - 20


def test_shingle_join_boundary_is_by_cost():
    s = ngram_jaccard.Settings()
    assert ngram_jaccard.boundary({12: 100}, s) >= 12
    assert ngram_jaccard.boundary({40: 100}, s) < 40
    for n in range(1, 60):
        for m in range(1, 60):
            o = ngram_jaccard.shared_least(n, m, s)
            assert all((100 * k >= 90 * (n + m - k)) == (k >= o) for k in range(min(n, m) + 1))


def test_representatives(docs):
    kept = ngram_jaccard.representatives(docs)
    assert kept.columns == docs.columns
    classes = {r.component_id for r in ngram_jaccard.classes(docs).collect() if r.n_shingles}
    assert sorted(r.doc_id for r in kept.collect() if plain_words(r.text)) == sorted(classes)
    assert sum(not plain_words(r.text) for r in kept.collect()) == 3


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (7, 7), (None, 3), (60, 61), (61, 62), (62, 60)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = dict.fromkeys(range(41), 0) | {50: 50, 100: 50} | dict.fromkeys((60, 61, 62), 60) | dict.fromkeys(range(200, 260), 200)
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) {{ "</p>" }}</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>{open}<h1>Title {i}</h1><p>First &amp; {words}<p>Second\n  line <b>bold</b> &copy;<div class="ad">Buy</div>{close}
<div id="comments"><p>Nice {i}</p></div><aside>Side</aside><form>Name <input></form><footer>&copy; host</footer></body></html>"""


def pages(spark, open_, close, n):
    rng = random.Random(3)
    rows = [(i, f"http://a.example.org/{i}", PAGE.format(open=open_, close=close, i=i, words=" ".join(rng.choices("abcdefgh", k=40)))) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("open_,close,n", [("<article>", "</article>", 12), ("<article>", "</article>", 1), ("<div class='x'>", "</div>", 12), ("<main>", "</main>", 150)])
def test_main_text(spark, open_, close, n):
    frame = pages(spark, open_, close, n)
    rows = html_template.main_texts(frame).collect()
    source = {r.page_id: r.html for r in frame.collect()}
    assert len(rows) == n
    for r in rows:
        words = re.search(r"&amp; ([^<]*)", source[r.page_id]).group(1)
        assert r.text == f"Title {r.page_id}\nFirst & {words}\nSecond line bold ©" and r.n_chars == len(r.text)


def test_main_text_of_odd_pages(spark):
    rows = [(1, None, None), (2, "http://b/", ""), (3, "not a url", "plain text"), (4, "http://b/", "<p>a<p>b <br>c"), (None, "http://b/", "<article>x"), (6, "http://b/", "<<>> <a href='"), (6, "http://b/", "<<>> <a href='")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as host", "2 as part")
    got = {r.page_id: r.text for r in html_template.main_texts(frame).collect()}
    assert got[1] == "" and got[2] == "" and got[None] == "x" and got[4].split() == ["a", "b", "c"]
    assert html_template.main_texts(frame.limit(0)).count() == 0


def test_main_text_of_many_copies(spark):
    """A page that is there thousands of times is one page of its host's template and leaves the others together."""
    frame = pages(spark, "<div class='x'>", "</div>", 60)
    copies = frame.filter("page_id = 7").crossJoin(spark.range(3000)).drop("id")
    nulls = spark.createDataFrame([(None, None, None)] * 5 + [(None, "http://a.example.org/q", None), (None, None, "http://a.example.org/q")], frame.schema)
    got = Counter((r.page_id, r.url, r.text) for r in html_template.main_texts(frame.union(copies).union(nulls).repartition(9)).collect())
    plain = {r.page_id: (r.url, r.text) for r in html_template.main_texts(frame).collect()}
    assert all(got[i, *plain[i]] == (3001 if i == 7 else 1) for i in range(60))
    assert got[None, None, ""] == 5 and got[None, "http://a.example.org/q", ""] == 1 and sum(got.values()) == 60 + 3000 + 7
    once = html_template._once(frame.union(copies).withColumn("host", F.lit("h")), frame.filter("page_id = 7").select(F.xxhash64("page_id", "url", "html").alias("content")))
    assert {r.page_id: r.copies for r in once.collect()} == {i: 3001 if i == 7 else 1 for i in range(60)}


def test_template_of_the_host_decides(spark):
    """The same page gives another text beside other pages of its host, and nothing with an empty template."""
    rng = random.Random(4)
    page = "<html><body><div class='t'>We are a small team of writers</div><div class='b'>The story of today is long and new</div></body></html>"
    alike = [page.replace("The story of today is long and new", " ".join(rng.choices("abcdefgh", k=40))) for _ in range(8)]
    other = [page.replace("We are a small team of writers", " ".join(rng.choices("abcdefgh", k=40))) for _ in range(8)]
    rows = [(i, "http://one.example.org/", p) for i, p in enumerate([page, *alike])] + [(100 + i, "http://two.example.org/", p) for i, p in enumerate([page, *other])]
    got = {r.page_id: r.text for r in html_template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "The story of today is long and new" and got[100] == "We are a small team of writers"
    tokens_ = html_template.tokenize(page)
    assert html_template.extract(tokens_, html_template.Template([])) == ""


def test_long_pages_in_groups_of_bytes(spark):
    body = "word " * 20_000
    rows = [(i, "http://long.example.org/", f"<html><body><div class='t'>Made here</div><article><p>{i} {body}</p></article></body></html>") for i in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in html_template.main_texts(frame).collect()}
    parts = {r.page_id: r.text for r in html_template.main_texts(frame, html_template.Settings(group_bytes=300_000)).collect()}
    assert whole == parts == {i: f"{i} {body.strip()}" for i in range(12)}


def test_equivalence_classes_nest():
    settings_ = html_template.Settings()
    made = [html_template.tokenize(f"<html><body><ul>{'<li><a href=x>q</a></li>' * k}</ul><div>{'long text ' * (20 + k)}</div></body></html>") for k in (2, 3, 5)]
    template = html_template.deduce(made, settings_)
    assert template.root == ["<html >", "<body >", "<ul >", "</ul>", "<div >", "</div>", "</body>", "</html>"]
    assert template.nested == {3: [["<li >", "<a >", "</a>", "</li>"]]}
    assert html_template.extract(made[0], template) == ("long text " * 22).strip()


def test_template_decides_inside_main(spark):
    """Constant slots and link lists inside a main element go, nested ones too; inline links and what varies stay."""
    rng, rows, want = random.Random(8), [], {}
    for i in range(12):
        words = [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(2 + i % 3)]
        body = "".join(f'<p class="t">{w} <a href="/{i}">see {i}</a></p>' for w in words)
        tools = '<ul class="u">' + '<li class="k">Print this page</li>' * (1 + i % 4) + "</ul>"
        also = "".join(f'<dd><a href="/{i}/{k}">Other story {i} {k}</a></dd>' for k in range(5 - i % 3))
        rows.append((i, f"http://main.example.org/{i}", f'<html><body><article><div class="x">Written by our team</div><h1>Title {i}</h1>{body}{tools}<dl class="q">{also}</dl></article></body></html>'))
        want[i] = "\n".join([f"Title {i}", *(f"{w} see {i}" for w in words)])
    got = {r.page_id: r.text for r in html_template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_main_element_is_evidence_only(spark):
    """A short main element does not outweigh the long varying text beside it."""
    rng = random.Random(9)
    rows = [(i, f"http://card.example.org/{i}", f'<html><body><article class="c">Card {i}</article><div class="x">{" ".join(rng.choices("abcdefgh", k=90 + i))}</div><div class="y">Made here</div></body></html>') for i in range(9)]
    for r in html_template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"Card {r.page_id}\n" + re.search(r'class="x">([^<]*)', rows[r.page_id][2]).group(1)


def test_licences(spark):
    rows = [
        ("repo/LICENSE", "Released under the MIT License"), ("repo/a.py", "x = 1\n"), ("repo/src/b.py", "# Licensed under the Apache License, Version 2.0.\ny = 2"),
        ("repo/src/deep/c.py", None), ("repo/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3"), ("repo/vendor/x/d.c", ""),
        ("other/e.py", "the public work of a licensed driver"), (None, "z"), ("repo/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3"),
    ]
    frame = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 as score", "2 as own")
    got = {(r.path, r.own, r.inherited_from, r.licence) for r in license_scan.scan(frame).collect()}
    assert got == {
        ("repo/LICENSE", "MIT", None, "MIT"), ("repo/a.py", None, "repo", "MIT"), ("repo/src/b.py", "Apache-2.0", None, "Apache-2.0"), ("repo/src/deep/c.py", None, "repo", "MIT"),
        ("repo/vendor/COPYING", "GPL-3.0", None, "GPL-3.0"), ("repo/vendor/x/d.c", None, "repo/vendor", "GPL-3.0"), ("other/e.py", None, None, None), (None, None, None, None),
    }
    assert license_scan.scan(frame.limit(0)).count() == 0


def test_licence_lines_are_not_missed():
    matcher = license_scan.Matcher(license_scan.Settings())
    rng = random.Random(5)
    for _, template in license_scan.statements():
        for _ in range(20):
            words = template.split()
            for _ in range(rng.randint(0, len(words))):
                words[rng.randrange(len(words))] = rng.choice(["the", "of", "filler", "a"])
            line = " ".join(words)
            best, _ = matcher.lines.best(license_scan.terms(line))
            if best >= matcher.threshold:
                assert matcher.scan(f"first\n{line}\nlast")[0]


def test_licence_files_and_headers():
    """Full texts, also with a holder and a year, wrapped headers in comments and identifiers."""
    scan = license_scan.Matcher(license_scan.Settings()).scan
    for name, text in license_scan.full_texts()[: len(license_scan.FULL)]:
        filled = text.replace("Copyright (c)", "Copyright (c) 2019-2021 Jane Doe and others. All rights reserved.")
        assert scan(filled)[0] == name and scan(filled)[2], name
        assert not scan(filled + "\n" + "code " * 50_000)[2]  # a licence inside a long file
    for name, text in license_scan.HEADERS:
        w = text.split()
        lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
        code = "#!/usr/bin/env run\n#\n# Copyright 2020 Jane Doe\n#\n" + "\n".join(f"# {x}" for x in lines) + "\n#\n\nimport os\nprint('no licence')\n" * 3
        assert scan(code)[:1] == (name,) and not scan(code)[2], name
    for i in license_scan.IDENTIFIERS:
        assert scan(f"// SPDX-License-Identifier: {i}\nint main() {{}}\n")[0] == re.sub("-(only|or-later)$", "", i)
    for text in ("", "plain words\n\nof no licence", "SPDX-License-Identifier: Other-1.0", "the software license is discussed here, and the general public", "\n\n\n", "x" * 300_000):
        assert scan(text) == (None, 0.0, False)


def test_quality_learns(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 != 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + "abc"[i % 3 : i % 3 + 1] for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" if i % 2 else w + "$$$" for w in words), 0.3))
        labels.append((i, int(good)))
    rows += [(600, None, 0.1), (601, "", 0.1), (None, "alpha beta", 0.1), (3, rows[3][1], 0.1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame([*labels, (None, 1), (7000, 0), (9, 5), (9, None)], "doc_id long, quality int")
    got = quality_gam.classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.97
    assert len({r.score for r in got if not r.text}) == 1
    empty = quality_gam.classify(docs, known.limit(0)).collect()
    assert {r.score for r in empty} == {0.5}
    assert quality_gam.classify(docs.limit(0), known).count() == 0


def test_quality_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit_tables(x[:2000], y[:2000], quality_gam.Settings(pairs=2, pair_rounds=80))
    assert (0, 1) in model.pairs
    assert np.mean((model.scores(x[2000:]) > 0.5) == y[2000:]) > 0.9
