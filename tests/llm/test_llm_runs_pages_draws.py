"""Periodic runs, HTML extraction and importance resampling against brute force."""

import hashlib
import html
import math
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import html_text, importance, page_samples, periodic_runs

DOCS = "doc_id long, text string, n_words string, rank string, row string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], DOCS)


# ---- periodic runs


def naive_runs(words, least=24, periods=3):
    w, out = np.array(words), []
    for q in range(1, len(w)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (w[:-q] == w[q:]).astype(int), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            n = b - a + q
            if n >= max(least, periods * q) and not any((w[a : a + n - r] == w[a + r : a + n]).all() for r in range(1, q)):
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def spoiled(rng, n, letters):
    w = rng.integers(0, letters, n)
    for _ in range(rng.integers(0, 4)):
        p, s = int(rng.integers(1, 20)), int(rng.integers(0, max(1, n)))
        for i in range(s + p, int(rng.integers(s, n + 1))):
            w[i] = w[i - p]
    return w


def test_runs_against_all_periods():
    rng, found = np.random.default_rng(0), 0
    for _ in range(800):
        w = spoiled(rng, int(rng.integers(0, 140)), int(rng.integers(1, 5)))
        want = naive_runs(w)
        assert periodic_runs.runs([b"%d" % x for x in w]) == want
        assert not len(w) or periodic_runs.runs_of(w, 3, 3) == naive_runs(w, 3)
        found += len(want)
    assert found > 200


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=90), st.integers(1, 12), st.integers(0, 60))
def test_runs_of_few_letters(head, period, more):
    w = np.array((head + (head or [0])[-period:] * more)[:150], np.int64)
    assert periodic_runs.runs([b"%d" % x for x in w]) == naive_runs(w)


def test_runs_where_hashes_mislead(monkeypatch):
    """What hashes call the same and is not is told by comparing words."""
    monkeypatch.setattr(periodic_runs.Prefixes, "same", lambda self, i, j, m: True)
    words = [b"a", b"b", b"c"] * 20 + [b"d"] + [b"%d" % i for i in range(30)]
    assert all(w[: len(w) - p] == w[p:] for s, n, p in periodic_runs.runs(words) for w in [words[s : s + n]])


def test_thue_morse_and_fibonacci_words():
    """Cube-free words have no run of three periods; Fibonacci words have many."""
    thue = [b"%d" % (i.bit_count() % 2) for i in range(3000)]
    assert periodic_runs.runs(thue) == []
    a, b = "0", "01"
    while len(b) < 700:
        a, b = b, b + a
    assert periodic_runs.runs([c.encode() for c in b]) == naive_runs([int(c) for c in b])


def test_long_periodic_texts_take_seconds():
    rng, began = np.random.default_rng(1), time.perf_counter()
    for p in (1, 7, 1000, 30_000):
        base = [b"w%d" % x for x in rng.integers(0, 10**6, p)]
        words = [b"start", *(base[i % p] for i in range(100_000)), b"end"]
        assert (1, 100_000, p) in periodic_runs.runs(words)
    assert time.perf_counter() - began < 60


def digests(doc_id, text):
    """A row of the query, by the contract's words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = naive_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_query_on_whole_rows(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", " \n\t ", "one", "é ü " * 40, "a b c " * 30 + "end", " x y z " * 12, "x" * 5000]
    texts += [" ".join(f"w{x}" for x in spoiled(rng, int(rng.integers(0, 160)), 6)) + "\n" for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q r " * 20), (5, texts[5]), (-3, texts[4])]
    made = docs(spark, rows).select("doc_id", periodic_runs.made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    got = sorted(map(tuple, periodic_runs.detect(made).drop("n_words").collect()), key=str)
    assert sum(r[1] > 0 for r in got) > 20
    assert got == sorted((digests(*r) for r in rows), key=str)


def test_runs_details_and_empty_table(spark):
    row = periodic_runs.detect(docs(spark, [(1, "x " + "a  b\n" * 20 + "y")]), details=True).first()
    assert [tuple(r) for r in row.runs] == [(1, 40, 2)] and row.collapsed == "x a b y" and row.n_words == 42
    assert periodic_runs.detect(docs(spark, []).limit(0), details=True).collect() == []


# ---- HTML extraction


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(html_text.labelled_blocks(spark))


def extracted(page, tree):
    found = html_text.blocks_of(page)
    return "\n".join(b.text for b, k in zip(found, tree.predict(html_text.features(found)) >= 0.5) if k)


def test_tree_on_pages_held_out():
    parts = [(html_text.features(html_text.blocks_of(p)), np.array(m, float)) for p, m in page_samples.labelled_pages(500)]
    seen, unseen = parts[:400], parts[400:]
    grown = html_text.grow(np.vstack([x for x, _ in seen]), np.concatenate([y for _, y in seen]))
    assert (grown.column >= 0).sum() >= 5  # more than one test
    right = (grown.predict(np.vstack([x for x, _ in unseen])) >= 0.5) == np.concatenate([y for _, y in unseen])
    assert right.mean() > 0.98


def test_tree_against_all_cuts():
    """The first cut is the one of the least impurity among all."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (60, 3)).astype(float), (rng.random(60) < 0.4).astype(float)
    grown = html_text.grow(x, y, depth=1, least=1)
    gini = lambda rows: 2 * y[rows].mean() * (1 - y[rows].mean()) * rows.sum() if rows.any() else 0
    best = min(gini(x[:, j] > c) + gini(x[:, j] <= c) for j in range(3) for c in np.unique(x[:, j]))
    cut = x[:, grown.column[0]] > grown.cut[0]
    assert math.isclose(gini(cut) + gini(~cut), best)


BODY = "<p>First paragraph of the story, long enough to read.</p><p>Ok.</p><ul><li>one <b>item</b></li><li>another</li></ul>"
TEXT = "First paragraph of the story, long enough to read.\nOk.\none item\nanother"


@pytest.mark.parametrize("begin,end", [("<article>", "</article>"), ('<main class="page">', "</main>"), ('<div class="post-content">', "</div>"), ('<div class="layout has-sidebar"><article>', "</article></div>"), ('<div id=content>', "</div>")])
def test_article_among_all_that_is_not(tree, begin, end):
    page = (
        "<!doctype html><html><head><title>no</title><style>p{no}</style><script>var a='<p>no</p>'</script></head><body class='article'>"
        '<header><div class="logo">no <a href="/">no</a></div></header><nav><ul><li><a href=a>no</a></li><li><a href="a>b">no</a><li><a>no</a></ul></nav><div class="cookie-notice"><p>no, we do use cookies on this site of ours</p></div>'
        f'{begin}<h1>Title</h1>{BODY}<div class="advert">no buy this thing now, it is the very best thing</div><script>no</script><!-- no <p>no</p> --><aside>no</aside><form action=x><label>no</label><select><option>no</option></select><button>no</button></form>{end}'
        '<section id="comments"><article><p>no, I read all of this and I do not agree with it at all</p></article></section><div class="sidebar"><p>no</p></div><footer>&copy; no</footer></body></html>'
    )
    assert extracted(page, tree) == "Title\n" + TEXT


def test_characters_white_space_and_broken_markup(tree):
    got = lambda x: extracted(f"<article>{x}", tree)
    assert got("<p> a&amp;b \n\t c&nbsp;&#233;&eacute;&#x20AC; &am &lt;p&gt; &unknown; </p>") == "a&b c éé€ &am <p> &unknown;"
    assert got("<p>a<br>b<br/>c</p>") == "a b c" and got("<p><b>a.<br><p>b</p>") == "a.\nb"
    assert got("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2" and got("<P>a<P CLASS=x>b</DIV>c") == "a\nb\nc"
    assert got('<p title="a>b" data-x=\'</p>\'>c</p>') == "c" and got('<p title="open>c</p><p>d</p>') == "c\nd"
    assert got("<p>a<!-- b --!> c --><p>d") == "a\nd" and got("<p>a</p><!-- no end <p>b</p>") == "a\nb"
    assert got("<p>a</p><script>b") == "a" and got("<p>a</p><p>b</p><a href='x") == "a\nb"
    assert got("<p>a<svg><text>b</text></svg>c<noscript>d</noscript><textarea>e</textarea></p>") == "ac"
    assert extracted("", tree) == extracted("   ", tree) == ""
    assert got("<p>Wort<b>teil</b> <i>kursiv</i> Ende</p>") == "Wortteil kursiv Ende"


def test_extraction_takes_linear_time(tree):
    for unit in ("<div>", "<p>a", "<a href=\"", "<", "</x>", "<!--", "<b><i>x</b>", "<script>", "&amp;", "<p title='"):
        seconds = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            html_text.blocks_of("<article>" + unit * n)
            seconds.append(time.perf_counter() - began)
        assert seconds[1] < 12 * seconds[0] + 0.5, unit


def test_extraction_rows(spark, tree):
    rows = [(1, "u", "<article><p>Hé llo</p></article>"), (1, "u", "<article><p>Hé llo</p></article>"), (None, None, "<article>x</article>"), (2, "v", None), (3, "v", ""), (4, None, "<nav><a>no</a></nav>")]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html_text.extract(pages, tree).collect()), key=str)
    want = [(1, "u", "Hé llo", 6), (1, "u", "Hé llo", 6), (None, None, "x", 1), (2, "v", "", 0), (3, "v", "", 0), (4, None, "", 0)]
    assert got == sorted(want, key=str)
    assert html_text.extract(pages.limit(0), tree).collect() == []
    with pytest.raises(ValueError):
        html_text.train(html_text.labelled_blocks(spark, 20), most=10)


def test_extraction_of_the_given_pages(spark, tree):
    """Their template is known, so that the article can be cut out by it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages, tree).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text)


# ---- importance resampling


def naive_draw(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [a + " " + b for a, b in zip(w, w[1:])]]

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    pool = sorted((r for r in out if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    drawn = pool[: percent * len(pool) // 100]
    ranked = [(*r[:4], k) for k, r in enumerate(drawn, 1)]
    rest = Counter(r[:4] for r in out) - Counter(r[:4] for r in drawn)
    return sorted([*ranked, *((*r, None) for r in rest.elements())], key=str)


def test_draw_against_a_sort(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "Beta", "gamma", "Δelta", "é", "x1", "of", "the", "test", "İ"]
    rows = [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 60)))) + rng.choice(["", ".", " \n"])) for i in rng.permutation(400) - 150]
    rows += [(None, "the test " * 20), (1, None), (2, ""), (3, "!!! ???"), (7, "same text of all " * 9), (7, "same text of all " * 9), (2**62, "of the " * 15), (-(2**63), "of the " * 16), (2**63 - 1, "of the " * 17), (5, "word " * 70_000)]
    target = ["the test of x1", "the the TEST", None, ""]
    frame = docs(spark, rows).repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (25, 100, 1):
        got = importance.resample(frame, items, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == naive_draw(rows, target, percent)


def test_draw_from_empty_tables(spark):
    empty, items = docs(spark, []).limit(0), spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(empty, items).collect() == []
    rows = [(i, "a b c d " * 6) for i in range(8)]
    assert sorted(map(tuple, importance.resample(docs(spark, rows), items.limit(0)).collect()), key=str) == naive_draw(rows, [])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, -1, 5, 2**40, -(2**63), 2**63 - 1]), st.integers(-3, 3)), min_size=1, max_size=40), st.floats(0, 1.2))
def test_first_k_is_exact(spark, pairs, share):
    rows = [(a, b, i) for i, (a, b) in enumerate(pairs)]
    frame, k = spark.createDataFrame(rows, "a long, b long, c long"), int(share * len(rows))
    got = frame.filter(importance.first_k(frame, [F.col("a"), F.col("b"), F.col("c")], k)).collect()
    assert sorted(map(tuple, got)) == sorted(rows)[:k]


def test_ranges_are_ranked_without_one_task(spark):
    frame = spark.range(0, 5000, 1, 16).withColumn("place", F.xxhash64("id"))
    got = importance.ranked(frame, [F.asc("place")], "rank")
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert [r.place for r in got.orderBy("rank").collect()] == sorted(r.place for r in frame.collect())
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 5001))
