"""Near-duplicates, leaks, neighbours and repeated windows against brute force; the pipeline."""

import hashlib
import itertools
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import ann, components, decontamination, fm_index, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, spans string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "y") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ---- connected components


def union_find(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("links", [[], [(3, 3)], [(i, i + 1) for i in range(120)], [(0, i) for i in range(1, 200)], [(random.Random(1).randrange(90), i) for i in range(90)] + [(5, 4), (5, 4), (-7, 300)]])
def test_components(spark, links):
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == union_find(links)


# ---- simhash


def naive_fingerprint(text):
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << i for i in range(64) if hashes and 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    base = [" ".join(prose(rng, 400)) for _ in range(6)]
    near = [b.replace(" ", "  ", 3).upper() if i % 2 else b + f" x{i}" for b in base for i in range(4)]
    texts = [*base, *near, None, "", " \t", "one", "one two", "ONE two", "a b c d", *[" ".join(prose(rng, 30)) for _ in range(20)], base[0], base[0]]
    ids = [i * 3 % 101 for i in range(len(texts))]
    ids[-1] = ids[-2]
    prints = [naive_fingerprint(t or "") for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = union_find([*links, *((i, i) for i in range(len(texts)))])
    least = {r: min(ids[i] for i in roots if roots[i] == r) for r in set(roots.values())}
    want = Counter((ids[i], f"{prints[i]:016x}", least[roots[i]]) for i in range(len(texts)))
    got = Counter(map(tuple, simhash.near_duplicates(docs(spark, texts, ids)).collect()))
    assert got == want
    assert kept_of(spark, texts, ids, 3, 1) == sorted(least.values())
    assert kept_of(spark, texts, ids, 5, 6) == naive_kept(texts, ids, 5, 6)


def kept_of(spark, texts, ids, size, n):
    kept = simhash.one_of_each(docs(spark, texts, ids), size=size, n=n)
    assert kept.columns == docs(spark, []).columns
    return sorted(r.doc_id for r in kept.collect())


def naive_kept(texts, ids, size, n):
    """The smallest id of each group; two texts are linked if any of their fingerprints are two bits apart at most."""
    prints = [simhash.fingerprints_of((t or "").encode(), size, n) for t in texts]
    near = lambda a, b: any((x ^ y).bit_count() <= 2 for x, y in zip(a, b))
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near(prints[i], prints[j])]
    roots = union_find([*links, *((i, i) for i in range(len(texts)))])
    return sorted(min(ids[i] for i in roots if roots[i] == r) for r in set(roots.values()))


def test_several_fingerprints_against_all_pairs(spark):
    """Near copies of several grades; more fingerprints link more, and never less, than one."""
    rng = random.Random(33)
    texts = []
    for _ in range(25):
        base = prose(rng, 300, 5000)
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 8, 30):
            copy = list(base)
            for at in rng.sample(range(300), edits):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    texts += [None, "", "a", "A", "b c", *[" ".join(prose(rng, 50, 5000)) for _ in range(20)]]
    ids = [(i * 37 + 5) % 997 for i in range(len(texts))]
    counts = []
    for n in (1, 2, 6):
        got = kept_of(spark, texts, ids, 5, n)
        assert got == naive_kept(texts, ids, 5, n)
        counts.append(len(got))
    assert counts[0] > counts[1] > counts[2] >= 25 + 24


def test_each_fingerprint_is_of_a_hash_of_its_own():
    words = prose(random.Random(34), 40)
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(36)], np.uint64)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in simhash._mixed(hashes, j)) > 36) for j in range(4)]
    assert simhash.fingerprints_of(" ".join(words).encode(), 5, 4) == want and len(set(want)) == 4
    assert simhash.fingerprints_of(b"", 5, 3) == [0, 0, 0]


def test_simhash_of_null_ids_and_empty_tables(spark):
    rows = simhash.near_duplicates(docs(spark, ["a b", "a b", "q"], [None, None, 4])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "None"), ("None", "None")]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 == simhash.one_of_each(docs(spark, [])).count()


def test_masks_cover_every_pair_of_bits():
    tables = simhash.masks(2)
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in tables) for i in range(64) for j in range(64))


def test_links_of_many_near_fingerprints(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {simhash._signed(centre ^ sum(1 << b for b in rng.sample(range(64), k))) for k in (0, 1, 2, 3, 4, 5) for _ in range(30)}
    got = {r.node: r.root for r in components.connected_components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()}
    want = union_find([(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    assert got == want


# ---- decontamination


def naive_alignment(item, words):
    best = [[0.0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            best[i][j] = max(0, best[i - 1][j - 1] + (1 if a == b else -0.5), best[i - 1][j] - 0.5, best[i][j - 1] - 0.5)
    return max(map(max, best)) / len(item)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.lists(st.sampled_from("abcde"), min_size=1, max_size=14))
def test_alignment(item, words):
    score, first, end = decontamination.align([a.encode() for a in item], [a.encode() for a in words])
    assert score == pytest.approx(naive_alignment(item, words))
    if score:
        assert naive_alignment(item, words[first:end]) == pytest.approx(score)


def leak_case(spark):
    rng = random.Random(6)
    items = [prose(rng, 30, 5000) for _ in range(25)]
    edited = list(items[3])
    for at in (4, 11, 19, 26):
        edited[at] = "changed"
    longer = items[4][:12] + ["put", "in"] + items[4][12:]
    texts = [" ".join(prose(rng, 80, 5000)) for _ in range(30)]
    texts += [" ".join([*prose(rng, 50), *w, *prose(rng, 50)]) for w in (items[0], edited, longer, [x.upper() + "," for x in items[5]], items[6][:10])]
    texts += [" ".join(items[7])] * 12 + [" ".join(items[8] * 40), None, "", "w1 w2"]
    return items, texts, [(30, 0), (31, 3), (32, 4), (33, 5), *((35 + i, 7) for i in range(12)), (47, 8)]


def test_leaks(spark):
    items, texts, want = leak_case(spark)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "a b"), (None, "x y z")], "item_id long, text string")
    rows = decontamination.leaks(docs(spark, texts), table).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == want
    assert all(r.score == 1 for r in rows if r.item_id in (0, 5, 7, 8)) and all(0.6 <= r.score < 1 for r in rows if r.item_id in (3, 4))
    for r in rows:
        assert r.last_word - r.first_word + 1 <= len(items[r.item_id]) + 2
    kept = decontamination.without_leaks(docs(spark, texts), table)
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})


def test_leaks_in_blocks_and_empty_tables(spark, monkeypatch):
    items, texts, want = leak_case(spark)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    split = decontamination.blocks
    monkeypatch.setattr(decontamination, "blocks", lambda t: split(t, 200))
    assert len(list(decontamination.blocks(table))) > 3
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs(spark, texts), table).collect()) == want
    assert decontamination.leaks(docs(spark, texts), table.limit(0)).count() == 0
    assert decontamination.leaks(docs(spark, []), table).count() == 0
    assert decontamination.without_leaks(docs(spark, texts), table.limit(0)).count() == len(texts)


def edited(rng, item, every, how):
    """``item`` with an edit at each ``every``-th word: changed, left out, or a word put in after it."""
    out = []
    for i, w in enumerate(item, 1):
        out += {"change": ["x%d" % rng.randrange(99)], "drop": [], "insert": [w, "x%d" % rng.randrange(99)]}[how] if i % every == 0 else [w]
    return out


def test_leaks_of_evenly_edited_copies_against_alignment(spark):
    rng = random.Random(16)
    items = [[f"i{k}n{j}" if rng.random() < 0.7 else rng.choice(["the", "of", "and"]) for j in range(n)] for k, n in enumerate([3, 4, 5, 6, 8, 15, 25, 40, 59])]
    copies = [edited(rng, w, every, how) for w in items for every in (2, 3, 4, 5) for how in ("change", "drop", "insert")]
    copies += [w[: len(w) // 5] + edited(rng, w[len(w) // 5 :], 1, "insert") for w in items] + items[5:7]  # long tails of words put in; exact copies beside the edited
    texts = [[*prose(rng, 40), *c, *prose(rng, 40)] for c in copies] + [[rng.choice(["the", "of", "and"]) for _ in range(300)]]
    want = {(d, i): s for d, t in enumerate(texts) for i, w in enumerate(items) if (s := naive_alignment(w, t)) >= 0.6}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(docs(spark, [" ".join(t) for t in texts]), table).collect()}
    assert got == pytest.approx(want)
    assert {(12 * k + 6 + h, k) for k in range(5, 9) for h in (0, 3)} <= want.keys()  # a changed word in every fourth and fifth


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=3, max_size=12), st.lists(st.sampled_from("abcdefg"), max_size=30), st.sampled_from([0.3, 0.6, 0.8, 0.9, 1.0]))
def test_seeds_leave_out_no_copy(item, words, threshold):
    item, words = ([w.encode() for w in x] for x in (item, words))
    block = decontamination.Block([0], [b" ".join(item)])
    grams = block.grams(threshold)
    counts = {n: np.array([1 + int(g) % 3 for g in x]) for n, x in grams.items()}  # any counts will do
    found = decontamination.find(words, decontamination.matcher(block, counts, grams, threshold))
    score = naive_alignment(item, words)
    assert [r[1] for r in found] == ([pytest.approx(score)] if score >= threshold else [])


def test_many_items_of_common_words_are_told_apart_early(spark):
    """20,000 items of the corpus' own words: hardly one is aligned, and a text takes milliseconds; the copies among them are found."""
    rng = random.Random(21)
    common = rng.choices([f"c{r}" for r in range(3000)], [1 / (r + 5) for r in range(3000)], k=200_000)
    items = [rng.sample(common, 40) for _ in range(20_000)]
    texts = [rng.sample(common, 250) for _ in range(60)]
    for d, (i, every) in enumerate([(7, 99), (8, 5), (9, 4), (19_999, 6)]):
        texts[d][100:140] = edited(rng, items[i], every, "change")
    block = decontamination.Block(list(range(len(items))), [" ".join(w).encode() for w in items])
    grams = block.grams(0.6)
    counts = {n: np.zeros(len(x), np.int64) for n, x in grams.items()}
    for t in texts:
        for n, x in grams.items():
            counts[n][np.unique(decontamination.Known(x).numbers(decontamination._grams(decontamination._hashes([w.encode() for w in t]), n))[1])] += 1
    m = decontamination.matcher(block, counts, grams, 0.6)
    coded = [[w.encode() for w in t] for t in texts]
    m.shifts(coded[0])
    began = time.perf_counter()
    got = [{i for i, *_ in decontamination.find(t, m)} for t in coded]
    assert time.perf_counter() - began < 3
    for d, i in enumerate((7, 8, 9, 19_999)):
        assert i in got[d]
    assert sum(len(m.shifts(t)) for t in coded[4:]) < 5 * len(texts)


@pytest.mark.parametrize("held", [1, 7, 1 << 20])
def test_seeds_are_counted_in_parts(monkeypatch, held):
    """However the places are cut into parts, and a long text into stretches, the same shifts come out."""
    rng = random.Random(22)
    items = [prose(rng, 20, 40) for _ in range(30)]
    text = [w.encode() for w in prose(rng, 300, 40) + items[3] + prose(rng, 200, 40) + edited(rng, items[4], 5, "drop")]
    block = decontamination.Block(list(range(30)), [" ".join(w).encode() for w in items])
    grams = block.grams(0.6)
    m = decontamination.matcher(block, {n: np.ones(len(x), np.int64) for n, x in grams.items()}, grams, 0.6)
    want = decontamination.find(text, m)
    assert {3, 4} <= {r[0] for r in want}
    monkeypatch.setattr(decontamination, "_HELD", held)
    monkeypatch.setattr(decontamination, "_STRETCH", 8)
    assert decontamination.find(text, m) == want


def test_alignment_of_long_texts_holds_two_rows():
    rng = random.Random(18)
    item = prose(rng, 600, 5000)
    words = [w.encode() for w in (item[:500] + prose(rng, 3)) * 360]  # 180,000 words, hits all over
    item = [w.encode() for w in item]
    tracemalloc.start()
    began = time.perf_counter()
    score, first, end = decontamination.align(item, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert score >= 500 / 600 and end - first >= 500 and peak < 100e6 and time.perf_counter() - began < 120


def test_leaks_in_a_text_of_hits(spark):
    rng = random.Random(19)
    item = prose(rng, 40, 5000)
    text = " ".join((item[:20] + ["x"]) * 5_000 + item[:36] + ["y"])
    table = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    row = decontamination.leaks(docs(spark, [text]), table).first()
    assert row.score == pytest.approx(0.9) and row.first_word == 21 * 5_000


# ---- neighbours


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, part int, vector string")


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(7)
    x = (rng.standard_normal((12, 16))[rng.integers(0, 12, 1500)] * 2 + rng.standard_normal((1500, 16))).astype(np.float32)
    x[600:1100] = x[0]  # a third are one vector
    rows = [(i, [float(v) for v in x[i]], 0, 1, "s") for i in range(1500)]
    odd = [(2000, None, 0, 0, ""), (2001, [0.0] * 16, 0, 0, ""), (2002, [float("nan")] * 16, 0, 0, ""), (2003, [None] * 16, 0, 0, ""), (2020, [1.0, 2.0], 0, 0, ""), (None, rows[0][1], 0, 0, "")]
    got = ann.search(vectors_of(spark, rows + odd), F.col("vec_id") % 20 == 0, k=20, parts=8).toPandas()
    exact, met = x.astype(np.float64), []
    for q in range(0, 1500, 20):
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        scores = (exact * exact[q]).sum(1)
        assert np.allclose(own.score, scores[own.vec_id], rtol=0, atol=1e-12)
        order = list(zip(-own.score, own.vec_id))
        assert order == sorted(order)
        scores[q] = -np.inf
        met.append(len(set(np.lexsort((np.arange(1500), -scores))[:20]) & set(own.vec_id)) / 20)
    assert got.query_id.nunique() == 75 and np.mean(met) >= 0.9


def clustered(n, seed=17):
    """``n`` vectors in clusters of about 100."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 100, 16)) * 3
    return (centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, 16)) * 0.5).astype(np.float32)


def recall_of(got, x, queries, k=20):
    exact, met = x.astype(np.float64), []
    for q in queries:
        s = exact @ exact[q]
        s[q] = -np.inf
        met.append(len(set(np.argsort(-s)[:k]) & set(got[got.query_id == q].vec_id)) / k)
    return np.mean(met)


def test_share_of_vectors_met_falls_as_they_grow(spark, monkeypatch):
    """Parts grow with the rows; beyond CUT they are cut twice. Recall stays, and a query meets a smaller share."""
    monkeypatch.setattr(ann, "PART", 64)
    monkeypatch.setattr(ann, "CUT", 32)
    shares = []
    for n in (1_000, 6_000):
        x = clustered(n)
        table = vectors_of(spark, [(i, [float(v) for v in r], 0, 1, "s") for i, r in enumerate(x)])
        index, probes = ann.fit(ann.usable(table), sample=2_000, below=400)
        assert (index.each > 1) == (n > 32 * 64) and index.parts == np.prod(ann.parts_for(n))
        sizes = np.bincount(index.file(x.astype(np.float64)), minlength=index.parts)
        shares.append(sizes[index.likeliest(x[::20].astype(np.float64), probes)].sum(1).mean() / n)
        got = ann.search(table, F.col("vec_id") % 40 == 0).toPandas()
        assert recall_of(got, x, range(0, n, 40)) >= 0.9
    assert shares[1] < 0.6 * shares[0]


@pytest.mark.parametrize(("rows", "parts"), [(0, (8, 1)), (8 * 1024, (8, 1)), (8 * 1024 + 1, (16, 1)), (64 * 1024, (64, 1)), (65 * 1024, (16, 8)), (10**12, (256, 256))])
def test_numbers_of_parts(rows, parts):
    assert ann.parts_for(rows) == parts


def test_neighbours_of_few_or_no_vectors(spark):
    rows = [(0, [1.0, 0.0], 0, 0, ""), (20, [1.0, 0.0], 0, 0, ""), (5, [1.0, 0.0], 0, 0, ""), (5, [1.0, 0.0], 0, 0, ""), (7, [0.5, 9.0], 0, 0, "")]
    got = ann.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, parts=4).toPandas()
    found = {q: list(d.sort_values("rank").vec_id) for q, d in got.groupby("query_id")}
    assert found == {0: [5, 20, 7], 20: [0, 5, 7]}
    assert ann.search(vectors_of(spark, rows[:1]), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(vectors_of(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(8).standard_normal((500, 8))
    sizes = np.bincount(ann.balanced_parts(ann.neighbour_graph(x, 6), 8), minlength=8)
    assert sizes.max() - sizes.min() <= 1


def test_blocks_split_large_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 4))
    got = ann.search(vectors_of(spark, [(i, [float(v) for v in r], 0, 0, "") for i, r in enumerate(x)]), F.col("vec_id") % 3 == 0, k=5, parts=2, recall=1.0).toPandas()
    y = x.astype(np.float32).astype(np.float64)
    for q, own in got.groupby("query_id"):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        assert list(own.sort_values("rank").vec_id) == list(np.argsort(-s)[:5])


@pytest.mark.parametrize("copies", ["one", "all"])
def test_ids_of_many_rows_take_one_place_each(spark, monkeypatch, copies):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng, k = np.random.default_rng(10), 5
    ids = np.concatenate([np.arange(200), np.full(90, 7) if copies == "one" else np.arange(200)])
    x = rng.standard_normal((len(ids), 4)).astype(np.float32)
    x[ids == 7] += np.float32(9) * x[0]  # near many queries
    got = ann.search(vectors_of(spark, [(int(i), [float(v) for v in r], 0, 0, "") for i, r in zip(ids, x)]), F.col("vec_id") % 10 == 0, k=k, parts=2, recall=1.0).toPandas()
    y = x.astype(np.float64)
    assert got.query_id.nunique() == 20
    for q, own in got.groupby("query_id"):
        s = (y @ y[ids == q].T).max(1)
        best = np.array([s[ids == i].max() if i != q else -np.inf for i in range(200)])
        assert list(own.sort_values("rank").vec_id) == list(np.argsort(-best, kind="stable")[:k])


def test_queries_of_thin_parts_ask_more(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.standard_normal((300, 4)) * 0.1 + 3, rng.standard_normal((6, 4)) * 0.1 - 3]).astype(np.float32)
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **b: (fit(*a, **b)[0], 1))  # one part asked at first
    rows = [(i, [float(v) for v in r], 0, 0, "") for i, r in enumerate(x)] + [(305, [float(v) for v in x[304]], 0, 0, "")]
    got = ann.search(vectors_of(spark, rows), F.col("vec_id") % 5 == 0, k=20, parts=32).toPandas()
    assert {q: sorted(d["rank"]) for q, d in got.groupby("query_id")} == {q: list(range(1, 21)) for q in range(0, 306, 5)}
    assert got.groupby("query_id").vec_id.nunique().eq(20).all() and (got.query_id != got.vec_id).all()
    few = ann.search(vectors_of(spark, rows[:12]), F.col("vec_id") % 5 == 0, k=20, parts=32).toPandas()
    assert few.groupby("query_id").size().to_dict() == {0: 11, 5: 11, 10: 11}


# ---- repeated windows


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.integers(0, 6), min_size=1, max_size=40), st.integers(2, 12))
def test_matching_statistics(text, query, most):
    t, q = np.array(text, np.int64), np.array(query)
    cut = len(q) // 2
    length, low, high = fm_index.FMIndex(t).matching_statistics(q, np.array([0, cut]), np.array([cut, len(q)]), most)
    held = Counter(tuple(text[i : i + n]) for n in range(1, most + 1) for i in range(len(text) - n + 1))
    for a, b in ((0, cut), (cut, len(q))):
        for p in range(a, b):
            n = max((n for n in range(1, min(most, b - p) + 1) if 0 not in query[p : p + n] and held[tuple(query[p : p + n])]), default=0)
            assert length[p] == n
            assert not n or high[p] - low[p] == held[tuple(query[p : p + n])]


def naive_dedup(texts, width):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def window_texts():
    rng = random.Random(10)
    shared = prose(rng, 50)
    texts = [" ".join([*prose(rng, rng.randrange(60)), *(shared if i % 3 == 0 else []), *prose(rng, rng.randrange(60))]) for i in range(40)]
    whole = " ".join(prose(rng, 200))
    near = [" ".join(w if j != 20 * i else "changed" for j, w in enumerate(whole.split())) for i in range(9)]
    loop = "again " * 80
    inside = " ".join(shared[:40] * 3)
    return [*texts, whole, whole, *near, loop, "again " * 35, "again " * 36, inside, None, "", "a b", "x\ty\nz " * 30, "É é " * 40, " ".join(shared[:35]), " ".join(shared[:34]), whole.upper()]


@pytest.mark.parametrize("options", [{}, {"hot": 1, "shard": 300}, {"hot": 10**6, "shard": 50}])
def test_dedup_against_brute_force(spark, options):
    texts = window_texts()
    rows = {r.doc_id: r for r in substring_dedup.dedup(docs(spark, texts), **options).collect()}
    assert [(rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) for i in range(len(texts))] == naive_dedup(texts, 35)
    assert all(sum(s.stop - s.first for s in r.removed) == r.n_removed for r in rows.values())


def test_a_window_of_all_documents_is_one_row_of_a_shard(spark):
    """Copies of a hot window are combined before they are dealt."""
    rng = random.Random(20)
    shared = prose(rng, 40)
    texts = [" ".join([*(f"a{i}n{j}" for j in range(6)), *shared, *(f"b{i}n{j}" for j in range(6))]) for i in range(3_000)]
    table = docs(spark, texts).select("doc_id", F.col("text").alias("doc"), F.xxhash64("doc_id", "text").alias("key"), F.hash("text", "doc_id").alias("salt"))
    sizes = []
    dealt = substring_dedup.shard_texts
    try:
        substring_dedup.shard_texts = lambda *a: sizes.append(dealt(*a)) or sizes[-1]
        found = {r.key: r.spans for r in substring_dedup.repeated_intervals(table, 35, shard=5_000, hot=50).collect()}
    finally:
        substring_dedup.shard_texts = dealt
    assert len(found) == 3_000 and all(min(s.first for s in x) == 6 and max(s.stop for s in x) == 46 for x in found.values())
    by_shard = sizes[0].groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split(F.col("words").cast("string"), " "))).alias("words")).collect()
    assert max(r.words for r in by_shard) < 25_000  # 3,000 rows of 35 words each came for every shared window before


def test_rows_that_share_a_key_are_told_apart(spark, monkeypatch):
    """One 64-bit hash for all rows: the other tells them apart."""
    whole = " ".join(prose(random.Random(21), 60))
    texts = [whole, "x " + whole, "y " * 3 + "z", None]
    monkeypatch.setattr(substring_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    rows = {r.doc_id: r for r in substring_dedup.dedup(docs(spark, texts)).collect()}
    monkeypatch.undo()
    assert [(rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) for i in range(len(texts))] == naive_dedup(texts, 35)
    monkeypatch.setattr(simhash, "_hashes", lambda i, t, key="key", salt="salt": [F.lit(5).cast("long").alias(key), F.hash(t, i).alias(salt)])
    kept = simhash.one_of_each(docs(spark, ["a b c d", "a b c d", "q r s t u", None], [3, 3, 9, 1]))
    got = sorted(r.doc_id for r in kept.collect())
    monkeypatch.undo()
    assert got == [1, 3, 9]


def test_dedup_of_a_very_long_text(spark):
    rng = random.Random(22)
    texts = [" ".join(prose(rng, 60_000, 10**5)), " ".join(prose(rng, 200, 10**5))]
    texts[1] += " " + " ".join(texts[0].split()[30_000:30_100])
    rows = {r.doc_id: r for r in substring_dedup.dedup(docs(spark, texts)).collect()}
    assert [(rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) for i in range(2)] == naive_dedup(texts, 35)


def test_dedup_of_repeated_rows_and_empty_tables(spark):
    text = " ".join(prose(random.Random(11), 60))
    rows = substring_dedup.dedup(docs(spark, [text, text, "short"], [1, 1, None])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("1", 60), ("1", 60), ("None", 0)]
    assert substring_dedup.dedup(docs(spark, [])).count() == 0


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    text = b" ".join(str(i * 7919).encode() for i in range(3000)) + b" " + b"x" * 5000
    whole = substring_dedup.word_hashes(text)
    monkeypatch.setattr(substring_dedup, "_SLICE", 97)
    assert (substring_dedup.word_hashes(text) == whole).all() and len(whole) == len(text.split()) == len(set(whole.tolist()))


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    items, texts, leaks = leak_case(spark)
    secret = "token = " + hashlib.sha1(b"k").hexdigest()
    plain = [" ".join(prose(rng, 120)) for _ in range(30)]
    rows = [*plain, plain[0], plain[1].upper(), f"{plain[2]} {secret} {plain[3]}", "12 34 -- 56", None, "", " ".join([*prose(rng, 40), *items[0], *prose(rng, 40)])]
    docs(spark, rows).drop("key", "spans").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = now.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{i}.parquet")
        now = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        kept.append({r.doc_id for r in now.collect()})
        assert i == len(corpus_pipeline.STAGES) - 1 or now.columns == columns
    everything = set(range(len(rows)))
    assert kept[0] == everything - {33, 34, 35}
    assert kept[1] == kept[0] - {30, 31}
    assert kept[2] == kept[1] - {36}
    assert kept[3] == kept[4] == kept[2]
    redacted = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3.parquet").collect()}
    assert redacted[32].text == f"{plain[2]} [secret] {plain[3]}" and redacted[32].n_chars == len(redacted[32].text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def stages_on(spark, tmp_path, rows, schema=DOCS):
    """Ids, sorted, after each stage of ``rows``; and each stage's columns."""
    items, _, _ = leak_case(spark)
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    now, out = spark.createDataFrame(rows, schema), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.mode("overwrite").parquet(f"{tmp_path}/s{i}.parquet")
        now = spark.read.parquet(f"{tmp_path}/s{i}.parquet")
        out.append((sorted([r.doc_id for r in now.select("doc_id").collect()], key=str), now.columns))
    return out


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert [ids for ids, _ in stages_on(spark, tmp_path, [])] == [[]] * 5


def test_pipeline_of_repeated_rows_nulls_and_clashing_columns(spark, tmp_path):
    """Names that the stages use inside: key, spans, __key, __salt, __lang, __text and others stay as they are."""
    schema = DOCS + ", __key long, __salt int, __lang string, __score double, __text string, __letters boolean, fp long, rank int, tags array<map<string,int>>"
    rng = random.Random(13)
    texts = [" ".join(prose(rng, 80)) for _ in range(12)]
    row = lambda i, t, n="en": (i, t, n, None, None, 7, "y", 1, 2, "l", 0.5, "t", True, 3, 4, [{"a": 1}])
    rows = [*(row(i, t) for i, t in enumerate(texts)), row(0, texts[0]), row(0, texts[0]), row(None, texts[1]), row(None, texts[11] + " one more"), row(None, " ".join(prose(rng, 80))), row(50, None, None), row(51, ""), row(52, "  \n"), row(3, "other words here now", None)]
    stages = stages_on(spark, tmp_path, rows, schema)
    assert all(columns == [f.split()[0] for f in schema.split(", ")] for _, columns in stages[:-1])
    ids = [i for i, _ in stages]
    assert [i for i in ids[0] if i in (50, 51, 52)] == [] and len(ids[0]) == 18  # repeated rows and null ids stay
    assert ids[1].count(0) == 1 and ids[1].count(None) == 1 and ids[1].count(1) == 1  # the copies of texts 1 and 11 under null ids go, the near one too
    assert ids[2] == ids[3] == ids[4] == ids[1]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from colloquy.llm import common

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(away)


def test_tables_on_the_way_are_deleted(spark):
    from colloquy.llm import common

    first = len(common._written)
    out = common.result_of(spark, lambda: simhash.near_duplicates(docs(spark, ["a b c", "a b c", "d"])), "out")
    assert len(common._written) == first + 1 and out.count() == 3
    common.discard(out)
    with pytest.raises(Exception):
        spark.read.parquet(common._written.pop())


# ---- bounds of the neighbour search


def wide_index(parts):
    rng = np.random.default_rng(9)
    return ann.Index(ann.Router(1.0, rng.standard_normal((16, 4)), np.zeros(4), rng.standard_normal((4, parts)), np.zeros(parts)), [], 1)


def test_batches_do_not_grow_with_the_parts_asked(spark, monkeypatch):
    import pyarrow as pa

    vectors = spark.range(0, 3000, 1, 1).select(F.col("id").alias("vec_id"), F.array(*[F.rand(3) for _ in range(16)]).alias("vector"))
    index, sizes = wide_index(1024), []
    made = pa.RecordBatch.from_arrays
    got = ann.routed(vectors, index, 400).groupBy("part").count().agg(F.sum("count")).first()[0]
    assert got == 400 * 3000
    # The same function by hand, to see the batches that it gives.
    step = max(1, min(ann.BLOCK, ann._TABLE // max(400 * 16, 1024)))
    batch = made([pa.array(np.arange(step)), pa.array([[0.5] * 16] * step)], names=["vec_id", "vector"])
    found = index.likeliest(np.full((step, 16), 0.5), 400)
    sizes.append(batch.take(pa.array(np.repeat(np.arange(step), 400))).nbytes)
    assert found.shape == (step, 400) and max(sizes) < 64e6


def test_parts_asked_are_counted_in_slices(monkeypatch):
    rng = np.random.default_rng(10)
    index, filed, asked = wide_index(64), rng.standard_normal((500, 16)), rng.standard_normal((90, 16))
    want = ann.probes_for(index, filed, asked, 20, 0.9)
    true = np.argsort(-(asked @ filed.T), axis=1)[:, :20]
    part, order = index.file(filed), index.likeliest(asked, 64)
    share = lambda n: np.mean([[part[v] in order[q, :n] for v in true[q]] for q in range(len(asked))])
    assert share(want) >= 0.9 > share(want - 1)
    monkeypatch.setattr(ann, "_TABLE", 1000)
    assert ann.probes_for(index, filed, asked, 20, 0.9) == want


# ---- very long texts, vectors of two lengths


def test_fingerprint_of_a_very_long_text():
    import xxhash

    words = prose(random.Random(31), 150_000, 50_000)  # over several chunks
    text = " ".join(words)
    ones = np.zeros(64, np.int64)
    for i in range(len(words) - 2):
        ones += np.unpackbits(np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42)], "<u8").view(np.uint8), bitorder="little")
    assert simhash.fingerprint(text.upper().replace("W", "w").encode()) == sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)


def test_pipeline_of_a_very_long_text(spark, tmp_path):
    rng = random.Random(32)
    items, _, _ = leak_case(spark)
    long = " ".join(prose(rng, 60_000, 5_000))
    texts = [long, long + " one word more", " ".join([*prose(rng, 30_000, 5_000), *items[2], *prose(rng, 30_000, 5_000)]), "w" * 300_000, " ".join(prose(rng, 40))]
    rows = [(i, t, "en", "s", len(t), 7, "y") for i, t in enumerate(texts)]
    out = [ids for ids, _ in stages_on(spark, tmp_path, rows)]
    assert out[0] == [0, 1, 2, 3, 4] and out[1] == [0, 2, 3, 4] and out[2] == out[3] == out[4] == [0, 3, 4]
    last = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/s4.parquet").collect()}
    assert all(r.round_trip for r in last.values()) and last[0].n_pieces > 60_000


def test_vectors_of_two_lengths(spark):
    """Of two lengths the commoner takes part, of equally common ones the shorter."""
    rows = [(i, [1.0, float(i)]) for i in range(6)] + [(10 + i, [1.0, 2.0, float(i)]) for i in range(6)]
    both = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.query_id for r in ann.search(both, F.col("vec_id") >= 0, k=2).collect()} == set(range(6))
    more = both.unionByName(spark.createDataFrame([(99, [0.0, 1.0, 0.0])], both.schema))
    got = ann.search(more, F.col("vec_id") == 99, k=3).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 10, 2.0), (2, 11, 2.0), (3, 12, 2.0)]
