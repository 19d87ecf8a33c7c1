"""License scans, quality, language ID, toxicity, secrets and pieces against brute force."""

import dataclasses
import functools
import hashlib
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import language_id, license_scan, pieces, quality, secrets, toxicity, trigrams

DOCS = "doc_id long, text string, lang string, score string, spans string, __key string"


def docs(spark, texts, first=0, lang=None):
    return spark.createDataFrame([(first + i, t, lang, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


EDGES = [None, "", " \n\t ", "a", "!!! ???", "word " * 30_000, "é" * 50, "same text here", "same text here"]

# ---- license scans


def naive_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    hits = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in hits}))


LICENSES = [
    "Released under the MIT License. MIT, license; mit LICENSE mit license", "the GNU\nGeneral--Public   License, cc by 4.0 CC-BY", "permit license", "apache licence", "GNU Genral Public Licence v2",
    "limit licenses", "Kelvin K mit license", "cc byte", "a" * 100 + " apache license " * 300,
]


def test_license_scan_matches_base_and_adds_fuzzy(spark):
    texts = [*EDGES, *LICENSES]
    rows = {r.doc_id: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == naive_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    by_text = {t: rows[i] for i, t in enumerate(texts)}
    assert by_text["apache licence"].labels == "apache" and by_text["apache licence"].n_base == 0
    assert by_text["GNU Genral Public Licence v2"].labels == "gpl"
    assert by_text["permit license"].labels == by_text["limit licenses"].labels == by_text["cc byte"].labels == ""


def test_license_spans_point_at_the_text(spark):
    text = "É vu — This is under the Apache  Licence, fine"
    spans = license_scan.license_scan(docs(spark, [text])).first().spans
    assert text[spans[0].start : spans[0].end] == "Apache  Licence"


def test_license_seeds_cover_phrases():
    for x in license_scan.FUZZY_NOTICES:
        assert "".join(p for _, p in license_scan.seeds(x)) == x.phrase and len(license_scan.seeds(x)) == x.edits + 1


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_license_edits_within_bound_are_found(data):
    scanner = license_scan.Scanner(license_scan.FUZZY_NOTICES)
    i = data.draw(st.sampled_from([i for i, x in enumerate(license_scan.FUZZY_NOTICES) if x.edits]))
    x = license_scan.FUZZY_NOTICES[i]
    letters = list(x.phrase)
    for _ in range(x.edits):
        at = data.draw(st.integers(1, len(letters) - 2))
        letters[at] = data.draw(st.sampled_from("abcxyz"))
    line = "before " + "".join(letters) + " after"
    assert any(k == i for k, *_ in scanner.matches(line))


def test_license_places_all_over_a_long_text(spark):
    """Offsets are counted once a text: seconds for 200,000 words, where counting from the start for each place took hours."""
    text = "É mit license GNU Genral Public Licence " * 28_572
    began = time.perf_counter()
    row = license_scan.license_scan(docs(spark, [text])).first()
    assert time.perf_counter() - began < 120
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (7 * 28_572, 28_572, 1, 7 * 28_571 + 1)
    assert {text[s.start : s.end] for s in row.spans} == {"mit license", "GNU Genral Public Licence"}


def test_license_labels_against_all_places(spark):
    """The seeded search of each notice finds what trying its expression at every word does."""
    rng = np.random.default_rng(6)
    scanner = license_scan.Scanner(license_scan.FUZZY_NOTICES)
    for _ in range(40):
        words = list(rng.choice(["the", "mit", "license", "licens", "public", "apache", "version", "2", "0", "cc", "by", "sa", "gnu", "general", "genral"], 25))
        line = " ".join(words)
        found = {i for i, *_ in scanner.matches(line)}
        starts = [m.start() for m in re.finditer(r"\S+", line)]
        for i, x in enumerate(license_scan.FUZZY_NOTICES):
            some = regex.compile(rf"\b(?:{regex.escape(x.phrase)}){{e<={x.edits}}}\b") if x.edits else re.compile(rf"(?<!\S){re.escape(x.phrase)}(?!\S)")
            assert (i in found) == any(some.search(line, a, min(len(line), a + len(x.phrase) + 3 * x.edits + 2)) is not None for a in starts), x


# ---- quality


def naive_statistics(text):
    t = text or ""
    words, n, chars = t.split(), max(1, len(t.split())), max(1, len(t))
    count = lambda p: len(re.findall(p, t))
    return {
        "n_chars": len(t), "n_words": len(words), "word_length": len(t) / n, "symbols": count(r"[#$%&*@^~<>{}=_+\\/\[\]]+") / n, "bars": t.count("|") / n,
        "capitals": count("[A-Z]") / chars, "digits": count("[0-9]+") / n, "points": count("[.,;:?]") / n, "lines": t.count("\n") / n,
        "distinct": len(set(words)) / n, "foreign": (len(t.encode()) - len(t)) / chars, "marks": count("!+") / n,
    }


def test_quality_statistics_against_python(spark):
    texts = [*EDGES, "A b, C! [x] {y} | | 12 3a", "É漢 é\nx\n\ny!!! !", "#$%&*@^~<>{}=_+\\/[]"]
    rows = quality.statistics(docs(spark, texts)).collect()
    for r in rows:
        assert r.stat.asDict() == pytest.approx(naive_statistics(texts[r.doc_id])), texts[r.doc_id]


def test_quality_takes_one_row_of_repeated_ids(spark):
    texts = ["good text here. " * 5, "bad ### | " * 5] * 30
    table = docs(spark, texts).unionByName(docs(spark, texts)).unionByName(docs(spark, ["other"] * 60))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    assert quality.train(table, labels) == quality.train(table.repartition(7, "text"), labels)


def test_quality_learns_and_scores_every_row(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["the", "of", "and", "river", "stone"], 40)) + "." for _ in range(120)]
    bad = [" ".join(w + "###" for w in rng.choice(["the", "of", "and"], 40)) for _ in range(120)]
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(table.select("doc_id", "text"), labels)
    assert model.rules
    rows = quality.classify(docs(spark, good + bad + EDGES), model).collect()
    assert len(rows) == 240 + len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    got = {r.doc_id: r.predicted for r in rows}
    assert np.mean([got[i] == int(i < 120) for i in range(240)]) > 0.97


def test_quality_expression_equals_the_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATISTICS)))
    model = quality.fit(x, (x[:, 2] > 0.5).astype(float))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.STATISTICS)).select(F.struct(*quality.STATISTICS).alias("stat"))
    got = [r[0] for r in frame.select(model.score(F.col("stat"))).collect()]
    at = {k: j for j, k in enumerate(quality.STATISTICS)}
    want = [model.intercept + sum(r.weight for r in model.rules if all((v[at[n]] > c) == above for n, c, above in r.tests)) for v in x]
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(want))))


def test_quality_of_empty_tables(spark):
    empty = docs(spark, []).select("doc_id", "text")
    model = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.classify(empty, model).count() == 0
    assert quality.classify(docs(spark, ["a"]), model).first().score == 0.5


# ---- language ID


def test_language_id(spark):
    words = {"aa": ["kal", "mor", "tis"], "bb": ["öze", "ürn", "ßal"], "cc": ["qui", "eau", "oix"]}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[k], 25)), k) for i, k in enumerate(sorted(words) * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table.filter("doc_id % 5 <> 0"), per_language=30, landmarks_per_language=8)
    got = {r.doc_id: r for r in language_id.predict(table, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows if i % 5 == 0)
    edges = language_id.predict(docs(spark, [*EDGES, "1234 567"]), model).collect()
    assert len(edges) == len(EDGES) + 1
    assert [r.lang_pred for r in edges if r.doc_id in (0, 1, 2, 4, len(EDGES))] == ["und"] * 5
    assert all(0 <= r.score <= 1 for r in edges)
    kept = language_id.without_unknown(docs(spark, [*EDGES, rows[0][1]]), model)
    assert kept.columns == docs(spark, []).columns and kept.filter(F.col("doc_id") == len(EDGES)).count() == 1
    assert kept.filter(F.col("doc_id").isin(0, 1, 2, 4)).count() == 0


def grams(text):
    return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}


@pytest.mark.parametrize("dense", [language_id._DENSE, 0])
def test_language_kernel_against_sets(monkeypatch, dense):
    monkeypatch.setattr(language_id, "_DENSE", dense)
    many = "".join(chr(0x4E00 + 7 * i % 900) for i in range(1500))  # hundreds of characters, as in Chinese
    marks = ["abcab", "bca", many, "", "q"]
    found = language_id.vocabulary(marks)
    known = set().union(*map(grams, marks))
    assert found.width == len(known)
    for t in [*marks, "Xyz abc", many[::-1], many[5:400] + "abcab", "ab", "\U0001f600b"]:
        assert found.presence(t).sum() == len(grams(t.lower()) & known)


def test_presence_does_not_depend_on_slices(monkeypatch):
    found = language_id.vocabulary(["abcabcaacb"])
    whole = found.presence("acbabcabbac" * 9)
    monkeypatch.setattr(language_id, "_SLICE", 5)
    assert (found.presence("acbabcabbac" * 9) == whole).all()


def test_language_scores_against_kernel_ridge_regression(spark):
    """Scores from the weights equal those of the regression worked out over kernels of sets."""
    words = {"aa": ["kal", "mor", "tis"], "bb": ["öze", "ürn", "ßal"], "cc": ["qui", "eau", "oix"]}
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([*words[k], "and"], 12)), k) for i, k in enumerate(sorted(words) * 20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table, per_language=20, landmarks_per_language=5)
    sample = language_id._sample(table, 20, 1000, 20_000, 10**7)
    texts = [(r.text, r.lang) for r in sample]
    marks = [t for k in sorted(words) for t in [t for t, g in texts if g == k][:5]]
    known = set().union(*map(grams, marks))

    def kernel(a, b):
        x, y = grams(a) & known, grams(b) & known
        return len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1))

    k_nm = np.array([[kernel(t, m) for m in marks] for t, _ in texts])
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    y = np.array([[1.0 if g == k else -1.0 for k in sorted(words)] for _, g in texts])
    bias = y.mean(0)  # as many texts of each language: equal weights
    alpha = np.linalg.solve(k_nm.T @ k_nm + 1e-2 * len(texts) * (k_mm + 1e-6 * np.eye(len(marks))), k_nm.T @ (y - bias))
    probes = ["kal öze and", "qui", "tis mor kal", "zzz"]
    values = np.array([[kernel(t, m) for m in marks] for t in probes]) @ alpha + bias
    want = np.exp(4.0 * (values - values.max(1, keepdims=True)))
    assert np.allclose(language_id.scores(probes, model), want / want.sum(1, keepdims=True), atol=1e-4)


def test_every_language_of_many_is_learned(spark):
    codes = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "uvwxyz"]
    rows = [(i, f"{k}{k} {k}a {k}o " * 4, k) for i, k in enumerate(codes * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table, per_language=4, total=100, most_landmarks=60)  # less than a row for each, by the totals
    assert model.languages == sorted(codes)
    again = language_id.train(table.repartition(5), per_language=4, total=100, most_landmarks=60)
    assert (again.weights == model.weights).all()
    got = language_id.predict(table, model).join(table.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang_pred = lang").count() > 0.9 * len(rows)


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, "kal mor tis " * 13, "aa") for i in range(20)] + [(100 + i, "... 12 " * 10 + "öze ürn ßal " * 2_000, "bb") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table)
    assert model.languages == ["aa", "bb"]
    sample = {r.lang: r.text for r in language_id._sample(table, 400, 25_600, 20_000, 10**8)}
    assert len(sample["bb"]) == 20_000 and sample["bb"].startswith("öze")  # from the first letter on
    got = {r.doc_id: r.lang_pred for r in language_id.predict(table, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_many_languages_of_many_characters_fit(spark):
    """64 languages with 300 characters each of their own: columns are shared, all are learned, and what is held stays small."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(64):
        own = [chr(0x4E00 + 300 * k + int(c)) for c in range(300)]
        rows += [(1000 * k + i, "".join(rng.choice(own, 400)), f"l{k:02}") for i in range(24)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = language_id.train(table.filter("doc_id % 1000 < 18"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(model.vocabulary.sizes) > 4 * language_id.WIDTH and model.weights.shape == (language_id.WIDTH, 64)
    assert peak < 600e6 and len(model.languages) == 64
    held_out = table.filter("doc_id % 1000 >= 18")
    got = language_id.predict(held_out, model).join(held_out.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang_pred = lang").count() > 0.95 * held_out.count()


def test_characters_learned_from_are_bounded(spark):
    table = spark.createDataFrame([(i, "abc def " * 50, "en") for i in range(30)], "doc_id long, text string, lang string")
    assert {len(r.text) for r in language_id._sample(table, 10, 100, 20_000, 500)} == {50}


def test_only_letters_make_a_language(spark):
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["abc def", "bcd efg"] * 4)], "doc_id long, text string, lang string")
    rows = language_id.predict(docs(spark, ["½ ² Ⅷ", "_", "ª", "漢", "1a"]), language_id.train(table)).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "en", "en", "en"]


def test_language_id_without_training_rows(spark):
    assert language_id.train(docs(spark, ["a b"])) is None
    assert language_id.predict(docs(spark, ["a b"]), None).first().lang_pred == "und"


# ---- toxicity


def toxic_case(spark):
    rng = np.random.default_rng(3)
    plain = [" ".join(rng.choice(["sun", "tree", "road", "lake"], 30)) for _ in range(200)]
    groups = (["idiot", "scum"], ["crétin", "ordure"], [f"zork{e}" for e in ("ling", "able", "ish", "ed", "ing", "o")])
    toxic = [t + " " + rng.choice(groups[i % 3]) for i, t in enumerate(plain[:120])]
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(320)] + [(None, 1), (5, None), (9, 0), (9, 0)], "doc_id long, toxic int")
    return plain, toxic, docs(spark, plain + toxic), labels


def test_toxicity_chain(spark):
    plain, toxic, table, labels = toxic_case(spark)
    chain = toxicity.train(table, labels)
    more = ["sun zorkest", "lake crétin"]
    rows = toxicity.score(docs(spark, plain + toxic + more + EDGES), chain).collect()
    assert len(rows) == 322 + len(EDGES)
    got = {r.doc_id: r for r in rows}
    assert all(got[i].predicted == int(i >= 200) for i in range(322))
    names = [f"p_category{k}" for k in range(1, 5)]
    strongest = [max(names, key=lambda n: got[200 + i][n]) for i in range(120)]
    by_group = [{s for s, t in zip(strongest, toxic) if t.split()[-1].startswith(w)} for w in ("zork", "crétin", "idiot")]
    assert all(len(g) <= 2 for g in by_group) and by_group[0].isdisjoint(by_group[1] | by_group[2]) and by_group[1].isdisjoint(by_group[2])  # no category holds two families of terms
    assert np.count_nonzero(np.tril(chain.links)) == 0 and np.count_nonzero(chain.links) > 0


def test_toxicity_chain_against_its_definition(spark):
    """Scores worked out link by link from the fitted weights, without matrices."""
    plain, toxic, table, labels = toxic_case(spark)
    chain = toxicity.train(table, labels)
    for r in toxicity.score(table, chain).collect()[::17]:
        held = [j for t, j in chain.terms.items() if t in toxicity.terms_of((plain + toxic)[r.doc_id].encode())]
        before = []
        for k in range(len(chain.categories)):
            z = chain.intercepts[k] + sum(chain.weights[j, k] for j in held) + sum(p * chain.links[i, k] for i, p in enumerate(before))
            before.append(1 / (1 + np.exp(-z)))
        assert [*[r[f"p_{c}"] for c in chain.categories[:-1]], r.score] == pytest.approx(before)


def test_later_models_learn_from_probabilities_of_other_folds(monkeypatch):
    """What a later model sees of an earlier category is predicted by a model that did not see the row."""
    seen, fit = [], toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y, **o: seen.append((x.copy(), y.copy())) or fit(x, y, **o))
    rng = np.random.default_rng(4)
    texts = [f"tree lake {'bad%d' % (i % 3) if i % 2 else 'good'} {rng.integers(9)}".encode() for i in range(80)]
    toxicity.fit(texts, np.array([i % 2 for i in range(80)], float), folds=4)
    whole = [s for s in seen if len(s[0]) == 80]
    parts = [s for s in seen if len(s[0]) < 80]
    fold = np.random.default_rng(10).integers(0, 4, 80)
    first, second = whole[0], whole[1]
    out = np.zeros(80)
    for f, (x, y) in zip(range(4), parts[:4]):
        assert (x == first[0][fold != f]).all()
        w, b = fit(x, y, l2=1e-3, rounds=200)
        out[fold == f] = toxicity.sigmoid(first[0][fold == f] @ w + b)
    assert second[0].shape[1] == first[0].shape[1] + 1 and np.allclose(second[0][:, -1], out, atol=1e-5)


def test_toxicity_factors_come_near():
    x = np.zeros((30, 9))
    for i in range(30):
        x[i, 3 * (i % 3) : 3 * (i % 3) + 3] = 1
    left, right = toxicity.factors(x, 3)
    assert np.abs(left @ right - x).max() < 0.05


def test_toxicity_without_labels(spark):
    chain = toxicity.train(docs(spark, ["a"]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs(spark, EDGES), chain).count() == len(EDGES)


# ---- secrets

HEX = hashlib.sha1(b"x").hexdigest()
SECRETS = [
    f'token = "{HEX}" and PassWord:abcdef', "token:token:abcdefgh", "token=secret=abcdefgh", "api_key='abc' apikey = abcdef", "AKIA" + "A1" * 10, "AKIAAKIA", "AKIA" * 5,
    f"é{HEX}é{HEX[:23]} {HEX[:24]}", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", f"token: {HEX} " * 700, "passwd\n=\nabcdef", "SECRET  :  +/_.=-",
]


def naive_secrets(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_against_python(spark):
    texts = [*EDGES, *SECRETS]
    rows = secrets.find_secrets(docs(spark, texts), spans_col="found").collect()
    assert len(rows) == len(texts) and rows[0].spans == "y" and rows[0]["__key"] == "z"
    for r in rows:
        base = [(s.start, s.rule, s.stop) for s in r.found if s.rule < 3]
        assert base == naive_secrets(texts[r.doc_id] or "")
    kinds = {secrets.RULES[s.rule].kind for r in rows for s in r.found}
    assert {"github", "pem"} <= kinds


def test_secret_plan_stays_in_the_jvm(spark):
    plan = secrets.find_secrets(docs(spark, SECRETS))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secrets_beside_columns_of_maps(spark):
    rows = spark.createDataFrame([(1, "token = abcdefgh", [{"a": 1}], ({"b": 2},)), (2, None, None, None)], "doc_id long, text string, tags array<map<string,int>>, more struct<inner:map<string,int>>")
    found = {r.doc_id: r for r in secrets.find_secrets(rows).collect()}
    assert [s.rule for s in found[1].spans] == [0] and found[1].tags == [{"a": 1}] and found[2].spans == []


def test_redaction_joins_overlapping_spans(spark):
    frame = secrets.find_secrets(docs(spark, [f"a token={HEX} b", "none", None]), spans_col="found")
    got = {r.doc_id: r.t for r in frame.select("doc_id", secrets.redacted(F.col("text"), F.col("found")).alias("t")).collect()}
    assert got == {0: "a [secret] b", 1: "none", 2: None}


def test_secrets_of_an_empty_table(spark):
    assert secrets.find_secrets(docs(spark, []), spans_col="found").count() == 0


@pytest.mark.parametrize(("pattern", "query"), [("abcd", [{"abc", "bcd"}]), ("ab|cde", [set()]), ("abc|xyz", [{"abc"}, {"xyz"}]), ("[0-9]+abc", [{"abc"}]), ("(ab){2,}c", [set()]), ("ab?cd", [{"abc", "bcd"}, {"acd"}]), ("[a-z]{20}", [set()])])
def test_trigram_queries(pattern, query):
    assert set(trigrams.query_of(pattern)) == {frozenset(c) for c in query}


@settings(max_examples=100, deadline=None)
@given(st.from_regex(re.compile(secrets.BASE_RULES[0].pattern, re.A), fullmatch=True))
def test_matches_satisfy_their_query(text):
    held = {text.lower()[i : i + 3] for i in range(len(text) - 2)}
    assert any(c <= held for c in trigrams.query_of(secrets.BASE_RULES[0].pattern))


# ---- pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


PIECES = [*EDGES, "  two  spaces \n x\t12345 é 漢字梦 \U0001f600  ", "aaaaaaaaaaaaaaaa ---- ==== !!!!", "x" * 300 + " " * 41 + "\n\n\n", "<0x0A><s>", "def f(x):\n        return x+1\n", "▁"]


def units_of(model, texts):
    return sorted({u for t in texts if t for u in model.units(model.split(t))[0].to_pylist()})


@pytest.mark.parametrize("most", [pieces.FREQUENT, 3, 0])
def test_pieces_equal_the_library(spark, library, most):
    rows = pieces.encode(docs(spark, PIECES), most=most).collect()
    assert len(rows) == len(PIECES)
    for r in rows:
        text = PIECES[r.doc_id]
        assert r.ids == (None if text is None else library.encode(text))
        assert r.n_pieces == len(r.ids or []) and r.round_trip == (text is None or "▁" not in text)


def test_pieces_of_empty_tables_and_repeated_rows(spark, library):
    assert pieces.encode(docs(spark, [])).count() == 0
    rows = docs(spark, ["a house", "a house", None]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.n_pieces for r in pieces.encode(rows, most=0).collect()) == [0, *[len(library.encode("a house"))] * 2]


def test_relational_lattice_equals_the_fold(spark, library):
    model = loaded()[0]
    rng = np.random.default_rng(5)
    names = [p for p in model.pieces if len(p) > 1]
    made = {"".join(rng.choice(names, 3))[:60] for _ in range(1500)} | {"▁" + "".join(rng.choice(list("etaoinshrdlu"), 12)) for _ in range(1500)}
    units = sorted({*units_of(model, PIECES), *made, *("▁" * n for n in range(1, 40)), "▁unbelievable", "qé漢", "\x00"} - {u for u in units_of(model, PIECES) if len(u) > pieces.LONGEST})
    frame = spark.createDataFrame([(u, 1) for u in units], "unit string, n long").repartition(4, "unit")
    got = {r.unit: r.ids for r in pieces.viterbi(pieces.lattice(frame, model), model).collect()}
    assert got == {u: model.encode_unit(u) for u in units}


def test_lattice_is_grouped_where_it_lies_and_stays_in_the_jvm(spark):
    model = loaded()[0]
    frame = spark.createDataFrame([("a", 1)], "unit string, n long").repartition(4, "unit")
    plan = pieces.viterbi(pieces.lattice(frame, model), model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and not re.search("Python|Pandas|InArrow", plan)


def test_edges_fold_in_order_of_rank_only_where_that_is_the_encoding(spark, library):
    model = loaded()[0]
    assert pieces.in_order(model)
    marks = spark.createDataFrame([("▁" * n + end, 1) for n in range(1, 60) for end in ("", "house")], "unit string, n long").repartition(4, "unit")
    edges = pieces.lattice(marks, model)
    assert not {"first", "last"} & set(edges.columns)  # no parts are carried along
    assert {r.unit: r.ids for r in pieces.viterbi(edges, model).collect()} == {r.unit: model.encode_unit(r.unit) for r in marks.collect()}
    tied = dataclasses.replace(model, stable={}, pieces={p: (i, s) for i, (p, s) in enumerate([("▁", -9.0), ("a", -9.0), ("b", -9.0), ("c", -9.0), ("ab", -1.0), ("bc", -1.0), ("abc", -1.0), ("abcab", -1.0)])})
    assert not pieces.in_order(tied)
    assert not pieces.in_order(dataclasses.replace(tied, pieces={"a": (0, -9.0), "aa": (1, -2.0), "aaa": (2, -1.0), "aaaa": (3, -1.0)}))
    got = pieces.encodings(docs(spark, ["abcabcab bcbcab cabab", "aabcabc"]), tied).collect()
    assert len(got) == 4 and all(r.ids == [i for p in tied.merged(r.unit) for i in tied.ids(p[0])] for r in got)


def test_units_are_found_without_hashing_the_table_anew(monkeypatch):
    model = loaded()[0]
    words = model.words_in(["the house of the  \n漢字 house ▁ zzzyx", None, "é"])
    known = pieces.table_of(words.units, pa.array([[i] for i in range(len(words.units))], pa.list_(pa.int32()))).hashed()
    asked = []
    index = pieces._index
    monkeypatch.setattr(pieces, "_index", lambda units, among: asked.append(len(among)) or index(units, among))
    assert known.units.take(pa.array(known.find(words.units))).equals(words.units) and not asked
    wanted = pa.array(["nowhere", *known.units.to_pylist()[::-1], "", "more"])
    both = known + pieces.Table(pa.array(["more", "some"]), pa.array([[7], [8]], pa.list_(pa.int32())))
    want = [-1, *range(len(known.units))[::-1], -1, len(known.units)]
    assert both.find(wanted).tolist() == want and asked == [2]
    assert known.find(wanted.slice(1, 3)).tolist() == want[1:4] and known.find(wanted.slice(0, 0)).tolist() == []
    monkeypatch.setattr(pieces, "hashes", lambda texts: np.zeros(len(texts), np.uint64))
    same = pieces.Table(known.units, known.ids).hashed() + pieces.Table(both.units.slice(len(known.units)), both.ids.slice(len(known.units)))
    assert same.find(wanted).tolist() == want  # all share a hash


@functools.cache
def loaded():
    return pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdeinorst .,-\n▁é漢"), max_size=60))
def test_any_text_equals_the_library(text):
    model, sp = loaded()
    units = sorted(set(model.units(model.split(text))[0].to_pylist()))
    tables = [pieces.unwritten(pa.array([" ".join([u, *map(str, model.encode_unit(u))]) for u in part], pa.string())) for part in (units[::2], units[1::2] * 2)]
    got, sizes, back = pieces.encode_texts([text, None, text], model, tables[0] + tables[1])
    ids = got[: sizes[0]].tolist()
    assert list(sizes) == [len(ids), 0, len(ids)] and got[sizes[0] :].tolist() == ids and back[0] == back[2] == b"".join(model.texts[i] for i in ids)
    assert ids == sp.encode(text)
    if "▁" not in text:
        assert model.decode(ids) == text


def test_decode_gives_the_text_again(spark):
    rows = pieces.decode(pieces.encode(docs(spark, PIECES[:-1])).select("doc_id", "ids")).collect()
    assert {r.doc_id: r.text for r in rows} == dict(enumerate(PIECES[:-1]))


def test_folds_follow_crc32(spark):
    from colloquy.llm.common import fold_of

    got = {r.i: r.f for r in spark.range(50).select(F.col("id").alias("i"), fold_of("id", 4).alias("f")).collect()}
    assert all(f == zlib.crc32(str(i).encode()) % 4 for i, f in got.items())
