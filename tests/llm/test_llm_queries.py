"""The registered queries on the smallest tables: columns, folds and digests as the contracts put them."""

import hashlib
import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import common, oracles, pieces, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, columns):
    got = queries.queries()[name](spark, SF)
    assert got.columns[: len(columns.split())] == columns.split() or set(columns.split()) <= set(got.columns)
    return got.collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_op1(spark, documents):
    got = rows(spark, "op1_license_scan", "doc_id n_words n_base first_word last_word base_labels labels score")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels) and 0 <= r.score <= 1


def test_op2(spark, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in rows(spark, "op2_decontamination", "doc_id item_id score first_word last_word")}
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    texts = {d: f" {plain(r.text)} " for d, r in documents.items()}
    assert {(d, i) for i, t in items.items() for d, text in texts.items() if len(plain(t).split()) >= 3 and f" {plain(t)} " in text} <= got


def test_op3(spark, documents):
    import xxhash

    for r in rows(spark, "op3_simhash", "doc_id fingerprint component_id"):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), documents[r.doc_id].text or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert r.fingerprint == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}" and r.component_id <= r.doc_id


def test_op4(spark, documents):
    got = rows(spark, "op4_quality", "doc_id score predicted held_out")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    unseen = [(r.score, marks[r.doc_id]) for r in queries.op4_quality(spark, "/root/testdata/sf0.01").filter("held_out").collect() if marks.get(r.doc_id) is not None]
    good, bad = ([s for s, m in unseen if m == k] for k in (1, 0))
    assert len(bad) > 5 and np.mean([[a > b for b in bad] for a in good]) > 0.97  # the area under the curve


def test_op5(spark, documents):
    got = rows(spark, "op5_language_id", "doc_id lang_pred score held_out")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1
    told = [(r.lang_pred, documents[r.doc_id].lang) for r in got if r.held_out and documents[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean([a == b for a, b in told]) > 0.9


def test_op6(spark):
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got, hits = {}, []
    for r in rows(spark, "op6_ann", "query_id rank vec_id score"):
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-9) and r.vec_id != r.query_id
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert set(got) == {v for v in vectors if v % 20 == 0}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        nearest = sorted((-float(vectors[q] @ x), v) for v, x in vectors.items() if v != q)[:20]
        hits.append(len({v for _, v in nearest} & {f[2] for f in found}) / 20)
    assert np.mean(hits) >= 0.9


def test_op8_and_op10(spark, documents):
    encoded = queries.op8_sentencepiece(spark, SF)
    for r in encoded.collect():
        assert r.round_trip and r.n_pieces == len(r.ids or []) if documents[r.doc_id].text is not None else r.ids is None
    assert pieces.decode(encoded.filter("ids IS NOT NULL")).count() == sum(r.text is not None for r in documents.values())
    for r in rows(spark, "op10_toxicity", "doc_id score predicted"):
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op11(spark, documents):
    from test_llm_runs_pages_draws import digests

    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256"
    got = {r.doc_id: tuple(r[c] for c in columns.split()) for r in rows(spark, "op11_periodic_runs", columns)}
    short = {d: r.text for d, r in documents.items() if len(words(r.text)) < 400}
    assert len(short) > 100 and any(crc(d) % 10 == 0 for d in short)
    assert {d: got[d] for d in short} == {d: digests(d, t) for d, t in short.items()}
    assert set(got) == set(documents)


def test_op12(spark):
    for r in rows(spark, "op12_html_extraction", "page_id url text n_chars"):
        assert r.n_chars == len(r.text) and "\n\n" not in r.text and "  " not in r.text


def test_queries_equal_their_sql(spark):
    from test_queries import rows as plain_rows

    tables = duckdb.connect()
    for file in os.listdir(SF):
        tables.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    for name, sql in oracles.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), tables.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and plain_rows(got) == plain_rows(want), name


# ---- the quality model's parts


def test_lasso_is_at_its_optimum():
    """The conditions of the optimum: where a weight stands the gradient is the penalty, elsewhere it is no more."""
    rng = np.random.default_rng(14)
    x = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < common.sigmoid(x[:, 0] * 2 - x[:, 1] * 3 + 0.5)).astype(float)
    l1 = 0.02
    w, b = common.fit_logistic(x, y, l2=0.0, l1=l1, rounds=5000)
    gap = common.sigmoid(x @ w + b) - y
    gradient = x.T @ gap / len(y)
    on = np.abs(w) > 1e-9
    assert 1 <= on.sum() < 12 and abs(gap.mean()) < 1e-4
    assert np.allclose(gradient[on], -l1 * np.sign(w[on]), atol=1e-4) and (np.abs(gradient[~on]) <= l1 + 1e-4).all()


def test_paths_part_the_rows():
    """Every row follows one path to its end; a path's beginnings are paths; the first cut is the best of its columns' quantiles."""
    rng = np.random.default_rng(15)
    x, y = rng.random((300, 6)), rng.random(300)
    y[x[:, 2] > 0.6] += 2
    for seed in range(5):
        paths = quality.grow(x, y, 3, np.random.default_rng(seed))
        ends = [p for p in paths if not any(q != p and q[: len(p)] == p for q in paths)]
        assert (sum(quality.fires(x, p).astype(int) for p in ends) == 1).all()
        assert all(p[:-1] in paths or len(p) == 1 for p in paths) and all(len(p) <= 3 for p in paths)
        assert (quality.fires(x, paths[0]) == np.logical_and.reduce([(x[:, j] > c) == above for j, c, above in paths[0]])).all()
    firsts = {quality.grow(x, y, 1, np.random.default_rng(s))[0][0] for s in range(12)}
    assert any(j == 2 and abs(c - 0.6) < 0.05 for j, c, _ in firsts)


def test_rules_as_a_column_equal_the_model(spark, documents):
    frame = quality.statistics(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = frame.select("doc_id", *[F.col("stat")[k].alias(k) for k in quality.STATISTICS]).toPandas()
    x = got[list(quality.STATISTICS)].to_numpy(np.float64)
    y = np.array([len(documents[d].text or "") % 2 for d in got["doc_id"]], float)
    model = quality.fit(x, y, trees=10)
    place = {k: j for j, k in enumerate(quality.STATISTICS)}
    want = common.sigmoid(model.intercept + sum((r.weight * quality.fires(x, [(place[k], c, above) for k, c, above in r.tests]) for r in model.rules), np.zeros(len(x))))
    scored = {r.doc_id: r.s for r in frame.select("doc_id", model.score(F.col("stat")).alias("s")).collect()}
    assert np.allclose([scored[d] for d in got["doc_id"]], want)


def test_held_out_folds_are_by_the_id(spark):
    ids = [0, 1, -7, 2**40, 999_999]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", common.fold_of("doc_id", 4).alias("f"), F.sha2(F.lit("a"), 256).alias("s"))
    assert all(r.f == crc(r.doc_id) % 4 and r.s == hashlib.sha256(b"a").hexdigest() for r in frame.collect())
