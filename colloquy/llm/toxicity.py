"""Toxicity categories by a classifier chain.

Categories are predicted one after the other: each has a linear model over the
presence of words and word beginnings, and every model after the first also sees the probabilities
that the earlier ones give. In training those are out-of-fold predictions, so
that a later model learns from probabilities as good as it will meet.

The labels mark toxic texts but no category, so that the categories are found in
them: the terms that stand in toxic texts far more often than in others are split
into factors by non-negative matrix factorisation of their presence in the toxic
texts. A toxic text belongs to its strongest factor, or to ``other`` if it has none
of these terms. No list of words is used, and texts of any language count. The last
category of the chain is the mark itself.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, fit_logistic, hashed_sample, map_batches, sigmoid

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

@dataclass
class Chain:
    categories: list[str]
    #: Words and beginnings; see :func:`terms_of`.
    terms: dict[bytes, int]
    #: Row by term, column by category.
    weights: np.ndarray
    #: Row by earlier category, column by category; 0 where not earlier.
    links: np.ndarray
    intercepts: np.ndarray
    #: By found category its strongest terms.
    leading: dict[str, list[bytes]] = field(default_factory=dict)

    def predict(self, linear: np.ndarray) -> np.ndarray:
        """Probabilities, category after category, from the terms' sums."""
        out = np.zeros_like(linear)
        for k in range(len(self.categories)):
            out[:, k] = sigmoid(linear[:, k] + out[:, :k] @ self.links[:k, k] + self.intercepts[k])
        return out


def words_of(text: bytes) -> set[bytes]:
    return set(_WORD.findall(text.lower()))


def terms_of(text: bytes) -> set[bytes]:
    """The text's words, and with a star the first 4, 5 and 6 bytes of longer ones, so that inflected forms meet."""
    words = words_of(text)
    return words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in (4, 5, 6)))


def factors(x: np.ndarray, n: int, rounds: int = 200, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative (rows by n, n by columns) whose product comes near ``x``; multiplicative updates."""
    rng = np.random.default_rng(seed)
    left, right = rng.random((x.shape[0], n)) + 0.1, rng.random((n, x.shape[1])) + 0.1
    for _ in range(rounds):
        right *= (left.T @ x) / (left.T @ left @ right + 1e-9)
        left *= (x @ right.T) / (left @ (right @ right.T) + 1e-9)
    return left, right


def categories_of(x: np.ndarray, toxic: np.ndarray, n: int, telling: int = 200, apart: float = 0.02) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Marks of ``n`` found categories and of other toxic texts; and the columns of each category, strongest first.

    Columns of ``x`` whose share in toxic texts is over that in others by ``apart``
    are factored, ``telling`` of them at most.
    """
    yes, no = toxic > 0, toxic == 0
    found = [np.zeros(len(x)) for _ in range(n + 1)]
    if not yes.any():
        return found, [np.empty(0, np.int64)] * n
    gain = x[yes].mean(0) - (x[no].mean(0) if no.any() else 0.0)
    columns = np.argsort(-gain, kind="stable")[:telling]
    columns = columns[gain[columns] > apart]
    rows = np.flatnonzero(yes)
    if not len(columns):
        found[n][rows] = 1.0
        return found, [np.empty(0, np.int64)] * n
    left, right = factors(x[np.ix_(rows, columns)].astype(np.float64), n)
    scaled = left * right.sum(1)
    which = np.where(x[np.ix_(rows, columns)].any(1), scaled.argmax(1), n)
    for k in range(n + 1):
        found[k][rows[which == k]] = 1.0
    return found, [columns[np.argsort(-r, kind="stable")[:10]] for r in right]


def fit(texts: list[bytes], toxic: np.ndarray, width: int = 1024, categories: int = 4, folds: int = 4, l2: float = 1e-3, seed: int = 10) -> Chain:
    """``width``: so many terms at most, those whose presence tells toxic from other texts best (chi-square). ``categories``: how many are found in the toxic texts."""
    found = [terms_of(t) for t in texts]
    yes, no = Counter(), Counter()
    for words, mark in zip(found, toxic):
        (yes if mark else no).update(words)
    n_yes, n_no = max(1.0, toxic.sum()), max(1.0, len(toxic) - toxic.sum())
    share = {w: (yes[w] + no[w]) / len(toxic) for w in {*yes, *no} if yes[w] + no[w] >= 3}
    apart = {w: (yes[w] / n_yes - no[w] / n_no) ** 2 / (p * (1 - p)) for w, p in share.items() if p < 1}
    chosen = sorted(apart, key=lambda w: (-apart[w], w))[:width]
    columns = {w: i for i, w in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for i, words in enumerate(found):
        x[i, [columns[w] for w in words if w in columns]] = 1.0
    found_marks, leading = categories_of(x, toxic, categories)
    names = [*(f"category{k + 1}" for k in range(categories)), "other", "toxic"]
    marks = [*found_marks, toxic.astype(float)]
    fold = np.random.default_rng(seed).integers(0, folds, len(texts))
    chain = Chain(names, columns, np.zeros((len(chosen), len(names))), np.zeros((len(names), len(names))), np.zeros(len(names)), {k: [chosen[j] for j in c] for k, c in zip(names, leading)})
    earlier = np.zeros((len(texts), 0), np.float32)
    for k, y in enumerate(marks):
        wide = np.hstack([x, earlier])
        w, b = fit_logistic(wide, y, l2=l2)
        chain.weights[:, k], chain.links[:k, k], chain.intercepts[k] = w[: len(chosen)], w[len(chosen) :], b
        if k + 1 < len(names):
            out = np.zeros(len(texts))
            for f in range(folds):
                if (fold == f).any():
                    wf, bf = fit_logistic(wide[fold != f], y[fold != f], l2=l2, rounds=200)
                    out[fold == f] = sigmoid(wide[fold == f] @ wf + bf)
            earlier = np.hstack([earlier, out[:, None].astype(np.float32)])
    return chain


def train(docs: DataFrame, labels: DataFrame, sample: int = 5_000, longest: int = 20_000, **options) -> Chain:
    """Fit on at most ``sample`` labelled texts of at most ``longest`` characters, half of them toxic where there are enough.

    Picked by the smallest hash of the id; both bounds hold at every size.
    Several marks of one id count as toxic if any is, several texts of one as the
    least of them. Null ids, marks and texts are left out.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = hashed_sample(marked.filter("toxic = 1"), "doc_id", sample // 2, 10).unionByName(hashed_sample(marked.filter("toxic <> 1"), "doc_id", sample // 2, 10))
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter(F.length("text") <= longest).join(F.broadcast(picked), "doc_id")
    got = sorted(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect())
    return fit([r.text.encode("utf-8", "surrogatepass") for r in got], np.array([r.toxic for r in got], float), **options)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, one probability per category, score and predicted, for every row of ``docs`` (doc_id, text).

    score is the chain's last probability, predicted 1 where it reaches the
    threshold. Null and empty texts have no words and get the intercepts' scores.
    A narrow map without a shuffle; null ids and repeated rows stay; an empty table
    gives none. Without labels all texts get the same score.
    """
    names = [f"p_{k}" for k in chain.categories[:-1]]
    arrow = pa.schema([("doc_id", pa.int64()), *[(n, pa.float64()) for n in names], ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batch: pa.RecordBatch) -> dict:
        c = shared.value
        linear = np.zeros((batch.num_rows, len(c.categories)))
        for i, text in enumerate(binary_values(batch, "text")):
            if on := [c.terms[w] for w in c.terms.keys() & terms_of(text)]:
                linear[i] = c.weights[sorted(on)].sum(0)
        p = c.predict(linear)
        return {"doc_id": batch.column("doc_id"), "score": p[:, -1], "predicted": (p[:, -1] >= threshold).astype(np.int32)} | {n: p[:, k] for k, n in enumerate(names)}

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(picked, run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", score double, predicted int", arrow)
