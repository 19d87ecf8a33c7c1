"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on the statistics, every path from a root is a
conjunctive rule, a lasso logistic regression keeps a few of the rules, and those
are compiled into one Spark column expression, so that scoring stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, hashed_sample, sigmoid

#: A statistic's name and how it follows from the counts below.
STATISTICS = ("n_chars", "n_words", "word_length", "symbols", "bars", "capitals", "digits", "points", "lines", "distinct", "foreign", "marks")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with column ``stat``: a struct of doubles by the names in STATISTICS.

    A null text counts as empty; shares of an empty text are 0.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    counted = df.withColumn(
        "__counts",
        F.struct(
            F.length(t).cast("double").alias("chars"),
            F.octet_length(t).cast("double").alias("octets"),
            words.alias("words"),
            F.regexp_count(t, F.lit(r"[#$%&*@^~<>{}=_+\\/\[\]]+")).cast("double").alias("symbols"),
            F.regexp_count(t, F.lit(r"\|")).cast("double").alias("bars"),
            F.regexp_count(t, F.lit(r"[A-Z]")).cast("double").alias("capitals"),
            F.regexp_count(t, F.lit(r"[0-9]+")).cast("double").alias("digits"),
            F.regexp_count(t, F.lit(r"[.,;:?]")).cast("double").alias("points"),
            F.regexp_count(t, F.lit(r"\n")).cast("double").alias("lines"),
            F.regexp_count(t, F.lit(r"!+")).cast("double").alias("marks"),
        ),
    )
    c = F.col("__counts")
    # The words go no further than this projection.
    summed = counted.withColumn("__counts", c.withField("n", F.size(c["words"]).cast("double")).withField("distinct", F.size(F.array_distinct(c["words"])).cast("double")).dropFields("words"))
    n, chars = F.greatest(c["n"], F.lit(1.0)), F.greatest(c["chars"], F.lit(1.0))
    values = {
        "n_chars": c["chars"], "n_words": c["n"], "word_length": c["chars"] / n, "symbols": c["symbols"] / n, "bars": c["bars"] / n,
        "capitals": c["capitals"] / chars, "digits": c["digits"] / n, "points": c["points"] / n, "lines": c["lines"] / n,
        "distinct": c["distinct"] / n, "foreign": (c["octets"] - c["chars"]) / chars, "marks": c["marks"] / n,
    }
    return summed.withColumn("stat", F.struct(*[values[k].alias(k) for k in STATISTICS])).drop("__counts")


@dataclass(frozen=True)
class Rule:
    """All of its (statistic, threshold, above) hold: over the threshold, or else at most it."""

    tests: tuple[tuple[str, float, bool], ...]
    weight: float = 0.0


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, least: int = 10, cuts: int = 24) -> list[tuple[tuple[int, float, bool], ...]]:
    """Paths of one regression tree, inner nodes' included; splits are sought at quantiles of a random half of the columns."""
    paths = []

    def descend(rows: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least or np.ptp(y[rows]) == 0:
            return
        best = (1e-9, None)
        mean_all = y[rows].mean()
        for j in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            sums = np.cumsum(y[rows][order] - mean_all)
            for at in np.unique(np.linspace(least, len(rows) - least, cuts).astype(int)):
                low, high = v[order[at - 1]], v[order[at]]
                if low < high and (gain := sums[at - 1] ** 2 * (1 / at + 1 / (len(rows) - at))) > best[0]:
                    best = (gain, (int(j), float((low + high) / 2)))
            edges = np.flatnonzero(np.diff(v[order]) > 0) + 1  # sparse statistics: few distinct values
            for at in edges if len(edges) <= cuts else (edges[0], edges[-1]):
                if least <= at <= len(rows) - least and (gain := sums[at - 1] ** 2 * (1 / at + 1 / (len(rows) - at))) > best[0]:
                    best = (gain, (int(j), float((v[order[at - 1]] + v[order[at]]) / 2)))
        if best[1] is None:
            return
        j, cut = best[1]
        above = x[rows, j] > cut
        descend(rows[~above], (*path, (j, cut, False)))
        descend(rows[above], (*path, (j, cut, True)))

    descend(np.arange(len(y)), ())
    return paths


def fires(x: np.ndarray, path: tuple[tuple[int, float, bool], ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, cut, above in path:
        out &= (x[:, j] > cut) == above
    return out


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, stat: Column) -> Column:
        """The rules as one column expression over the struct of statistics."""
        total = F.lit(self.intercept)
        for r in self.rules:
            holds = F.lit(True)
            for name, cut, above in r.tests:
                holds = holds & ((stat[name] > cut) if above else (stat[name] <= cut))
            total = total + F.when(holds, F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, l1: float = 2e-3, seed: int = 4) -> RuleModel:
    """Boosted shallow trees on subsamples; their paths; lasso over all of them, 2 (2^depth - 1) a tree at most."""
    rng = np.random.default_rng(seed)
    paths: dict[tuple, None] = {}
    if len(y):
        margin = np.zeros(len(y))
        for _ in range(trees):
            rows = rng.choice(len(y), size=min(len(y), max(200, len(y) // 4)), replace=False)
            residual = y - sigmoid(margin)
            own = grow(x[rows], residual[rows], depth, rng)
            for p in own:
                paths.setdefault(tuple(sorted(p)))
            for p in own:  # every row falls in one leaf: the longest path that fires
                if not any(q != p and q[: len(p)] == p for q in own):
                    on = fires(x, p)
                    if on.any():
                        margin[on] += 0.5 * 4 * residual[on].mean()
    kept = list(paths)
    if not kept:
        return RuleModel((), fit_logistic(np.zeros((len(y), 1)), y)[1] if len(y) else 0.0)
    on = np.stack([fires(x, p) for p in kept], 1)
    _, unique = np.unique(on, axis=1, return_index=True)
    kept, on = [kept[i] for i in sorted(unique)], on[:, sorted(unique)].astype(np.float64)
    w, b = fit_logistic(on, y, l2=0.0, l1=l1, rounds=600)
    rules = tuple(Rule(tuple((STATISTICS[j], cut, above) for j, cut, above in p), float(k)) for p, k in zip(kept, w) if abs(k) > 1e-4)
    return RuleModel(rules, float(b))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 12_000, **options) -> RuleModel:
    """Fit on at most ``sample`` labelled rows, those of the smallest hash of the id.

    ``docs``: doc_id, text. ``labels``: doc_id and the label. Several labels of
    one id count as their majority (ties: 1), several texts of one as that of the
    least statistics. Null ids and labels are left out.
    The sampled ids (8 bytes each) are broadcast, so the documents aren't shuffled.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    picked = hashed_sample(marked, "doc_id", sample, 4)
    rows = statistics(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id"))
    once = rows.groupBy("doc_id").agg(F.min(F.struct("label", *[F.col("stat")[k].alias(k) for k in STATISTICS])).alias("row"))
    got = once.select("doc_id", "row.*").toPandas().sort_values("doc_id")
    return fit(got[list(STATISTICS)].to_numpy(np.float64), got["label"].to_numpy(np.float64), **options)


def classify(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs`` (doc_id, text); no Python, no shuffle.

    An empty or null text is scored by its statistics, all zero. Null ids and
    repeated rows stay; other columns are ignored.
    """
    scored = statistics(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", model.score(F.col("stat")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
