"""Approximate nearest neighbours with learned partitions.

A bounded sample's neighbour graph is cut into balanced parts, a small classifier
learns the part of a vector from those of its neighbours, and it then files every
vector under its likeliest part and sends every query to several, and to more where
those hold too few. Parts grow in number with the vectors, so that a query meets a
smaller share of more vectors: where one cut would make too many, each of its parts
is cut again, by a classifier learned from a sample of that part. Within a part,
blocks of vectors meet blocks of queries and are ranked exactly.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hashed_sample, materialize

#: Vectors, or queries, in a block: bounds what a task holds.
BLOCK = 4096
#: Numbers in an array that is made for a slice of queries: 32 MB in doubles.
_TABLE = 1 << 22
#: Vectors that a part is meant to hold, and the parts of one cut: at most CUT, or CUT_TWICE each where parts are cut again.
PART, FEWEST, CUT, CUT_TWICE = 1024, 8, 64, 256


@dataclass
class Router:
    """One hidden layer; ``scale`` brings vectors to about unit length."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2

    def likeliest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` likeliest parts, likeliest first."""
        return np.argsort(-self.log_odds(x), axis=1, kind="stable")[:, :n]


def _log_shares(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


@dataclass
class Index:
    """A router, and for each of its parts one that tells ``each`` smaller parts apart (None: all in the first)."""

    top: Router
    below: list[Router | None]
    each: int = 1

    @property
    def parts(self) -> int:
        return self.top.w2.shape[1] * self.each

    def file(self, x: np.ndarray) -> np.ndarray:
        """Each vector's part: the likeliest of the likeliest."""
        part = self.top.likeliest(x, 1)[:, 0]
        if self.each == 1:
            return part
        out = part * self.each
        for p in np.unique(part):
            if self.below[p] is not None:
                rows = np.flatnonzero(part == p)
                out[rows] += self.below[p].likeliest(x[rows], 1)[:, 0]
        return out

    def likeliest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` likeliest parts of each vector, likeliest first."""
        if self.each == 1:
            return self.top.likeliest(x, n)
        out = []
        for a in range(0, len(x), 256):  # bounds the table of all parts
            rows = x[a : a + 256]
            odds = np.repeat(_log_shares(self.top.log_odds(rows)), self.each, axis=1)
            for p, router in enumerate(self.below):
                first = p * self.each
                if router is None:
                    odds[:, first + 1 : first + self.each] = -np.inf
                else:
                    odds[:, first : first + self.each] += _log_shares(router.log_odds(rows))
            out.append(np.argsort(-odds, axis=1, kind="stable")[:, :n])
        return np.concatenate(out) if out else np.empty((0, n), np.int64)


def parts_for(rows: int) -> tuple[int, int]:
    """Parts of the first cut and of each second one, powers of two, for so many vectors."""
    wanted = max(FEWEST, -(-rows // PART))
    k = (wanted - 1).bit_length()
    if 1 << k <= CUT:
        return 1 << k, 1
    return min(CUT_TWICE, 1 << (k + 1) // 2), min(CUT_TWICE, 1 << k // 2)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each vector's k others of the largest inner product."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 512] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else out[a : a + 512]
    return out


def _halves(nodes: np.ndarray, links: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which of ``nodes`` fall in the second half: median of a smooth vector on the graph, then swaps that cut fewer links."""
    n = len(nodes)
    place = np.full(int(max(links.max(), nodes.max())) + 1, -1)
    place[nodes] = np.arange(n)
    source = np.repeat(np.arange(n), links.shape[1])
    target = place[links[nodes].ravel()]
    inside = target >= 0
    source, target = np.concatenate([source[inside], target[inside]]), np.concatenate([target[inside], source[inside]])
    degree = np.maximum(np.bincount(source, minlength=n), 1)
    v = rng.standard_normal(n)
    for _ in range(40):
        v = 0.5 * v + 0.5 * np.bincount(source, v[target], minlength=n) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        across = np.bincount(source, side[source] != side[target], minlength=n)
        gain = 2 * across - np.bincount(source, minlength=n)
        ones, zeros = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (side, ~side))
        m = min(len(ones), len(zeros), max(1, n // 20))
        moves = int((gain[ones[:m]] + gain[zeros[:m]] > 2).sum())
        if not moves:
            break
        kept = side.copy()
        side[ones[:moves]], side[zeros[:moves]] = False, True
        if (side[source] != side[target]).sum() >= (kept[source] != kept[target]).sum():
            return kept
    return side


def balanced_parts(links: np.ndarray, parts: int, seed: int = 6) -> np.ndarray:
    """Part of each node: halved again and again, so that sizes differ by one at most at each cut. ``parts``: a power of two."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(links))]
    while len(groups) < parts:
        cut = []
        for g in groups:
            side = _halves(g, links, rng) if len(g) > 1 and links.size else np.arange(len(g)) % 2 == 1
            cut += [g[~side], g[side]]
        groups = cut
    out = np.empty(len(links), np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


def fit_router(x: np.ndarray, wanted: np.ndarray, hidden: int = 128, epochs: int = 60, seed: int = 6) -> Router:
    """Adam on the cross-entropy to ``wanted``, rows of probabilities."""
    rng = np.random.default_rng(seed)
    scale = 1.0 / max(float(np.sqrt((x**2).sum(1).mean())), 1e-30)
    w = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2.0), np.zeros(hidden), rng.standard_normal((hidden, wanted.shape[1])) / np.sqrt(hidden), np.zeros(wanted.shape[1])]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            rows = order[a : a + 128]
            z = x[rows] * scale @ w[0] + w[1]
            h = np.maximum(z, 0.0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(1, keepdims=True))
            gap = (p / p.sum(1, keepdims=True) - wanted[rows]) / len(rows)
            back = (gap @ w[2].T) * (z > 0)
            t += 1
            for i, g in enumerate(((x[rows] * scale).T @ back, back.sum(0), h.T @ gap, gap.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(scale, *w)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector, without null ids and without null, zero or non-finite vectors and those not of the commonest length."""
    v = F.col("vector")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    length = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("vector") == (length.n if length else 0))


def probes_for(index: Index, filed: np.ndarray, asked: np.ndarray, k: int, recall: float) -> int:
    """The fewest parts per query that hold ``recall`` of the k true nearest of ``asked`` among ``filed``; queries are taken in slices, so that no table by query and part is larger than _TABLE."""
    home, met, n = index.file(filed), np.zeros(index.parts, np.int64), 0
    step = max(1, _TABLE // max(index.parts, len(filed)))
    for a in range(0, len(asked), step):
        some = asked[a : a + step]
        true = np.argpartition(-(some @ filed.T), min(k, len(filed)) - 1, axis=1)[:, :k]
        rank = np.argsort(index.likeliest(some, index.parts), axis=1)  # of each part, by query
        met += np.bincount(np.take_along_axis(rank, home[true], axis=1).ravel(), minlength=index.parts)
        n += true.size
    return min(index.parts, int(np.searchsorted(met.cumsum() / n, recall)) + 1)


def learn(x: np.ndarray, parts: int, neighbours: int = 10, hidden: int = 128) -> Router:
    """Router of ``parts`` balanced parts of the neighbour graph of ``x`` (two vectors or more)."""
    links = neighbour_graph(x, neighbours)
    part = balanced_parts(links, parts)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(x)), links.shape[1]), part[links].ravel()), 1.0)
    wanted[np.arange(len(x)), part] += 0.5 * links.shape[1]
    return fit_router(x, wanted / wanted.sum(1, keepdims=True), hidden)


def _learn_below(vectors: DataFrame, top: Router, each: int, sample: int) -> list[Router | None]:
    """A router for each part of ``top``, learned where a sample of that part's vectors lies: ``sample`` of the smallest hash at most."""
    n = top.w2.shape[1]
    place = F.pmod(F.xxhash64("vec_id", F.lit(62)), F.lit(1 << 40))
    share = min(1.0, 4.0 * sample * n / max(vectors.count(), 1))
    filed = routed(vectors.filter(place < int(share * (1 << 40))), Index(top, [], 1))
    first = Window.partitionBy("part").orderBy(place, "vec_id")
    few = filed.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample)

    def fit_part(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(list(rows.sort_values("rank")["vector"])).astype(np.float64)
        router = learn(x, each, hidden=64) if len(x) > 1 else None
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "router": [pickle.dumps(router)]})

    found = {r.part: pickle.loads(r.router) for r in few.groupBy("part").applyInPandas(fit_part, "part int, router binary").collect()}
    return [found.get(p) for p in range(n)]


def fit(vectors: DataFrame, parts: int | None = None, sample: int = 8_192, below: int = 4_096, k: int = 20, recall: float = 0.93) -> tuple[Index, int] | None:
    """Index and number of parts to ask, on vectors (vec_id, vector); ``parts`` by default as their number asks (:func:`parts_for`).

    Learned from the ``sample`` vectors of the smallest hash of the id, and where
    parts are cut again from ``below`` vectors of each at most: CUT_TWICE routers,
    of some hundred kilobytes, are the most that is collected and broadcast. Up to
    as many vectors, which nothing is learned from, tell how many parts reach
    ``recall``: an eighth of them asks for the others. None where there are fewer
    than two vectors.
    """
    n = vectors.count()
    rows = hashed_sample(vectors, "vec_id", 2 * sample, 6).collect()
    if len(rows) < 2:
        return None
    x = np.array([r.vector for r in rows], np.float64)
    used = min(sample, -(-len(x) * 3 // 4))
    x, apart = x[:used], x[used:]
    first, each = (parts, 1) if parts else parts_for(n)
    top = learn(x, first)
    index = Index(top, [], 1)
    if each > 1:
        known = vectors.sparkSession.createDataFrame([(r.vec_id,) for r in rows[used:]], "vec_id long")
        index = Index(top, _learn_below(vectors.join(F.broadcast(known), "vec_id", "left_anti"), top, each, below), each)
    asked, filed = apart[: len(apart) // 8], apart[len(apart) // 8 :]
    return index, probes_for(index, filed, asked, k, recall) if len(asked) and len(filed) else index.parts


def routed(vectors: DataFrame, index: Index, probes: int = 0, after: int = 0) -> DataFrame:
    """``vectors`` (vec_id, vector and others) with column part: the one it is filed under, or a row for each of the ``probes`` likeliest but the first ``after``."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    asked, index_parts = probes - after if probes else 1, index.parts

    def run(batches):
        for whole in batches:
            if not whole.num_rows:
                continue
            # What is given at a time holds _TABLE numbers at most, and so do tables by row and part, however many parts are asked.
            length = len(whole.column("vector")[0])
            step = max(1, min(BLOCK, _TABLE // max(asked * length, index_parts if probes else 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = batch.column("vector")
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                found = shared.value.likeliest(x, probes)[:, after:] if probes else shared.value.file(x)[:, None]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(found.ravel().astype(np.int32))], names=[*batch.schema.names, "part"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, part int")


def nearest(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best ids among a block's vectors other than of its own id: product in doubles, ties to the smaller id.

    An id's rows count once, at their best score, before the cut to k. Of a query
    with a ``bound`` only scores that reach it are given.
    """
    if queries.empty or vectors.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    vectors = vectors.sort_values("vec_id", kind="stable")
    q, v = (np.stack(list(x["vector"])).astype(np.float64) for x in (queries, vectors))
    own, ids = queries["vec_id"].to_numpy(), vectors["vec_id"].to_numpy()
    bounds = queries["bound"].fillna(-np.inf).to_numpy(np.float64)
    first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))  # each id's first row
    slack = 1e-12 * np.abs(q).sum(1).max() * np.abs(v).max()
    whose, found, scores = [], [], []
    for a in range(0, len(q), 256):
        rough = q[a : a + 256] @ v.T
        rough[own[a : a + 256, None] == ids[None, :]] = -np.inf
        by_id = rough if len(first) == len(v) else np.maximum.reduceat(rough, first, axis=1)
        at = min(k, len(first)) - 1
        limit = -np.partition(-by_id, at, axis=1)[:, at]
        for i, row in enumerate(rough):
            held = np.flatnonzero((row >= max(limit[i], bounds[a + i]) - slack) & (row > -np.inf))
            score = (v[held] * q[a + i]).sum(1)  # the same order of sums for every vector: equal vectors tie
            held, score = held[score >= bounds[a + i]], score[score >= bounds[a + i]]
            best = np.lexsort((-score, ids[held]))
            best = best[np.diff(ids[held][best], prepend=ids[0] - 1) != 0]  # of each id the best row; none of no rows
            best = best[np.lexsort((ids[held][best], -score[best]))][:k]
            whose.append(np.full(len(best), own[a + i]))
            found.append(ids[held][best])
            scores.append(score[best])
    return pd.DataFrame({"query_id": np.concatenate(whose), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})


def search(vectors: DataFrame, is_query: Column, k: int = 20, parts: int | None = None, recall: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row for which ``is_query`` (of vec_id) holds.

    Nearest: the largest inner product, in doubles; ties go to the smaller id. All
    rows but the query's own are candidates. Rows of one id count as one vector,
    at its best score. Vectors that :func:`usable` leaves out take no part. A query
    first asks the likeliest few of its parts, the root of their number; the others
    then give only what reaches the k-th score found, which loses nothing and keeps
    the rows found from growing with the parts asked. Queries
    whose parts hold fewer than k ids are sent on, to twice as many parts each time,
    until they have k or all parts were asked: where there are fewer than k
    candidates, all are returned; an empty table gives no rows. ``parts``: by default
    as many as the vectors ask for. A part's vectors and queries are dealt into
    blocks of ``BLOCK`` by a hash of the id, however many a part has; only the
    counts by part (at most CUT_TWICE squared rows) come to the driver.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, id_col, vector_col)
    fitted = fit(kept, parts, k=k, recall=recall)
    schema = "query_id long, vec_id long, score double"
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, probes = fitted
    filed, queries = routed(kept, index), kept.filter(is_query)

    def blocks_of(df: DataFrame, name: str) -> DataFrame:
        """(part, blocks), as a table of literals."""
        counts = df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name)).collect()
        return F.broadcast(spark.createDataFrame(counts, f"part int, {name} int"))

    n_filed = blocks_of(filed, "filed")

    def dealt(df: DataFrame, sizes: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        """Each row goes to one block of its own side, which meets every block of the other."""
        rows = df.join(sizes, "part").withColumn(names[0], F.pmod(F.xxhash64("vec_id", F.lit(61)), F.col(own)).cast("int"))
        return rows.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)

    def near(asked: DataFrame) -> DataFrame:
        sizes = F.broadcast(n_filed.join(blocks_of(asked, "asked"), "part"))  # parts that hold both
        right = dealt(filed, sizes, "filed", "asked", ("block", "ask")).groupBy("part", "block", "ask")
        left = dealt(asked, sizes, "asked", "filed", ("ask", "block")).groupBy("part", "block", "ask")
        return left.cogroup(right).applyInPandas(lambda q, v: nearest(q, v, k), schema)

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return materialize(once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")

    done = math.isqrt(probes)
    best = ranked(near(routed(queries.withColumn("bound", F.lit(None).cast("double")), index, done)))
    while done < index.parts:
        full = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        asked, upto = queries.join(full, "vec_id", "left").select("vec_id", "vector", "bound"), probes
        if done >= probes:
            asked, upto = asked.filter("bound IS NULL"), min(index.parts, 2 * done)
            if asked.isEmpty():
                break
        had, best = best, ranked(best.select("query_id", "vec_id", "score").unionByName(near(routed(asked, index, upto, done))))
        discard(had)
        done = upto
    return best
