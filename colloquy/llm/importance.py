"""Importance resampling towards a target distribution.

Hashed word n-grams of a target text set and of the corpus give each bucket a gain,
the log of the ratio of its shares. A document's weight is the mean gain of its
n-grams; with a Gumbel variate of its id added, the documents of the highest scores
are a draw without replacement in proportion to the exponentials of the weights.

The k highest are found without a sort of all: the exact k-th key is selected digit
by digit, each digit by a distributed count of at most 65,536 values among the rows
that share the digits before. Only what is drawn is then sorted, by ranges, and
ranked by the sizes of the ranges.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, free_name, map_batches, materialize

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: So many features are hashed at a time, whatever the text's length.
_CHUNK = 1 << 16


def buckets_of(text: bytes, buckets: int) -> tuple[int, Iterator[np.ndarray]]:
    """The number of words, and the buckets of all runs of one and two words, in parts."""
    words = _WORD.findall(text.lower())  # bytes: A-Z only

    def parts() -> Iterator[np.ndarray]:
        crc, last = zlib.crc32, None
        for at in range(0, len(words), _CHUNK):
            some = words[at : at + _CHUNK]
            single = list(map(crc, some))
            before = [last, *single[:-1]] if last is not None else single[:-1]
            pairs = [crc(b" " + w, h) for w, h in zip(some if last is not None else some[1:], before)]
            last = single[-1]
            yield np.array(single + pairs, np.int64) % buckets

    return len(words), parts()


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over the column text: counted in each partition, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in binary_values(batch, "text"):
                for part in buckets_of(text, buckets)[1]:
                    counts += np.bincount(part, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(counts[some], pa.int64())})

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln of the ratio of shares), each bucket counted once more than it is, by bucket; one number for each reaches the driver."""
    counts = []
    for texts in (corpus, target):
        found = np.zeros(buckets)
        for r in bucket_counts(texts, buckets).collect():
            found[r.bucket] = r.n
        counts.append(found)
    (s, t), (all_s, all_t) = counts, [c.sum() + buckets for c in counts]
    return np.floor(1000 * np.log((t + 1) * all_s / ((s + 1) * all_t))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs`` (doc_id, text); weight is the mean gain, rounded down."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        gain, rows = shared.value, []
        for text in binary_values(batch, "text"):
            n, parts = buckets_of(text, len(gain))
            features = max(0, 2 * n - 1)
            rows.append((n, features, sum(int(gain[p].sum()) for p in parts) // features if features else 0))
        n_words, n_features, weight = zip(*rows)
        return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_features": n_features, "weight": weight}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_words long, n_features long, weight long", arrow)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate), from the first 32 bits of the SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _digit(key: Column, shift: int) -> Column:
    """16 bits of a signed number, such that digits order as the numbers do."""
    digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return digit.bitwiseXOR(F.lit(0x8000).cast("long")) if shift == 48 else digit


def first_k(rows: DataFrame, keys: list[Column], k: int) -> Column:
    """A condition that holds for exactly the ``k`` rows of the least keys, compared one after the other.

    ``rows`` is a written table, ``keys`` are long columns without nulls that together
    tell all rows apart. A scan finds what a key's values span; digits that all of
    them share are passed over. Each further scan counts one digit.
    """
    none, taken, tied, left = F.lit(False), F.lit(False), F.lit(True), k
    if k <= 0:
        return none
    for key in keys:
        low, high = rows.filter(tied).agg(F.min(key), F.max(key)).first()
        if low is None:
            return taken
        differ = (low ^ high) & ((1 << 64) - 1)
        for shift in (48, 32, 16, 0):
            if not differ >> shift:
                continue
            counts = sorted(map(tuple, rows.filter(tied).groupBy(_digit(key, shift).alias("digit")).count().collect()))
            for digit, n in counts:
                if n >= left:
                    break
                left -= n
            else:  # fewer rows than asked for: all
                return taken | tied
            taken, tied = taken | (tied & (_digit(key, shift) < digit)), tied & (_digit(key, shift) == digit)
            if n == left:
                return taken | tied
    return taken | tied


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` with their place from 1 in ``order``: sorted by ranges and written; a place is the number of rows in the ranges before and the place in its own."""
    place = free_name(rows, "__place")
    placed = materialize(rows.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "placed")
    part, own = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    before = rows.sparkSession.createDataFrame(starts, "__part long, __before long")  # a row for each range
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(rank, F.col("__before") + own + 1).select(*rows.columns, rank)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), towards ``target`` (text).

    Of the N rows of ``least_words`` words or more floor(percent N / 100) are drawn, of
    the highest scores, ties to the smaller id, then in any fixed order; they are ranked
    from 1, others have no rank. Null and empty texts have no features and weight 0; a null id has no score,
    does not count and is not drawn; repeated rows are rows. An empty table gives
    none, an empty target weighs by the corpus alone. Other columns are ignored.

    The corpus is read twice, once for the counts of buckets; neither scan shuffles
    texts. A row of numbers for each document is written to the shared folder.
    """
    scored = weights(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    table = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    pool = table.filter(eligible)
    chosen = first_k(pool, [F.bitwise_not("score"), F.col("doc_id"), F.col("row")], percent * pool.count() // 100)
    drawn = ranked(pool.filter(chosen), [F.desc("score"), F.asc("doc_id"), F.asc("row")], "rank")
    others = table.filter(~(eligible & chosen)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")
