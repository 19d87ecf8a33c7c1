"""Substring dedup: words in windows that stand twice are removed.

Every window of ``width`` words has an anchor, the least hash among its 8-word
n-grams; equal windows have equal anchors. Neighbouring windows of one anchor form
a run. Runs whose anchor stands once cannot hold a repeated window and go no
further. The others' texts, each different one once, are dealt by anchor to
shards; runs of an anchor that very many have are taken apart into windows, equal
ones combined by two hashes and counted before any of them is dealt. A shard
indexes its texts in a compressed FM-index and streams them
through it: matching statistics of at least ``width`` words whose rows stand for
two places or more are the repeated windows. Their intervals go back to the
documents over the runs.

A document is streamed to the shards of its own anchors only, so that work grows
with the corpus and not with the number of shards.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, discard, materialize, spread_join
from .fm_index import DEPTH, FMIndex

_GRAM = 8
#: Bytes hashed at a time (a longer word is taken whole).
_SLICE = 1 << 20
#: Words in a shard's texts, about.
SHARD = 500_000
#: Different runs of one anchor beyond which its windows are combined and dealt to shards one by one, by their own hash.
HOT = 2_000
#: What tells rows apart: two hashes of id and text, 96 bits.
_ROW = ["key", "salt"]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        known = _POWERS[int(base)] = (_powers(base, max(n, 1 << 16)), _powers(_inverse(base), max(n, 1 << 16)))
    return known


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _STEP
    return h ^ (h >> np.uint64(32))


def _spans_hash(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of values[begins[i]:ends[i]], the same wherever it stands."""
    power, inverse = _tables(base, len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)))
    return _mixed((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``text``, slice after slice."""
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + _SLICE)
        while stop < len(text) and not _SPACE[text[stop]]:
            stop += 1
        part = np.frombuffer(text, np.uint8, stop - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[part], [True])).view(np.int8)))
        out.append(_spans_hash(part.astype(np.uint64) + np.uint64(1), edge[::2], edge[1::2], _BASE))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` neighbours, the leftmost among equals."""
    n = len(values)
    place, span = np.arange(n), 1
    while span < width:
        by = min(span, width - span)
        left, right = place[: n - span - by + 1], place[by : n - span + 1]
        place = np.where(values[left] <= values[right], left, right)
        span += by
    return place


def runs_of(words: np.ndarray, document: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Runs over the word hashes of documents laid end to end.

    anchor, text (hash of the run's words), start (word), n (windows), times: how
    often the run repeats at once, one word further each time (n is 1 then).
    """
    names = ("anchor", "text", "start", "n", "times")
    if len(words) < width:
        return {k: np.empty(0, np.int64) for k in names}
    gram, step, span = words, int(_STEP), 1
    while span < _GRAM:
        gram = gram[:-span] + np.uint64(step) * gram[span:]
        step, span = step * step % (1 << 64), span * 2
    gram = _mixed(gram)
    place = _least(gram, width - _GRAM + 1)
    valid = document[: len(place)] == document[width - 1 :]
    new = valid & np.concatenate(([True], ~valid[:-1] | (place[1:] != place[:-1])))
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    n = np.bincount(run[valid], minlength=len(start))
    anchor = gram[place[start]]
    text = _spans_hash(words, start, start + n + width - 1, _BASE)
    again = np.zeros(len(start), bool)
    again[1:] = (n[1:] == 1) & (n[:-1] == 1) & (start[1:] == start[:-1] + 1) & (anchor[1:] == anchor[:-1]) & (text[1:] == text[:-1]) & (document[start[1:]] == document[start[:-1]])
    first = np.flatnonzero(~again)
    times = np.diff(np.append(first, len(start)))
    return {"anchor": anchor[first].view(np.int64), "text": text[first].view(np.int64), "start": start[first], "n": n[first], "times": times}


def _batches(texts: list[bytes]):
    """Positions of texts, about a slice's bytes at a time."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t)
        if size >= _SLICE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _group_runs(texts: list[bytes], width: int):
    """(positions of the texts, runs, each run's text in the group, word before which each text begins)."""
    for group in _batches(texts):
        parts = [word_hashes(texts[i]) for i in group] if len(group) == 1 else None
        if parts is None:
            hashes = word_hashes(b"\n".join(texts[i] for i in group))
            sizes = [len(texts[i].split()) for i in group]
        else:
            hashes, sizes = parts[0], [len(parts[0])]
        begins = np.concatenate(([0], np.cumsum(sizes)))
        document = np.repeat(np.arange(len(group)), sizes)
        runs = runs_of(hashes, document, width)
        yield group, runs, document[runs["start"]] if len(runs["start"]) else runs["start"], begins


_RUN = "key long, salt int, anchor long, text long, start int, n int, times int"
_RUN_ARROW = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("anchor", pa.int64()), ("text", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("times", pa.int32())])


def find_runs(docs: DataFrame, width: int) -> DataFrame:
    """Runs of docs (key, salt, doc), start counted within the document."""

    def run(batches):
        for batch in batches:
            keys, salts = (batch.column(c).to_numpy() for c in _ROW)
            for group, runs, which, begins in _group_runs(binary_values(batch, "doc"), width):
                rows = np.array(group)[which]
                columns = {"key": keys[rows], "salt": salts[rows], "anchor": runs["anchor"], "text": runs["text"], "start": runs["start"] - begins[which], "n": runs["n"], "times": runs["times"]}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _RUN_ARROW], schema=_RUN_ARROW)

    return docs.mapInArrow(run, _RUN)


_TEXT = "anchor long, text long, n int, at int, count long, first_hash long, second_hash long, words binary"
_TEXT_ARROW = pa.schema([("anchor", pa.int64()), ("text", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("count", pa.int64()), ("first_hash", pa.int64()), ("second_hash", pa.int64()), ("words", pa.binary())])


def run_texts(wanted: DataFrame, width: int) -> DataFrame:
    """The words of runs. ``wanted``: doc, runs (array of anchor, text, n, count, hot).

    A run of a hot anchor comes window by window (``at``, from 0), each with two
    hashes of its words; another whole, at -1. Runs that a row of ``wanted`` lacks,
    as one that shares the keys of another may, are that other's.
    """

    def run(batches):
        for batch in batches:
            rows = [[] for _ in _TEXT_ARROW]
            for doc, runs in zip(binary_values(batch, "doc"), batch.column("runs").to_pylist()):
                asked = {(r["anchor"], r["text"], r["n"]): r for r in runs}
                words = doc.split()
                found = runs_of(word_hashes(doc), np.zeros(len(words), np.int64), width)
                for anchor, text, start, n in zip(*(found[k].tolist() for k in ("anchor", "text", "start", "n"))):
                    r = asked.pop((anchor, text, n), None)
                    if r is None:
                        continue
                    if r["hot"]:
                        windows = [b" ".join(words[start + i : start + i + width]) for i in range(n)]
                        digests = [hashlib.blake2b(w, digest_size=16).digest() for w in windows]
                        own = [(i, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), w) for i, (d, w) in enumerate(zip(digests, windows))]
                    else:
                        own = [(-1, 0, 0, b" ".join(words[start : start + n + width - 1]))]
                    for at, one, two, w in own:
                        for column, value in zip(rows, (anchor, text, n, at, r["count"], one, two, w)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _TEXT_ARROW)], schema=_TEXT_ARROW)

    return wanted.mapInArrow(run, _TEXT)


def repeated_in_shard(words: list[bytes], counts: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """For each text of a shard, the intervals of its windows that stand twice or more; ``counts``: places each text stands for."""
    split = [w.split() for w in words]
    sizes = np.array([len(s) for s in split])
    codes = pd.factorize(np.array(list(chain.from_iterable(split)), dtype=object))[0] + 1
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    sequence = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(sequence), bool)
    inside[ends] = False
    sequence[inside] = codes
    index = FMIndex(sequence)
    length, low, high = index.matching_statistics(sequence, begins, ends, width)
    weight = np.repeat(counts, sizes + 1)
    stands = np.concatenate(([0], np.cumsum(np.append(weight, 0)[index.suffixes])))
    twice = (length >= width) & (stands[high] - stands[low] >= 2)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], twice & inside, [False])).view(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in words]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        i = int(np.searchsorted(begins, a, side="right")) - 1
        out[i].append((a - int(begins[i]), b - int(begins[i])))
    return out


def _shard_function(width: int):
    arrow = pa.schema([("anchor", pa.int64()), ("text", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("stop", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        rows = {(r["anchor"], r["text"], r["n"]): (r["count"], r["words"]) for r in table.to_pylist()}  # equal documents bring a text again
        found = repeated_in_shard([w for _, w in rows.values()], np.array([c for c, _ in rows.values()]), width)
        out = [(*run, a, b) for run, spans in zip(rows, found) for a, b in spans]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    return run


def shard_texts(sent: DataFrame, width: int, shard: int = SHARD) -> DataFrame:
    """(shard, anchor, text, n, count, words): what the shards get of :func:`run_texts`' rows, a text once each.

    Hot windows are counted by their two hashes, in the tasks that hold them before
    any shuffle, so that a window that stands in all documents is one row here; it
    has its hashes for anchor and text, and 0 for n. A shard has about ``shard`` words.
    """
    hot = sent.filter("at >= 0").groupBy(F.col("first_hash").alias("anchor"), F.col("second_hash").alias("text")).agg(F.lit(0).alias("n"), F.sum("count").alias("count"), F.first("words").alias("words"))
    texts = materialize(sent.filter("at < 0").select("anchor", "text", "n", "count", "words").unionByName(hot), "shard-texts")
    load = texts.agg(F.sum(F.greatest("n", F.lit(1)) + width - 1)).first()[0] or 0
    return texts.select(F.pmod("anchor", F.lit(int(load // shard) + 1)).cast("int").alias("shard"), "anchor", "text", "n", "count", "words")


def repeated_intervals(docs: DataFrame, width: int, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(key, salt, spans): intervals of words that repeated windows cover, of docs (key, salt, doc)."""
    runs = materialize(find_runs(docs, width), "runs")
    often = materialize(runs.groupBy("anchor").agg(F.sum("times").alias("seen")).filter("seen > 1").select("anchor"), "anchors")  # a table, so that the join may be split
    shared = materialize(runs.join(often, "anchor", "left_semi"), "shared-runs")
    discard(runs)
    texts = materialize(shared.groupBy("anchor", "text", "n").agg(F.sum("times").alias("count"), F.min(F.struct(*_ROW)).alias("row")), "run-texts")
    crowded = materialize(texts.groupBy("anchor").agg(F.count(F.lit(1)).alias("__texts")).filter(F.col("__texts") > hot).select("anchor", F.lit(True).alias("hot")), "crowded")
    marked = texts.join(crowded, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = marked.groupBy("row").agg(F.collect_list(F.struct("anchor", "text", "n", "count", "hot")).alias("runs")).select("row.*", "runs")
    sent = materialize(run_texts(docs.join(asked, _ROW).select("doc", "runs"), width), "sent-texts")
    discard(texts)
    dealt = shard_texts(sent, width, shard)
    found = materialize(dealt.groupBy("shard").applyInArrow(_shard_function(width), "anchor long, text long, n int, first int, stop int"), "found")
    windows = found.filter("n = 0").select(F.col("anchor").alias("first_hash"), F.col("text").alias("second_hash"))
    places = sent.filter("at >= 0").select("anchor", "text", "n", "at", "first_hash", "second_hash").join(windows, ["first_hash", "second_hash"], "left_semi").select("anchor", "text", "n", F.col("at").alias("first"), (F.col("at") + 1).alias("stop"))
    placed = shared.join(materialize(found.filter("n > 0").unionByName(places), "intervals"), ["anchor", "text", "n"])
    first = F.col("start") + F.col("first")
    stop = F.col("start") + F.when(F.col("n") == 1, F.col("times")).otherwise(F.col("stop")) + width - 1
    return placed.groupBy(*_ROW).agg(F.collect_set(F.struct(first.alias("first"), stop.alias("stop"))).alias("spans"))


def dedup(df: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed for every row of ``df``.

    Words are split at ASCII spaces and otherwise unchanged. A word is removed if
    a window of ``width`` words that covers it has a word sequence that starts
    anywhere else too, in the same document or another. kept_sha256: of the kept
    words joined by one space. removed: intervals of word positions, sorted and
    apart. A null, empty or short text loses nothing. Repeated rows are copies of
    each other; null ids are ids; an empty table gives none. Rows are told apart by
    two hashes of id and text, of 96 bits. Nothing is collected by word, window or
    anchor: what is gathered is one document's runs, or one shard's texts, of about
    ``SHARD`` words.
    """
    if not _GRAM <= width <= DEPTH:
        raise ValueError(f"width must lie between {_GRAM} and {DEPTH}")
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("doc"))
    docs = named.select("doc_id", "doc", F.xxhash64("doc_id", "doc").alias("key"), F.hash("doc", "doc_id").alias("salt"))
    spans = repeated_intervals(docs.select(*_ROW, "doc"), width, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            total, gone, digest, removed = [], [], [], []
            for doc, found in zip(binary_values(batch, "doc"), batch.column("spans").to_pylist()):
                words, merged = doc.split(), []
                for a, b in sorted((s["first"], s["stop"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                removed.append([{"first": a, "stop": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(removed, span)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    joined = spread_join(docs, spans, _ROW, "left").select("doc_id", "doc", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,stop:int>>")
