"""Benchmark decontamination: passages of test items in training texts.

Rare word n-grams of the items are seeds. A copy at or over the threshold can have
so many edits only, and so holds some number of the item's n-grams at least (see
:func:`shared_grams`). Of an item's n-grams the most frequent are left out, half as
many as that number; every such copy then still holds the other half of it. How
frequent an n-gram is, is counted over all documents.

Documents and items are joined by the seeds: the places of a text's n-grams in the
items are looked up in arrays and counted by item and by how far the text is shifted
against it. Only where as many different seeds as a copy holds stand about one shift
is the document aligned with the item (Smith-Waterman over words), which scores edited
and paraphrased copies.

Items are taken in blocks of bounded size. A block is broadcast and every document
is matched against it where it lies; no text is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words in an item, at least; words in a seed, at most.
_N = 3
#: n-grams in a block of items, at most (one item may exceed it): 8 bytes each, and as much for each place.
BLOCK = 1_000_000
#: What a word put in, left out or changed costs; a word in place is worth 1.
_GAP = 0.5
#: Words of a text that are looked up at a time, at least, and places of the items that are held at a time.
_STRETCH, _HELD = 4096, 1 << 20
#: Of the table of bits: log2 of its places, at most.
_BITS = 24


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words, from the words' own."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return out


def shared_grams(length: int, threshold: float) -> tuple[int, int]:
    """(n, least): a copy of an item of ``length`` words that scores ``threshold`` holds ``least`` of its n-grams or more.

    M words kept and E edits, each at _GAP, score M - E / 2: E is 2 (M - threshold
    length) at most. They lie in E + 1 runs at most, which hold M - (n - 1)(E + 1)
    n-grams or more; for n > 1 that is least where M = length. The longest n that
    leaves one is taken; for n = 1 it is M itself.
    """
    for n in range(_N, 1, -1):
        least = math.ceil(length - (n - 1) * ((1 - threshold) * length / _GAP + 1) - 1e-9)
        if least > 0:
            return n, least
    return 1, max(1, math.ceil(threshold * length - 1e-9))


def most_edits(length: int, threshold: float) -> int:
    """Edits that a copy at the threshold has at most; so far, too, may its words be shifted against each other."""
    return int((1 - threshold) * length / _GAP + 1e-9)


@dataclass
class Block:
    """Items by position: id and words, joined by spaces."""

    ids: list[int] = field(default_factory=list)
    items: list[bytes] = field(default_factory=list)

    def grams(self, threshold: float) -> dict[int, np.ndarray]:
        """By n: the items' n-grams, in order, each once."""
        found = defaultdict(list)
        for item in self.items:
            words = item.split(b" ")
            n = shared_grams(len(words), threshold)[0]
            found[n].append(_grams(_hashes(words), n))
        return {n: np.unique(np.concatenate(x)) for n, x in found.items()}


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[Block]:
    """Items (item_id, text) in order of id, in blocks; those of under three words and null ids take no part."""
    now, n = Block(), 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().distinct().orderBy("item_id", "text").toLocalIterator():
        words = words_of(row.text.encode("utf-8", "replace"))
        if len(words) < _N:
            continue
        if now.ids and n + len(words) > size:
            yield now
            now, n = Block(), 0
        now.ids.append(row.item_id)
        now.items.append(b" ".join(words))
        n += len(words)
    if now.ids:
        yield now


class Known:
    """Numbers of known n-grams of one length; a table of bits passes over most others."""

    def __init__(self, grams: np.ndarray):
        size = min(_BITS, max(10, (16 * len(grams)).bit_length()))  # sixteen places a gram or more
        self.grams, self.bits, self.shift = grams, np.zeros(1 << size, bool), np.uint64(64 - size)
        self.bits[grams >> self.shift] = True

    def numbers(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known ones among ``grams``, and their numbers."""
        maybe = np.flatnonzero(self.bits[grams >> self.shift])
        at = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        same = self.grams[at] == grams[maybe]
        return maybe[same], at[same]


def document_counts(docs: DataFrame, grams: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How many of all documents hold each n-gram; partitions are counted where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        known = {n: Known(x) for n, x in shared.value.items()}
        counts = {n: np.zeros(len(x), np.int64) for n, x in shared.value.items()}
        for batch in batches:
            for text in binary_values(batch, "text"):
                hashes = _hashes(words_of(text))
                for n, own in known.items():
                    counts[n][np.unique(own.numbers(_grams(hashes, n))[1])] += 1
        for n, c in counts.items():
            some = np.flatnonzero(c)
            for at in range(0, len(some), 1 << 16):
                part = some[at : at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(part), n), pa.int32()), "gram": pa.array(part, pa.int32()), "n": pa.array(c[part], pa.int64())})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "size int, gram int, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    out = {n: np.zeros(len(x), np.int64) for n, x in grams.items()}
    for r in found.collect():
        out[r.size][r.gram] = r.n
    return out


@dataclass
class Seeds:
    """Seeds of one length, in order, and the places (item, word) at which each stands: those of seed k from starts[k] to starts[k + 1]."""

    grams: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    word: np.ndarray


@dataclass
class Matcher:
    """What a text is matched against: the items, their seeds, how many of those a copy holds, and how many words and edits it has."""

    ids: list[int]
    items: list[bytes]
    seeds: dict[int, Seeds]
    needed: np.ndarray
    lengths: np.ndarray
    edits: np.ndarray
    threshold: float

    def __post_init__(self):
        self.known = None

    def shifts(self, words: list[bytes]) -> dict[int, set[int]]:
        """By item the shifts of the text against it about which as many different seeds stand as a copy holds."""
        if self.known is None:  # once in a worker
            self.known = {n: Known(s.grams) for n, s in self.seeds.items()}
        out: dict[int, set[int]] = defaultdict(set)
        hashes = _hashes(words)
        span = int((self.lengths + self.edits).max(initial=0))
        for n, seeds in self.seeds.items():
            at, gram = self.known[n].numbers(_grams(hashes, n))
            for first in range(0, int(at[-1]) + 1 if len(at) else 0, max(_STRETCH, 2 * span)):
                a, b = np.searchsorted(at, (first, first + max(_STRETCH, 2 * span) + span))
                self._count(seeds, at[a:b], gram[a:b], out)
        return out

    def _places(self, seeds: Seeds, at: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in the items of a stretch's seeds: item, word, and place in the text, _HELD at a time or those of one seed."""
        lengths = seeds.starts[gram + 1] - seeds.starts[gram]
        upto = np.cumsum(lengths)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _HELD, side="right")))
            own = lengths[a:b]
            where = np.repeat(seeds.starts[gram[a:b]] - np.concatenate(([0], np.cumsum(own)[:-1])), own) + np.arange(own.sum())
            yield seeds.item[where], seeds.word[where], np.repeat(at[a:b], own)
            a = b

    def _count(self, seeds: Seeds, at: np.ndarray, gram: np.ndarray, out: dict[int, set[int]]) -> None:
        counts, once = np.zeros(len(self.items), np.int64), np.unique(gram)  # each seed counts once in a stretch, however often it stands there
        for item, _, _ in self._places(seeds, once, once):
            counts += np.bincount(item, minlength=len(counts))
        enough = counts >= self.needed
        if not enough.any():
            return
        held = [(i[k], w[k], p[k]) for i, w, p in self._places(seeds, at, gram) for k in [np.flatnonzero(enough[i])]]
        item, word, place = (np.concatenate(x).astype(np.int64) for x in zip(*held))
        shift, width = place - word, 2 * (self.edits[item] + 1)
        near = np.zeros(len(item), bool)
        for move in (0, 1):  # shifts of one copy lie within half a bucket: all of them in one of either kind
            bucket = (shift + move * (width >> 1)) // width
            order = np.lexsort((word, bucket, item))
            i, k, w = item[order], bucket[order], word[order]
            begins = np.concatenate(([True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])))
            differs = begins | np.concatenate(([True], w[1:] != w[:-1]))
            group = np.cumsum(begins) - 1
            near[order] |= (np.bincount(group, differs) >= self.needed[i[begins]])[group]
        for i, s in set(zip(item[near].tolist(), shift[near].tolist())):
            out[i].add(s)


def matcher(block: Block, counts: dict[int, np.ndarray], grams: dict[int, np.ndarray], threshold: float) -> Matcher:
    """Seeds of a block of items: of each item all n-grams but the most frequent, those left out being half of what a copy holds."""
    needed, lengths, places = [], [], defaultdict(list)
    for i, item in enumerate(block.items):
        words = item.split(b" ")
        n, least = shared_grams(len(words), threshold)
        own = _grams(_hashes(words), n)
        number = np.searchsorted(grams[n], own)
        order = np.lexsort((number, counts[n][number]))[: len(own) - least // 2]
        order = order[counts[n][number[order]] > 0]  # what no document holds seeds nothing
        places[n].append((number[order], np.full(len(order), i), order))
        needed.append(least - least // 2)
        lengths.append(len(words))
    seeds = {}
    for n, parts in places.items():
        number, item, word = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(number, kind="stable")
        kept, first = np.unique(number[order], return_index=True)
        seeds[n] = Seeds(grams[n][kept], np.append(first, len(order)), item[order].astype(np.int32), word[order].astype(np.int32))
    edits = np.array([most_edits(x, threshold) for x in lengths], np.int64)
    return Matcher(block.ids, block.items, {n: x for n, x in seeds.items() if len(x.grams)}, np.array(needed, np.int64), np.array(lengths, np.int64), edits, threshold)


def _scores(item: np.ndarray, words: np.ndarray, local: bool) -> Iterator[np.ndarray]:
    """Rows of the alignment table, one for each beginning of the item, each of len(words) + 1; scores in half words.

    ``local``: alignments may begin anywhere, else at the first words of both. Only
    one row is held.
    """
    ramp = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64) if local else -ramp
    yield row
    for i, code in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = 0 if local else -i
        np.maximum(row[:-1] + np.where(words == code, 2, -1), row[1:] - 1, out=best[1:])
        if local:
            np.maximum(best, 0, out=best)
        row = np.maximum.accumulate(best + ramp) - ramp  # gaps along the row
        yield row


def align(item: list[bytes], words: list[bytes]) -> tuple[float, int, int]:
    """Smith-Waterman over words: score as a share of a perfect one, and the aligned words' first and end.

    Two rows of the table are held, however long the item and the words are. The
    beginning is found by the table of both read backwards from the best end.
    """
    index = {w: i for i, w in enumerate(dict.fromkeys(item))}
    rows, columns = (np.array([index.get(w, -1) for w in x], np.int64) for x in (item, words))
    best, at, end = 0, 0, 0
    for i, row in enumerate(_scores(rows, columns, True)):
        j = int(row.argmax())
        if row[j] > best:
            best, at, end = int(row[j]), i, j
    if not best:
        return 0.0, 0, 0
    longest = min(end, 2 * at - best + at)  # words put in cost a half each
    back = _scores(rows[:at][::-1], columns[end - longest : end][::-1], False)
    first = min(int(np.argmax(row == best)) for row in back if (row == best).any())
    return best / 2 / len(item), end - first, end


def find(words: list[bytes], m: Matcher) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end) of the best place of each item at or over the threshold."""
    shifts = m.shifts(words)
    out, there = [], set(words) if shifts else set()
    for i, found in sorted(shifts.items()):
        item, best = m.items[i].split(b" "), (0.0, 0, 0)
        n, least = len(item), m.threshold * len(item) - 1e-9  # a score is no more than the words kept
        if sum(map(there.__contains__, item)) < least:
            continue
        counts, more = Counter(item), int(m.edits[i]) + 1  # words put in, at most
        todo = []
        for s in sorted(found):
            if s >= 0 and words[s : s + n] == item:
                best = (1.0, s, s + n)
                break
            if (counts & Counter(words[max(0, s - more) : max(0, s + n + more)])).total() >= least:
                todo.append(s)
        while todo and best[0] < 1.0:
            group = [todo.pop(0)]
            while todo and todo[0] - group[-1] <= n:
                group.append(todo.pop(0))
            a, b = max(0, group[0] - more), min(len(words), group[-1] + n + more)
            score, first, end = align(item, words[a:b])
            if score > best[0]:
                best = (score, a + first, a + end)
        if best[0] >= m.threshold:
            out.append((i, *best))
    return out


def _matched(docs: DataFrame, items: DataFrame, threshold: float):
    """By block: a function from one text to its places, for use in executors."""
    for block in blocks(items):
        grams = block.grams(threshold)
        shared = docs.sparkSession.sparkContext.broadcast(matcher(block, document_counts(docs, grams), grams, threshold))

        def places(text: bytes, shared=shared) -> list[tuple[int, float, int, int]]:
            m = shared.value
            return [(m.ids[i], *rest) for i, *rest in find(words_of(text), m)]

        yield places


_SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text) and item (item_id, text) it holds a copy of.

    score: the alignment's, as a share of the item's words (1: every word in
    place); at least ``threshold``. first_word and last_word: the copy's place in
    the document. Nulls, empty texts, items of under three words and documents
    without a copy give no rows; repeated rows and repeated items give theirs; two
    texts of one item_id count as two items. Other columns are ignored.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], _SCHEMA)
    for places in _matched(picked, items, threshold):

        def run(batches, places=places):
            for batch in batches:
                rows = [(d, i, s, a, b - 1) for d, t in zip(batch.column("doc_id").to_pylist(), binary_values(batch, "text")) for i, s, a, b in places(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

        out = out.unionByName(picked.mapInArrow(run, _SCHEMA))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no copy of an item.

    A copy is one that :func:`leaks` reports. Null and empty texts hold none and
    stay, as do null ids and repeated rows; without items every row stays; an empty
    table gives none.
    """
    out = docs
    for places in _matched(docs, items, threshold):

        def run(batches, places=places):
            for batch in batches:
                yield batch.filter(pa.array([not places(t) for t in binary_values(batch, "text")], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
