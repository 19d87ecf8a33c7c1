"""Periodic runs of words by Lyndon roots.

A run of period q is a longest stretch of words in which words q apart are equal.
Every run holds a Lyndon word of its period that is the longest one starting at its
place, under the order of the words or under the reverse order. Those longest Lyndon
words come from one scan of the text from right to left with a stack: a word ends
where the next smaller suffix begins. Suffixes are compared, and found words are
extended to runs on both sides, by the length of what they have in common, which
rolling hashes and a binary search give. What is reported has been compared word by
word.

Only stretches that can hold a run are scanned: each word of a run of three periods
stands three times in it or more, and so does twice each sequence of eight words of
a run of at least 24. Words outside such stretches cost a count and nothing else.
"""

from __future__ import annotations

import hashlib
import random
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, map_batches

#: A run has this many words and this many periods at least.
LEAST, PERIODS = 24, 3
_GRAM = 8
_PRIME = (1 << 61) - 1
_BASE = random.Random(11).randrange(1 << 40, _PRIME)
_powers = [1]


class Prefixes:
    """Hashes of all prefixes of a sequence of numbers, to compare parts of it."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        h, self.hashes = 0, [0]
        for w in words:
            h = (h * _BASE + w * 0x9E3779B97F4A7C15 + 1) % _PRIME
            self.hashes.append(h)
        while len(_powers) <= self.n:
            _powers.append(_powers[-1] * _BASE % _PRIME)

    def same(self, i: int, j: int, m: int) -> bool:
        h, p = self.hashes, _powers[m]
        return (h[i + m] - h[j + m] - (h[i] - h[j]) * p) % _PRIME == 0

    def _most(self, fits, most: int) -> int:
        """The greatest m up to ``most`` that fits; steps double, then halve."""
        low, step = 0, 8
        while low < most and fits(min(low + step, most)):
            low, step = min(low + step, most), 2 * step
        high = min(low + step, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low

    def after(self, i: int, j: int) -> int:
        """How many words from i and from j, i < j, are the same."""
        w, most = self.words, self.n - j
        for m in range(min(4, most)):
            if w[i + m] != w[j + m]:
                return m
        return self._most(lambda m: self.same(i, j, m), most)

    def before(self, i: int, j: int) -> int:
        """How many words up to i and up to j, i < j, both inclusive, are the same."""
        w, most = self.words, i + 1
        for m in range(min(4, most)):
            if w[i - m] != w[j - m]:
                return m
        return self._most(lambda m: self.same(i - m + 1, j - m + 1, m), most)


def next_smaller(words: list[int], prefixes: Prefixes) -> list[int]:
    """Where the next smaller suffix begins, for each place; a suffix that begins another is smaller."""
    n = len(words)
    following = [n] * (n + 1)
    for i in range(n - 2, -1, -1):
        j, w = i + 1, words[i]
        while j < n:
            other = words[j]
            if w == other:
                m = prefixes.after(i, j)
                if j + m == n or words[i + m] > words[j + m]:
                    break
            elif w > other:
                break
            j = following[j]
        following[i] = j
    return following[:n]


def _promising(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places at which the word from there to its end is followed, or preceded, by itself, as far as hashes of 64 bits tell; in order of length, then place."""
    n = len(ids)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([1], np.full(n, _BASE | 1))).astype(np.uint64))
        at = np.concatenate((np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * power[:n])))
        i = np.arange(n)
        p = ends - i
        right, left = np.minimum(i + 2 * p, n), np.maximum(i - p, 0)
        own = at[ends] - at[i]
        follows = (i + 2 * p <= n) & (own * power[p] == at[right] - at[ends])
        leads = (i - p >= 0) & ((at[i] - at[left]) * power[p] == own)
    found = np.flatnonzero(follows | leads)
    return found[np.lexsort((found, p[found]))]


def runs_of(ids: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of numbers, by start, then period; ``periods`` is three or more."""
    words = ids.tolist()
    prefixes, found = Prefixes(words), {}
    for order in (1, -1):
        ends = next_smaller([order * w for w in words], prefixes)
        last = (0, 0, 0)
        for i in _promising(ids, np.array(ends)).tolist():
            p = ends[i] - i
            if p == last[2] and i >= last[0] and i + p <= last[0] + last[1]:
                continue  # a root of the run just found
            before = prefixes.before(i - 1, i + p - 1) if i else 0
            start, length = i - before, before + p + prefixes.after(i, i + p)
            if words[start : start + length - p] != words[start + p : start + length]:  # hashes have misled: word by word
                start, stop = i, i + p
                while start and words[start - 1] == words[start - 1 + p]:
                    start -= 1
                while stop < len(words) and words[stop] == words[stop - p]:
                    stop += 1
                length = stop - start
            last = (start, length, p)
            if length >= max(least, periods * p):
                found[start, p] = length
    return [(s, n, p) for (s, p), n in sorted(found.items())]


def _stretches(on: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


def candidates(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside which no run can lie: of words that stand often enough, and in them of sequences that stand twice."""
    out = []
    often = np.bincount(ids)[ids] >= PERIODS
    for a, b in _stretches(often, LEAST):
        with np.errstate(over="ignore"):
            mixed = (ids[a:b].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            grams = np.zeros(b - a - _GRAM + 1, np.uint64)
            for k in range(_GRAM):
                grams = grams * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(grams)]
        order = np.argsort(grams)
        same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
        covered = np.zeros(b - a + 1, np.int32)
        twice = np.unique(np.concatenate((order[same], order[same + 1])))
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + _GRAM, -1)
        out += [(a + c, a + d) for c, d in _stretches(np.cumsum(covered[:-1]) > 0, LEAST)]
    return out


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    return sorted(((a + s, m, p) for a, b in candidates(ids) for s, m, p in runs_of(ids[a:b])), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return list(compress(words, kept))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, counted exactly; ties go to the least start, then the least period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def made_periodic(doc_id: Column, text: Column) -> Column:
    """``text``; where crc32 of the id is a multiple of ten, from some word on periodic.

    h being that crc32 and g = floor(h / 10), each word i from a = g mod n on becomes word
    a + (i - a) mod p with p = 1 + floor((n - a) / (3 + g mod 8)); words are then joined by spaces.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def changed(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.concat(F.slice(w, 1, a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda k: F.get(w, a + k % p))), " ")

    # As a variable of a function the array is made once, not for each word.
    whole = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, changed(w)).otherwise(F.lit(""))), 0)
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & text.isNotNull(), whole).otherwise(text)


_SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, details: bool = False) -> DataFrame:
    """Runs of each row of ``docs`` (doc_id, text): their number, the strongest one and digests of all.

    Words are what ASCII white space parts. A null text has none, a text of under 24
    words no run; without a run start, length, period and exponent_milli are null.
    Null ids and repeated rows stay, other columns are ignored, an empty table gives
    none. ``details`` adds runs, an array of structs, and collapsed, the words that
    no run repeats, joined by one space. A narrow map without a shuffle; a text is
    held whole by the task that has it.
    """

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in arrow if f.name != "doc_id"}
        for text in binary_values(batch, "text"):
            words = text.split()
            found = runs(words)
            left = b" ".join(collapsed(words, found))
            best = strongest(found)
            row = {
                "n_words": len(words), "n_runs": len(found), "runs_sha256": hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(left).hexdigest(),
                "exponent_milli": best and 1000 * best[1] // best[2], "runs": [dict(zip(("start", "length", "period"), r)) for r in found] if details else None, "collapsed": left.decode("utf-8", "surrogatepass") if details else None,
            } | dict(zip(("start", "length", "period"), best or (None,) * 3))
            for name, values in out.items():
                values.append(row[name])
        return {"doc_id": batch.column("doc_id")} | out

    arrow, schema = _ARROW, _SCHEMA
    if details:
        arrow = arrow.append(pa.field("runs", _RUNS)).append(pa.field("collapsed", pa.string()))
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema, arrow)
