"""Language identification with a string kernel.

Kernel: blended spectrum of n-gram presence. A text is the set of its character
n-grams, n = 1..3, that occur in some landmark text; two texts' kernel is the size
of the sets' intersection over the root of the product of their sizes. Nyström:
landmark texts span the feature space. One kernel ridge regression per language
(one versus the rest) is fitted there. A batch of texts is scored by one product
of its presence matrix with landmarks and weights. Presence has WIDTH columns at
most: beyond, n-grams share columns, by their number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

UNKNOWN = "und"
#: A letter, in training and in prediction.
_LETTER = r"\p{L}"
_MAX_N = 3


#: Codes up to which a table of columns is laid out whole; beyond, codes are searched in their order. Either gives the same.
_DENSE = 1 << 24


class Codes:
    """Numbers of known codes, in order; -1 for others."""

    def __init__(self, known: np.ndarray, size: int):
        self.known, self.table = known, None
        if size <= _DENSE:
            self.table = np.full(size, -1, np.int32)
            self.table[known] = np.arange(len(known))

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[codes]
        if not len(self.known):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at, -1)


@dataclass
class Vocabulary:
    """The n-grams of some texts, however many characters those have."""

    #: Code point -> symbol from 1; 0 is any character that the texts lack.
    symbols: np.ndarray
    #: By n from 2: an n-gram's number from its beginning's number and its last symbol.
    longer: list[Codes]
    #: Columns of the single characters, of the pairs and so on, one behind the other.
    sizes: list[int]

    @property
    def width(self) -> int:
        return min(sum(self.sizes), WIDTH)

    def columns(self, text: str) -> list[np.ndarray]:
        """By n: the numbers of the known n-grams of ``text``, from 0 for each n."""
        symbol = self.symbols[np.minimum(_points(text), len(self.symbols) - 1)]
        base = self.sizes[0] + 1
        found = [symbol.astype(np.int64) - 1]
        for n, codes in enumerate(self.longer, 2):
            begin, last = found[-1][: max(len(symbol) - n + 1, 0)], symbol[n - 1 :]
            number = np.full(len(begin), -1, np.int64)
            known = (begin >= 0) & (last > 0)
            number[known] = codes[begin[known] * base + last[known]]
            found.append(number)
        return [x[x >= 0] for x in found]

    def presence(self, text: str) -> np.ndarray:
        """Which n-grams the whole text has, by column."""
        width = self.width
        out = np.zeros(width, np.uint8)
        for at in range(0, max(len(text), 1), _SLICE):
            first = 0
            for size, numbers in zip(self.sizes, self.columns(text[at : at + _SLICE + _MAX_N - 1])):
                out[(first + numbers) % max(width, 1)] = 1
                first += size
        return out


@dataclass
class KernelModel:
    languages: list[str]
    vocabulary: Vocabulary
    #: Column by language: landmarks' presence times the fitted weights.
    weights: np.ndarray
    landmarks: np.ndarray
    bias: np.ndarray
    sharpness: float


#: Texts are cut into slices of so many characters (overlapping by two), so that no array is longer.
_SLICE = 1 << 20
_BATCH = 256
#: Columns of presence at most, and so many are multiplied at a time.
WIDTH = 1 << 16
_COLUMNS = 1 << 13
#: Languages whose counts are broadcast; more are joined.
_FEW = 100_000


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def vocabulary(landmarks: list[str]) -> Vocabulary:
    """All n-grams of the landmark texts."""
    points = [_points(t) for t in landmarks]
    found = np.unique(np.concatenate([*points, np.empty(0, np.uint32)]))
    symbols = np.zeros(int(found.max(initial=0)) + 2, np.int32)
    symbols[found] = np.arange(1, len(found) + 1)
    base, out = len(found) + 1, Vocabulary(symbols, [], [len(found)])
    for n in range(2, _MAX_N + 1):
        codes = [np.empty(0, np.int64)]
        for t, p in zip(landmarks, points):
            begin = _numbers(out, t)[: max(len(p) - n + 1, 0)]
            codes.append(np.unique(begin * base + symbols[p[n - 1 :]]))
        known = np.unique(np.concatenate(codes))
        out.longer.append(Codes(known, out.sizes[-1] * base + base))
        out.sizes.append(len(known))
    return out


def _numbers(v: Vocabulary, text: str) -> np.ndarray:
    """Numbers of the longest n-grams of ``v`` that begin at each place of a landmark text; all are known."""
    return v.columns(text)[-1]


def _product(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``rows`` (presence, in bytes) times ``weights`` (a row a column of presence), some columns at a time."""
    out = np.zeros((len(rows), weights.shape[1]), np.float32)
    for c in range(0, rows.shape[1], _COLUMNS):
        out += rows[:, c : c + _COLUMNS].astype(np.float32) @ weights[c : c + _COLUMNS].astype(np.float32)
    return out


def _sizes(rows: np.ndarray) -> np.ndarray:
    return np.maximum(rows.sum(1, dtype=np.int64), 1).astype(np.float32)


def _kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    return _product(rows, landmarks.T) / np.sqrt(_sizes(rows))[:, None] / np.sqrt(_sizes(landmarks))[None, :]


def _sample(df: DataFrame, per_language: int, total: int, longest: int, characters: int) -> list[Row]:
    """Rows (lang, text) of each language in the order of a hash of id, language and text; see :func:`train`."""
    rows = df.filter(F.col("lang").isNotNull() & F.col("text").rlike(_LETTER))
    counts = materialize(rows.groupBy("lang").count(), "languages")
    n = counts.count()
    wanted = max(1, min(per_language, total // max(n, 1)))
    longest = max(1, min(longest, characters // max(1, wanted * n)))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5), "lang", "text"), F.lit(1 << 30))
    picked = rows.withColumn("place", place).join(F.broadcast(counts) if n <= _FEW else counts, "lang").filter(F.col("place") / float(1 << 30) * F.col("count") < 1.2 * wanted + 20)
    part = F.when(F.length("text") <= longest, F.col("text")).otherwise(F.substring(F.regexp_substr("text", F.lit(rf"(?s){_LETTER}.*")), 1, longest))
    once = picked.withColumn("text", part).groupBy("lang", "place").agg(F.min("text").alias("text"))  # copies of a row count once
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).filter(F.col("rank") <= wanted)
    return ranked.select("lang", "text", "place").orderBy("lang", "place").collect()


def train(df: DataFrame, per_language: int = 400, total: int = 25_600, landmarks_per_language: int = 32, most_landmarks: int = 1024, longest: int = 20_000, characters: int = 16_000_000, ridge: float = 1e-2) -> KernelModel | None:
    """Fit on columns doc_id, text and lang of ``df``.

    The sample is bounded: ``per_language`` texts of each language, those of the
    smallest hash. Where so many would make more than ``total``, and for landmarks
    more than ``most_landmarks``, every language has an equal share, and one at
    least: none is left out, whatever the length of its texts. Of a text of over
    ``longest`` characters, or over an even share of ``characters`` where that is
    less, so many from its first letter on are learned from. The first
    ``landmarks_per_language`` of a language are landmarks. The same rows give the
    same model. None where no row can be used.
    """
    sample = _sample(df, per_language, total, longest, characters)
    languages = sorted({r.lang for r in sample})
    if not languages:
        return None
    by_language: dict[str, list[str]] = {x: [] for x in languages}
    for r in sample:
        by_language[r.lang].append(r.text)
    each = max(1, min(landmarks_per_language, most_landmarks // len(languages)))
    chosen = [t for x in languages for t in by_language[x][:each]]
    grams = vocabulary(chosen)
    marks = np.stack([grams.presence(t) for t in chosen])
    texts = [t for x in languages for t in by_language[x]]
    y = np.repeat(np.arange(len(languages)), [len(by_language[x]) for x in languages])
    target = np.where(y[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    balance = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y][:, None]
    bias = (target * balance).sum(0) / balance.sum()
    # Only sums over the texts are kept, not their kernels.
    squares, sides = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(languages)))
    for a in range(0, len(texts), _BATCH):
        k = _kernel(np.stack([grams.presence(t) for t in texts[a : a + _BATCH]]), marks).astype(np.float64)
        squares += k.T @ (balance[a : a + _BATCH] * k)
        sides += k.T @ (balance[a : a + _BATCH] * (target[a : a + _BATCH] - bias))
    k_mm = _kernel(marks, marks).astype(np.float64)
    alpha = np.linalg.solve(squares + ridge * len(y) * (k_mm + 1e-6 * np.eye(len(k_mm))), sides)
    scaled = (alpha / np.sqrt(_sizes(marks))[:, None]).astype(np.float32)
    weights = np.concatenate([marks[:, c : c + _COLUMNS].T.astype(np.float32) @ scaled for c in range(0, marks.shape[1], _COLUMNS)] or [np.zeros((0, len(languages)), np.float32)])
    return KernelModel(languages, grams, weights, marks, bias, 4.0)


def scores(texts: list[str], model: KernelModel) -> np.ndarray:
    """Row by text, column by language; each row adds up to 1."""
    out = []
    for a in range(0, len(texts), _BATCH):
        rows = np.stack([model.vocabulary.presence(t) for t in texts[a : a + _BATCH]])
        values = _product(rows, model.weights) / np.sqrt(_sizes(rows))[:, None] + model.bias
        values = np.exp(model.sharpness * (values - values.max(1, keepdims=True)))
        out.append(values / values.sum(1, keepdims=True))
    return np.concatenate(out) if out else np.empty((0, len(model.languages)))


def predict(df: DataFrame, model: KernelModel | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of ``df`` with lang_pred and score (``names``), from column text alone.

    A text that is null or has no letter gets ``und`` and score 0, as does every
    text without a model; one that shares no
    n-gram with the landmarks gets the bias's choice.
    A narrow map without a shuffle; rows are kept as they are, repeated or not; an
    empty table gives none.
    """
    kept = df.select(*keep).schema
    text, letters = free_name(df, "__text"), free_name(df, "__letters")
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(None if model is None else KernelModel(**{**vars(model), "landmarks": np.empty((0, 0))}))

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * _BATCH):
                part = batch.slice(at, 2 * _BATCH)
                texts, lettered = (part.column(c).to_pylist() for c in (text, letters))
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                usable = [i for i in range(len(texts)) if m is not None and lettered[i]]
                for i, row in zip(usable, scores([texts[i] for i in usable], m) if usable else ()):
                    best = int(row.argmax())
                    lang[i], score[i] = m.languages[best], float(row[best])
                columns = [part.column(n) for n in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    value = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(*keep, value.alias(text), value.rlike(_LETTER).alias(letters)).mapInArrow(run, f"{fields}, {names[0]} string, {names[1]} double")


def without_unknown(df: DataFrame, model: KernelModel | None) -> DataFrame:
    """The rows of ``df``, all columns, whose language can be told: letters, and a best score above an even share by a tenth or more.

    Null and empty texts go; without a model all rows go; repeated rows and null ids
    are judged like any other.
    """
    least = 1.1 / len(model.languages) if model and len(model.languages) > 1 else 0.0
    lang, score = free_name(df, "__lang"), free_name(df, "__score")
    marked = predict(df, model, tuple(df.columns), (lang, score))
    return marked.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
