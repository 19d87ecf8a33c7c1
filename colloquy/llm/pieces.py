"""SentencePiece encoding and decoding over a relational lattice.

Texts fall into units over whose ends no piece reaches: at spaces, and between any two
characters that stand side by side in no piece. Every different unit of the corpus is
encoded once: units are exploded into substrings of bounded length, those that are
pieces (an equi-join with the piece table) become edges from position to position,
edges are grouped by unit, and a fold (``aggregate``) finds each unit's path.

The model at hand is of the merging kind (BPE): its scores order merges and are no
path costs, so a path's largest sum of scores is not its encoding. The fold therefore
takes a unit's edges by rank, the leftmost first among equals, and holds the borders
that stand. An edge whose two ends stand is merged: the borders within it fall. One
look at each edge is enough, since the encoder's merges come in order of rank wherever
every piece's own merging does and ranks differ (see :func:`in_order`): what lies between two borders that
stand is merged as if it stood alone, so a piece there is whole at its rank, and no
merge makes room for one that ranks before it. The edges between neighbouring borders
are the path.

The units' encodings are a table. Of the most frequent units they are broadcast, up
to a bound; those of a document's other units are joined to it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units whose encodings are broadcast at most, of at most LONGEST characters each.
FREQUENT = 800_000
#: Characters of a unit in the relational lattice; longer ones, which no bits of one number hold, are encoded by :meth:`Model.encode_unit`, those of a model that isn't :func:`in_order` by its merges.
LONGEST = 64
#: Different units that a lattice partition is meant to hold.
_UNITS = 25_000
#: Different words that a worker holds at most, about, and characters of the texts that it takes at a time.
_REMEMBERED, _CHARS = 600_000, 1 << 22
_SLICE = 256
#: Above all ranks: a character that is no piece.
_NEVER = 1 << 24


@dataclass
class Words:
    """Different words of some texts, each word of each text as a number of those, and their units."""

    numbers: np.ndarray
    #: Of each text's first word, and behind the last.
    begins: np.ndarray
    keys: list[str]
    units: pa.StringArray
    #: Units of each word.
    sizes: np.ndarray


@dataclass
class Model:
    """Pieces by text with id and score, the bytes' ids, and the texts that ids decode to."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown_id: int
    texts: list[bytes]
    longest: int
    #: Ends of pieces, pieces included.
    tails: frozenset[str]
    #: Words between which no piece reaches, in a text with its space marks; None where pieces may reach over any.
    words: re.Pattern | None
    #: Code point -> number of a character that stands in a piece of two or more; else 0.
    symbols: np.ndarray
    #: Whether some piece has the two numbered characters side by side.
    bridged: np.ndarray
    #: texts, as an array.
    bytes_of: pa.BinaryArray
    stable: dict[tuple[str, str], bool] = field(default_factory=dict)

    def merged(self, text: str) -> list[tuple[str, int, int]]:
        """Parts after all merges, the best-scored first, leftmost among equals: (text, begin, stop)."""
        parts = [(c, i, i + 1) for i, c in enumerate(text)]
        for _, at in self.merges(text):
            i = next(i for i, p in enumerate(parts) if p[1] == at)
            parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], at, parts[i + 1][2])]
        return parts

    def merges(self, text: str) -> list[tuple[str, int]]:
        """The merges of a short text in order: (merged text, begin)."""
        parts, done = [(c, i) for i, c in enumerate(text)], []
        while True:
            open_ = [(self.pieces[x][1], -i) for i in range(len(parts) - 1) if (x := parts[i][0] + parts[i + 1][0]) in self.pieces]
            if not open_:
                return done
            i = -max(open_)[1]
            parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i][1])]
            done.append(parts[i])

    def is_stable(self, left: str, right: str) -> bool:
        """Whether the pair stays as it is; an empty left asks for the piece alone."""
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) >= _REMEMBERED:
                self.stable.clear()
            known = self.stable[left, right] = [p[0] for p in self.merged(left + right)] == ([left, right] if left else [right])
        return known

    def ids(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found:
            return [found[0]]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown_id]

    def encode_unit(self, unit: str) -> list[int]:
        """The encoding from left to right, by pairs of pieces that stay as they are; linear in the unit's length."""
        last = [""]  # the last piece of each beginning's encoding
        for stop in range(1, len(unit) + 1):
            for start in range(stop - 1, -1, -1):
                piece = unit[start:stop]
                if (piece in self.pieces or start + 1 == stop) and self.is_stable(last[start], piece):
                    last.append(piece)
                    break
                if piece not in self.tails and start + 1 < stop:
                    raise RuntimeError(f"no encoding of {unit[:100]!r}")
        path, at = [], len(unit)
        while at:
            path.append(last[at])
            at -= len(last[at])
        return [i for p in reversed(path) for i in self.ids(p)]

    def split(self, text: str) -> list[str]:
        """Keys of the text's words; see :meth:`word_of`."""
        if not text:
            return []
        if self.words and SPACE not in text and "  " not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        words = self.words.findall(marked) if self.words else [marked]
        return [w[1:] if self.words and w[0] == SPACE and SPACE not in w[1:] and w != SPACE else SPACE + w for w in words]

    @staticmethod
    def word_of(key: str) -> tuple[str, str]:
        """(what stands before, word): a line break and the word behind it, a word as it is behind a mark, or a word that a space precedes."""
        if key.startswith("\n"):
            return "\n", key[1:]
        return "", key[1:] if key.startswith(SPACE) else SPACE + key

    def units(self, keys: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The units of the keys' words, one after the other, and how many each key has."""
        parts = [SPACE + k if k[:1] not in ("\n", SPACE) else k if k[0] == "\n" else k[1:] for k in keys]
        if not parts:
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        symbols = self.symbols[np.minimum(points, len(self.symbols) - 1)]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.bridged[symbols[:-1], symbols[1:]]
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        cut[ends] = True
        at = np.flatnonzero(cut)
        octets = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))[at].astype(np.int32)
        found = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(octets), pa.py_buffer(whole.encode()))
        return found, np.diff(np.searchsorted(at, ends))

    def words_in(self, texts: list[str | None]) -> Words:
        def marked(t: str | None) -> str | None:
            """The text's keys between spaces; null where there are none."""
            if not t:
                return None
            plain = self.words and SPACE not in t and "  " not in t and t[0] != " "
            return t.replace("\n", " \n") if plain else " ".join(self.split(t))

        lists = pc.split_pattern(pa.array(map(marked, texts), pa.string()), " ")
        begins = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return Words(coded.indices.to_numpy().astype(np.int64), begins, keys, *self.units(keys))

    @staticmethod
    def text_of(spelled: bytes) -> str:
        text = spelled.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids) -> str:
        return self.text_of(b"".join(map(self.texts.__getitem__, ids)))


def load(path: str = DEFAULT_MODEL) -> Model:
    """Read a SentencePiece model of the merging kind; nothing but its table is used later."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    pieces = {names[i]: (i, sp.get_score(i)) for i in plain}
    byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    texts = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].encode() if names[i] in pieces else b"" for i in range(n)]
    apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
    words = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n") if apart else None
    used = sorted({ord(c) for p in pieces if len(p) > 1 for c in p})
    symbols = np.zeros(max(used, default=0) + 2, np.int32)
    symbols[used] = np.arange(1, len(used) + 1)
    bridged = np.zeros((len(used) + 1, len(used) + 1), bool)
    for p in pieces:
        for a, b in zip(p, p[1:]):
            bridged[symbols[ord(a)], symbols[ord(b)]] = True
    return Model(pieces, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [], sp.unk_id(), texts, max(map(len, pieces)), frozenset(p[i:] for p in pieces for i in range(len(p))), words, symbols, bridged, pa.array(texts, pa.binary()))


def piece_rows(model: Model) -> list[tuple[str, int, int]]:
    """The piece table: piece, id and rank.

    Ranks count the scores from the best. They must not fall along a piece's own
    merging, which holds for trained models, and is checked.
    """
    order = {s: i for i, s in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}
    rank = {p: order[s] for p, (_, s) in model.pieces.items()}
    if len(order) >= _NEVER or model.longest >= 64:
        raise ValueError("the model's table is too large")
    for piece in model.pieces:
        done = model.merges(piece)
        ranks = [rank[x] for x, _ in done]
        if len(piece) > 1 and (not done or done[-1][0] != piece) or ranks != sorted(ranks):
            raise ValueError(f"the model does not merge {piece!r} in order of its scores")
    return [(piece, i, rank[piece]) for piece, (i, _) in model.pieces.items()]


def in_order(model: Model) -> bool:
    """Whether one look at each edge by rank, start and id merges as the encoder does, which merges the leftmost of equals and looks again.

    It does where pieces of two or more characters differ in score, and also where all
    runs of one character share one and, by trial of each length, come out alike.
    """
    tied = {}
    for piece, (i, score) in sorted(model.pieces.items(), key=lambda x: x[1][0]):
        if len(piece) > 1:
            tied.setdefault(score, []).append(piece)
    for group in tied.values():
        c = group[0][0]
        if len(group) == 1:
            continue
        if any(p.strip(c) for p in group) or any(len(p) > 1 and not p.strip(c) and p not in group for p in model.pieces):
            return False
        for n in range(2, LONGEST + 1):
            borders = set(range(n + 1))
            for start in range(n):
                for p in group:
                    if {start, start + len(p)} <= borders:
                        borders -= set(range(start + 1, start + len(p)))
            if sorted(borders - {n}) != [begin for _, begin, _ in model.merged(c * n)]:
                return False
    return True


@dataclass
class Table:
    """Units and their ids. The first ones may stand in order of their :func:`hashes`, which then serve all look-ups; the others are hashed anew for each."""

    units: pa.StringArray
    ids: pa.ListArray
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def __add__(self, other: Table) -> Table:
        return Table(pa.concat_arrays([self.units, other.units]), pa.concat_arrays([self.ids, other.ids]), self.hashes) if len(other.units) else self

    def hashed(self) -> Table:
        """The same rows in order of their hashes."""
        found = hashes(self.units)
        order = np.argsort(found, kind="stable")
        return Table(self.units.take(pa.array(order)), self.ids.take(pa.array(order)), found[order])

    def find(self, units: pa.StringArray) -> np.ndarray:
        """Where each of ``units`` stands; -1 if nowhere."""
        at = np.full(len(units), -1)
        if len(self.hashes):
            wanted = hashes(units)
            order = np.argsort(wanted)  # near ones one after the other are found sooner
            place = np.zeros(len(units), np.int64)
            place[order] = np.minimum(np.searchsorted(self.hashes, wanted[order]), len(self.hashes) - 1)
            held = np.flatnonzero(self.hashes[place] == wanted)
            same = pc.equal(self.units.take(pa.array(place[held])), units.take(pa.array(held))).to_numpy(zero_copy_only=False)
            at[held[same]] = place[held[same]]
            if not same.all():  # two texts of one hash
                at[held[~same]] = _index(units.take(pa.array(held[~same])), self.units)
        others = np.flatnonzero(at < 0)
        if len(others) and len(self.hashes) < len(self.units):
            rest = _index(units.take(pa.array(others)), self.units.slice(len(self.hashes)))
            at[others] = np.where(rest < 0, -1, rest + len(self.hashes))
        return at


def _index(units: pa.StringArray, among: pa.StringArray) -> np.ndarray:
    return pc.fill_null(pc.index_in(units, value_set=among), -1).to_numpy()


#: Numbers that octets and their places are hashed by.
_BY_OCTET, _BY_PLACE = np.random.default_rng(8).integers(0, 1 << 64, (2, 256), np.uint64)


def hashes(texts: pa.StringArray) -> np.ndarray:
    """A number of each text, the same for the same text; two texts seldom share one."""
    ends = np.frombuffer(texts.buffers()[1] or bytes(4), np.int32)[texts.offset : texts.offset + len(texts) + 1]
    octets = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    place = np.arange(len(octets), dtype=np.int32) - np.repeat(ends[:-1], np.diff(ends))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BY_OCTET[octets] * _BY_PLACE[place & 255], dtype=np.uint64)))[ends]
    return sums[1:] - sums[:-1]


def table_of(units: pa.Array, ids: pa.Array) -> Table:
    """Of units and their ids, of which any may repeat."""
    first = np.unique(units.dictionary_encode().indices.to_numpy(), return_index=True)[1]
    if len(first) < len(units):
        units, ids = units.take(pa.array(first)), ids.take(pa.array(first))
    return Table(units.cast(pa.string()), ids.cast(pa.list_(pa.int32())))


def unwritten(rows: pa.StringArray) -> Table:
    """The table of rows as :func:`written` makes them."""
    parts = pc.split_pattern(rows, " ")
    begins, words = parts.offsets.to_numpy(), parts.flatten()
    unit = np.zeros(len(words), bool)
    unit[begins[:-1]] = True
    ids = words.filter(pa.array(~unit)).cast(pa.int32())
    return table_of(words.filter(pa.array(unit)), pa.ListArray.from_arrays(pa.array(begins - np.arange(len(begins)), pa.int32()), ids))


def written(unit: Column, ids: Column) -> Column:
    """A unit, which holds no space, and its ids in one text."""
    return F.concat_ws(" ", unit, ids.cast("array<string>"))


def encode_texts(texts: list[str | None], model: Model, table: Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All ids, text after text, how many each text has, and the bytes that they decode to; every unit stands in the table.

    Different words are cut into units, looked up and spelled out once.
    """
    words = model.words_in(texts)
    at = table.find(words.units)
    if len(at) and at.min() < 0:
        raise KeyError(words.units[int(at.argmin())].as_py())
    by_unit = table.ids.take(pa.array(at))
    edges = by_unit.offsets.to_numpy()[np.concatenate(([0], np.cumsum(words.sizes)))]
    ids, numbers = by_unit.flatten(), pa.array(words.numbers)
    spelled = model.bytes_of.take(ids)
    octets = np.frombuffer(spelled.buffers()[1], np.int32)[: len(spelled) + 1][edges]
    by_word = pa.Array.from_buffers(pa.binary(), len(words.sizes), [None, pa.py_buffer(octets), spelled.buffers()[2]]).take(numbers)
    decoded = memoryview(by_word.buffers()[2] or b"")
    places = np.frombuffer(by_word.buffers()[1], np.int32)[: len(by_word) + 1][words.begins].tolist() if len(by_word) else [0] * len(words.begins)
    whole = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids).take(numbers)
    sizes = np.diff(whole.offsets.to_numpy()[words.begins])
    return whole.flatten().to_numpy(), sizes, [bytes(decoded[a:b]) for a, b in zip(places, places[1:])]


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[i] .. begins[i] + sizes[i] - 1, span after span."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _slices(batch: pa.RecordBatch, column: str, most: int = _CHARS):
    """Parts of a batch of at most ``most`` bytes of ``column`` (a longer value is taken whole)."""
    sizes = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)
    pa.default_memory_pool().release_unused()


def count_units(docs: DataFrame, model: Model) -> DataFrame:
    """(unit, n): every different unit of all documents (text), and how often it stands there."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def summed(parts: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(parts).group_by("unit").aggregate([("n", "sum")])
        return pa.table({"unit": out["unit"], "n": out["n_sum"]})

    def run(batches):
        m, held = shared.value, []
        for batch in batches:
            for part in _slices(batch, "text"):
                words = m.words_in(part.column("text").to_pylist())
                n = np.bincount(words.numbers, minlength=len(words.keys))
                held.append(pa.table({"unit": words.units, "n": np.repeat(n, words.sizes)}))
                if sum(len(t) for t in held) > _REMEMBERED:
                    held = [summed(held)]
                if len(held[0]) > _REMEMBERED:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from summed(held).to_batches()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """``units`` (unit, others) by substring: start, stop and the piece's id and rank; single characters that are no piece have null ones.

    The piece table is the model's vocabulary, of fixed size, and is broadcast. It is
    joined by a hash of the text, which is quicker to look up, and then compared.
    """
    table = units.sparkSession.createDataFrame(piece_rows(model), "piece string, id int, rank int").withColumn("hash", F.xxhash64("piece"))
    starts = units.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)))
    spans = starts.withColumn("stop", F.explode(F.sequence(F.col("start") + 1, F.least(F.length("unit"), F.col("start") + model.longest))))
    parts = spans.withColumn("part", F.expr("substring(unit, start + 1, stop - start)")).withColumn("hash", F.xxhash64("part"))
    same = F.startswith("part", "piece") & F.startswith("piece", "part")  # an equation would be made a key
    joined = parts.join(F.broadcast(table), (parts["hash"] == table["hash"]) & same, "left")
    return joined.filter("id IS NOT NULL OR stop = start + 1").drop("piece", "part", "hash")


def viterbi(edges: DataFrame, model: Model) -> DataFrame:
    """(unit, n, ids): the encoding of each unit, of at most 64 characters, by a fold over its edges (unit, n and those of :func:`lattice`) in order of rank.

    The state holds the borders that stand as bits, that behind the first character
    lowest; the one at the unit's beginning always stands and has none. An edge has
    the bits of its ends, and all but those within it.
    """
    at = (F.coalesce("rank", F.lit(_NEVER)) * 64 + F.col("start")).alias("at")
    ends = F.expr("CASE WHEN start = 0 THEN 0L ELSE shiftleft(1L, start - 1) END | shiftleft(1L, stop - 1)").alias("ends")
    beside = F.expr("~(shiftleft(-1L, start) & ~shiftleft(-1L, stop - 1))").alias("beside")
    grouped = edges.select("unit", "n", F.struct(at, "id", ends, beside).alias("edge")).groupBy(F.xxhash64("unit"), "unit", "n").agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    def stands(borders: Column, e: Column) -> Column:
        return borders.bitwiseAND(e["ends"]) == e["ends"]

    def spelled(e: Column) -> Column:
        character = F.substr(F.col("unit"), e["at"].bitwiseAND(63) + 1, F.lit(1))
        if not model.byte_ids:
            return F.array(F.lit(model.unknown_id))
        table = F.array(*[F.lit(i) for i in model.byte_ids])
        return F.transform(F.sequence(F.lit(1), F.octet_length(character)), lambda i: F.get(table, F.conv(F.substr(F.hex(character), 2 * i - 1, F.lit(2)), 16, 10).cast("int")))

    def path(borders: Column) -> Column:
        kept = F.filter("edges", lambda e: stands(borders, e) & (borders.bitwiseAND(e["beside"]) == borders))
        ids = F.transform(kept, lambda e: F.struct(e["at"].bitwiseAND(63).alias("start"), F.when(e["id"].isNull(), spelled(e)).otherwise(F.array(e["id"])).alias("ids")))
        return F.flatten(F.sort_array(ids)["ids"])

    folded = F.aggregate("edges", F.lit(-1).cast("long"), lambda b, e: F.when(stands(b, e), b.bitwiseAND(e["beside"])).otherwise(b), path)
    return grouped.select("unit", "n", folded.alias("ids"))


def encodings(docs: DataFrame, model: Model) -> DataFrame:
    """(unit, n, ids) of every different unit of ``docs`` (text), written to the shared folder."""
    counted = materialize(count_units(docs, model), "units")
    size, most = F.length("unit"), LONGEST if in_order(model) else 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, counted.count() // _UNITS + 1)
    short = viterbi(lattice(counted.filter(size <= most).repartition(parts, "unit"), model), model)  # a unit's rows stay where it lies
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encoded(m: Model, unit: str) -> list[int]:
        return m.encode_unit(unit) if len(unit) > LONGEST else [i for part, _, _ in m.merged(unit) for i in m.ids(part)]

    def run(batches):
        for batch in batches:
            ids = [encoded(shared.value, u) for u in batch.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["unit", "n", "ids"])

    done = materialize(short.unionByName(counted.filter(size > most).mapInArrow(run, "unit string, n long, ids array<int>")), "encodings")
    discard(counted)
    return done


def frequent(table: DataFrame, most: int) -> Column:
    """Whether a row of ``table`` (unit, n) is among the most frequent: so many steps of the counts' logarithm, from the largest down, as give ``most`` rows at most.

    A histogram of a few hundred rows tells; no task sorts the units. A unit left
    out makes up no more than about one part in ``most`` of all.
    """
    step, least, taken = F.floor(F.log2("n") * 16), None, 0
    for r in sorted(table.filter(F.length("unit") <= LONGEST).groupBy(step.alias("step")).count().collect(), reverse=True):
        taken += r["count"]
        if taken > most:
            break
        least = r.step
    return (step >= least) & (F.length("unit") <= LONGEST) if least is not None else F.lit(False)


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip for every row of ``docs`` (doc_id, text).

    ids are those of the model's own encoder, without begin and end marks.
    round_trip: decoding gives the text again; false only where the text itself
    holds the space mark. A null text has null ids and counts 0, an empty text
    empty ids; both round-trip. Null ids of documents and repeated rows stay;
    other columns are ignored; an empty table gives none.

    Every id comes from the table of :func:`encodings`. Its ``most`` most frequent
    rows are broadcast. A document's other units are looked up by a join, and their
    encodings joined to it by a hash of id and text (they are a dictionary: rows that
    share the hash may share it); texts are compressed for that shuffle.
    """
    model = load(model_path)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = picked.withColumn("key", F.xxhash64("doc_id", "text"))
    table = encodings(picked, model)
    common = frequent(table, most)
    known = table.filter(common).select("unit", "ids").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((model, table_of(known["unit"].combine_chunks(), known["ids"].combine_chunks()).hashed()))

    def rare(batches):
        m, table = shared.value
        for batch in batches:
            for part in _slices(batch, "text"):
                words = m.words_in(part.column("text").to_pylist())
                other = table.find(words.units) < 0
                held = np.add.reduceat(np.append(other, 0), np.append(0, np.cumsum(words.sizes))[:-1]) if len(words.sizes) else words.sizes  # of each word
                text = np.repeat(np.arange(part.num_rows), np.diff(words.begins))
                odd = held[words.numbers] > 0
                pairs = np.unique(text[odd] << 32 | words.numbers[odd])  # each word of a text once
                text, word = pairs >> 32, pairs & 0xFFFFFFFF
                units = words.units.filter(pa.array(other)).take(pa.array(_spans((np.cumsum(held) - held)[word], held[word])))
                keys = part.column("key").take(pa.array(np.repeat(text, held[word])))
                yield pa.RecordBatch.from_arrays([keys, units], names=["key", "unit"])

    def compressed(batches):
        for batch in batches:
            for part in _slices(batch, "text"):
                packed = [None if t is None else zlib.compress(t, 4) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(packed, pa.binary())], names=["doc_id", "key", "packed"])

    def run(batches):
        m, table = shared.value
        for batch in batches:
            for part in _slices(batch, "packed", _CHARS // 3):
                texts = [None if t is None else zlib.decompress(t).decode() for t in part.column("packed").to_pylist()]
                ids, sizes, back = encode_texts(texts, m, table + unwritten(part.column("own").flatten()))
                same = [t is None or m.text_of(b) == t for t, b in zip(texts, back)]
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.array([t is None for t in texts] + [False]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])

    found = keyed.mapInArrow(rare, "key long, unit string").join(table.filter(~common).select("unit", written(F.col("unit"), F.col("ids")).alias("row")), "unit")
    own = found.groupBy("key").agg(F.collect_set("row").alias("own"))
    joined = keyed.mapInArrow(compressed, "doc_id long, key long, packed binary").join(own, "key", "left")
    return joined.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with column text: the ids' text; null for null ids. Ids outside the table give nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def text_of(ids):
        n = len(shared.value.texts)
        return None if ids is None else shared.value.decode([i for i in ids if i is not None and 0 <= i < n])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(text_of, part.column(ids_col).to_pylist()), pa.string())], names=[*part.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, text string")
