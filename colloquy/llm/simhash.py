"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. Bit i is given the vector i mod (2^(r+1) - 1) + 1 over GF(2), of r + 1
components; table v keeps the bits whose vector has an odd product with v. The r
vectors at most of the bits in which two fingerprints differ leave some v with
even products only, so that a pair within radius r always collides in a table.

Buckets are not expanded into pairs. Fingerprints of a shared bucket meet at hubs:
values at most r/2 bits from each. Two fingerprints are within r bits exactly if
they share such a value, so a star around each hub links what all pairs would.

One fingerprint meets few of the pairs that are alike but not nearly the same. Several, by
hashes of their own, meet more: a pair is linked where any of them are within the
radius, and every pair that is so is linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, free_name, map_batches, materialize, spread_join
from .components import connected_components

_BITS = 64
_CHUNK = 1 << 16


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The ``j``-th of several hashes that one 64-bit hash gives; the first is the hash itself."""
    if j:
        with np.errstate(over="ignore"):
            h = h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def fingerprints_of(text: bytes, size: int = 3, n: int = 1) -> list[int]:
    """``n`` fingerprints of the lower-cased text's shingles of ``size`` words, repeats counted, each by a hash of its own; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return [0] * n
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [int(_mixed(np.array([digest(line, 42)], np.uint64), j)[0]) for j in range(n)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    set_in = np.zeros((n, _BITS), np.int64)
    for at in range(0, len(first), _CHUNK):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])], dtype="<u8")
        for j in range(n):
            set_in[j] += np.unpackbits(_mixed(hashes, j).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int(np.packbits(2 * row > len(first), bitorder="little").view("<u8")[0]) for row in set_in]


def fingerprint(text: bytes, size: int = 3) -> int:
    return fingerprints_of(text, size)[0]


def masks(radius: int = 2) -> list[int]:
    """The tables' bit masks, as signed 64-bit numbers."""
    n = 2 ** (radius + 1) - 1
    out = [sum(1 << i for i in range(_BITS) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << _BITS) if m >> (_BITS - 1) else m for m in out]


def _signed(x: int) -> int:
    return x - (1 << _BITS) if x >> (_BITS - 1) else x


def _hashes(id_col: str, text_col: str, key: str = "key", salt: str = "salt") -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias(key), F.hash(text_col, id_col).alias(salt)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, n: int = 1) -> DataFrame:
    """doc_id, key and salt (hashes of id and text, 96 bits), fp (the first fingerprint's bits as a signed long) and fps (all ``n``), a row per row of ``df``."""
    arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("salt", pa.int32()), ("fp", pa.int64()), ("fps", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> dict:
        found = [[_signed(x) for x in fingerprints_of(t, size, n)] for t in binary_values(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "salt": batch.column("salt"), "fp": [f[0] for f in found], "fps": found}

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), *_hashes(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, run, "doc_id long, key long, salt int, fp long, fps array<long>", arrow)


def links(fps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(u, v), and the columns ``by``: links of distinct fingerprints ``fps`` (fp), among those that agree in ``by``, that connect all pairs at most two bits apart, and no others."""
    tables = masks(2)
    keys = fps.select(*by, "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in tables])).alias("t", "key"))
    shared = keys.groupBy(*by, "t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by, "t", "key")
    free = F.element_at(F.array(*[F.lit(~m) for m in tables]), F.col("t") + 1)
    met = spread_join(keys, shared, [*by, "t", "key"]).groupBy(*by, "fp").agg(F.bit_or(free).alias("free"))
    bits = [F.when(F.col("free").bitwiseAND(F.lit(_signed(1 << i))) != 0, F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)))) for i in range(_BITS)]
    hubs = met.select(*by, "fp", F.explode(F.array_compact(F.array(F.col("fp"), *bits))).alias("hub"))
    centre = hubs.groupBy(*by, "hub").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most").select(*by, "hub", "least")
    return spread_join(hubs, centre, [*by, "hub"]).filter("fp <> least").select(*by, F.col("fp").alias("u"), F.col("least").alias("v"))


def groups(fps: DataFrame) -> DataFrame:
    """(fp, root): every distinct fingerprint of ``fps`` (fp) and the least one that links reach."""
    found = connected_components(links(fps)).withColumnRenamed("node", "fp")
    return fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``df``.

    Texts whose fingerprints differ in two bits at most are linked; component_id
    is the smallest doc_id that links reach, the row's own included. Equal
    fingerprints are combined first and only distinct ones are hashed and linked.
    Texts without words, null ones too, share fingerprint 0. Repeated rows each
    get a row; a component of null ids alone has a null component_id.
    """
    rows = materialize(fingerprints(df, id_col, text_col).select("doc_id", "fp"), "fingerprints")
    heads = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    rooted = materialize(heads.join(groups(heads.select("fp")), "fp"), "groups")
    reached = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    by_fp = materialize(spread_join(rooted, reached, ["root"]).select("fp", "component_id"), "components")  # the last join then has a table on either side and may be split
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def groups_by_any(sets: DataFrame) -> DataFrame:
    """(set, root): for each distinct array ``fps`` of ``sets`` (set, fps), set being a hash of it, the group that links reach.

    Two arrays are linked where their fingerprints of any one place are at most two
    bits apart. Nodes are fingerprints with their place, told apart by a hash of 64
    bits. A node that one array alone has, and that no link touches, takes no part: most don't.
    """
    place = sets.select("set", F.posexplode("fps").alias("j", "fp")).withColumn("node", F.xxhash64("j", "fp"))
    nodes = materialize(place.groupBy("j", "fp", "node").agg(F.count(F.lit(1)).alias("n")), "nodes")
    near = materialize(links(nodes.select("j", "fp"), ("j",)).select(F.xxhash64("j", "u").alias("u"), F.xxhash64("j", "v").alias("v")), "near")
    live = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).unionByName(nodes.filter("n > 1").select("node")).distinct()
    held = materialize(spread_join(place.select("set", "node"), live, ["node"]), "held")
    first = held.groupBy("set").agg(F.min("node").alias("first"))
    own = spread_join(held, first, ["set"]).select(F.col("node").alias("u"), F.col("first").alias("v"))
    found = connected_components(near.unionByName(own))
    return spread_join(first.withColumnRenamed("first", "node"), found, ["node"]).select("set", "root")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, n: int = 8) -> DataFrame:
    """The rows of ``df``, all columns, less all but one row of each group of near-duplicates.

    Texts have ``n`` fingerprints of shingles of ``size`` words, each by a hash of its
    own, and are linked where any of them are two bits apart at most. The row of the
    smallest id stays; among rows of one id that of the smallest hash of id and text,
    and one of those that agree in both. Null ids come last.
    Null texts and those without words are one group. An empty table gives none.
    Rows are told apart by two hashes, of 96 bits together; rows that agree in them
    are combined where they lie before the texts are shuffled, once, for the join.
    """
    own = [free_name(df, "__key"), free_name(df, "__salt")]
    keyed = df.select("*", *_hashes(id_col, text_col, *own))
    rows = materialize(fingerprints(df, id_col, text_col, size, n).withColumn("set", F.xxhash64("fps")), "fingerprints")
    rooted = materialize(groups_by_any(rows.groupBy("set").agg(F.first("fps").alias("fps"))), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "salt"))
    grouped = spread_join(rows.select("doc_id", "key", "salt", "set"), rooted, ["set"], "left").groupBy(F.coalesce("root", "set").alias("root"), F.col("root").isNull().alias("alone"))
    kept = grouped.agg(first.alias("first")).select(F.col("first.key").alias(own[0]), F.col("first.salt").alias(own[1]))
    return keyed.dropDuplicates(own).join(materialize(kept, "kept"), own, "left_semi").drop(*own)
