"""What the operators of this subpackage share: shared-folder tables, folds, fits."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that setting is absent on a single machine, as in tests, a folder of this
    process is set once and kept for the session. On a cluster its absence is an
    error: executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where this process' tables go, below the shared folder.
_OWN = f"colloquy-{uuid.uuid4().hex}"
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what is written.
    The table stays until :func:`discard` or, for results that still hang on it,
    :func:`clear`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_OWN}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def result_of(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as a table; the tables that it wrote on its way are deleted."""
    first = len(_written)
    out = materialize(make(), name)
    for path in _written[first:-1]:
        _delete(spark, path)
    del _written[first:-1]
    return out


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process wrote, once no result that hangs on them is read any more."""
    _delete(spark, f"{shared_dir(spark)}/{_OWN}")
    _written.clear()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def to_ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a ``right`` that was aggregated by the keys.

    It lies dealt by them already, and adaptive execution splits a hot key's rows
    only where both sides are exchanged for the join. A hash of the keys as a
    further key asks for that; ``right`` has one row a key and moves cheaply.
    """
    h, name = F.xxhash64(*on), free_name(left, free_name(right, "__h"))
    return left.withColumn(name, h).join(right.withColumn(name, h), [name, *on], how).drop(name)


def hashed_sample(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """The ``most`` rows of the smallest hash of ``key``, ties by the key.

    A share of the rows, by the hash, is picked first, so that no task sorts more
    than a little over ``most`` rows, however many there are.
    """
    order = F.xxhash64(key, F.lit(seed))
    share = (most * 1.2 + 200) / max(df.count(), 1)
    picked = df if share >= 1 else df.filter(F.pmod(F.shiftright(order, 20), F.lit(1 << 40)) < int(share * (1 << 40)))
    return picked.orderBy(F.pmod(F.shiftright(order, 20), F.lit(1 << 40)), key).limit(most)


def binary_values(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, nulls as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, arrow: pa.Schema, barrier: bool = False) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch; ``fn`` returns columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f in arrow for c in [columns[f.name]]], schema=arrow)

    return df.mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, l1: float = 0.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated proximal gradient; the intercept is not penalised.

    Returns weights and intercept. With one class only, weights are zero and the
    intercept gives that class a probability near one.
    """
    n, d = x.shape
    if n == 0:
        return np.zeros(d), 0.0
    if y.min() == y.max():
        return np.zeros(d), 6.0 if y[0] else -6.0
    probe = np.full(d, 1 / np.sqrt(max(d, 1)), x.dtype)
    for _ in range(12):  # the largest eigenvalue bounds the step
        probe = x.T @ (x @ probe)
        norm = np.linalg.norm(probe)
        if norm == 0:
            break
        probe = probe / norm
    step = 1.0 / (0.25 * (float(np.linalg.norm(x @ probe) ** 2) / n * 1.1 + 1.0) + l2)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(d), float(np.log(mean / (1 - mean)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        gap = sigmoid(x @ v.astype(x.dtype) + c) - y  # in the matrix' own precision, which is not copied
        w_new = v - step * (x.T @ gap.astype(x.dtype) / n + l2 * v)
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * l1, 0.0)
        b_new = c - step * float(gap.mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w_new + (t - 1) / t_new * (w_new - w)
        c = b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, b
