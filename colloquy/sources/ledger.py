"""A ledger of replies: what has been asked of a model is never asked again.

A request is known by a hash of all that is sent. The ledger is a folder of Parquet
files in parts by the hash's first two digits. Requests that it lacks are found by an
anti-join and asked by the tasks that hold them; each task writes what it has been
told at once, batch by batch, and looks into its parts first. A task that is tried
again, or a run after one that was killed, so goes on where the last has stopped; at
most the batch in the air is asked twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import names_in, store
from .schemas import REPLIES

#: Who asks is no part of a request: equal requests share a reply.
_ASKERS = ("key", "session_id", "request")
_ARROW = pa.schema([("request", pa.string()), ("model", pa.string()), ("reply", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64())])


class Reply(NamedTuple):
    reply: str
    prompt_tokens: int
    completion_tokens: int


Client = Callable[[pd.DataFrame], list[Reply]]


def keyed(asked: DataFrame) -> DataFrame:
    """``asked`` with request, the SHA-256 of all its columns but those of who asks, by name; columns may be arrays and structs."""
    return asked.withColumn("request", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(asked.columns) if c not in _ASKERS])), 256))


def replies(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's replies (request, model, reply, prompt_tokens, completion_tokens), one a request: the least, should there be two. A ledger that is not there is empty."""
    files, folder = store(path)
    if not names_in(files, folder):
        return spark.createDataFrame([], REPLIES)
    rows = spark.read.schema(REPLIES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.groupBy("request").agg(F.min(F.struct("model", "reply", "prompt_tokens", "completion_tokens")).alias("r")).select("request", "r.*")


def open_requests(asked: DataFrame, path: str) -> DataFrame:
    """Requests of ``asked`` (see :func:`keyed`) that the ledger lacks, each once."""
    return keyed(asked).dropDuplicates(["request"]).join(replies(asked.sparkSession, path).select("request"), "request", "left_anti")


def record(asked: DataFrame, client: Client, path: str, batch: int = 16) -> int:
    """Ask ``client`` what the ledger lacks and add its replies; the number asked.

    ``asked``: rows of requests, with a column model, such as the three analyses' and
    the chat's. The client gets ``batch`` of them at a time as a pandas frame, with
    request as a name by which it may tell repeated calls. Runs outside queries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = store(path)
        known: dict[str, set[str]] = {}

        def had(part: str) -> set[str]:
            if part not in known:  # what an earlier try of this task has written
                known[part] = {r for name in names_in(files, f"{folder}/part={part}") if name.endswith(".parquet") for r in pq.read_table(name, filesystem=files, columns=["request"], partitioning=None).column(0).to_pylist()}
            return known[part]

        for rows in batches:
            n = 0
            for part, own in rows.groupby(rows["request"].str[:2]):
                todo = own[~own["request"].isin(had(part))]
                for at in range(0, len(todo), batch):
                    some = todo.iloc[at : at + batch].reset_index(drop=True)
                    told = client(some)
                    if len(told) != len(some):
                        raise ValueError(f"{len(told)} replies to {len(some)} requests")
                    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((some["request"], some["model"], *zip(*told)), _ARROW)], schema=_ARROW)
                    name = f"{folder}/part={part}/{uuid.uuid4().hex}"
                    files.create_dir(f"{folder}/part={part}", recursive=True)
                    pq.write_table(table, f"{name}.tmp", filesystem=files)
                    files.move(f"{name}.tmp", f"{name}.parquet")  # seen whole or not at all
                    n += len(some)
            yield pd.DataFrame({"n": [n]})

    parts = open_requests(asked, path).repartition(F.substring("request", 1, 2))
    return parts.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def answered(asked: DataFrame, told: DataFrame) -> DataFrame:
    """``asked`` with request, reply, prompt_tokens and completion_tokens, from replies (see :func:`replies`); nulls where there is none."""
    return keyed(asked).join(told.select("request", "reply", "prompt_tokens", "completion_tokens"), "request", "left")
