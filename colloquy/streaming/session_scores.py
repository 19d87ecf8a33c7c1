"""The score fold over a stream of messages, one state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import parsing

_OUTPUT = "session_id long, seq long, ordinal int, score int"
_STATE = "attempt int, pending boolean, ordinal int, best int"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: submissions since the last move, whether one awaits its reply, and the latest entry with its score."""
    attempt, pending, ordinal, best = state.get if state.exists else (0, False, 0, 0)
    out = []
    for row in pd.concat(list(batches)).sort_values("seq").itertuples():
        if row.kind == "submit":
            attempt, pending = attempt + 1, True
        elif row.kind in ("move", "ready"):
            attempt, pending = (0 if row.kind == "move" else attempt), False
        elif pending:
            pending = False
            if not pd.isna(row.score) and (attempt == 1 or ordinal):
                ordinal, best = (ordinal + 1, int(row.score)) if attempt == 1 else (ordinal, max(best, int(row.score)))
                out.append((key[0], row.seq, ordinal, best))
    state.update((attempt, pending, ordinal, best))
    yield pd.DataFrame(out, columns=["session_id", "seq", "ordinal", "score"])


def stream_scores(messages: DataFrame) -> DataFrame:
    """Each change of a session's scores: (session_id, seq, ordinal, score so far).

    ``messages`` (session_id, seq, role, content) is a stream whose batches come in
    order of seq within a session; the last row of an ordinal holds its score.
    """
    content = F.col("content")
    kind = (
        F.when(F.col("role") == "assistant", F.lit("reply")).when(content.isin(parsing.SATISFIED, parsing.SKIPPED), F.lit("move")).when(content == parsing.READY, F.lit("ready")).otherwise(F.lit("submit"))
    )
    rows = messages.filter(F.col("role").isin("user", "assistant")).select("session_id", "seq", kind.alias("kind"), parsing.score(content).alias("score"))
    return rows.groupBy("session_id").applyInPandasWithState(_fold, _OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)
