"""The event state machine over a stream: one state a session, several variables.

The state is kept by ``transformWithState``: flags and counters, the scores as a
list, and what the last reply scored. A reset clears all of it, so that a session
that is over takes no room. Needs the RocksDB state store, which
:func:`stream_events` sets for the session where no other is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import events as machine

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FLAGS = "started boolean, done boolean, awaiting_decision boolean, is_final_answer boolean"
_COUNTS = "question_count int, total_questions int, attempt int, n_messages long"
_MESSAGES = "array<struct<role:string,content:string>>"
OUTPUT = f"session_id {{}}, seq long, event string, accepted boolean, refused string, {_FLAGS}, {_COUNTS}, last_score int, scores array<int>, messages {_MESSAGES}"


class _Session:
    """A session's state in hand; :meth:`take` applies one event."""

    def __init__(self, flags: tuple | None, counts: tuple | None, last_score: tuple | None, scores: list[int]):
        self.started, self.done, self.awaiting, self.final = flags or (False, False, False, False)
        self.number, self.total, self.attempt, self.n_messages = counts or (1, machine.DEFAULT_TOTAL, 0, 0)
        self.last_score = last_score[0] if last_score else None
        self.scores = scores

    def take(self, event: str, refused: str | None, score: int | None, total: int | None) -> tuple[bool, bool]:
        """Whether the event is accepted, and whether it adds messages."""
        live = self.started and not self.done
        if event == "start" and not self.started and refused is None:
            self.started, self.number, self.total, self.attempt = True, 1, total, 0
        elif event == "submit" and live and not self.awaiting and refused is None:
            if score is not None and self.attempt == 0:
                self.scores.append(score)
            elif score is not None and self.scores:
                self.scores[-1] = max(self.scores[-1], score)
            self.attempt, self.awaiting, self.final = self.attempt + 1, True, self.number == self.total
        elif event == "improve" and live and self.awaiting and (self.last_score is None or self.last_score < 10):
            self.awaiting = self.final = False
            return True, False
        elif event == "next" and live and self.awaiting and self.final or event == "skip" and live and not (self.awaiting and self.final) and self.number >= self.total:
            self.done, self.awaiting = True, False
            return True, False
        elif event == "next" and live and self.awaiting or event == "skip" and live and not (self.awaiting and self.final):
            self.number = self.number + 1 if event == "skip" else min(self.number + 1, self.total)
            self.attempt, self.awaiting, self.final = 0, False, False
        else:
            return False, False
        self.last_score = score
        self.n_messages += 2
        return True, True


def _given(value: object) -> object:
    return None if pd.isna(value) else value


class _Events(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", _FLAGS)
        self.counts = handle.getValueState("counts", _COUNTS)
        self.last_score = handle.getValueState("last_score", "score int")
        self.scores = handle.getListState("scores", "score int")

    def _clear(self) -> None:
        for variable in (self.flags, self.counts, self.last_score, self.scores):
            variable.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        scores = [r[0] for r in self.scores.get()] if self.scores.exists() else []
        session = _Session(*[v.get() if v.exists() else None for v in (self.flags, self.counts, self.last_score)], scores)
        out = []
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            refused, score, total = _given(row.refused), _given(row.score), _given(row.total_questions)
            if row.event == "reset":
                session, accepted, speaks = _Session(None, None, None, []), True, False
            else:
                accepted, speaks = session.take(row.event, refused, score if score is None else int(score), total if total is None else int(total))
            messages = [{"role": "user", "content": row.said}, {"role": "assistant", "content": row.reply}] if speaks else []
            out.append((key[0], row.seq, row.event, accepted, refused, session.started, session.done, session.awaiting, session.final, session.number, session.total, session.attempt, session.n_messages, session.last_score, list(session.scores), messages))
        if session.started:
            self.flags.update((session.started, session.done, session.awaiting, session.final))
            self.counts.update((session.number, session.total, session.attempt, session.n_messages))
            self.last_score.update((session.last_score,))
            if session.scores:  # an empty list can't be put
                self.scores.put([(s,) for s in session.scores])
        else:
            self._clear()
        names = [f.split(" ")[0] for f in "session_id,seq,event,accepted,refused,started,done,awaiting_decision,is_final_answer,question_count,total_questions,attempt,n_messages,last_score,scores,messages".split(",")]
        frame = pd.DataFrame(out, columns=names)
        frame["last_score"] = frame["last_score"].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


def stream_events(events: DataFrame) -> DataFrame:
    """A row for each event: whether it was accepted, the state after it, and the messages that it added.

    ``events`` is a stream (see :mod:`~colloquy.operators.events`) whose batches come
    in order of seq within a session. The last row of a session holds what
    :func:`~colloquy.operators.events.final_states` gives for its whole log.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)
    kind = events.schema["session_id"].dataType.simpleString()
    return machine.read(events).groupBy("session_id").transformWithStateInPandas(_Events(), OUTPUT.format(kind), "append", "none")
