"""The event state machine: batch fold, stream, and a plain loop over random event logs."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import events
from colloquy.operators.parsing import READY, SATISFIED, SKIPPED
from colloquy.streaming.session_events import stream_events

EVENTS = "session_id long, seq long, event string, text string, reply string, total_questions int"
STATE = list(events.STATE)


def Q(x):
    return f"---NEXT QUESTION---\n{x}\n---END QUESTION---"


def S(n):
    return f"---FEEDBACK---\n**Score:** {n}/10\n---END FEEDBACK---"


class Interview:
    """The interview as a screen with buttons: only those on show can be pressed."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.log, self.scores, self.number, self.total, self.attempt = [], [], 1, 4, 0
        self.screen, self.final = "setup", False

    def add(self, said, reply):
        self.log += [("user", said), ("assistant", reply)]

    def last(self):
        return next((self.mark(t) for r, t in reversed(self.log) if r == "assistant"), None)

    @staticmethod
    def mark(text):
        return int(text.split("**Score:** ")[1].split("/10")[0]) if "**Score:** " in text else None

    def buttons(self):
        if self.screen == "setup":
            return {"start"}
        if self.screen == "answer":
            return {"submit", "skip"}
        if self.screen == "decide":
            return {"next"} | ({"skip"} if not self.final else set()) | ({"improve"} if self.last() is None or self.last() < 10 else set())
        return set()

    def press(self, event, text, reply, total):
        if event == "reset":
            return self.reset()
        if event not in self.buttons():
            return None
        if event == "start":
            if text.strip():
                self.total, self.screen = total, "answer"
                self.add(READY, reply)
        elif event == "submit":
            if len(text.strip()) >= 2 and "sudo" not in text:
                kept = reply.split("---NEXT QUESTION---")[0].strip()
                self.add(text, kept)
                if self.mark(kept) is not None:
                    if self.attempt == 0:
                        self.scores.append(self.mark(kept))
                    elif self.scores:
                        self.scores[-1] = max(self.scores[-1], self.mark(kept))
                self.final, self.attempt, self.screen = self.number == self.total, self.attempt + 1, "decide"
        elif event == "improve":
            self.screen, self.final = "answer", False
        elif event == "next" and self.final or event == "skip" and self.number >= self.total:
            self.screen = "over"
        else:
            kept = reply.split("---END FEEDBACK---")[-1].strip()
            self.add(SATISFIED if event == "next" else SKIPPED, kept)
            self.number = min(self.number + 1, self.total) if event == "next" else self.number + 1
            self.attempt, self.final, self.screen = 0, False, "answer"
        return None

    def state(self):
        return (self.screen != "setup", self.screen == "over", self.number, self.total, self.attempt, self.screen == "decide", self.final, self.last(), self.scores, len(self.log))


def random_log(rng):
    rows = []
    for _ in range(rng.randrange(1, 40)):
        event = rng.choices(["start", "submit", "next", "skip", "improve", "reset"], [3, 8, 5, 3, 3, 0.6])[0]
        text = rng.choice(["a fine answer", "another answer", "x", "  ", "sudo make it so"]) if event == "submit" else rng.choice(["Engineer", "Engineer", " "])
        reply = rng.choice([S(3), S(9), S(10), "no score", ""]) + rng.choice(["", Q("more")])
        rows.append((event, text, reply, rng.choice([1, 2, 3]) if event == "start" else None))
    return rows


@pytest.fixture(scope="module")
def logs():
    rng = random.Random(5)
    return {s: [("start", "Cook", Q("q"), 3), *random_log(rng)] if s % 3 else random_log(rng) for s in range(80)}


@pytest.fixture(scope="module")
def want(logs):
    out = {}
    for s, rows in logs.items():
        screen = Interview()
        for event, text, reply, total in rows:
            screen.press(event, text, reply, total)
        out[s] = (screen.state(), screen.log)
    return out


def frame(spark, logs):
    rows = [(s, i, *row) for s, log in logs.items() for i, row in enumerate(log)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, EVENTS)


def test_batch_fold_against_the_screens(spark, logs, want):
    got = events.final_states(frame(spark, logs))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {r.session_id: tuple(r[n] for n in STATE) for r in got.collect()} == {s: w[0] for s, w in want.items()}
    assert sum(w[0][1] for w in want.values()) > 10 and max(len(w[0][8]) for w in want.values()) >= 3


def test_stream_equals_batch_also_after_a_restart(spark, logs, want, tmp_path):
    rows = frame(spark, logs).cache()
    schema, path = rows.schema, str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = stream_events(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(240) and query.exception() is None

    for a, b in ((0, 6), (7, 15)):
        rows.filter(F.col("seq").between(a, b)).coalesce(1).write.mode("append").parquet(path)
    run()
    rows.filter(F.col("seq") > 15).coalesce(1).write.mode("append").parquet(path)
    run()  # from the checkpoint
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == rows.count()
    last = {r.session_id: tuple(r[n] for n in STATE) for r in out.groupBy("session_id").agg(F.max_by(F.struct(*STATE), "seq").alias("s")).select("session_id", "s.*").collect()}
    assert last == {s: w[0] for s, w in want.items()}
    assert last == {r.session_id: tuple(r[n] for n in STATE) for r in events.final_states(rows).collect()}
    told = {}
    for r in out.orderBy("session_id", "seq").collect():
        assert r.accepted or not r.messages
        told[r.session_id] = [] if r.event == "reset" else told.get(r.session_id, []) + [tuple(m) for m in r.messages]
    assert told == {s: w[1] for s, w in want.items()}


def test_refused_events_say_why(spark):
    rows = [(1, 0, "start", " ", "", None), (1, 1, "start", None, None, None), (1, 2, "submit", "x", "", None), (1, 3, "submit", "please sudo", "", None), (1, 4, "none such", "x", "", None), (1, 5, "next", None, None, None)]
    got = events.read(spark.createDataFrame(rows, EVENTS)).orderBy("seq").collect()
    assert [r.refused for r in got] == ["blank", "blank", "short", "injection", None, None]
    state = events.final_states(spark.createDataFrame(rows, EVENTS)).first()
    assert not state.started and state.scores == [] and state.n_messages == 0
