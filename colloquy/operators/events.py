"""A session's events: what each may do, and the state that they lead to.

Events (session_id, seq, event, text, reply, total_questions) are start, submit, next,
skip, improve and reset. text is the role at a start and the answer at a submission;
reply is what the model said to it; total_questions counts at a start. Events that the
state doesn't allow, and answers that a guard refuses, change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import EVENTS, checked
from . import guards, parsing
from .scores import show_improve

#: Questions of a session whose start gives no number.
DEFAULT_TOTAL = 4
#: The state that a session begins with and that a reset brings back, by name and type.
STATE = {
    "started": ("boolean", False), "done": ("boolean", False), "question_count": ("int", 1), "total_questions": ("int", DEFAULT_TOTAL), "attempt": ("int", 0),
    "awaiting_decision": ("boolean", False), "is_final_answer": ("boolean", False), "last_score": ("int", None), "scores": ("array<int>", []), "n_messages": ("long", 0),
}


def read(events: DataFrame) -> DataFrame:
    """(session_id, seq, event, refused, said, reply, score, total_questions): what a fold needs of each event.

    refused is why a start or an answer isn't taken, or null; said and reply are the
    two messages that the event adds if it is taken; score is that of the reply. All
    of it hangs on the event alone, so that it is found once, before any state.
    """
    event, text, reply = F.col("event"), F.coalesce("text", F.lit("")), F.coalesce("reply", F.lit(""))
    verdict = guards.answer_guard(text)
    refused = (
        F.when(event.isin("start", "submit") & ~guards.not_blank(text), F.lit("blank"))
        .when((event == "submit") & ~verdict["ok"], verdict["code"])
    )
    kept = F.when(event == "submit", parsing.without_question(reply)).when(event.isin("next", "skip"), parsing.without_feedback(reply)).otherwise(reply)
    said = F.when(event == "start", F.lit(parsing.READY)).when(event == "submit", text).when(event == "next", F.lit(parsing.SATISFIED)).when(event == "skip", F.lit(parsing.SKIPPED))
    total = F.when(event == "start", F.coalesce("total_questions", F.lit(DEFAULT_TOTAL)))
    found = checked(events, EVENTS).select("session_id", "seq", "event", refused.alias("refused"), said.alias("said"), kept.alias("reply"), total.cast("int").alias("total_questions"))
    return found.withColumn("score", parsing.score(F.col("reply")))


def _begin() -> Column:
    return F.struct(*[(F.array() if value == [] else F.lit(value)).cast(kind).alias(name) for name, (kind, value) in STATE.items()])


def _after(s: Column, e: Column) -> Column:
    """The state after event ``e``; each field by itself."""
    event, score = e["event"], e["score"]
    live = s["started"] & ~s["done"]
    starts = (event == "start") & ~s["started"] & e["refused"].isNull()
    submits = (event == "submit") & live & ~s["awaiting_decision"] & e["refused"].isNull()
    improves = (event == "improve") & live & s["awaiting_decision"] & show_improve(s["last_score"])
    wants_next = (event == "next") & live & s["awaiting_decision"]
    skips = (event == "skip") & live & ~(s["awaiting_decision"] & s["is_final_answer"])
    ends = (wants_next & s["is_final_answer"]) | (skips & (s["question_count"] >= s["total_questions"]))
    moves = (wants_next | skips) & ~ends
    settles = moves | improves
    first = F.when((s["attempt"] == 0), F.concat(s["scores"], F.array(score)))
    better = F.when(F.size(s["scores"]) > 0, F.concat(F.slice(s["scores"], 1, F.size(s["scores"]) - 1), F.array(F.greatest(F.element_at(s["scores"], -1), score)))).otherwise(s["scores"])
    fields = {
        "started": s["started"] | starts,
        "done": s["done"] | ends,
        "question_count": F.when(starts, F.lit(1)).when(moves & (event == "next"), F.least(s["question_count"] + 1, s["total_questions"])).when(moves, s["question_count"] + 1).otherwise(s["question_count"]),
        "total_questions": F.when(starts, e["total_questions"]).otherwise(s["total_questions"]),
        "attempt": F.when(starts | moves, F.lit(0)).when(submits, s["attempt"] + 1).otherwise(s["attempt"]),
        "awaiting_decision": (s["awaiting_decision"] | submits) & ~(ends | settles),
        "is_final_answer": F.when(submits, s["question_count"] == s["total_questions"]).otherwise(s["is_final_answer"] & ~settles),
        "last_score": F.when(starts | submits | moves, score).otherwise(s["last_score"]),
        "scores": F.when(submits & score.isNotNull(), F.coalesce(first, better)).otherwise(s["scores"]),
        "n_messages": s["n_messages"] + F.when(starts | submits | moves, F.lit(2)).otherwise(F.lit(0)).cast("long"),
    }
    after = F.struct(*[c.cast(STATE[name][0]).alias(name) for name, c in fields.items()])
    return F.when(event == "reset", _begin()).otherwise(after)


def final_states(events: DataFrame) -> DataFrame:
    """The state that each session's events, in order of seq, lead to: session_id and the fields of STATE.

    A fold over one array a session: a scan, one exchange by session, no join.
    """
    steps = read(events).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "refused", "score", "total_questions"))).alias("events"))
    return steps.select("session_id", F.aggregate("events", _begin(), _after).alias("s")).select("session_id", "s.*")
