"""Scores of a session: the fold over attempts, summaries, tiers, bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_decimal
from . import parsing
from .folds import folded

# Tiers by the least average, with message (on screen, in the report) and colour; bar colours by the least score.
TIERS = (
    (8, 1, "🌟 Outstanding! You're well-prepared for this interview.", "🌟 Outstanding performance! You're well-prepared for this interview.", "#005a8e"),
    (6, 2, "✅ Good work! A bit more practice and you'll be ready.", "✅ Good work! A bit more practice on your weaker areas and you'll be ready.", "#007a59"),
    (4, 3, "📈 Decent effort — review the improved answers and try again.", "📈 Decent effort — review the improved answers and try again.", "#7a5000"),
    (None, 4, "💪 Keep practising! Study the model answers and focus on structure.", "💪 Keep practising! Study the model answers and focus on structure.", "#a03000"),
)
SCORE_COLOURS = ((7, "#3a9fd4"), (5, "#56B4E9"), (None, "#D55E00"))


def _by_least(value: Column, cases: list[tuple[int | None, object]]) -> Column:
    out = F.lit(cases[-1][1])
    for least, result in reversed(cases[:-1]):
        out = F.when(value >= least, F.lit(result)).otherwise(out)
    return out


def tier(average: Column) -> Column:
    return _by_least(average, [(t[0], t[1]) for t in TIERS])


def tier_message(average: Column, report: bool = False) -> Column:
    return _by_least(average, [(t[0], t[3 if report else 2]) for t in TIERS])


def tier_colour(average: Column) -> Column:
    return _by_least(average, [(t[0], t[4]) for t in TIERS])


def score_colour(score: Column) -> Column:
    return _by_least(score, list(SCORE_COLOURS))


def nudge(score: Column) -> Column:
    return F.coalesce(score < 6, F.lit(False))


def show_improve(score: Column) -> Column:
    return score.isNull() | (score < 10)


def attempts(messages: DataFrame) -> DataFrame:
    """User and assistant rows of messages (session_id, seq, role, content) with visit, attempt and score.

    A submission is a user row that is no internal message. visit counts the
    requests for a next question; attempt counts submissions in the visit from 0.
    score is set on an assistant row that replies to a submission. One shuffle, by
    session.
    """
    by_session = Window.partitionBy("session_id").orderBy("seq")
    is_user = F.col("role") == "user"
    moves = is_user & F.col("content").isin(parsing.SATISFIED, parsing.SKIPPED)
    submits = is_user & ~F.col("content").isin(parsing.READY, parsing.SATISFIED, parsing.SKIPPED)
    rows = messages.filter(F.col("role").isin("user", "assistant"))
    rows = rows.withColumn("visit", F.sum(F.when(moves, 1).otherwise(0)).over(by_session)).withColumn("submits", submits).withColumn("answers", F.lag("submits", 1, False).over(by_session))
    by_visit = Window.partitionBy("session_id", "visit").orderBy("seq")
    rows = rows.withColumn("attempt", F.sum(F.when(F.col("submits"), 1).otherwise(0)).over(by_visit) - 1)
    return rows.withColumn("score", F.when((F.col("role") == "assistant") & F.col("answers"), parsing.score(F.col("content"))))


def score_list(messages: DataFrame) -> DataFrame:
    """(session_id, ordinal, score): the best score of each scored question.

    A score of a first attempt opens an entry; later ones raise the latest entry,
    of whatever question, and are dropped where there is none.
    """
    return folded(messages).select("session_id", F.posexplode("scores").alias("at", "score")).select("session_id", (F.col("at") + 1).cast("long").alias("ordinal"), "score")


def summed(scores: Column) -> dict[str, Column]:
    """Average, shown average, best, worst, number, tier, message and colour of an array of scores; zeros without any."""
    average = F.coalesce(F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0)), F.lit(0.0))
    return {
        "avg_score": F.round(average, 9), "avg_shown": one_decimal(average), "best": F.coalesce(F.array_max(scores), F.lit(0)), "worst": F.coalesce(F.array_min(scores), F.lit(0)),
        "n_scores": F.size(scores).cast("long"), "tier": tier(average), "message": tier_message(average), "colour": tier_colour(average),
    }


def summary(messages: DataFrame) -> DataFrame:
    """A row per session: see :func:`summed`."""
    return folded(messages).select("session_id", *[c.alias(name) for name, c in summed(F.col("scores")).items()])


def breakdown(messages: DataFrame) -> DataFrame:
    """Bars: label, width in percent and colour of each score."""
    return score_list(messages).select("session_id", "ordinal", "score", *[c.alias(name) for name, c in bar(F.col("ordinal"), F.col("score")).items()])


def bar(ordinal: Column, score: Column) -> dict[str, Column]:
    """A score's label, width in percent and colour."""
    return {"label": F.concat(F.lit("Q"), ordinal.cast("string")), "width": score * 10, "colour": score_colour(score)}


def latest(messages: DataFrame) -> DataFrame:
    """Score of each session's last assistant row, null if it has none, with the two decisions that hang on it."""
    found = messages.filter(F.col("role") == "assistant").groupBy("session_id").agg(F.max_by(F.struct(parsing.score(F.col("content")).alias("score")), "seq").alias("last"))
    s = F.col("last.score")
    return found.select("session_id", s.alias("score"), nudge(s).alias("nudge"), show_improve(s).alias("show_improve"))


def progress(messages: DataFrame, total: int = 4) -> DataFrame:
    """Question number, bar, whether it is the last question, and whether the session is over.

    A fold over each session's moves and answers in order: a request for the next
    question and a skip both count up to the total. At the last question a skip ends the
    session, and so does a request once the question is answered; a request before that
    changes nothing. What comes after the end counts no more. One shuffle, by session.
    """
    content = F.col("content")
    moves = content.isin(parsing.SATISFIED, parsing.SKIPPED)
    said = F.when((F.col("role") == "user") & (content != parsing.READY), F.struct("seq", moves.alias("moves"), (content == parsing.SKIPPED).alias("skip")))
    begin = F.struct(F.lit(1).alias("number"), F.lit(False).alias("answered"), F.lit(False).alias("done"))

    def step(s: Column, m: Column) -> Column:
        over = s["done"] | ((s["number"] >= total) & m["moves"] & (m["skip"] | s["answered"]))
        number = F.when(m["moves"] & ~over, F.least(s["number"] + 1, F.lit(total))).otherwise(s["number"])
        return F.struct(number.alias("number"), (~m["moves"]).alias("answered"), over.alias("done"))

    steps = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(said)).alias("steps"))
    folded = steps.select("session_id", F.aggregate("steps", begin, step).alias("s"))
    number = F.col("s.number")
    return folded.select("session_id", number.alias("q_num"), progress_bar(number, F.lit(total)).alias("progress"), (number == total).alias("is_last"), F.col("s.done").alias("done"))


def progress_bar(number: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least((number - 1) / total, F.lit(1.0)))
