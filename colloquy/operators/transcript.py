"""Transcripts: chat numbering and the report's questions and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import parsing
from .folds import folded, listed


def chat(messages: DataFrame, awaiting: DataFrame | None = None) -> DataFrame:
    """What the chat shows: (session_id, seq, part, kind, number, text).

    The first assistant row is Question 1; later ones show feedback, then a
    question with the next number. ``awaiting`` (session_id): sessions in which
    the last assistant row's question is held back.
    """
    rows = messages.filter(F.col("role").isin("user", "assistant"))
    if awaiting is not None:
        rows = rows.join(awaiting.select("session_id").distinct().withColumn("held", F.lit(True)), "session_id", "left")
    else:
        rows = rows.withColumn("held", F.lit(False))
    whole = Window.partitionBy("session_id")
    by_session = whole.orderBy("seq")
    said = F.col("role") == "assistant"
    rows = (
        rows.withColumn("feedback", parsing.chat_feedback(F.col("content")))
        .withColumn("question", parsing.question(F.col("content")))
        .withColumn("opening", said & (F.sum(F.when(said, 1).otherwise(0)).over(by_session) == 1))
        .withColumn("last_said", F.max(F.when(said, F.col("seq"))).over(whole))
    )
    asks = said & ~F.col("opening") & (F.col("question") != "") & ~(F.coalesce("held", F.lit(False)) & (F.col("seq") == F.col("last_said")))
    rows = rows.withColumn("asks", asks).withColumn("number", F.lit(1) + F.sum(F.when(F.col("asks"), 1).otherwise(0)).over(by_session))
    nothing = F.lit(None)

    def part(i: int, kind: str, number, text, when) -> object:
        return F.when(when, F.struct(F.lit(i).alias("part"), F.lit(kind).alias("kind"), number.cast("long").alias("number"), text.alias("text")))

    parts = F.array(
        part(0, "question", F.lit(1), F.when(F.col("question") != "", F.col("question")).otherwise(F.col("content")), F.col("opening")),
        part(0, "user", nothing, F.col("content"), (F.col("role") == "user") & ~F.col("content").isin(*parsing.CHAT_INTERNAL)),
        part(0, "feedback", nothing, F.col("feedback"), said & ~F.col("opening") & (F.col("feedback") != "")),
        part(1, "question", F.col("number"), F.col("question"), F.col("asks")),
    )
    return rows.select("session_id", "seq", F.explode(F.array_compact(parts)).alias("p")).select("session_id", "seq", "p.*")


def report_blocks(messages: DataFrame) -> DataFrame:
    """The report's blocks, literally: (session_id, number, question, score, attempt, answer, feedback).

    A question opens at the first assistant row without feedback, or at any with
    feedback and a question; only the latter kind closes a block. So a question
    that comes without feedback after the first does not open a block, and text
    around a question block counts as feedback. Scores are joined by position. A
    block without attempts has one row with null attempt. See :mod:`~colloquy.operators.folds`.
    """
    return listed(folded(messages), "blocks")


def repaired_blocks(messages: DataFrame) -> DataFrame:
    """The same columns with blocks as a reader means them.

    Every question block opens a question; skipped answers are none; feedback
    stays with its answer; a block's score is the best of its own attempts.
    """
    return listed(folded(messages), "repaired")


def nested(messages: DataFrame) -> DataFrame:
    """A row per session with literal blocks: array of (number, question, score, attempts of (attempt, answer, feedback)), in order."""
    tries = lambda b: F.transform(b["tries"], lambda t, j: F.struct((j + 1).alias("attempt"), t["answer"].alias("answer"), t["feedback"].alias("feedback")))
    blocks = F.transform("blocks", lambda b, i: F.struct((i + 1).cast("long").alias("number"), b["question"].alias("question"), b["score"].alias("score"), tries(b).alias("attempts")))
    return folded(messages).filter(F.size("blocks") > 0).select("session_id", blocks.alias("questions"))
