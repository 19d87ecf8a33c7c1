"""Messages, and tables that are derived from them for trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import parsing

MODELS = ("gpt-4.1", "gpt-4.1-mini", "gpt-4.1-nano", "gpt-4o", "gpt-4o-mini", "unknown")


def messages_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def marked_messages(conversations: DataFrame) -> DataFrame:
    """Conversations with the marks of an interview, set by fixed rules over ids and turns."""
    c, t = F.col("conv_id"), F.col("turn")
    said = F.col("role") == "assistant"
    k = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    rows = conversations.withColumn("k", k)
    asks = said & ((F.col("k") == 1) | (((c * 3 + t) % 4).isin(0, 1) & ((c + F.col("k")) % 2 == 0)))
    rows = rows.withColumn("asks", asks).withColumn("next_asks", F.lead("asks", 1, False).over(Window.partitionBy("conv_id").orderBy("turn")))
    question = F.concat(F.lit("---NEXT QUESTION---\n"), F.col("text"), F.lit("\n---END QUESTION---"))
    feedback = F.concat(F.lit("---FEEDBACK---\n**Score:** "), ((c * 7 + t * 3) % 11).cast("string"), F.lit("/10\n"), F.col("text"), F.lit("\n---END FEEDBACK---"))
    content = (
        F.when(F.col("role") == "system", F.col("text")).when(F.col("asks"), question).when(said & ((c + t * 5) % 7 == 0), F.col("text")).when(said, feedback)
        .when(F.col("k") == 1, F.lit(parsing.READY)).when(F.col("next_asks"), F.lit(parsing.SATISFIED)).otherwise(F.col("text"))
    )
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", content.alias("content"))


def api_calls_of(conversations: DataFrame) -> DataFrame:
    """Synthetic calls: one per assistant turn; tokens are characters of what came before, and of the turn."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = conversations.withColumn("input_tokens", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("conv_id") % 6 + 1).cast("int"))
    return rows.filter(F.col("role") == "assistant").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("call_seq"), model.alias("model"), "input_tokens", F.length("text").cast("long").alias("output_tokens"))


def ui_events_of(conversations: DataFrame) -> DataFrame:
    """Conversations as event logs, by fixed rules over ids and turns: (session_id, seq, event, text, reply, total_questions).

    The first row of a conversation that is no system row starts the session.
    """
    c, t = F.col("conv_id"), F.col("turn")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    pick = (c * 5 + t * 3) % 12
    answers = F.element_at(F.array(*[F.lit(e) for e in ("submit",) * 8 + ("skip", "skip", "improve", "next")]), (pick + 1).cast("int"))
    moves = F.element_at(F.array(*[F.lit(e) for e in ("next",) * 5 + ("improve", "improve", "submit", "submit", "skip", "start", "reset")]), (pick + 1).cast("int"))
    event = F.when(k == 1, F.lit("start")).when(F.col("role") == "user", answers).otherwise(moves)
    score = F.when((c + t) % 6 != 0, F.concat(F.lit("**Score:** "), ((c * 7 + t * 3) % 11).cast("string"), F.lit("/10"))).otherwise(F.lit("no score"))
    reply = F.concat(F.lit("---FEEDBACK---\n"), score, F.lit("\n---END FEEDBACK---\n---NEXT QUESTION---\n"), F.col("text"), F.lit("\n---END QUESTION---"))
    rows = conversations.filter(F.col("role") != "system").withColumn("event", event)
    start = F.col("event") == "start"
    return rows.select(
        c.alias("session_id"), t.alias("seq"), "event", F.when(start, F.when(c % 9 == 0, F.lit(" ")).otherwise(F.lit("Engineer"))).when((c + t) % 8 == 0, F.lit("a")).otherwise(F.col("text")).alias("text"),
        F.when(start, F.concat(F.lit("---NEXT QUESTION---\n"), F.col("text"), F.lit("\n---END QUESTION---"))).otherwise(reply).alias("reply"), F.when(start, (F.lit(1) + c % 4).cast("int")).alias("total_questions"),
    )


def _one_of(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def sessions_of(conversations: DataFrame) -> DataFrame:
    """A session's settings and summaries for each conversation, by fixed rules over ids; the summaries are its first and last texts."""
    c = F.col("session_id")
    ends = conversations.groupBy(F.col("conv_id").alias("session_id")).agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    return ends.select(
        "session_id", _one_of(("Zero-Shot", "Few-Shot", "Chain-of-Thought", "Persona-Based", "Structured Output"), c).alias("technique"), _one_of(("", None, "  ", "Engineer"), c).alias("role"),
        _one_of(("Behavioral", "Technical", "Mixed (Behavioral + Technical)"), c).alias("interview_type"), _one_of(("Easy", "Medium", "Hard"), c + 1).alias("difficulty"), _one_of(("Friendly 😊", "Neutral 😐", "Strict 😤"), c).alias("persona_key"),
        F.when(c % 2 == 1, F.col("first")).otherwise(F.lit("")).alias("jd_summary"), F.when(c % 3 != 0, F.col("last")).alias("cv_summary"), F.when(c % 5 == 0, F.concat(F.lit("gap: "), F.col("first"))).alias("gap_analysis"), (c % 2 == 0).alias("is_last"),
    )


def settings_of(conversations: DataFrame) -> DataFrame:
    """Settings as a user may leave them, by fixed rules over ids: missing, known, unknown, within bounds and beyond."""
    c = F.col("session_id")
    return conversations.select(F.col("conv_id").alias("session_id")).distinct().select(
        "session_id", _one_of((None, "Zero-Shot", "Persona-Based", "Ten-Shot"), c).alias("technique"), _one_of((None, "Strict 😤", "nobody"), c).alias("persona_key"), _one_of((*MODELS, None), c).alias("model"),
        F.when(c % 4 != 0, (c % 25) / F.lit(10.0)).alias("temperature"), F.when(c % 3 != 0, (c % 12) / F.lit(10.0)).alias("top_p"), F.when(c % 5 != 0, (F.lit(100) + c % 16 * 100).cast("int")).alias("max_tokens"), F.when(c % 6 != 0, (c % 13).cast("int")).alias("total_questions"),
    )
