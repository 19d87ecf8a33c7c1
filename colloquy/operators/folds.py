"""A session's messages folded once: scores, the report's blocks, blocks as a reader means them.

:func:`folded` gathers what the folds need of each message, by one exchange, and gives
each fold as an array; a fold that nobody reads isn't run. A fold is an ``aggregate``
with a struct as its state, and each follows the messages one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parsing

_TRY = "struct<answer:string,feedback:string>"
_BLOCK = f"struct<question:string,tries:array<{_TRY}>>"
_SCORED_BLOCK = f"struct<question:string,score:int,tries:array<{_TRY}>>"


def steps(messages: DataFrame) -> DataFrame:
    """(session_id, steps): each session's user and assistant rows in order, parsed; no steps in a session without such rows."""
    said, user, content = F.col("role") == "assistant", F.col("role") == "user", F.col("content")
    fields = {
        "seq": F.col("seq"), "said": said, "content": content,
        "feedback": F.when(said, parsing.report_feedback(content)), "question": F.when(said, parsing.question(content)), "score": F.when(said, parsing.score(content)),
        "moves": user & content.isin(parsing.SATISFIED, parsing.SKIPPED), "submits": user & ~content.isin(parsing.READY, parsing.SATISFIED, parsing.SKIPPED),
        "answers": user & ~content.isin(*parsing.REPORT_INTERNAL), "tries": user & ~content.isin(*parsing.CHAT_INTERNAL),
    }
    step = F.when(said | user, F.struct(*[F.coalesce(c, F.lit(False)).alias(n) if n in ("said", "moves", "submits", "answers", "tries") else c.alias(n) for n, c in fields.items()]))
    return messages.groupBy("session_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _with_last(items: Column, last: Column) -> Column:
    """``items``, not empty, with another last one."""
    return F.concat(F.slice(items, 1, F.size(items) - 1), F.array(last))


def _told(tries: Column, feedback: Column) -> Column:
    """Feedback goes to the last try, over what that had."""
    return F.when(F.size(tries) > 0, _with_last(tries, F.struct(F.element_at(tries, -1)["answer"].alias("answer"), feedback.alias("feedback")))).otherwise(tries)


def _tried(tries: Column, answer: Column) -> Column:
    return F.concat(tries, F.array(F.struct(answer.alias("answer"), F.lit("").alias("feedback"))))


def _or_content(m: Column) -> Column:
    return F.when(m["question"] != "", m["question"]).otherwise(m["content"])


def score_fold(steps: Column) -> Column:
    """Array of the scores: that of a first submission opens an entry, that of a later one raises the last entry; a move begins anew."""
    begin = F.struct(F.lit(0).alias("attempt"), F.lit(False).alias("pending"), _empty("int").alias("scores"))

    def step(s: Column, m: Column) -> Column:
        counts = m["said"] & s["pending"] & m["score"].isNotNull()
        raised = F.when(F.size(s["scores"]) > 0, _with_last(s["scores"], F.greatest(F.element_at(s["scores"], -1), m["score"]))).otherwise(s["scores"])
        return F.struct(
            F.when(m["moves"], F.lit(0)).otherwise(s["attempt"] + m["submits"].cast("int")).alias("attempt"),
            m["submits"].alias("pending"),
            F.when(~counts, s["scores"]).when(s["attempt"] == 1, F.concat(s["scores"], F.array(m["score"]))).otherwise(raised).alias("scores"),
        )

    return F.aggregate(steps, begin, step, lambda s: s["scores"])


def block_fold(steps: Column) -> Column:
    """Array of (question, tries), literally: the first reply without feedback opens a question; one with feedback and a question closes it and opens the next."""
    begin = F.struct(F.lit("").alias("question"), _empty(_TRY).alias("tries"), _empty(_BLOCK).alias("blocks"))

    def with_block(blocks: Column, question: Column, tries: Column) -> Column:
        return F.concat(blocks, F.array(F.struct(question.alias("question"), tries.alias("tries"))))

    def step(s: Column, m: Column) -> Column:
        opens = m["said"] & (m["feedback"] == "") & (s["question"] == "")
        tells = m["said"] & (m["feedback"] != "")
        closes = tells & (m["question"] != "")
        told = _told(s["tries"], m["feedback"])
        return F.struct(
            F.when(opens, _or_content(m)).when(closes, m["question"]).otherwise(s["question"]).alias("question"),
            F.when(opens | closes, _empty(_TRY)).when(tells, told).when(m["answers"], _tried(s["tries"], m["content"])).otherwise(s["tries"]).alias("tries"),
            F.when(closes, with_block(s["blocks"], s["question"], told)).otherwise(s["blocks"]).alias("blocks"),
        )

    return F.aggregate(steps, begin, step, lambda s: F.when(s["question"] != "", with_block(s["blocks"], s["question"], s["tries"])).otherwise(s["blocks"]))


def repaired_fold(steps: Column) -> Column:
    """Array of (question, score, tries): every question opens a block; feedback and score of a reply go to the block of its answer."""
    begin = F.struct(F.lit(False).alias("begun"), F.lit(False).alias("pending"), _empty(_SCORED_BLOCK).alias("blocks"))

    def step(s: Column, m: Column) -> Column:
        blocks, last = s["blocks"], F.element_at(s["blocks"], -1)

        def with_last(score: Column, tries: Column) -> Column:
            return F.when(F.size(blocks) > 0, _with_last(blocks, F.struct(last["question"].alias("question"), score.alias("score"), tries.alias("tries")))).otherwise(blocks)

        replied = F.when(m["said"] & s["pending"], with_last(F.greatest(last["score"], m["score"]), F.when(m["feedback"] != "", _told(last["tries"], m["feedback"])).otherwise(last["tries"]))).otherwise(blocks)
        opened = F.array(F.struct(_or_content(m).alias("question"), F.lit(None).cast("int").alias("score"), _empty(_TRY).alias("tries")))
        return F.struct(
            (s["begun"] | m["said"]).alias("begun"),
            m["submits"].alias("pending"),
            F.when(m["said"] & (~s["begun"] | (m["question"] != "")), F.concat(replied, opened)).when(m["tries"], with_last(last["score"], _tried(last["tries"], m["content"]))).otherwise(replied).alias("blocks"),
        )

    return F.aggregate(steps, begin, step, lambda s: s["blocks"])


def folded(messages: DataFrame) -> DataFrame:
    """(session_id, scores, blocks, repaired) of messages (session_id, seq, role, content), a row a session: one scan, one exchange by session.

    blocks and repaired are arrays of (question, score, tries); the score of a literal
    block is the one at its place in scores. A session's messages stand in one row.
    """
    found = steps(messages).select("session_id", score_fold(F.col("steps")).alias("scores"), block_fold(F.col("steps")).alias("blocks"), repaired_fold(F.col("steps")).alias("repaired"))
    with_score = F.transform("blocks", lambda b, i: F.struct(b["question"].alias("question"), F.get("scores", i).alias("score"), b["tries"].alias("tries")))
    return found.withColumn("blocks", with_score)


def listed(folds: DataFrame, blocks: str) -> DataFrame:
    """Rows of an array of blocks: session_id, number, question, score, attempt, answer, feedback; a block without tries has one row with a null attempt."""
    asked = folds.select("session_id", F.posexplode(blocks).alias("at", "b"))
    tried = asked.select("session_id", (F.col("at") + 1).cast("long").alias("number"), "b", F.posexplode_outer("b.tries").alias("attempt", "t"))
    return tried.select("session_id", "number", "b.question", "b.score", (F.col("attempt") + 1).alias("attempt"), "t.answer", "t.feedback")
