"""What marked-up replies hold: score, feedback, question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import block, without_blocks

# Marks and internal messages.
FEEDBACK = ("---FEEDBACK---", "---END FEEDBACK---")
QUESTION = ("---NEXT QUESTION---", "---END QUESTION---")
READY = "I am ready. Please ask me the first question."
SATISFIED = "I am satisfied with my answer. Please move to the next question."
SKIP_REQUEST = "Please skip this question and move to the next one."
SKIPPED = "*(skipped)*"
CHAT_INTERNAL = (READY, SKIP_REQUEST, SATISFIED, SKIPPED)
REPORT_INTERNAL = (READY, SKIP_REQUEST, SATISFIED)


def score(text: Column) -> Column:
    """The first marked score out of ten, whatever its size; null without one."""
    return F.regexp_extract(text, r"\*\*Score:\*\*\s*(\d+)\s*/\s*10", 1).try_cast("int")


def chat_feedback(text: Column) -> Column:
    """The feedback block; the whole text if that and the question block are empty."""
    found = block(text, *FEEDBACK)
    return F.when((found == "") & (question(text) == ""), text).otherwise(found)


def question(text: Column) -> Column:
    return block(text, *QUESTION)


def report_feedback(text: Column) -> Column:
    """The feedback block if there is one, even an empty one; else the text without question blocks."""
    return F.when(text.rlike(f"(?s){FEEDBACK[0]}.*?{FEEDBACK[1]}"), block(text, *FEEDBACK)).otherwise(without_blocks(text, *QUESTION))


def without_feedback(text: Column) -> Column:
    return without_blocks(text, *FEEDBACK)


def without_question(text: Column) -> Column:
    return without_blocks(text, *QUESTION)


def clipped(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)

