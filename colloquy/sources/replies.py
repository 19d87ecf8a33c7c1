"""Replies of a language model, recorded or live.

A query reads recorded replies: a table joined by request, so that results can be
had again. A live client runs once, outside queries, to record them; see
:mod:`~colloquy.sources.ledger`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cost import call_cost
from ..operators.guards import not_blank
from ..operators.prompts import gap_stage
from .sessions import with_settings, wrong_settings

# Characters of a document that a request holds, by stage, and the stages' temperature and most tokens.
CLIPS = {"cv": 6000, "jd": 4000}
STAGES = {"cv": (0.2, 600), "jd": (0.2, 500), "gap": (0.3, 500)}
ANALYSIS_MODEL = "gpt-4.1-mini"

#: What each stage asks for, and how its text is brought; this library's wording.
INSTRUCTIONS = {
    "cv": "Summarise this CV: name, latest role, years of experience, technical and soft skills, education, achievements, and where experience is thin. Invent nothing.",
    "jd": "Summarise this job posting: title, seniority, required technical and soft skills, responsibilities, what would be nice to have, and what an interview will likely test.",
    "gap": "Compare the candidate with the position: strengths that match, skills that are missing, the three topics to prepare first, and how good the fit is.",
}
_TEXTS = {"cv": "CV:\n\n", "jd": "Job posting:\n\n"}
_PAIR = ("Candidate:\n", "\n\nPosition:\n")


def _asked(rows: DataFrame, stage: str, prompt: Column) -> DataFrame:
    temperature, tokens = STAGES[stage]
    return rows.select("key", F.lit(stage).alias("stage"), F.lit(ANALYSIS_MODEL).alias("model"), F.lit(INSTRUCTIONS[stage]).alias("system"), prompt.alias("prompt"), F.lit(temperature).alias("temperature"), F.lit(tokens).alias("max_tokens"))


def requests(documents: DataFrame, stage: str) -> DataFrame:
    """(key, stage, model, system, prompt, temperature, max_tokens) for documents (key, text) of stage cv or jd.

    Texts are clipped before any client sees them; null and blank ones, of white
    space of any kind, ask nothing.
    """
    asking = documents.filter(F.coalesce(not_blank(F.col("text")), F.lit(False)))
    return _asked(asking, stage, F.concat(F.lit(_TEXTS[stage]), F.substring("text", 1, CLIPS[stage])))


def gap_requests(cvs: DataFrame, jds: DataFrame) -> DataFrame:
    """The same columns for pairs of summaries (key, reply) by key; those of which both are given ask."""
    pairs = cvs.select("key", F.col("reply").alias("cv")).join(jds.select("key", F.col("reply").alias("jd")), "key")
    return _asked(pairs.filter(gap_stage(F.col("jd"), F.col("cv"))), "gap", F.concat(F.lit(_PAIR[0]), F.col("cv"), F.lit(_PAIR[1]), F.col("jd")))


def cost_log(replies: DataFrame) -> DataFrame:
    """What each recorded reply (model, prompt_tokens, completion_tokens and others) cost; rows without a reply's tokens cost nothing; see :func:`~colloquy.operators.cost.call_cost`."""
    tokens = {new: F.coalesce(F.col(old), F.lit(0)).cast("long") for new, old in (("input_tokens", "prompt_tokens"), ("output_tokens", "completion_tokens"))}
    return call_cost(replies.withColumns(tokens).drop("prompt_tokens", "completion_tokens"))


def chat_requests(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, model, temperature, top_p, max_tokens, frequency_penalty, messages): the system prompt and then the log, in order.

    ``sessions``: session_id, system_prompt and whatever settings are given; the
    others get their defaults. A session whose settings are wrong asks nothing.
    """
    settings = ("model", "temperature", "top_p", "max_tokens", "frequency_penalty")
    asking = with_settings(sessions).filter(F.size(wrong_settings()) == 0)
    first = asking.select("session_id", F.lit(-1).cast("long").alias("seq"), F.lit("system").alias("role"), F.col("system_prompt").alias("content"))
    log = first.unionByName(messages.join(asking.select("session_id"), "session_id", "left_semi").select("session_id", "seq", "role", "content"))
    logs = log.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("messages"))
    return asking.select("session_id", *settings).join(logs, "session_id")
