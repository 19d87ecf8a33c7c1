"""Sessions and settings: missing values filled in, given ones checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cost import RATES
from ..operators.prompts import PERSONA_KEY, PERSONAS, TECHNIQUES

# What a session begins with, by name and type.
SESSION_DEFAULTS = {
    "messages": ("array<struct<role:string,content:string>>", []),
    "interview_started": ("boolean", False),
    "interview_done": ("boolean", False),
    "question_count": ("int", 1),
    "total_questions": ("int", 4),
    "attempt": ("int", 0),
    "awaiting_decision": ("boolean", False),
    "is_final_answer": ("boolean", False),
    "scores": ("array<int>", []),
    "cost_log": ("array<double>", []),
    "last_cost": ("string", None),
    "jd_summary": ("string", ""),
    "cv_summary": ("string", ""),
    "gap_analysis": ("string", ""),
    "jd_text": ("string", ""),
}
# Settings by name, type and default; and what they may be: labels, or the least and the greatest number.
SETTING_DEFAULTS = {
    "technique": ("string", "Zero-Shot"),
    "persona_key": ("string", "Neutral 😐"),
    "model": ("string", "gpt-4.1-mini"),
    "interview_type": ("string", "Behavioral"),
    "difficulty": ("string", "Medium"),
    "total_questions": ("int", 4),
    "temperature": ("double", 0.4),
    "top_p": ("double", 0.9),
    "max_tokens": ("int", 700),
    "frequency_penalty": ("double", 0.3),
}
LABELS = {
    "technique": tuple(label for label, _ in TECHNIQUES),
    "persona_key": tuple(p[0] for p in PERSONAS),
    "model": tuple(r[0] for r in RATES),
    "interview_type": ("Behavioral", "Technical", "Mixed (Behavioral + Technical)"),
    "difficulty": ("Easy", "Medium", "Hard"),
}
BOUNDS = {"total_questions": (1, 10), "temperature": (0.0, 2.0), "top_p": (0.1, 1.0), "max_tokens": (200, 1500), "frequency_penalty": (0.0, 2.0)}


def _filled(rows: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    def value(name: str, kind: str, given: object) -> Column:
        default = (F.array() if given == [] else F.lit(given)).cast(kind)
        return F.coalesce(F.col(name), default) if name in rows.columns else default

    return rows.withColumns({name: value(name, *d) for name, d in defaults.items()})


def with_defaults(sessions: DataFrame) -> DataFrame:
    """``sessions`` with each value of SESSION_DEFAULTS: a missing column is added, a null is filled."""
    return _filled(sessions, SESSION_DEFAULTS)


def with_settings(rows: DataFrame) -> DataFrame:
    """``rows`` with each value of SETTING_DEFAULTS. A persona counts for its technique only; other rows get the default one."""
    filled = _filled(rows, SETTING_DEFAULTS)
    by_persona = F.col("technique") == next(label for label, key in TECHNIQUES if key == PERSONA_KEY)
    return filled.withColumn("persona_key", F.when(by_persona, F.col("persona_key")).otherwise(F.lit(SETTING_DEFAULTS["persona_key"][1])))


def wrong_settings() -> Column:
    """Array of the names of a row's settings (see :func:`with_settings`) that are no known label or out of bounds; nulls are wrong."""
    known = {name: F.col(name).isin(*labels) for name, labels in LABELS.items()} | {name: F.col(name).between(*b) for name, b in BOUNDS.items()}
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in known.items()]))
