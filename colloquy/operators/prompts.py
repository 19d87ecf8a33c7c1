"""Prompt text from templates: context, technique, persona, last-question note.

Templates are tables, so that a user may bring their own wording; the defaults
below are this library's. Placeholders stand in braces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Techniques by label, and what a missing role is called.
TECHNIQUES = (
    ("Zero-Shot", "zero_shot"),
    ("Few-Shot", "few_shot"),
    ("Chain-of-Thought", "chain_of_thought"),
    ("Persona-Based", "persona"),
    ("Structured Output", "structured"),
)
NO_ROLE = "a professional position"
DEFAULT_KEY, PERSONA_KEY = "zero_shot", "persona"

FEEDBACK_RULES = (
    "Give feedback between the lines ---FEEDBACK--- and ---END FEEDBACK---, beginning with **Score:** X/10.\n"
    "Put the next question between the lines ---NEXT QUESTION--- and ---END QUESTION---, never in the feedback.\n"
)
TEMPLATES = (
    ("zero_shot", "Ask one question at a time and judge each answer.\n{feedback_format}"),
    ("few_shot", "Ask one question at a time. Follow the pattern of an answer, its feedback and a next question.\n{feedback_format}"),
    ("chain_of_thought", "Think about each answer step by step before you judge it.\n{feedback_format}"),
    ("persona", "You are {persona_name}. {persona_description}\n\n{style_instructions}\n{feedback_format}"),
    ("structured", "Keep strictly to the form below.\n{feedback_format}"),
)
PERSONAS = (
    ("Friendly 😊", "a kind coach", "You praise what is good first.", "- Warm in tone."),
    ("Neutral 😐", "a matter-of-fact coach", "You keep to what was said.", "- Calm in tone."),
    ("Strict 😤", "an exacting coach", "You expect precise answers.", "- Short in tone."),
)
#: What is shown beside a technique; this library's wording.
EXPLANATIONS = (
    ("Zero-Shot", "Instructions alone, without examples: quick, for any session."),
    ("Few-Shot", "Example exchanges come first and set form and depth: even results."),
    ("Chain-of-Thought", "The answer is thought through in steps before it is judged: thorough results."),
    ("Persona-Based", "An interviewer of a chosen temper: practice for different rooms."),
    ("Structured Output", "A strict form for every reply: easy to read and to compare."),
)
LAST_QUESTION = "\n\nThis is the last question: end with the feedback block and ask nothing more."


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def context(role: Column, interview_type: Column, difficulty: Column, jd_summary: Column, cv_summary: Column, gap_analysis: Column) -> Column:
    """Header and the sections whose text is not empty; nulls count as empty."""
    named = F.when(_given(role), role).otherwise(F.lit(NO_ROLE))
    header = F.concat(F.lit("Hold a mock interview. Role: **"), named, F.lit("**. Kind: **"), interview_type, F.lit("**. Level: **"), difficulty, F.lit("**.\n\n"))

    def section(title: str, text: Column, after: str = "") -> Column:
        return F.when(_given(text), F.concat(F.lit(f"### {title}:\n"), text, F.lit("\n\n" + after))).otherwise(F.lit(""))

    return F.concat(
        header,
        section("What the position asks for", jd_summary),
        section("What the candidate brings", cv_summary),
        section("Where the two differ", gap_analysis, "Put the gaps above first when you choose questions.\n\n"),
    )


def gap_stage(jd_summary: Column, cv_summary: Column) -> Column:
    """Whether a gap analysis can be asked for."""
    return _given(jd_summary) & _given(cv_summary)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "key string, template string")


def default_personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSONAS, "persona_key string, persona_name string, persona_description string, style_instructions string")


def default_techniques(spark: SparkSession) -> DataFrame:
    """(technique, technique_key, explanation), a row per label."""
    told = dict(EXPLANATIONS)
    return spark.createDataFrame([(label, key, told[label]) for label, key in TECHNIQUES], "technique string, technique_key string, explanation string")


def looked_up(rows: DataFrame, table: DataFrame, key: str, needed: Column | None = None) -> DataFrame:
    """``rows`` with the columns of a table of one row a key; a key that it lacks, or a null, is an error.

    ``needed``: where that doesn't hold, a missing key is none and gives nulls. The
    check is a filter, so that it is made whichever columns are read.
    """
    found = free = "__found"
    while found in rows.columns or found in table.columns:
        found = free = f"_{free}"
    joined = rows.join(table.withColumn(found, F.lit(True)), key, "left")
    missing = F.col(found).isNull() if needed is None else F.col(found).isNull() & F.coalesce(needed, F.lit(False))
    message = F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return joined.filter(F.assert_true(~missing, message).isNull()).drop(found)


def techniques_of(rows: DataFrame, techniques: DataFrame | None = None) -> DataFrame:
    """``rows`` with technique_key and explanation of their technique, a label."""
    return looked_up(rows, techniques if techniques is not None else default_techniques(rows.sparkSession), "technique")


def system_prompt(sessions: DataFrame, templates: DataFrame | None = None, personas: DataFrame | None = None, feedback_rules: str = FEEDBACK_RULES) -> DataFrame:
    """``sessions`` with system_prompt.

    Reads technique_key, role, interview_type, difficulty, persona_key, the three
    summaries and is_last. An unknown technique gets the zero-shot template, and is
    an error where the table has none; a persona technique with an unknown persona is
    an error. Both tables are small dimensions (a row per technique, per persona) and
    joined by key; the zero-shot template is a scalar subquery of its table.
    """
    spark = sessions.sparkSession
    templates = templates if templates is not None else default_templates(spark)
    personas = personas if personas is not None else default_personas(spark)
    zero_shot = templates.filter(F.col("key") == DEFAULT_KEY).select("template").scalar()
    rows = sessions.join(templates.select(F.col("key").alias("technique_key"), "template"), "technique_key", "left")
    rows = looked_up(rows, personas, "persona_key", F.col("technique_key") == PERSONA_KEY).withColumn("template", F.coalesce("template", zero_shot))
    rows = rows.filter(F.assert_true(F.col("template").isNotNull(), F.lit("there is no zero-shot template")).isNull())
    values = {n: F.coalesce(F.col(n), F.lit("")) for n in ("persona_name", "persona_description", "style_instructions")} | {"feedback_format": F.lit(feedback_rules)}
    head = context(*[F.col(n) for n in ("role", "interview_type", "difficulty", "jd_summary", "cv_summary", "gap_analysis")])
    suffix = F.when(F.coalesce("is_last", F.lit(False)), F.lit(LAST_QUESTION)).otherwise(F.lit(""))
    return rows.withColumn("system_prompt", F.concat(head, _filled(F.col("template"), values), suffix)).drop("template", "persona_name", "persona_description", "style_instructions")
