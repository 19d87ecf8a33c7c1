"""The session report as HTML, a row per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, ordered_text
from . import scores
from .folds import folded
from .markdown import to_html

# What an attempt, an analysis and a report without questions are called.
FIRST_ANSWER, IMPROVED_ANSWER = "Your Answer", ("Your Improved Answer (Attempt ", ")")
GAP_TITLE, JD_TITLE = "🔎 Gap Analysis", "📄 Job Description Analysis"
NO_QUESTIONS = "No question data available."


def _text(value: Column) -> Column:
    return to_html(html_escape(F.coalesce(value, F.lit(""))))


def attempt_label(attempt: Column) -> Column:
    return F.when(attempt > 1, F.concat(F.lit(IMPROVED_ANSWER[0]), attempt.cast("string"), F.lit(IMPROVED_ANSWER[1]))).otherwise(F.lit(FIRST_ANSWER))


def gap_section(gap_analysis: Column, jd_summary: Column) -> Column:
    """Struct of title and text: the gap analysis, else the job description's, else null."""
    gap, jd = F.nullif(gap_analysis, F.lit("")), F.nullif(jd_summary, F.lit(""))
    return F.when(gap.isNotNull(), F.struct(F.lit(GAP_TITLE).alias("title"), gap.alias("text"))).when(jd.isNotNull(), F.struct(F.lit(JD_TITLE).alias("title"), jd.alias("text")))


def _try_html(attempt: Column, answer: Column, feedback: Column) -> Column:
    """An attempt without an answer shows nothing."""
    told = F.when(feedback != "", F.concat(F.lit("<aside><em>Feedback</em>"), _text(feedback), F.lit("</aside>"))).otherwise(F.lit(""))
    shown = F.concat(F.lit("<li><strong>"), attempt_label(attempt), F.lit("</strong><blockquote>"), _text(answer), F.lit("</blockquote>"), told, F.lit("</li>"))
    return F.when(F.coalesce(answer != "", F.lit(False)), shown).otherwise(F.lit(""))


def _question_html(number: Column, question: Column, score: Column, tries: Column) -> Column:
    """``tries``: their HTML, joined."""
    mark = F.when(score.isNotNull(), F.concat(F.lit(' <mark style="background:'), scores.score_colour(score), F.lit('">'), score.cast("string"), F.lit(" of 10</mark>"))).otherwise(F.lit(""))
    asked = F.when(question != "", _text(question)).otherwise(F.lit(""))
    return F.concat(F.lit("<article><h3>"), number.cast("string"), F.lit("."), mark, F.lit("</h3>"), asked, F.lit("<ol>"), tries, F.lit("</ol></article>"))


def _bar_html(ordinal: Column, score: Column) -> Column:
    b = scores.bar(ordinal, score)
    return F.concat(F.lit("<tr><th>"), b["label"], F.lit('</th><td><hr style="width:'), b["width"].cast("string"), F.lit("%;border-color:"), b["colour"], F.lit('"></td><td>'), score.cast("string"), F.lit("</td></tr>"))


def questions(blocks: Column) -> Column:
    """HTML of an array of blocks (see :mod:`~colloquy.operators.folds`), in order."""
    tries = lambda b: F.array_join(F.transform(b["tries"], lambda t, j: _try_html(j + 1, t["answer"], t["feedback"])), "")
    return F.array_join(F.transform(blocks, lambda b, i: _question_html(i + 1, b["question"], b["score"], tries(b))), "\n")


def bars(found: Column) -> Column:
    """A table's rows for an array of scores, in order."""
    return F.array_join(F.transform(found, lambda s, i: _bar_html(i + 1, s)), "\n")


def listed_bars(breakdown: DataFrame) -> DataFrame:
    """(session_id, bars): the same from rows of ordinal and score, by an ordered string aggregate."""
    return ordered_text(breakdown.withColumn("html", _bar_html(F.col("ordinal"), F.col("score"))), ["session_id"], "html", "ordinal", "bars", "\n")


def listed_questions(blocks: DataFrame) -> DataFrame:
    """(session_id, questions): the same from rows of blocks, question by question, then session by session."""
    tried = blocks.withColumn("html", _try_html(F.col("attempt"), F.col("answer"), F.col("feedback")))
    by_question = ordered_text(tried, ["session_id", "number", "question", "score"], "html", "attempt", "tries")
    shown = by_question.withColumn("html", _question_html(F.col("number"), F.col("question"), F.col("score"), F.col("tries")))
    return ordered_text(shown, ["session_id"], "html", "number", "questions", "\n")


def printed_date(time: Column) -> Column:
    """As in a letter, with the hour."""
    return F.date_format(time, "MMMM dd, yyyy '—' HH:mm")


def file_name(time: Column) -> Column:
    return F.concat(F.lit("interview_report_"), F.date_format(time, "yyyyMMdd_HHmm"), F.lit(".html"))


def build(messages: DataFrame, sessions: DataFrame, generated: Column) -> DataFrame:
    """(session_id, file_name, html). ``sessions``: session_id, role, interview_type, difficulty, technique, jd_summary, gap_analysis; ``generated``: the time printed.

    All free text is escaped, the role too. Messages are read once and exchanged once, by session.
    """
    folds = folded(messages).select("session_id", *[c.alias(name) for name, c in scores.summed(F.col("scores")).items()], bars(F.col("scores")).alias("bars"), F.when(F.size("blocks") > 0, questions(F.col("blocks"))).alias("questions"))
    found = folds.join(sessions, "session_id")
    given = html_escape(F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("Not specified")))
    titled = html_escape(F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("Candidate")))
    gap = gap_section(F.col("gap_analysis"), F.col("jd_summary"))
    shown_gap = F.when(gap.isNotNull(), F.concat(F.lit("<section><h2>"), gap["title"], F.lit("</h2>"), _text(gap["text"]), F.lit("</section>"))).otherwise(F.lit(""))

    def fact(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"<dt>{label}</dt><dd>"), value, F.lit("</dd>"))

    message = scores.tier_message(F.col("avg_score"), report=True)
    parts = [
        F.lit('<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Session report: '), titled, F.lit("</title></head><body><header><h1>Session report</h1><p>"), printed_date(generated), F.lit("</p></header><dl>"),
        fact("Role", given), fact("Interview", html_escape(F.col("interview_type"))), fact("Difficulty", html_escape(F.col("difficulty"))), fact("Technique", html_escape(F.col("technique"))), fact("Questions scored", F.col("n_scores").cast("string")),
        fact("Average", F.concat(F.col("avg_shown"), F.lit(" of 10"))), fact("Best", F.col("best").cast("string")), fact("Lowest", F.col("worst").cast("string")), F.lit('</dl><p style="color:'), F.col("colour"), F.lit('">'), message, F.lit("</p><table>"), F.coalesce("bars", F.lit("")), F.lit("</table>"),
        shown_gap, F.lit("<main>"), F.coalesce("questions", F.lit(f"<p>{NO_QUESTIONS}</p>")), F.lit("</main></body></html>"),
    ]
    return found.select("session_id", file_name(generated).alias("file_name"), F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("html"))


def write(reports: DataFrame, path: str) -> None:
    """All reports (session_id, file_name, html) as one Parquet table."""
    reports.select("session_id", "file_name", "html").write.parquet(path)


def download(reports: DataFrame, session_id: int, folder: str) -> str:
    """Put one session's report into ``folder``, of any file system that Spark reaches, under its own name; returns the path."""
    spark = reports.sparkSession
    row = reports.filter(F.col("session_id") == session_id).select("file_name", "html").first()
    if row is None:
        raise KeyError(session_id)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, row.file_name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(row.html.encode()))
    finally:
        out.close()
    return path.toString()
