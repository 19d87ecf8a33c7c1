"""A small part of Markdown to HTML, without a shuffle: each line looks at the one before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip


def _marked(line: Column) -> Column:
    return F.struct(line.alias("text"), (line.startswith("- ") | line.startswith("* ")).alias("bullet"))


def _strong(line: Column) -> Column:
    return F.when(line.contains("**"), F.regexp_replace(line, r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>")).otherwise(line)


def html_lines(text: Column) -> Column:
    """Array of HTML lines: lists, headings, paragraphs, bold; empty for an empty text.

    Each line is paired with the one before it once, so that the work grows with
    the number of lines.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: _marked(strip(x)))
    before = F.concat(F.array(_marked(F.lit(""))), lines)

    def of_line(line: Column, previous: Column) -> Column:
        own, listed = line["bullet"], previous["bullet"]
        bold = _strong(line["text"])
        tagged = (
            F.when(bold.startswith("### "), F.concat(F.lit("<h4>"), F.substr(bold, F.lit(5)), F.lit("</h4>")))
            .when(bold.startswith("## "), F.concat(F.lit("<h3>"), F.substr(bold, F.lit(4)), F.lit("</h3>")))
            .when(bold.startswith("# "), F.concat(F.lit("<h3>"), F.substr(bold, F.lit(3)), F.lit("</h3>")))
            .otherwise(F.concat(F.lit("<p>"), bold, F.lit("</p>")))
        )
        item = F.concat(F.lit("<li>"), _strong(F.substr(line["text"], F.lit(3))), F.lit("</li>"))
        # Behind the last line stands none: only a list is closed there.
        opened = F.when(F.coalesce(own, F.lit(False)) & ~listed, F.lit("<ul>")).when(~F.coalesce(own, F.lit(False)) & listed, F.lit("</ul>"))
        return F.array_compact(F.array(opened, F.when(own, item).when(line["text"] != "", tagged)))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.flatten(F.zip_with(lines, before, of_line)))


def to_html(text: Column) -> Column:
    return F.array_join(html_lines(text), "\n")
