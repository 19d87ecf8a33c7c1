"""Text functions that agree with Python's on the points where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode's white space, and the four separators U+001C-1F.
_EDGES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(text, F.lit(_EDGES))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"(?U)[\s\x1c-\x1f]+", -1)))


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def one_decimal(value: Column) -> Column:
    """As ``:.1f``: ties go to the even digit."""
    return F.format_string("%.1f", F.bround(value, 1))


def block(text: Column, begin: str, end: str) -> Column:
    """Inner text of the first block between two marks, stripped; empty without one."""
    return strip(F.regexp_extract(text, f"(?s){begin}(.*?){end}", 1))


def without_blocks(text: Column, begin: str, end: str) -> Column:
    return strip(F.regexp_replace(text, f"(?s){begin}.*?{end}", ""))


def ordered_text(rows: DataFrame, by: list[str], value: str, order: str, name: str, separator: str = "") -> DataFrame:
    """``by`` and ``name``: the texts of ``value`` joined in the order of a column; groups may have null keys, null texts are passed over."""
    quoted = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return rows.groupBy(*by).agg(F.expr(f"listagg(`{value}`, '{quoted}') WITHIN GROUP (ORDER BY `{order}`)").alias(name))
