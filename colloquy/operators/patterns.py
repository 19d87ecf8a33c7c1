"""A user's table of patterns as one matcher: which pattern, first in the table's order, is found in a text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and characters of a table that is made into an expression, at most.
MOST_PATTERNS, MOST_CHARS = 1_000, 100_000
#: Patterns that stand behind one common test.
_GROUP = 25


@dataclass(frozen=True)
class Matcher:
    """(position, pattern, label) in order of position."""

    rows: tuple[tuple[int, str, str | None], ...]

    def found(self, text: Column) -> Column:
        """Struct of position, pattern and label of the first pattern in the table's order that is found in ``text``; null without one, or of a null text.

        One expression without a join: a group of patterns is tried one by one only
        where their alternation is found at all.
        """
        groups = [self.rows[a : a + _GROUP] for a in range(0, len(self.rows), _GROUP)]
        none = F.lit(None).cast("struct<position:int,pattern:string,label:string>")
        return F.coalesce(*[F.when(text.rlike("|".join(f"(?:{p})" for _, p, _ in g)), self._first(text, g)) for g in groups], none)

    @staticmethod
    def _first(text: Column, group: tuple[tuple[int, str, str | None], ...]) -> Column:
        out = F.lit(None)
        for position, pattern, label in reversed(group):
            own = F.struct(F.lit(position).cast("int").alias("position"), F.lit(pattern).alias("pattern"), F.lit(label).cast("string").alias("label"))
            out = F.when(text.rlike(pattern), own).otherwise(out)
        return out


def matcher(patterns: DataFrame) -> Matcher:
    """Matcher of a table (position, pattern, label); positions tell its rows apart.

    The table goes into the plan, and with it to every task: one of over
    MOST_PATTERNS rows or MOST_CHARS characters is an error, as is one with a null
    position or pattern, a position twice, or a back reference by number, which would count other
    patterns' groups.
    """
    size = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern")), F.lit(0)), F.count_distinct("position"), F.count_if(F.col("pattern").isNull() | F.col("pattern").rlike(r"\\[1-9]"))).first()
    n, chars, positions, wrong = size
    if n > MOST_PATTERNS or chars > MOST_CHARS:
        raise ValueError(f"{n} patterns of {chars} characters; {MOST_PATTERNS} of {MOST_CHARS} at most")
    if positions < n or wrong:
        raise ValueError("positions must differ, and patterns be given without back references by number")
    rows = patterns.select(F.col("position").cast("int"), "pattern", F.col("label").cast("string")).orderBy("position").collect()
    return Matcher(tuple(map(tuple, rows)))
