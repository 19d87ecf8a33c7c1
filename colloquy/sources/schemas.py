"""Shapes of the library's inputs, and a check of a table against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGES = "session_id long, seq long, role string, content string"
EVENTS = "session_id long, seq long, event string, text string, reply string, total_questions int"
API_CALLS = "session_id long, call_seq int, model string, input_tokens long, output_tokens long"
REPLIES = "request string, model string, reply string, prompt_tokens long, completion_tokens long"
REPORTS = "session_id long, file_name string, html string"


def _kind(of: T.DataType) -> type:
    return T.IntegralType if isinstance(of, T.IntegralType) else type(of)


def checked(rows: DataFrame, shape: str, but: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """``rows`` as they are; an error that names the columns of ``shape`` that are missing or of another kind. Whole numbers are one kind; columns ``but`` may be of any."""
    given = {f.name: f.dataType for f in rows.schema}
    wrong = [f.name for f in T.StructType.fromDDL(shape) if f.name not in given or f.name not in but and not issubclass(type(given[f.name]), _kind(f.dataType)) and not isinstance(given[f.name], T.NullType)]
    if wrong:
        raise ValueError(f"columns missing or of another kind: {', '.join(wrong)}")
    return rows
