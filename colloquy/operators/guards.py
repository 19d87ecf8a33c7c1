"""Guards over free text: each gives a struct of ok, code and reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip, word_count

# Limits, patterns and messages that results must equal.
MIN_ANSWER, MAX_ANSWER = 2, 1500
MIN_JD, MAX_JD = 30, 5000
MAX_FILE_MB = 5
EXTENSIONS = (".pdf", ".docx")
INJECTION_PATTERNS = (
    r"ignore (all |previous |above |prior )?instructions",
    r"disregard (all |previous |above |prior )?instructions",
    r"forget (all |previous |above |prior )?instructions",
    r"you are now",
    r"act as (a |an )?(?!interview)",
    r"new persona",
    r"override",
    r"system prompt",
    r"reveal (your |the )?(prompt|instructions|system)",
    r"print (your |the )?(prompt|instructions|system)",
    r"what (are|were) your instructions",
    r"jailbreak",
    r"pretend (you are|to be)",
    r"roleplay as",
    r"DAN",
    r"developer mode",
    r"sudo",
)
TOO_SHORT = "⚠️ Your message is too short. Please type a proper answer."
TOO_LONG = ("⚠️ Your message is too long (", f" characters). Please keep responses under {MAX_ANSWER} characters.")
INJECTION = "🚫 Your message appears to contain a prompt injection attempt. This app is designed strictly for interview preparation."
QUALITY = "⚠️ Your answer doesn't seem to contain meaningful text. Please write a proper response to the interview question."
JD_SHORT = "⚠️ The job description is too short. Please paste a proper job posting."
JD_LONG = "⚠️ The job description is too long. Please trim it to under 5000 characters."
UNSUPPORTED = ("⚠️ Unsupported file type '", "'. Please upload a PDF (.pdf) or Word (.docx) file.")
TOO_LARGE = ("⚠️ File is too large (", f" MB). Please upload a file under {MAX_FILE_MB} MB.")


def _verdict(code: Column, reasons: dict[str, Column]) -> Column:
    reason = F.lit("")
    for name, text in reasons.items():
        reason = F.when(code == name, text).otherwise(reason)
    return F.struct((code == "ok").alias("ok"), code.alias("code"), reason.alias("reason"))


def _length_code(text: Column) -> Column:
    n = F.length(strip(text))
    return F.when(n < MIN_ANSWER, F.lit("short")).when(n > MAX_ANSWER, F.lit("long"))


def _injection_code(text: Column) -> Column:
    """One alternation of all patterns over the lower-cased, unstripped text."""
    return F.when(F.lower(text).rlike("|".join(f"(?:{p})" for p in INJECTION_PATTERNS)), F.lit("injection"))


def _quality_code(text: Column) -> Column:
    """Texts of over 20 words pass; else at least a tenth letters, and of 8 letters or more at least 8 % vowels."""
    bare = strip(text)
    total = F.length(bare)
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]", ""))
    vowels = F.regexp_count(F.lower(bare), F.lit("[aeiou]"))
    poor = (letters / F.nullif(total, F.lit(0)) < 0.10) | ((letters >= 8) & (vowels / F.nullif(letters, F.lit(0)) < 0.08))
    return F.when((word_count(text) <= 20) & (total > 0) & poor, F.lit("quality"))


def _answer_reasons(text: Column) -> dict[str, Column]:
    long = F.concat(F.lit(TOO_LONG[0]), F.length(strip(text)).cast("string"), F.lit(TOO_LONG[1]))
    return {"short": F.lit(TOO_SHORT), "long": long, "injection": F.lit(INJECTION), "quality": F.lit(QUALITY)}


def length_guard(text: Column) -> Column:
    return _verdict(F.coalesce(_length_code(text), F.lit("ok")), _answer_reasons(text))


def injection_guard(text: Column) -> Column:
    return _verdict(F.coalesce(_injection_code(text), F.lit("ok")), _answer_reasons(text))


def quality_guard(text: Column) -> Column:
    return _verdict(F.coalesce(_quality_code(text), F.lit("ok")), _answer_reasons(text))


def answer_guard(text: Column) -> Column:
    """Length, injection and quality in this order; the first failure counts."""
    return _verdict(F.coalesce(_length_code(text), _injection_code(text), _quality_code(text), F.lit("ok")), _answer_reasons(text))


def jd_guard(text: Column) -> Column:
    n = F.length(strip(text))
    code = F.when((n > 0) & (n < MIN_JD), F.lit("short")).when(n > MAX_JD, F.lit("long")).otherwise(F.lit("ok"))
    return _verdict(code, {"short": F.lit(JD_SHORT), "long": F.lit(JD_LONG)})


def file_extension(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(F.lower(name), ".", -1))).otherwise(F.lit(""))


def cv_file_guard(name: Column, size: Column) -> Column:
    """No file passes; the type is looked at before the size."""
    extension, mb = file_extension(name), size / F.lit(1024 * 1024)
    code = F.when(name.isNull(), F.lit("ok")).when(~extension.isin(*EXTENSIONS), F.lit("unsupported")).when(mb > MAX_FILE_MB, F.lit("large")).otherwise(F.lit("ok"))
    return _verdict(code, {"unsupported": F.concat(F.lit(UNSUPPORTED[0]), extension, F.lit(UNSUPPORTED[1])), "large": F.concat(F.lit(TOO_LARGE[0]), F.format_string("%.1f", F.bround(mb, 1)), F.lit(TOO_LARGE[1]))})


def not_blank(text: Column) -> Column:
    return F.length(strip(text)) > 0
