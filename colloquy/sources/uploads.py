"""Uploaded documents as text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Messages.
NO_TEXT = {".pdf": "⚠️ Could not extract text from this PDF. It may be image-based or scanned.", ".docx": "⚠️ Could not extract text from this Word file. It may be empty."}
FAILED = {".pdf": "⚠️ Error reading PDF: ", ".docx": "⚠️ Error reading Word file: "}
UNSUPPORTED = "⚠️ Unsupported file type. Please upload a PDF or .docx file."

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_PATTERN = "*.{[pP][dD][fF],[dD][oO][cC][xX]}"
_FILES = "path string, modificationTime timestamp, length long, content binary"


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def read_uploads(spark: SparkSession, path: str, pattern: str = _PATTERN) -> DataFrame:
    """Files as (name, size, content); by default those of either kind, in any case of letters. Spark leaves out files of no bytes."""
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def stream_uploads(spark: SparkSession, path: str, pattern: str = _PATTERN) -> DataFrame:
    """The same as a stream: files are read as they come."""
    return _named(spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).load(path))


def new_texts(uploads: DataFrame) -> DataFrame:
    """(content_hash, name, size, ok, value) of a stream of uploads: each different content is extracted once, under the first name it comes by.

    What is remembered of a content is its hash and ending, since the ending says how it is read.
    """
    ending = F.lower(F.substring_index("name", ".", -1))
    once = uploads.withColumns({"content_hash": F.sha2("content", 256), "ending": ending}).dropDuplicates(["content_hash", "ending"])
    return once.withColumn("got", extract_text(F.col("name"), F.col("content"))).select("content_hash", "name", "size", "got.ok", "got.value")


def extract_new(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = _PATTERN) -> None:
    """Add the texts of files that have come into ``path`` since the last run with this checkpoint to the Parquet table ``out``."""
    run = new_texts(stream_uploads(spark, path, pattern)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def _run_text(run: ElementTree.Element) -> str:
    """Text of a run's own children; page and column breaks, drawings and text boxes give none."""
    out = []
    for node in run:
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}cr" or node.tag == f"{_W}br" and node.get(f"{_W}type", "textWrapping") == "textWrapping":
            out.append("\n")
        elif node.tag in (f"{_W}tab", f"{_W}ptab"):
            out.append("\t")
        elif node.tag == f"{_W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def docx_text(content: bytes) -> str:
    """Texts of the body's own paragraphs, a line each: of their runs and of those in links, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for paragraph in [] if body is None else body.findall(f"{_W}p"):
        runs = [r for node in paragraph for r in ([node] if node.tag == f"{_W}r" else node.findall(f"{_W}r") if node.tag == f"{_W}hyperlink" else [])]
        lines.append("".join(map(_run_text, runs)))
    return "\n".join(lines).strip()


def make_docx(lines: list[str]) -> bytes:
    """The least Word file with a paragraph per line."""
    root = ElementTree.Element(f"{_W}document")
    body = ElementTree.SubElement(root, f"{_W}body")
    for line in lines:
        node = ElementTree.SubElement(ElementTree.SubElement(ElementTree.SubElement(body, f"{_W}p"), f"{_W}r"), f"{_W}t")
        node.text = line
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", ElementTree.tostring(root, encoding="utf-8"))
    return out.getvalue()


def pdf_text(content: bytes) -> str:
    """Pages' texts, by whichever PDF library is installed."""
    try:
        import fitz
    except ImportError:
        try:
            import pypdf
        except ImportError:
            raise RuntimeError("no PDF library is installed") from None
        return "".join(page.extract_text() for page in pypdf.PdfReader(io.BytesIO(content)).pages).strip()
    with fitz.open(stream=content, filetype="pdf") as doc:
        return "".join(page.get_text() for page in doc).strip()


def _extracted(name: str | None, content: bytes | None) -> tuple[bool, str]:
    low = (name or "").lower()
    readers: dict[str, Callable[[bytes], str]] = {".pdf": pdf_text, ".docx": docx_text}
    for suffix, reader in readers.items():
        if low.endswith(suffix):
            try:
                text = reader(content or b"")
            except Exception as e:  # one bad file is a value, not a failed job
                return False, FAILED[suffix] + str(e)
            return (True, text) if text else (False, NO_TEXT[suffix])
    return False, UNSUPPORTED


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", T.StringType())]))
def _extract(name: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_extracted(n, c) for n, c in zip(name, content)], columns=["ok", "value"])


def extract_text(name: Column, content: Column) -> Column:
    """Struct of ok and value: the text, or what went wrong."""
    return _extract(name, content)
