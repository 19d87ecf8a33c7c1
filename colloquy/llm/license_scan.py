"""License scans: fuzzy search for short notices.

Each notice may differ from the text by a few edits. It is split into one piece
more than it has edits (pigeonhole: one piece must then stand unchanged), an
Aho-Corasick automaton finds the pieces, and the ``regex`` library's
bounded-error matching verifies the place around each and gives the span.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, map_batches

#: A word: letters a-z after lower-casing, digits, and everything outside ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Notice:
    """``phrase``: words joined by one space. ``edits``: at most so many insertions, deletions and substitutions of characters."""

    label: str
    phrase: str
    edits: int = 0


#: Found exactly, word by word.
BASE_NOTICES = (
    Notice("gpl", "gnu general public license"),
    Notice("apache", "apache license"),
    Notice("cc-by", "cc by"),
    Notice("mit", "mit license"),
)
FUZZY_NOTICES = (
    Notice("gpl", "gnu general public license", 2),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("apache", "apache license", 1),
    Notice("apache-2.0", "apache license version 2 0", 2),
    Notice("mit", "mit license", 1),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by-sa", "cc by sa"),
    Notice("cc-by-nc", "cc by nc"),
    Notice("cc-by-nd", "cc by nd"),
    Notice("cc0", "creative commons zero", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "bsd 3 clause", 1),
    Notice("bsd", "bsd 2 clause", 1),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("isc", "isc license"),
    Notice("all-rights-reserved", "all rights reserved", 1),
)


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces of nearly equal length that cover the phrase."""
    n, k = len(notice.phrase), notice.edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Scanner:
    """Automaton and patterns of a list of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for i, x in enumerate(notices):
            for offset, piece in seeds(x):
                by_piece.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in by_piece.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?b)\b(?:{regex.escape(x.phrase)}){{e<={x.edits}}}\b") for x in notices]

    def matches(self, line: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a text of words between single spaces; exact places all count, overlapping ones too."""
        found, tried = {}, set()
        for last, (size, uses) in self.automaton.iter(line):
            for i, offset in uses:
                at = last - size + 1 - offset
                if (i, at) in tried:
                    continue
                tried.add((i, at))
                x = self.notices[i]
                stop = at + len(x.phrase)
                if not x.edits:
                    if (at == 0 or line[at - 1] == " ") and (stop == len(line) or line[stop] == " "):
                        found[i, at] = (stop, 0)
                    continue
                m = self.patterns[i].search(line, max(0, at - x.edits), min(len(line), stop + 2 * x.edits + 1))
                if m:
                    found[i, m.start()] = (m.end(), sum(m.fuzzy_counts))
        return [(i, a, b, e) for (i, a), (b, e) in sorted(found.items())]


def scan(text: bytes, scanner: Scanner, n_base: int) -> tuple:
    """One text: word count, base places, labels, score, spans in code points of the text.

    The words' and code points' offsets are counted once, however many places there are.
    """
    low = text.lower()  # of bytes: A-Z only
    words = _WORD.findall(low)
    line = b" ".join(words).decode("utf-8", "replace")
    hits = scanner.matches(line)
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, []
    begins = np.cumsum([0, *(len(w) + 1 for w in line.split(" "))])[:-1]  # of words, in the line
    hits = [(i, a + (line[a] == " "), b - (line[b - 1] == " "), e) for i, a, b, e in hits]
    firsts, lasts = (np.searchsorted(begins, [h[j] - (j == 2) for h in hits], side="right") - 1 for j in (1, 2))
    places = [int(w) for (i, *_), w in zip(hits, firsts) if i < n_base]
    base = sorted({scanner.notices[i].label for i, *_ in hits if i < n_base})
    labels = sorted({scanner.notices[i].label for i, *_ in hits})
    score = max(1.0 - e / max(1, len(scanner.notices[i].phrase)) for i, _, _, e in hits)
    where = np.array([m.span() for m in _WORD.finditer(low)])
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))  # code points before each byte
    starts, ends = points[where[firsts, 0]].tolist(), points[where[lasts, 1]].tolist()
    spans = [{"label": scanner.notices[i].label, "start": a, "end": b, "edits": e} for (i, _, _, e), a, b in zip(hits, starts, ends)]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), score, spans


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,edits:int>>"


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Notice, ...] = BASE_NOTICES, fuzzy: tuple[Notice, ...] = FUZZY_NOTICES) -> DataFrame:
    """One row per input row: word count, places of ``base`` phrases, labels, score and spans.

    A narrow map: no shuffle, one Arrow batch in memory at a time. A null or
    empty text, or one without words, has no place, empty labels and score 0.
    Null ids and repeated rows are kept as they are; other columns are ignored.
    The score is one less the share of edited characters in the best place.
    Spans are code points of the whole text, from its first matched word to the
    end of its last.
    """
    notices, n_base = (*base, *fuzzy), len(base)
    built: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not built:
            built.append(Scanner(notices))
        rows = [scan(x, built[0], n_base) for x in binary_values(batch, "text")]
        columns = list(zip(*rows)) if rows else [[]] * 8
        return {"doc_id": batch.column("doc_id")} | {f.name: list(c) for f, c in zip(list(_ARROW)[1:], columns)}

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, run, _SCHEMA, _ARROW)
