"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived. The index
lists, for every trigram that some query names, the documents that hold it.
Intersecting the lists by the queries gives each rule's candidates; only those are
searched by the rule's expression. A rule without mandatory trigrams searches
every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, spread_join, to_ascii_lower
from .trigrams import ALWAYS, query_of


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + f"|{_either_case('api')}_?{_either_case('key')}"

BASE_RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = (*BASE_RULES, *MORE_RULES)

_PLACE = "array<struct<start:int,stop:int>>"
#: Matches whose offsets are summed in one fold; more are dealt to several.
_FOLD = 256


def places(text: Column, rule: Rule) -> Column:
    """The rule's spans in one text: array of (start, stop) in code points.

    A split by the expression gives the stretches between its matches, so that
    lengths add up to offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    steps = F.zip_with(F.split(text, rule.pattern, -1), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
    steps = F.filter(steps, lambda s: s["size"].isNotNull())  # the last stretch has no match behind it
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / _FOLD).cast("int")), lambda i: F.slice(steps, i * _FOLD + 1, _FOLD))
    sums = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda n, s: n + s["gap"] + s["size"]))
    begins = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def spans(group: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast(_PLACE).alias("out"))

        def put(a: Column, s: Column) -> Column:
            stop = a["at"] + s["gap"] + s["size"]
            return F.struct(stop.alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), stop.alias("stop")))).alias("out"))

        return F.aggregate(group, start, put, lambda a: a["out"])

    found = F.flatten(F.zip_with(groups, begins, spans))
    long_enough = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    kept = F.filter(F.zip_with(found, long_enough, lambda p, g: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), (F.length(g) >= rule.least).alias("ok"))), lambda p: p["ok"])
    return F.transform(kept, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop")))


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of docs (key, text) as rows (trigram: position in the list, key), written to the shared folder."""
    low = docs.select("key", to_ascii_lower(F.col("text")).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return materialize(low.select(F.explode(held).alias("trigram"), "key"), "postings")


def candidates(postings: DataFrame, trigrams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): which rules' queries a document's trigrams satisfy, as positions in ``rules``; none, no row.

    Lists are intersected as bit sets, combined before the shuffle.
    """
    words = range((len(trigrams) + 62) // 63)
    bit = F.expr("shiftleft(1L, trigram % 63)")
    sets = postings.groupBy("key").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words])

    def holds(clause: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in words:
            need = sum(1 << (i % 63) for i, t in enumerate(trigrams) if t in clause and i // 63 == w)
            if need:
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(need)) == need)
        return out

    met = []
    for i, rule in enumerate(rules):
        query = query_of(rule.pattern)
        if query != ALWAYS:
            hit = F.lit(False)
            for clause in sorted(query, key=sorted):
                hit = hit | holds(clause)
            met.append(F.when(hit, F.lit(i)))
    return sets.select("key", F.array_compact(F.array(*met)).alias("rules")).filter(F.size("rules") > 0)


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, spans_col: str = "spans") -> DataFrame:
    """``docs`` with ``spans_col``: array of (start, rule, stop), sorted; a column of that name gives way.

    start and stop are code points of the whole text, stop exclusive; rule is a
    position in ``rules``. Every row stays, with all its columns; a null or empty
    text has an empty array; an empty table gives none. Documents are told apart by
    a hash of the row (of what can be hashed: columns that hold maps are left out);
    rows that share one share their candidates, and each is verified on its own
    text. The join has one row by key on the candidates' side and may be split.
    """
    whole, key, met = (free_name(docs, n) for n in ("__text", "__key", "__rules"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({whole: text, key: F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not re.search(r"\b(map<|variant)", kind)])})
    queries = [query_of(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries if q != ALWAYS for c in q for t in c})
    if trigrams:
        postings = index(keyed.select(F.col(key).alias("key"), F.col(whole).alias("text")), trigrams)
        keyed = spread_join(keyed, candidates(postings, trigrams, rules).withColumnsRenamed({"key": key, "rules": met}), [key], "left")
    else:
        keyed = keyed.withColumn(met, F.array().cast("array<int>"))
    none = F.array().cast("array<struct<start:int,rule:int,stop:int>>")
    by_rule = []
    for i, (rule, query) in enumerate(zip(rules, queries)):
        wanted = F.array_contains(met, i) if query != ALWAYS else F.col(whole).rlike(rule.pattern)
        number = F.lit(i)
        spans = F.transform(places(F.col(whole), rule), lambda p: F.struct(p["start"].alias("start"), number.alias("rule"), p["stop"].alias("stop")))
        by_rule.append(F.when(wanted, spans).otherwise(none))
    kept = [c for c in docs.columns if c != spans_col]
    return keyed.withColumn(spans_col, F.array_sort(F.concat(*by_rule))).select(*[f"`{c}`" for c in kept], spans_col)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping ones, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def put(a: Column, s: Column) -> Column:
        kept = F.when(s["start"] >= a["at"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.concat(a["out"], kept).alias("out"))

    done = F.aggregate(spans, start, put, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
