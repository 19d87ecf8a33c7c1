"""Boolean trigram queries of regular expressions.

A query is in disjunctive form: a set of clauses, each a set of trigrams that all
occur in any text which the expression matches that way. A clause without
trigrams means that nothing is mandatory.
"""

from __future__ import annotations

import re
from re import _constants as kinds
from re import _parser

Query = frozenset[frozenset[str]]

ALWAYS: Query = frozenset({frozenset()})
#: Strings that one part of an expression is followed through, and clauses of a query, at most; beyond, less is asked for.
_MOST = 64


def _absorb(clauses: set[frozenset[str]]) -> Query:
    kept = frozenset(c for c in clauses if not any(d < c for d in clauses))
    return kept if len(kept) <= _MOST else ALWAYS


def _both(a: Query, b: Query) -> Query:
    joined = _absorb({x | y for x in a for y in b})
    return joined if joined != ALWAYS else (a if a != ALWAYS else b)


def _of_strings(strings: set[str]) -> Query:
    return _absorb({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _characters(items: list) -> set[str] | None:
    """Lower-cased characters of a class, if they are few."""
    out: set[str] = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            out.add(chr(value).lower())
        elif kind is kinds.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _parts(tokens) -> tuple[set[str] | None, Query]:
    """What a sequence matches: all its strings if they are few, and what any match needs."""
    run, needed, whole = {""}, ALWAYS, True
    for kind, value in tokens:
        exact, own = _part(kind, value)
        if exact is not None and len(run) * len(exact) <= _MOST:
            run = {a + b for a in run for b in exact}
            continue
        needed, whole = _both(_both(needed, _of_strings(run)), own), False
        run = exact if exact is not None else {""}
    return (run, _of_strings(run)) if whole else (None, _both(needed, _of_strings(run)))


def _part(kind, value) -> tuple[set[str] | None, Query]:
    if kind is kinds.LITERAL:
        return {chr(value).lower()}, ALWAYS
    if kind is kinds.IN:
        return _characters(value), ALWAYS
    if kind is kinds.SUBPATTERN:
        return _parts(value[-1])
    if kind is kinds.BRANCH:
        found = [_parts(x) for x in value[1]]
        exact = set().union(*(e for e, _ in found)) if all(e is not None for e, _ in found) else None
        return exact if exact is not None and len(exact) <= _MOST else None, _absorb(set().union(*(q for _, q in found)))
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        least, most, inner = value
        exact, own = _parts(inner)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, ALWAYS
        if least == most == 1:
            return exact, own
        return None, own if least else ALWAYS
    if kind is kinds.AT:
        return {""}, ALWAYS
    return None, ALWAYS


def query_of(pattern: str) -> Query:
    """Trigrams of the ASCII-lower-cased text that a match of ``pattern`` needs; ALWAYS if none is mandatory."""
    return _parts(_parser.parse(re.compile(pattern).pattern))[1]
