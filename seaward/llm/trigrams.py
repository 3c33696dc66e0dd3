"""Boolean trigram queries of regular expressions: what every match must contain.

A query is a list of alternatives, each a set of lower-case trigrams that must all occur; None means that no trigram is
mandatory.  The expression's parse tree is walked once: short alternatives are multiplied out as exact strings, and a
string of three letters or more gives the trigrams that it holds.
"""

from __future__ import annotations

from re import _constants as c
from re import _parser

_MOST = 64


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _query(exact: set[str]) -> list[frozenset[str]] | None:
    found = [_trigrams(s) for s in sorted(exact)]
    return None if not found or not all(found) else found


def _both(a, b):
    """Queries that must hold together; where multiplying out gets long, the more selective one stands alone."""
    if a is None or b is None:
        return a or b
    if len(a) * len(b) > _MOST:
        return min(a, b, key=len)
    return [x | y for x in a for y in b]


def _sequence(items) -> tuple[set[str] | None, list | None]:
    """(all strings it can be, if few; what it must contain)."""
    query, exact, whole = None, {""}, True
    for item in items:
        strings, inner = _item(item)
        if strings is not None and len(exact) * len(strings) <= _MOST:
            exact = {a + b for a in exact for b in strings}
            continue
        query, whole = _both(_both(query, _query(exact)), inner), False
        exact = strings if strings is not None else {""}
    if whole:
        return exact, _query(exact)
    return None, _both(query, _query(exact))


def _item(item) -> tuple[set[str] | None, list | None]:
    op, value = item
    if op is c.LITERAL:
        return {chr(value).lower()}, None
    if op is c.IN and all(o is c.LITERAL for o, _ in value):
        return {chr(v).lower() for _, v in value}, None
    if op is c.SUBPATTERN:
        return _sequence(value[3])
    if op is c.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
        if strings is not None and len(strings) <= _MOST:
            return strings, _query(strings)
        queries = [q for _, q in parts]
        return None, None if any(q is None for q in queries) else [x for q in queries for x in q]
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, None
        if least == most and strings is not None and len(strings) ** least <= _MOST:
            return _sequence(list(inner) * least)
        return None, query if least else None
    return None, None


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The query of a regular expression, without alternatives that hold all of another one's trigrams."""
    _, query = _sequence(_parser.parse(pattern))
    if query is None:
        return None
    return [q for i, q in enumerate(query) if not any(o < q or (o == q and j < i) for j, o in enumerate(query))]
