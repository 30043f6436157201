"""What a text must hold for a regular expression to be found in it."""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

LONGEST, MOST = 3, 64


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The one of two needed sets that fewer texts meet: longer runs, then fewer of them."""
    if not a or not b:
        return a or b
    return min(a, b, key=lambda s: (-min(map(len, s)), len(s)))


def _needed(items) -> set[str] | None:
    """Runs of characters of which any match holds one; None if there are none."""
    best, run = None, ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if run:
            best, run = _better(best, {run[:LONGEST]}), ""
        found = None
        if kind is op.IN:
            size = sum(v[1] - v[0] + 1 if k is op.RANGE else 1 for k, v in value if k in (op.RANGE, op.LITERAL))
            if size <= MOST and all(k in (op.RANGE, op.LITERAL) for k, _ in value):
                found = {chr(c) for k, v in value for c in (range(v[0], v[1] + 1) if k is op.RANGE else (v,))}
        elif kind is op.SUBPATTERN:
            found = _needed(value[-1])
        elif kind is op.ATOMIC_GROUP:
            found = _needed(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            found = _needed(value[2])
        elif kind is op.BRANCH:
            parts = [_needed(x) for x in value[1]]
            if all(parts) and sum(map(len, parts)) <= MOST:
                found = set().union(*parts)
        best = _better(best, found)
    return best


def needed(pattern: str) -> set[str] | None:
    """Runs of up to LONGEST characters, one of which every text has in which the pattern is found; {""} if nothing is needed, None if it isn't a pattern."""
    try:
        tree = parser.parse(pattern)
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    return ({""} if tree.state.flags & re.IGNORECASE else _needed(tree)) or {""}
