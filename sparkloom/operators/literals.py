"""Literals that a regular expression can't match without: a cheap test before the expression itself."""

from __future__ import annotations

from re import _constants as sre, _parser  # the parse tree of Python's own expressions

from pyspark.sql import Column, functions as F


def _best(candidates: list[frozenset[str]]) -> frozenset[str] | None:
    """The choice whose shortest word is longest; of equal ones the smaller."""
    return max(candidates, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _of(tree) -> frozenset[str] | None:
    found, run = [], ""

    def close() -> None:
        nonlocal run
        if run:
            found.append(frozenset([run]))
        run = ""

    for op, value in tree:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        close()
        inner = None
        if op is sre.SUBPATTERN:
            inner = _of(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _of(value[2])
        elif op is sre.BRANCH:
            each = [_of(b) for b in value[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif op is sre.ATOMIC_GROUP:
            inner = _of(value)
        if inner:
            found.append(inner)
    close()
    return _best(found)


def required(pattern: str) -> frozenset[str] | None:
    """Words of which every match holds one, in lower case; None if there are none, or if the expression is not understood.

    >>> sorted(required(r"(os\\.system|popen)\\s*\\("))
    ['os.system', 'popen']
    """
    try:
        words = _of(_parser.parse(pattern))
    except Exception:  # noqa: BLE001  another dialect's syntax: no prefilter
        return None
    if not words or not all(w.isascii() for w in words):
        return None
    low = {w.lower() for w in words}
    # a word that holds another adds nothing
    return frozenset(w for w in low if not any(x != w and x in w for x in low))


def may_match(low: Column, pattern: str) -> Column:
    """Whether a text, given in lower case, holds what the pattern requires: true wherever the pattern is found."""
    words = required(pattern)
    if words is None:
        return F.lit(True)
    out = None
    for w in sorted(words):
        hit = F.contains(low, F.lit(w))
        out = hit if out is None else out | hit
    return out
