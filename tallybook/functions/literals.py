"""Literals that a pattern can't match without, so that a text without them need not be tried."""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser


def _of(parts) -> tuple[str | None, list[frozenset[str]]]:
    """(the text itself if parts are nothing else, sets of literals of which a match holds one each)."""
    sets, run, whole = [], "", True
    for kind, value in parts:
        text, more = None, []
        if kind is op.LITERAL:
            text = chr(value)
        elif kind is op.SUBPATTERN:
            text, more = _of(value[-1])
        elif kind is op.BRANCH:
            branches = [_best(b) for b in value[1]]
            more = [frozenset().union(*branches)] if all(branches) else []
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            more = _of(value[2])[1]
            one = _of(value[2])[0]
            more = [frozenset([one])] if one else more
        if text is None:
            whole = whole and kind is op.AT
            sets += [*more, frozenset([run])]
            run = run if kind is op.AT else ""
        else:
            run += text
    return (run if whole else None), [s for s in [*sets, frozenset([run])] if all(s)]


def _best(parts) -> frozenset[str]:
    """The set whose shortest literal is longest; of several the smallest set."""
    return max(_of(parts)[1], key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def required(pattern: str) -> list[str]:
    """Texts, one of which stands in whatever the pattern matches, in capital letters; none if there is no such set."""
    return sorted({s.upper() for s in _best(parser.parse(pattern))})
