"""Literals that a pattern demands of a text."""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser


def _best(options: list[list[str]]) -> list[str]:
    """The factors whose shortest is longest; none if there is no option."""
    return max(options, key=lambda f: (min(map(len, f)), -len(f)), default=[])


def _factors(items: list) -> list[str]:
    """Literals of which each match of a parsed sequence holds one; empty for none."""
    options, run = [], ""
    for kind, arg in [*items, (None, None)]:
        if kind is op.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            options.append([run])
        run = ""
        if kind is op.SUBPATTERN:
            options.append(_factors(arg[3]))
        elif kind is op.ATOMIC_GROUP:
            options.append(_factors(arg))
        elif kind is op.BRANCH:
            branches = [_factors(b) for b in arg[1]]
            options.append([f for b in branches for f in b] if all(branches) else [])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] > 0:
            options.append(_factors(arg[2]))
    return _best([o for o in options if o])


def factors(pattern: str) -> list[str]:
    """Small ASCII literals of which every match of the pattern, without case, holds at least one; empty if it demands none."""
    parsed = _parser.parse(pattern, re.I)
    if parsed.state.flags & re.X or re.search(r"\(\?[a-zA-Z]*-[a-z]*i", pattern):
        return []
    return sorted(set(_factors(list(parsed))))
