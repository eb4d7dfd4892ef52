"""Words that a pattern's every match holds, so that plain searches spare most texts the pattern itself."""

from __future__ import annotations

import re
from functools import cache
from re import _constants as C
from re import _parser


#: Spellings that a run of characters and small sets is written out to.
MOST_SPELLINGS = 12


def _spellings(op, value) -> list[str] | None:
    """The few characters that an item stands for, in lower case."""
    if op is C.LITERAL and value < 128:
        return [chr(value).lower()]
    if op is C.IN and all(o is C.LITERAL and v < 128 for o, v in value):
        return list(dict.fromkeys(chr(v).lower() for _, v in value))
    return None


def _of(items) -> tuple[str, ...] | None:
    """The best any-of list of words (lower case) of a sequence: the one whose shortest word is longest."""
    found: list[tuple[str, ...]] = []
    run = [""]
    for op, value in [*items, (None, None)]:
        more = _spellings(op, value)
        if more and len(run) * len(more) <= MOST_SPELLINGS:
            run = [r + c for r in run for c in more]
            continue
        if run != [""]:
            found.append(tuple(run))
        run = more if more and len(more) <= MOST_SPELLINGS else [""]
        inner = None
        if op is C.SUBPATTERN:
            inner = _of(value[3])
        elif op is C.ATOMIC_GROUP:
            inner = _of(value)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0]:
            inner = _of(value[2])
        elif op is C.BRANCH:
            arms = [_of(arm) for arm in value[1]]
            inner = None if None in arms else tuple(dict.fromkeys(w for arm in arms for w in arm))
        if inner:
            found.append(inner)
    return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=None)


@cache
def words(pattern: str, least: int = 3) -> tuple[str, ...] | None:
    """Words of which each match holds one at least, in any case; None where the pattern tells none of that length."""
    try:
        found = _of(_parser.parse(pattern))
    except re.error:
        return None
    return found if found and min(map(len, found)) >= least else None


def shortest(found: set[str]) -> list[str]:
    """Words without those that hold another one, as they add nothing."""
    return sorted(w for w in found if not any(o != w and o in w for o in found))
