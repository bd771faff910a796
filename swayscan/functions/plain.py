"""A second reading of what a match must hold, to check the literals of the scan by.

Nothing here is shared with ``functions.regex.needs`` and the walk that looks for its literals.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from swayscan.functions.text import sql_string


def plain_letters(pattern: str) -> tuple[str, ...]:
    """Strings of which every match holds one, in lower case and anywhere; none if nothing is sure.

    Only runs of plain letters are read, side by side in the pattern: no word starts, no white space, no sets. Kept apart
    from ``functions.regex.needs``, which it helps to check.
    """
    def best(nodes) -> set[str]:
        found, run = [], ""
        for op, value in [*nodes, (None, None)]:
            if op is sre.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                continue
            if run:
                found.append({run})
            run, inner = "", set()
            if op is sre.SUBPATTERN:
                inner = best(value[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                inner = best(value[2])
            elif op is sre.BRANCH:
                options = [best(branch) for branch in value[1]]
                inner = set().union(*options) if all(options) else set()
            if inner:
                found.append(inner)
        return max(found, key=lambda strings: (min(map(len, strings)), -len(strings)), default=set())

    return tuple(sorted(best(parser.parse(pattern))))


def _longest(strings: list[str]) -> str:
    """A pattern for the longest of some strings, letter by letter; a look at the next letter halves the choices."""
    rests: dict[str, list[str]] = {}
    for string in filter(None, strings):
        rests.setdefault(string[0], []).append(string[1:])

    def choice(heads: list[str]) -> str:
        if len(heads) < 5:
            return "|".join(re.escape(head) + _longest(rests[head]) for head in heads)
        sides = heads[: len(heads) // 2], heads[len(heads) // 2 :]
        return "|".join(f"(?=[{''.join(map(re.escape, side))}])(?:{choice(side)})" for side in sides)

    return f"(?:{choice(sorted(rests))})" + ("?" if "" in strings else "") if rests else ""


class Plain:
    """The plain letters of some patterns; ``seen`` lists those that a text holds."""

    def __init__(self, patterns: list[str]):
        self.strings = sorted({string for pattern in patterns for string in plain_letters(pattern)})

    def seen(self, lowered: Column) -> Column:
        """The longest of the strings at each place of a lower-cased text, once each; one walk over it."""
        return F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?=({_longest(self.strings) or '(?!)'}))"), 1))

    def may_match(self, pattern: str, seen: str) -> str:
        """SQL: does a text hold one of the pattern's strings? True if nothing is sure of its matches."""
        parts = plain_letters(pattern)
        # the longest one at a place may go on behind the string that is asked for
        listed = ", ".join(sql_string(s) for s in self.strings if s.startswith(parts)) if parts else ""
        return f"arrays_overlap({seen}, array({listed}))" if parts else "true"
