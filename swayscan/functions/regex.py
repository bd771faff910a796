"""Driver-side preparation of pack patterns for Spark's regex functions.

Packs are written in Python-style regex. Spark matches with Java's, whose
``\\w``, ``\\d``, ``\\s``, ``\\b`` and ``.`` read fewer or other characters, so
each pattern is rewritten once, on the driver, into a Java pattern that reads
the same text. The same walk yields the literals a text must contain for the
pattern to match, which the scan uses as a cheap filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

# The character classes as Python reads them.
# Most characters are told by the ranges, which are read before the kinds of character that hold them too.
WORD = r"a-zA-Z0-9\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
# Single characters below U+0100 are one table look-up in Java; ranges are a test each.
SPACE = r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x85\xA0\p{Z}"
_CLASSES = {"w": WORD, "d": DIGIT, "s": SPACE}

FLAG_BITS = {"i": re.IGNORECASE, "s": re.DOTALL}


def flag_bits(letters: str) -> int:
    """Python flag bits of a pack's flag letters; an unknown letter is an error."""
    unknown = sorted(set(letters) - set(FLAG_BITS))
    if unknown:
        raise ValueError(f"unsupported pattern flag {unknown[0]!r}")
    return sum(FLAG_BITS[letter] for letter in set(letters))


def check_pattern(pattern: str, flags: str) -> None:
    """Refuse patterns that the span columns cannot read exactly."""
    tree = sre_parser.parse(pattern, flag_bits(flags))
    if tree.getwidth()[0] == 0:
        raise ValueError(f"pattern can match empty text: {pattern!r}")
    if re.search(r"[\U00010000-\U0010FFFF]|\\U", pattern):
        raise ValueError(f"pattern names characters above U+FFFF: {pattern!r}")
    if tree.state.groups > 1:
        raise ValueError(f"pattern has a capturing group: {pattern!r}")


@lru_cache(maxsize=4096)
def to_java(pattern: str, flags: str) -> str:
    """The Java pattern that reads text as ``pattern`` does in Python."""
    body = rewrite(pattern, "s" in flags)
    body = body.replace("(?i:", "(?iu:")
    # A pattern that names kinds of letters, as Java does, is not for Python to read.
    firsts = _first_letters(_parsed(pattern) or [])
    # Most places fail at this look at one letter, before any look-behind. A body may begin with the same look.
    guard = f"(?=[{''.join(sorted(firsts))}])" if firsts else ""
    return ("" if guard and body.startswith(guard) else guard) + ("(?iu)" if "i" in flags else "") + body


_EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_INSIDE = rf"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"


def rewrite(pattern: str, dotall: bool, edge: tuple[str, str] | None = None) -> str:
    """Spell out the shorthand classes; ``edge`` replaces ``\\b`` and ``\\B``."""
    out, at, in_class = [], 0, False
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            letter = pattern[at + 1]
            at += 2
            kind = letter.lower()
            if kind in _CLASSES:
                if letter.isupper():
                    out.append(f"[^{_CLASSES[kind]}]")
                else:
                    out.append(_CLASSES[kind] if in_class else f"[{_CLASSES[kind]}]")
            elif letter == "b" and not in_class:
                out.append(edge[0] if edge else _one_sided(pattern, at - 2, at))
            elif letter == "B" and not in_class:
                out.append(edge[1] if edge else _INSIDE)
            elif letter == "Z":
                out.append(r"\z")
            else:
                out.append("\\" + letter)
            continue
        if in_class:
            if char == "]":
                in_class = False
            elif char in "[&":
                char = "\\" + char
        elif char == "[":
            in_class = True
            if pattern[at + 1 : at + 2] == "^":
                out.append("[")
                at, char = at + 1, "^"
            if pattern[at + 1 : at + 2] == "]":
                out.append(char)
                at, char = at + 1, r"\]"
        elif char == "." and not dotall:
            char = r"[^\n]"
        elif char == "." and dotall:
            char = "(?s:.)"
        elif char == "{" and pattern[at + 1 : at + 2] == ",":
            char = "{0"
        out.append(char)
        at += 1
    return "".join(out)


def _one_sided(pattern: str, before: int, after: int) -> str:
    """The cheap half of ``\\b`` where the neighbouring pattern decides the other.

    A word character that must follow leaves only "no word character before"
    to check, and the reverse. A look at the first letter comes before the
    look-behind, which is the slower of the two.
    """
    right, left = _parsed(pattern[after:]), _parsed(pattern[:before])
    if right is not None and _edge_is_word(right, 0):
        firsts = _first_letters(right)
        guard = f"(?=[{''.join(sorted(firsts))}])" if firsts else ""
        return rf"{guard}(?<![{WORD}])"
    if left is not None and _edge_is_word(left, -1):
        return rf"(?![{WORD}])"
    return _EDGE


def _parsed(part: str):
    """The parse tree of a piece of a pattern, or None if it is not whole."""
    try:
        return list(sre_parser.parse(part))
    except re.error:
        return None


_REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT)
_ZERO_WIDTH = (sre.AT, sre.ASSERT, sre.ASSERT_NOT)


def _edge_is_word(nodes, end: int) -> bool:
    """Must the first (``end`` 0) or last (-1) character be a word character?"""
    for op, value in nodes if end == 0 else reversed(nodes):
        if op is sre.LITERAL:
            return chr(value).isalnum() or value == ord("_")
        if op is sre.IN:
            return all(_item_is_word(*item) for item in value)
        if op is sre.BRANCH:
            return all(_edge_is_word(list(branch), end) for branch in value[1])
        if op is sre.SUBPATTERN:
            return _edge_is_word(list(value[3]), end)
        if op in _REPEATS:
            if not _edge_is_word(list(value[2]), end):
                return False
            if value[0] > 0:
                return True
        elif op not in _ZERO_WIDTH:
            return False
    return False


def _item_is_word(op, value) -> bool:
    if op is sre.LITERAL:
        return chr(value).isalnum() or value == ord("_")
    if op is sre.RANGE:
        return all(chr(c).isalnum() for c in range(value[0], min(value[1], value[0] + 300) + 1))
    return op is sre.CATEGORY and value in (sre.CATEGORY_WORD, sre.CATEGORY_DIGIT)


def _first_letters(nodes):
    """Every form of the ASCII letters a match can start with, or None."""
    for op, value in nodes:
        if op in _ZERO_WIDTH:
            continue
        codes = [v for o, v in value if o is sre.LITERAL] if op is sre.IN else [value]
        if op in (sre.LITERAL, sre.IN):
            known = len(codes) == (len(value) if op is sre.IN else 1)
            if not known or not all(c < 128 and chr(c).isalpha() for c in codes):
                return None
            return set().union(*(_forms(chr(c)) for c in codes))
        if op is sre.SUBPATTERN:
            return _first_letters(list(value[3]))
        if op is sre.BRANCH:
            found = [_first_letters(list(branch)) for branch in value[1]]
            return set().union(*found) if all(found) else None
        if op in _REPEATS and value[0] > 0:
            return _first_letters(list(value[2]))
        return None
    return None


def needs_digit(pattern: str, flags: str) -> bool:
    """Does every match hold a digit?"""

    def held(nodes) -> bool:
        return any(by(op, value) for op, value in nodes)

    def by(op, value) -> bool:
        if op is sre.LITERAL:
            return chr(value).isdecimal()
        if op is sre.IN:
            return all(_item_is_digit(*item) for item in value)
        if op is sre.SUBPATTERN:
            return held(value[3])
        if op is sre.BRANCH:
            return all(held(branch) for branch in value[1])
        return op in _REPEATS and value[0] > 0 and held(value[2])

    return held(sre_parser.parse(pattern, flag_bits(flags)))


def _item_is_digit(op, value) -> bool:
    if op is sre.LITERAL:
        return chr(value).isdecimal()
    if op is sre.RANGE:
        return all(chr(c).isdecimal() for c in range(value[0], min(value[1], value[0] + 300) + 1))
    return op is sre.CATEGORY and value is sre.CATEGORY_DIGIT


def _forms(letter: str) -> set[str]:
    """The characters that an ignore-case match reads as this letter."""
    # The four characters outside ASCII that do.
    extra = {"s": "ſ", "k": "\u212a", "i": "İı"}
    return {letter.lower(), letter.upper(), *extra.get(letter.lower(), "")}


# --- literals a match must contain -------------------------------------------

_MOST_LITERALS = 24  # that stretches of a pattern are combined to
_MOST_CHOICES = 256  # of one set
_MOST_SETS = 3


@dataclass(frozen=True)
class Needs:
    """What a text must hold for a pattern to match; used to skip texts cheaply.

    Of every set in ``words`` one literal starts a word of the folded text, and
    of every set in ``marks`` (punctuation) one is in it.
    """

    words: tuple[tuple[str, ...], ...]
    marks: tuple[tuple[str, ...], ...]


@lru_cache(maxsize=4096)
def needs(pattern: str, flags: str, blanks: bool = False) -> Needs:
    """The literals a pattern promises, longest first, at most three sets each.

    With ``blanks``, literals go on over white space: a blank in one of ``words``
    stands for white space of any kind and length, and ``marks`` hold none.
    """
    run, run_edge, found, _ = _walk(sre_parser.parse(pattern, flag_bits(flags)), False, blanks)
    found = {_shortest(s) for s in found + _usable(run, run_edge, blanks)}
    ranked = sorted(found, key=_strength, reverse=True)
    words = [s for s in ranked if all(x[0].isalnum() for x in s)]
    marks = [s for s in ranked if s not in words]
    return Needs(
        tuple(tuple(sorted(s)) for s in words[:_MOST_SETS]),
        tuple(tuple(sorted(s)) for s in marks[:_MOST_SETS]),
    )


def _shortest(strings) -> frozenset:
    """Without the literals that start with another one of the set."""
    return frozenset(s for s in strings if not any(s.startswith(o) for o in strings if o != s))


def _strength(literals):
    return min(map(len, literals)), -len(literals), sorted(literals)


def _usable(strings, edge: bool, blanks: bool) -> list[frozenset]:
    """A list holding the set, if it can be looked for; ``edge``: at a word start."""
    if not strings or len(strings) > _MOST_CHOICES:
        return []
    if not any(c.isalnum() for s in strings for c in s):
        marks = [max(s.split(), key=len, default="") if blanks else s for s in strings]
        return [frozenset(marks)] if all(s.strip() for s in marks) else []
    words = {_from_word_start(re.sub(r"\s+", " ", s) if blanks else s, edge) for s in strings}
    return [frozenset(words)] if all(len(w.strip()) > 1 for w in words) else []


def _from_word_start(string: str, edge: bool) -> str:
    """The longest tail of ``string`` that surely starts a word; may be empty."""
    for at, char in enumerate(string):
        at_edge = edge if at == 0 else not _is_word(string[at - 1])
        if at_edge and _is_word(char):
            return string[at:]
    return ""


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _walk(nodes, edge: bool, blanks: bool):
    """Read a sequence: ``(last run, was it at a word start, sets, edge after)``.

    A run is every string its stretch of the pattern can be, or None once the
    sequence holds more than one stretch. ``edge`` says that whatever comes
    next starts a word, if it is a word character at all.
    """
    run, run_edge, whole, sets = {""}, edge, True, []
    for op, value in nodes:
        part, inner, after = _node(op, value, edge, blanks)
        sets += inner
        if part is not None and len(run) * len(part) <= _MOST_LITERALS:
            run = {a + b for a, b in product(run, part)}
        else:
            sets += _usable(run, run_edge, blanks)
            whole = False
            run, run_edge = (part, edge) if part else ({""}, after)
        if op is sre.AT and run == {""}:
            run_edge = after
        edge = after
    if whole:
        return run, run_edge, sets, edge
    return None, False, sets + _usable(run, run_edge, blanks), edge


_BLANK = [(sre.CATEGORY, sre.CATEGORY_SPACE)]


def _caseless(code: int) -> bool:
    char = chr(code)
    return not char.isalnum() and char.lower() == char.upper() == char


def _readable(code: int) -> bool:
    return code < 128 or _caseless(code)


def _node(op, value, edge: bool, blanks: bool):
    """``(every string one node can be, or None; sets; edge after it)``."""
    if op is sre.AT:
        opens = value in (sre.AT_BOUNDARY, sre.AT_BEGINNING, sre.AT_BEGINNING_STRING)
        return {""}, [], edge or opens
    if op in _ZERO_WIDTH:
        return {""}, [], edge
    if op is sre.LITERAL:
        after = not _is_word(chr(value))
        return ({chr(value).lower()} if _readable(value) else None), [], after
    if blanks and op is sre.IN and value == _BLANK:
        return {" "}, [], True
    if op is sre.IN:
        after = all(_item_is_apart(*item) for item in value)
        if all(o is sre.LITERAL and _readable(v) for o, v in value):
            return {chr(v).lower() for _, v in value}, [], after
        return None, [], after
    if op is sre.SUBPATTERN:
        run, _, sets, after = _walk(value[3], edge, blanks)
        return run, sets, after
    if op is sre.BRANCH:
        return _branch(value[1], edge, blanks)
    if op in _REPEATS:
        least, most, inner = value
        if blanks and least > 0 and list(inner) == [(sre.IN, _BLANK)]:
            return {" "}, [], True
        run, run_edge, sets, after = _walk(inner, edge and least > 0 and most == 1, blanks)
        if least == 0:
            optional = run | {""} if most == 1 and run is not None else None
            return optional, [], after and edge
        once = run if most == 1 else None
        return once, sets + ([] if once else _usable(run, run_edge, blanks)), after
    return None, [], False


def _branch(branches, edge: bool, blanks: bool):
    walks = [_walk(branch, edge, blanks) for branch in branches]
    after = all(walk[3] for walk in walks)
    if all(walk[0] is not None for walk in walks):
        run = set().union(*(walk[0] for walk in walks))
        if len(run) <= _MOST_CHOICES:
            return run, [], after
    options = [sets + _usable(run, run_edge, blanks) for run, run_edge, sets, _ in walks]
    if not all(options):
        return None, [], after
    together = frozenset().union(*(max(o, key=_strength) for o in options))
    mixed = len({_is_word(x[0]) for x in together}) > 1
    return None, [together] if len(together) <= _MOST_CHOICES and not mixed else [], after


def _item_is_apart(op, value) -> bool:
    """Does a class item hold no word character?"""
    if op is sre.LITERAL:
        return not _is_word(chr(value))
    return op is sre.CATEGORY and value in (sre.CATEGORY_SPACE, sre.CATEGORY_NOT_WORD)


def word_finder(words) -> str:
    """A Java pattern whose group 1 is the longest of ``words`` at each word start behind another character.

    One pass over a text finds the literals of a whole pack. The words are laid
    out as a tree that halves the choices at every step. A blank in a word
    matches white space of any kind and length.
    """
    # Most characters are small letters, which one table look-up tells; only others meet the whole class.
    # Of the others most are marks and blanks of ASCII, again one look-up.
    return rf"[^abcdefghijklmnopqrstuvwxyz](?:(?<=[{_APART}])|(?<![{WORD}]))(?=({_tree(sorted(words), blank=SPACE)}))"


# The characters of ASCII that are in no word, one by one.
_APART = "".join(rf"\x{code:02X}" for code in range(128) if not (chr(code).isalnum() or chr(code) == "_"))


def form_finder(forms) -> str:
    """A Java pattern whose group 1 is the longest of ``forms`` at each place behind no letter.

    A form that ends with a letter must not go on with one.
    """
    return rf"(?<!\p{{L}})(?=({_tree(sorted(forms), END_OF_FORM)}))"


END_OF_FORM = r"(?:(?<=[.])|(?!\p{L}))"


def _tree(tails, end: str = "", blank: str = "") -> str:
    """``blank``: the characters that a blank stands for, one or more of them; by itself if not given."""
    heads: dict[str, list[str]] = {}
    for tail in tails:
        if tail:
            heads.setdefault(tail[0], []).append(tail[1:])
    if not heads:
        return end
    branches = []
    for head, rest in sorted(heads.items()):
        item = blank if blank and head == " " else re.escape(head)
        branches.append((item, (f"[{blank}]++" if item == blank else item) + _tree(rest, end, blank)))
    if len(branches) == 1 and "" not in tails:
        return branches[0][1]  # a group for each letter would be a step for each
    body = _halves(branches)
    return f"(?:{body}|{end})" if end and "" in tails else f"(?:{body})" + ("?" if "" in tails else "")


_FEW = 9  # choices that are faster tried one by one


def _halves(branches) -> str:
    if len(branches) < _FEW:
        return "|".join(body for _, body in branches)
    middle = len(branches) // 2
    sides = (branches[:middle], branches[middle:])
    return "|".join(
        f"(?=[{''.join(item for item, _ in side)}])(?:{_halves(side)})" for side in sides
    )
