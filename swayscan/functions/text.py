"""Column functions over one text: folding, clipping, counting, offsets."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from swayscan.functions.regex import SPACE, WORD, Needs, word_finder

MAX_CHARS = 200_000
"""Longest text the scan accepts, in code points."""

MARK = ""
"""Private-use character put around matches so that a text can be cut there."""

_ABOVE_BMP = r"[\x{10000}-\x{10FFFF}]"
_STAND_INS = (
    # One stand-in per kind of character: a digit, a letter, anything else.
    (rf"(?=\p{{Nd}}){_ABOVE_BMP}", "０"),
    (rf"(?=[{WORD}]){_ABOVE_BMP}", "ꙮ"),
    (rf"{_ABOVE_BMP}|{MARK}", "￼"),
)


def matchable(text: Column) -> Column:
    """The text with one stand-in for each character that matching cannot read.

    Java's look-behinds misread characters above U+FFFF, and ``MARK`` is the
    scan's own. Each becomes one character of the same kind, so every match
    keeps its offsets. Plain ASCII text passes untouched.
    """
    out = text
    for pattern, stand_in in _STAND_INS:
        out = F.regexp_replace(out, pattern, stand_in)
    # Only characters above U+FFFF take more UTF-16 units than there are characters.
    rare = (F.octet_length(F.encode(text, "UTF-16BE")) > 2 * F.length(text)) | F.contains(text, F.lit(MARK))
    return F.when(ascii_only(text) | ~rare, text).otherwise(out)


def ascii_only(text: Column) -> Column:
    """Is each character of a text one byte?"""
    return F.octet_length(text) == F.length(text)


def folded(text: Column, lowered: Column | None = None) -> Column:
    """Lower case, with the characters that ignore-case matching reads as ASCII; ``lowered``: the lower case, if at hand."""
    # Long s, Kelvin sign, dotless i, dotted I.
    odd = "ſ\u212aıİ"
    usual = ascii_only(text) | ~reduce(or_, (F.contains(text, F.lit(char)) for char in odd))
    plain = F.translate(text, odd, "skii")
    if lowered is None:
        return F.lower(F.when(usual, text).otherwise(plain))
    return F.when(usual, lowered).otherwise(F.lower(plain))


def sql_string(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def holds_digit(text: Column) -> Column:
    """Is a decimal digit of any script in the text?"""
    return F.when(ascii_only(text), text.rlike("[0123456789]")).otherwise(text.rlike(r"[0123456789\p{Nd}]"))


class Literals:
    """The literals that patterns need, each set of them a bit of ``seen``, a column of the bits that a text has."""

    BITS = 62  # of a number

    def __init__(self, patterns: list[Needs]):
        self.sets = sorted({literals for needed in patterns for literals in needed.words})
        self.place = {literals: n for n, literals in enumerate(self.sets)}
        self.words = sorted({word for literals in self.sets for word in literals})

    def numbers(self, sets) -> list[int]:
        """Some sets as bits."""
        out = [0] * (len(self.sets) // self.BITS + 1)
        for n in {self.place[literals] for literals in sets}:
            out[n // self.BITS] |= 1 << n % self.BITS
        return out

    def seen(self, text: Column) -> Column:
        """Which sets have a literal that starts a word of the text, by one walk over it."""
        if not self.words:
            return F.when(text.isNotNull(), F.array(F.lit(0).cast("bigint")))
        finder = F.regexp_extract_all(F.concat(F.lit(" "), folded(text)), F.lit(word_finder(self.words)), 1)
        bits = F.transform(
            F.array_distinct(finder), lambda w: F.coalesce(self._bits(w), self._bits(F.regexp_replace(w, f"[{SPACE}]+", " ")))
        )
        none = F.array(*(F.lit(n).cast("bigint") for n in self.numbers([])))
        return F.aggregate(bits, none, lambda all_, some: F.zip_with(all_, some, lambda a, b: a.bitwiseOR(b)))

    def _bits(self, word: Column) -> Column:
        """The bits of one word, from a table dealt out by the words' checksums; null if it is none of them."""
        parts = 2 * len(self.words)
        table: list[list] = [[] for _ in range(parts)]
        for w in self.words:
            held = [literals for literals in self.sets if w.startswith(literals)]
            table[crc32(w.encode("utf-8")) % parts].append({"word": w, "bits": self.numbers(held)})
        listed = F.from_json(F.lit(json.dumps(table)), "array<array<struct<word:string,bits:array<bigint>>>>")
        part = F.get(listed, (F.crc32(word) % parts).cast("int"))
        return F.get(F.filter(part, lambda entry: entry["word"] == word), F.lit(0))["bits"]

    def holds(self, needed: Needs, seen: str, text: str) -> str:
        """SQL: may a text match, judging by the literals it holds?"""
        tests = [f"({seen}[{k}] & {bits}L) = {bits}L" for k, bits in enumerate(self.numbers(needed.words)) if bits]
        for literals in needed.marks:
            tests.append("(" + " OR ".join(f"contains({text}, {sql_string(x)})" for x in literals) + ")")
        return " AND ".join(tests) or "true"

    def holds_any(self, sets, seen: str) -> str:
        """SQL: does a text hold a literal of any of these sets?"""
        return "(" + " OR ".join(f"({seen}[{k}] & {bits}L) != 0L" for k, bits in enumerate(self.numbers(sets)) if bits) + ")"


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not white space."""
    return F.size(F.array_remove(F.split(text, f"[{SPACE}]+"), ""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def holds_pairs(text: Column) -> Column:
    """Does the text hold characters that take two UTF-16 units?"""
    return text.rlike(_ABOVE_BMP)


def clip_text(text: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units, never half of a pair."""
    cut = F.substring(F.encode(text, "UTF-16BE"), 1, 2 * units)
    last_unit = F.hex(F.substring(cut, 2 * units - 1, 2))
    halves_a_pair = F.coalesce(last_unit.rlike("^D[89AB]"), F.lit(False))
    whole = F.when(halves_a_pair, F.substring(cut, 1, 2 * units - 2)).otherwise(cut)
    return F.decode(whole, "UTF-16BE")

