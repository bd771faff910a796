"""Sentences of a text as column expressions.

A stop, mark or ellipsis with white space behind it ends a sentence unless the
words around it say otherwise: a title before it never ends one, an initial or
another short form only before a word that opens sentences, and nothing does
before a lower-case letter. A blank line always ends one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swayscan.functions.regex import to_java
from swayscan.functions.spans import SPAN, cut_at_matches, let, starts_of
from swayscan.functions.text import matchable

# Forms that take a period and stand before a name, and forms that may also end a sentence.
TITLES = ("Dr", "Mr", "Mrs", "Ms", "Mx", "Prof", "Rev", "Msgr", "Fr", "Sen", "Rep", "Gov", "Gen", "Col", "Capt", "Lt", "Sgt",
          "Hon", "St", "Mt", "Ft", "vs", "v", "cf", "e\\.g", "i\\.e", "No", "Nos", "Fig", "Figs", "Eq", "pp", "p", "al")
SHORT_FORMS = ("Inc", "Ltd", "Co", "Corp", "Bros", "Jr", "Sr", "Esq", "Ph\\.D", "M\\.D", "etc", "Univ", "Inst", "Dept", "Assn",
               "Ave", "Blvd", "Rd", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
               "a\\.m", "p\\.m", "approx", "est")
OPENERS = ("The", "A", "An", "This", "That", "These", "Those", "It", "He", "She", "We", "They", "You", "I", "In", "On", "At", "But",
           "And", "So", "If", "When", "While", "As", "For", "There", "No", "Not", "However", "Some", "Many", "Most", "All")
_LEFT, _RIGHT = "(?:^|[\\s(\\[\"“‘'])", "$"
CUT = "[.!?…]+[\"'”’)\\]»]*\\s+|\\n[ \\t\\r]*\\n\\s*"
"""Where a sentence may end, white space included."""
BLANK = "\\n[ \\t\\r]*\\n"
ONE_STOP = "^[.][\"'”’)\\]»\\s]"
TITLE = f"{_LEFT}(?:{'|'.join(TITLES)}){_RIGHT}"
SHORT = f"(?:{_LEFT}(?:{'|'.join(SHORT_FORMS)})|(?:^|[\\s(\\[\"“‘'.])[A-Z]){_RIGHT}"
LOWER = "^[\"'“‘(\\[]*\\p{Ll}"
OPENS = f"^[\"'“‘(\\[]*(?:{'|'.join(OPENERS)})(?:\\W|$)"
NEAR = 24
"""Characters looked at on either side."""


def _java(pattern: str) -> str:
    """The pattern with shorthand classes for all letters, as in ``CUT``, and with an end that is that of the text."""
    return to_java(pattern, "").replace("$", r"\z")


def sentence_starts(text: Column) -> Column:
    """Code-point offsets where sentences begin, the first at 0. A null text gives null."""

    def ends(cuts, n):
        plain = F.get(cuts, n + 1)
        after = F.left(F.when(plain == "", F.coalesce(F.get(cuts, n + 2), F.lit(""))).otherwise(plain), F.lit(NEAR))
        near = F.array(F.right(F.get(cuts, n - 1), F.lit(NEAR)), F.get(cuts, n), after)
        return let(near, lambda places: ends_at(*(F.get(places, F.lit(k)) for k in range(3))))

    def ends_at(before, stop, after):
        one, opens = stop.rlike(_java(ONE_STOP)), after.rlike(_java(OPENS))
        held = after.rlike(_java(LOWER)) | (one & before.rlike(_java(TITLE))) | (one & before.rlike(_java(SHORT)) & ~opens)
        return (after != "") & (stop.rlike(_java(BLANK)) | ~held)

    def of(cuts, starts):
        odd = F.filter(F.sequence(F.lit(0), F.size(cuts) - 1), lambda n: (n % 2 == 1) & ends(cuts, n))
        return F.concat(F.array(F.lit(0)), F.transform(odd, lambda n: F.get(starts, n + 1)))

    def cut(cuts):
        return let(starts_of(F.transform(cuts, lambda piece: F.length(piece))), lambda starts: of(cuts, starts))

    return F.when(text.isNotNull(), let(cut_at_matches(matchable(text), CUT, ""), cut))


def sentence_spans(text: Column) -> Column:
    """Sentences as spans that cover the text, each with the white space behind it. An empty text has none."""

    def spans(starts):
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts) - 1), F.array(F.length(text)))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")).cast(SPAN))

    return F.when(F.length(text) > 0, let(sentence_starts(text), spans)).when(
        text.isNotNull(), F.array().cast(f"array<{SPAN}>")
    )


def sentence_no(starts: Column, offset: Column) -> Column:
    """Number, from 1, of the sentence in which an offset lies."""
    return F.size(F.filter(starts, lambda s: s <= offset))
