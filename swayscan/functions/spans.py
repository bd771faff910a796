"""Span columns: matches as ``array<struct<start:int,end:int>>``.

Everything here works inside one row, so none of it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from swayscan.functions.regex import to_java
from swayscan.functions.text import MARK, holds_pairs, matchable, sql_string, utf16_length

SPAN = "struct<start:int,end:int>"
_CHUNK = 256
_BLOCK = 64  # sizes summed by themselves
_PIECE = 1024  # characters of a block of a long text


def cut_at_matches_sql(text: str, pattern: str, flags: str) -> str:
    """SQL cutting ``text`` at every match: plain, match, plain, match, ..., plain.

    ``text`` must be ``matchable``. The pattern stays a literal, so it is
    compiled once per task. SQL text, because a pack makes hundreds of these
    and building each from column objects takes the driver seconds.
    """
    java, around = sql_string(to_java(pattern, flags)), sql_string(f"{MARK}$0{MARK}")
    return f"split(regexp_replace({text}, {java}, {around}), {sql_string(MARK)}, -1)"


def cut_at_matches(text: Column, pattern: str, flags: str) -> Column:
    """The same cut of any text column."""
    marked = F.regexp_replace(text, to_java(pattern, flags), f"{MARK}$0{MARK}")
    return F.split(marked, MARK, -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collect_fold(
    items: Column,
    start: Column,
    step: Callable[[Column, Column], tuple[Column, Column]],
    element: str,
) -> Column:
    """Fold over an array, keeping the non-null value each step emits.

    ``step(state, item)`` returns the next state and the value to keep. Values
    are gathered in chunks: adding to one long array would copy it every time.
    """
    empty = F.array().cast(f"array<{element}>")
    none_done = F.array().cast(f"array<array<{element}>>")

    def merge(acc, item):
        state, value = step(acc["state"], item)
        full = F.size(acc["open"]) >= _CHUNK
        grown = F.when(full, F.array(value)).otherwise(F.concat(acc["open"], F.array(value)))
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        kept = value.isNotNull()
        return F.struct(
            state.alias("state"),
            F.when(kept, grown).otherwise(acc["open"]).alias("open"),
            F.when(kept, done).otherwise(acc["done"]).alias("done"),
        )

    seed = F.struct(start.alias("state"), empty.alias("open"), none_done.alias("done"))
    return F.aggregate(
        items,
        seed,
        merge,
        lambda acc: F.concat(F.flatten(acc["done"]), acc["open"]),
    )


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end")).cast(SPAN)


def starts_of(sizes: Column) -> Column:
    """Sum of all sizes before each: within blocks, and over blocks, so that the work stays near the length."""

    def before(values, count):
        return F.aggregate(F.slice(values, F.lit(1), count), F.lit(0), lambda total, size: total + size)

    def numbers(values):
        return F.sequence(F.lit(0), F.size(values) - 1)

    def of_blocks(blocks):
        sums = F.transform(blocks, lambda block: before(block, F.size(block)))
        bases = let(sums, lambda s: F.transform(numbers(s), lambda n: before(s, n)))
        inner = F.zip_with(
            blocks, bases, lambda block, base: F.transform(numbers(block), lambda n: base + before(block, n))
        )
        return F.flatten(inner)

    last = F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda n: F.slice(sizes, n * _BLOCK + 1, F.lit(_BLOCK)))
    return let(blocks, of_blocks)


def spans_of_cuts(cuts: Column) -> Column:
    """Spans of the matches in a text cut by ``cut_at_matches``; empty ones dropped."""

    def of(sizes, starts):
        # Every second piece is a match; a lone piece has none.
        matches = F.filter(F.sequence(F.lit(0), F.size(sizes) - 1), lambda n: (n % 2 == 1) & (F.get(sizes, n) > 0))
        return F.transform(matches, lambda n: _span(F.get(starts, n), F.get(starts, n) + F.get(sizes, n)))

    def one(cuts):
        # Most texts that match do so once; what lies behind the match need not be measured.
        start, size = F.length(F.get(cuts, F.lit(0))), F.length(F.get(cuts, F.lit(1)))
        return let(start, lambda at: F.array(_span(at, at + size)))

    none = F.array().cast(f"array<{SPAN}>")
    lone = (F.size(cuts) == 3) & (F.get(cuts, F.lit(1)) != "")
    sizes = F.transform(cuts, lambda piece: F.length(piece))
    every = let(sizes, lambda s: let(starts_of(s), lambda starts: of(s, starts)))
    return F.when(F.size(cuts) == 1, none).when(lone, one(cuts)).otherwise(every)


def with_pieces(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body(piece)``, where ``piece(start, end)`` is that stretch of the text.

    Finding a place in a text takes a walk from its beginning. A long text is cut into blocks once, so that each walk
    begins at a block.
    """
    short = F.length(text) <= 4 * _PIECE
    blocks = F.when(short, F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{_PIECE}}})"), 1)
    )

    def cut(blocks):
        def piece(start, end):
            block = F.floor(start / _PIECE).cast("int")
            two = F.concat(F.get(blocks, block), F.coalesce(F.get(blocks, block + 1), F.lit("")))
            near = F.substring(two, start - block * _PIECE + 1, end - start)
            whole = F.substring(text, start + 1, end - start)
            return F.when((F.size(blocks) == 0) | (end - start > _PIECE), whole).otherwise(near)

        return body(piece)

    return let(blocks, cut)


def with_utf16(text: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body(units)``, where ``units(offset)`` is the UTF-16 offset of a code-point offset into the text.

    The two are the same unless a character lies above U+FFFF; then the text is cut into blocks whose units are
    added up once.
    """
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{_PIECE}}})"), 1)
    blocks = F.when(holds_pairs(text), cut)

    def counted(blocks, starts):
        def units(offset):
            block = F.floor(F.greatest(offset - 1, F.lit(0)) / _PIECE).cast("int")
            inside = utf16_length(F.left(F.get(blocks, block), offset - block * _PIECE))
            return F.when(starts.isNull(), offset).otherwise(F.get(starts, block) + inside)

        return body(units)

    def numbered(blocks):
        sizes = F.transform(blocks, utf16_length)
        return let(F.when(blocks.isNotNull(), starts_of(sizes)), lambda starts: counted(blocks, starts))

    return let(blocks, numbered)


def find_spans(text: Column, pattern: str, flags: str = "") -> Column:
    """Every non-overlapping, non-empty match of one pattern, left to right."""
    return spans_of_cuts(cut_at_matches(matchable(text), pattern, flags))


def drop_overlaps(spans: Column) -> Column:
    """Earliest first, longest first; keep what starts at or after the last kept end."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back")))
    )

    def step(last_end, item):
        keep = item["start"] >= last_end
        end = -item["back"]
        return F.when(keep, end).otherwise(last_end), F.when(keep, _span(item["start"], end))

    def kept(items):
        following = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
        crossing = F.zip_with(items, following, lambda a, b: F.coalesce(b["start"] < -a["back"], F.lit(False)))
        as_it_is = F.transform(items, lambda item: _span(item["start"], -item["back"]))
        folded = collect_fold(items, F.lit(0), step, SPAN)
        return F.when(F.exists(crossing, lambda crosses: crosses), folded).otherwise(as_it_is)

    return F.when(F.size(spans) == 1, spans).otherwise(let(ordered, kept))
