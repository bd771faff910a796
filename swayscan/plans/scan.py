"""The scan: texts in, moves out, in one narrow stage.

Every step works on array columns of the text's own row. Nothing shuffles, so
a scan takes time in proportion to the text and skew between keys is harmless.

``_raw`` is ``array<struct<ord, least, cited, spans>>``: one entry per rule that
matches, with its place in the pack, its threshold, whether it heeds citations,
and the spans of all its patterns.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayscan.functions.plain import Plain
from swayscan.functions.regex import needs, needs_digit, to_java
from swayscan.functions.spans import (
    SPAN,
    cut_at_matches,
    cut_at_matches_sql,
    drop_overlaps,
    let,
    spans_of_cuts,
    with_pieces,
)
from swayscan.functions.text import MAX_CHARS, Literals, folded, holds_digit, matchable, sql_string
from swayscan.sources.pack import CITATION_REACH, DOMAINS, TIERS, RulePack, bundled_pack, stamp

REJECT_REASON = "reject_reason"


# --- intake -------------------------------------------------------------------


def intake(df: DataFrame, text: str = "text", domain: Column | None = None) -> DataFrame:
    """Add ``reject_reason``: null for rows the scan accepts. Never truncates.

    ``domain`` is the domain of each row, if rows have one; null counts as general.
    """
    reason = F.when(F.col(text).isNull(), "text is null").when(
        (F.octet_length(text) > MAX_CHARS) & (F.length(text) > MAX_CHARS), "text is too long"
    )
    if domain is not None:
        reason = reason.when(~F.coalesce(domain, F.lit("general")).isin(*DOMAINS), "domain is unknown")
    return df.withColumn(REJECT_REASON, reason)


def rejects(df: DataFrame, text: str = "text", domain: Column | None = None) -> DataFrame:
    """The rows that the scan does not accept, each with its reason."""
    return intake(df, text, domain).where(F.col(REJECT_REASON).isNotNull())


# --- matching -----------------------------------------------------------------


def _pack_literals(rules) -> Literals:
    """The literals that the patterns of these rules need."""
    return Literals([needs(pattern, rule["flags"], True) for _, rule in rules for pattern in rule["indicators"]])


def _rule_hits(order: int, rule: dict, literals: Literals, by_row: bool) -> str:
    """SQL for one rule: the text cut at the matches of each of its patterns."""
    parts, firsts = [], []
    for pattern in rule["indicators"]:
        cuts = cut_at_matches_sql("_match", pattern, rule["flags"])
        needed = needs(pattern, rule["flags"], True)
        parts.append(f"CASE WHEN {literals.holds(needed, '_seen', '_match')} THEN {cuts} END")
        firsts.append(needed.words[0] if needed.words else None)
    entry = (
        f"named_struct('ord', {order}, 'least', {rule['min_matches']}, "
        f"'cited', {str(rule['suppress_if_cited']).lower()}, 'parts', array({', '.join(parts)}))"
    )
    tests = []
    if by_row and rule["domain"] != "general":
        tests.append(f"_domain IN ('all', '{rule['domain']}')")
    if len(parts) > 1 and all(firsts):
        # One test for the whole rule spares most texts a test per pattern.
        tests.append(literals.holds_any(firsts, "_seen"))
    return f"CASE WHEN {' AND '.join(tests)} THEN {entry} END" if tests else entry


def raw_spans(
    df: DataFrame,
    pack: RulePack | None = None,
    domain: str | Column | None = None,
    text: str = "text",
    add: str = "_raw",
    then: Callable[[Column], Column] = lambda raw: raw,
) -> DataFrame:
    """Add ``_raw``: per rule, every match of every pattern; and ``reject_reason``.

    Rows that the scan does not accept stay, with the reason and a null result.

    ``then`` turns the raw spans into another column, added as ``add``; in one
    step, because Spark analyses the whole pack again for every step.
    """
    pack = pack or bundled_pack()
    rules = pack.select("all" if isinstance(domain, Column) else domain)
    return _raw_spans(df, rules, domain, text, add, then)


def _raw_spans(
    df: DataFrame,
    rules: list[tuple[int, dict]],
    domain: str | Column | None,
    text: str,
    add: str,
    then: Callable[[Column], Column],
) -> DataFrame:
    """``raw_spans`` of numbered rules."""
    by_row = isinstance(domain, Column)
    literals = _pack_literals(rules)
    checked = intake(df, text, domain if by_row else None)
    readable = F.when(F.col(REJECT_REASON).isNull(), F.col(text))
    prepared = checked.withColumns({"_match": matchable(readable), "_seen": literals.seen(readable)})
    if by_row:
        prepared = prepared.withColumn("_domain", F.coalesce(domain, F.lit("general")))
    hits = F.expr(f"array({', '.join(_rule_hits(n, r, literals, by_row) for n, r in rules)})")
    # One match cuts a text into three pieces or more.
    hit = F.filter(
        hits, lambda h: F.exists(h["parts"], lambda p: F.coalesce(F.size(p) > 1, F.lit(False)))
    )

    def entry(h):
        cuts = F.filter(h["parts"], lambda p: F.size(p) > 1)
        spans = F.flatten(F.transform(cuts, spans_of_cuts))
        return F.struct(h["ord"], h["least"], h["cited"], spans.alias("spans"))

    kept = [c for c in df.columns if c not in ("_raw", "_match", add, REJECT_REASON)]
    found = F.when(F.col(REJECT_REASON).isNull(), then(F.transform(hit, entry)))
    return prepared.select(*kept, REJECT_REASON, "_match", found.alias(add))


def prefilter_report(
    df: DataFrame, pack: RulePack | None = None, domain: str | None = None, text: str = "text"
) -> DataFrame:
    """Per rule: texts its patterns are run on, texts they match, and matching texts that the filter would hide.

    Matching is tested on every accepted text, whatever the filter says. A pattern is left out only where the text lacks
    all of its plain letters, which the filter knows nothing of.
    """
    pack = pack or bundled_pack()
    rules = pack.select(domain)
    literals = _pack_literals(rules)
    plain = Plain([pattern for _, rule in rules for pattern in rule["indicators"]])
    accepted = intake(df, text).where(F.col(REJECT_REASON).isNull())
    prepared = accepted.select(
        matchable(F.col(text)).alias("_match"), literals.seen(F.col(text)).alias("_seen"), plain.seen(folded(F.col(text))).alias("_plain")
    )
    facts = []
    for _, rule in rules:
        tests = [literals.holds(needs(p, rule["flags"], True), "_seen", "_match") for p in rule["indicators"]]
        may = [plain.may_match(p, "_plain") for p in rule["indicators"]]
        patterns = [to_java(p, rule["flags"]) for p in rule["indicators"]]
        each = [f"rlike(_match, {sql_string(p)})" for p in patterns]
        hits = [f"{m} AND {hit}" for m, hit in zip(may, each)]
        if len(patterns) > 1:
            # Where all patterns may match, one walk for all of them comes first.
            any_hit = f"rlike(_match, {sql_string('|'.join(f'(?:{p})' for p in patterns))})"
            whole = f"CASE WHEN {' AND '.join(may)} THEN {any_hit} ELSE true END"
            found = f"transform(array({whole}), some -> array({', '.join(f'some AND {hit}' for hit in hits)}))[0]"
        else:
            found = f"array({hits[0]})"
        # By the place of a pattern: does it match, and does the filter let it run?
        facts.append(
            f"transform(array({found}), hit -> named_struct('rule_id', {sql_string(rule['id'])}, "
            f"'run', {' OR '.join(f'({t})' for t in tests)}, 'hit', exists(hit, x -> x), "
            f"'hidden', {' OR '.join(f'(hit[{n}] AND NOT ({t}))' for n, t in enumerate(tests))}))[0]"
        )
    rows = prepared.select(F.explode_outer(F.expr(f"array({', '.join(facts)})")).alias("r")).select("r.*")
    return rows.groupBy("rule_id").agg(
        F.count_if("run").alias("tested"), F.count_if("hit").alias("matched"), F.count_if("hidden").alias("hidden")
    )


def at_least(raw: Column) -> Column:
    """Keep a rule only if it has at least ``min_matches`` raw spans in the text."""
    return F.filter(raw, lambda r: F.size(r["spans"]) >= r["least"])


def apply_min_matches(df: DataFrame) -> DataFrame:
    """``at_least`` on the ``_raw`` column."""
    return df.withColumn("_raw", at_least(F.col("_raw")))


# --- citations ----------------------------------------------------------------


def _may_be_cited(text: Column, lowered: Column, pack: RulePack) -> list[Column]:
    """Per citation pattern: does a text hold the literals of a match? ``lowered`` is the folded text."""
    out = []
    for pattern in pack.citations["patterns"]:
        needed = needs(pattern, pack.citations["flags"])
        places = [(lowered, literals) for literals in needed.words] + [(text, literals) for literals in needed.marks]
        held = [reduce(or_, (F.contains(place, F.lit(x)) for x in literals)) for place, literals in places]
        out.append(reduce(and_, held, F.lit(True)))
    return out


def citation_spans(text: Column, pack: RulePack, held: list[Column] | None = None) -> Column:
    """Spans of every citation pattern in a ``matchable`` text, pattern by pattern.

    ``held`` says of each pattern if it may match; a text of which the given one is a part may have been asked.
    """
    if held is None:
        return let(folded(text), lambda lowered: citation_spans(text, pack, _may_be_cited(text, lowered, pack)))
    flags = pack.citations["flags"]

    def cut(pattern: str, may: Column, digits: Column) -> Column:
        """The whole text in one piece if it lacks what a match must hold."""
        may = digits & may if needs_digit(pattern, flags) else may
        return F.when(may, cut_at_matches(text, pattern, flags)).otherwise(F.array(text))

    cuts = let(
        holds_digit(text), lambda digits: F.array(*(cut(p, may, digits) for p, may in zip(pack.citations["patterns"], held)))
    )
    return F.flatten(F.transform(cuts, spans_of_cuts))


def is_cited(
    text: Column, match_text: Column, lowered: Column, wording: Column, pack: RulePack, held: list[Column] | None = None
) -> Column:
    """Does a citation touch the window around a wording, ``struct<words, size>``?

    The window lies around the first place where the wording occurs in the
    lowercased text, which may be before the span itself. The search reads a
    little further, so that a long citation is seen whole.
    """
    window = pack.citations["window"]

    def around(first):
        at = first - 1
        low = F.greatest(F.lit(0), at - window)
        high = F.least(F.length(text), at + wording["size"] + window)
        base = F.greatest(F.lit(0), low - CITATION_REACH)
        nearby = F.substring(match_text, base + 1, high + CITATION_REACH - base)
        return F.struct((low - base).alias("low"), (high - base).alias("high"), nearby.alias("text"))

    def touched(place):
        return F.exists(
            citation_spans(place["text"], pack, held),
            lambda c: (c["start"] < place["high"]) & (c["end"] > place["low"]),
        )

    return let(F.instr(lowered, wording["words"]), lambda first: (first > 0) & let(around(first), touched))


def cited_marks(raw: Column, pack: RulePack, text: str = "text") -> Column:
    """Add ``quiet`` to each entry: the rule heeds citations and all its spans are cited.

    The verdict depends on a span's wording alone, so each wording of a rule is looked up once. Texts that no such rule
    marks are left alone, and what literals of citations a text holds is asked once.
    """
    body, match_text = F.col(text), F.col("_match")

    def with_verdict(r, quiet):
        return F.struct(r["ord"], r["least"], r["cited"], r["spans"], quiet.alias("quiet"))

    def marked(raw: Column, known: Column, piece: Callable[[Column, Column], Column]) -> Column:
        held = [F.get(known["held"], F.lit(n)) for n in range(len(pack.citations["patterns"]))]

        def entry(r):
            wordings = F.array_distinct(
                F.transform(
                    r["spans"],
                    lambda s: F.struct(
                        F.lower(piece(s["start"], s["end"])).alias("words"), (s["end"] - s["start"]).alias("size")
                    ),
                )
            )
            uncited = F.exists(wordings, lambda w: ~is_cited(body, match_text, known["lowered"], w, pack, held))
            return with_verdict(r, F.when(r["cited"], ~uncited).otherwise(False))

        return F.transform(raw, entry)

    def looked_up(raw: Column) -> Column:
        def facts(lowered):
            held = let(folded(match_text, lowered), lambda low: F.array(*_may_be_cited(match_text, low, pack)))
            return F.struct(lowered.alias("lowered"), held.alias("held"))

        known = let(F.lower(body), facts)
        return let(known, lambda known: with_pieces(body, lambda piece: marked(raw, known, piece)))

    def verdicts(raw: Column) -> Column:
        unmarked = F.transform(raw, lambda r: with_verdict(r, F.lit(False)))
        return F.when(F.exists(raw, lambda r: r["cited"]), looked_up(raw)).otherwise(unmarked)

    return let(raw, verdicts)


def uncited(raw: Column, pack: RulePack, text: str = "text") -> Column:
    """Drop a citation-sensitive rule from a text where all its spans are cited."""
    if not any(r["suppress_if_cited"] for r in pack.rules):
        return raw
    return F.filter(cited_marks(raw, pack, text), lambda r: ~r["quiet"])


def mark_cited(df: DataFrame, pack: RulePack | None = None, text: str = "text") -> DataFrame:
    """``cited_marks`` on the ``_raw`` column."""
    return df.withColumn("_raw", cited_marks(F.col("_raw"), pack or bundled_pack(), text))


def suppress_cited(df: DataFrame, pack: RulePack | None = None, text: str = "text") -> DataFrame:
    """``uncited`` on the ``_raw`` column."""
    return df.withColumn("_raw", uncited(F.col("_raw"), pack or bundled_pack(), text))


# --- moves --------------------------------------------------------------------


def without_overlaps(raw: Column) -> Column:
    """Remove overlaps inside each rule; rules never affect each other."""
    return F.transform(
        raw, lambda r: F.struct(r["ord"].alias("ord"), drop_overlaps(r["spans"]).alias("spans"))
    )


def keep_spans(df: DataFrame) -> DataFrame:
    """``without_overlaps`` on the ``_raw`` column."""
    return df.withColumn("_raw", without_overlaps(F.col("_raw")))


def _rule_facts(pack: RulePack) -> Column:
    """Id, name, tier, domain and severity of each rule, by pack order."""
    rows = (
        f"named_struct('rule_id', {sql_string(r['id'])}, 'name', {sql_string(r['name'])}, "
        f"'tier', {r['pit_tier']}, 'domain', {sql_string(r['domain'])}, "
        f"'severity', {sql_string(r['severity'])})"
        for r in pack.rules
    )
    return F.expr(f"array({', '.join(rows)})")


def ordered_moves(raw: Column, pack: RulePack, text: Column) -> Column:
    """Moves by start, longest first, then pack order."""
    keys = F.array_sort(
        F.flatten(
            F.transform(
                raw,
                lambda r: F.transform(
                    r["spans"],
                    lambda s: F.struct(
                        s["start"].alias("start"), (-s["end"]).alias("back"), r["ord"].alias("ord")
                    ),
                ),
            )
        )
    )
    facts = _rule_facts(pack)

    def move(k, piece):
        rule = F.get(facts, k["ord"])
        end = -k["back"]
        return F.struct(
            *(rule[f].alias(f) for f in ("rule_id", "name", "tier", "domain", "severity")),
            k["start"].alias("start"),
            end.alias("end"),
            piece(k["start"], end).alias("match"),
        )

    return with_pieces(text, lambda piece: F.transform(keys, lambda k: move(k, piece)))


def tier_counts(moves: Column) -> Column:
    """Moves per tier, zeros included."""
    def in_tier(tier: int) -> Column:
        return F.size(F.filter(moves, lambda m: m["tier"] == tier)).cast("bigint")

    return F.struct(*(in_tier(t).alias(f"tier_{t}") for t in TIERS))


def with_moves(
    df: DataFrame,
    pack: RulePack | None = None,
    domain: str | Column | None = None,
    text: str = "text",
) -> DataFrame:
    """Add ``moves``, the ordered moves of each text, and ``reject_reason``; moves are null where that is set."""
    pack = pack or bundled_pack()

    def finish(raw: Column) -> Column:
        kept = without_overlaps(uncited(at_least(raw), pack, text))
        return ordered_moves(kept, pack, F.col(text))

    return raw_spans(df, pack, domain, text, add="moves", then=finish).drop("_match")


def with_moves_of_both(
    df: DataFrame, before: RulePack, after: RulePack, domain: str | None = None, text: str = "text"
) -> DataFrame:
    """Add ``moves_before`` and ``moves_after``, the moves by either pack, and ``reject_reason``.

    Rules with the same patterns are matched, and looked up for citations, once for both packs.
    """
    packs = {"moves_before": before, "moves_after": after}
    if before.citations != after.citations:
        for column, pack in packs.items():
            df = with_moves(df, pack, domain, text).withColumnRenamed("moves", column)
        return df
    shared: dict[str, dict] = {}  # a rule that both packs match alike, with the lower threshold
    places: dict[str, dict[str, tuple]] = {column: {} for column in packs}
    for column, pack in packs.items():
        for n, rule in pack.select(domain):
            key = json.dumps([rule["id"], rule["domain"], rule["flags"], rule["indicators"]])
            least, cited = rule["min_matches"], rule["suppress_if_cited"]
            places[column][key] = (n, least, cited)
            known = shared.get(key, rule)
            shared[key] = known | {
                "min_matches": min(least, known["min_matches"]), "suppress_if_cited": cited or known["suppress_if_cited"],
            }

    def own(marked: Column, column: str) -> Column:
        """The raw spans of one pack, with its own order and thresholds."""
        rows = (
            "named_struct('ord', {}, 'least', {}, 'cited', {})".format(*map(str, places[column][key])).lower()
            if key in places[column] else "cast(null as struct<ord:int,least:int,cited:boolean>)"
            for key in shared
        )
        listed = F.expr(f"array({', '.join(rows)})")

        def counts(r):
            place = F.get(listed, r["ord"])
            return place.isNotNull() & (F.size(r["spans"]) >= place["least"]) & ~(place["cited"] & r["quiet"])

        kept = F.filter(marked, lambda r: F.coalesce(counts(r), F.lit(False)))
        numbered = F.transform(kept, lambda r: F.struct(F.get(listed, r["ord"])["ord"].alias("ord"), r["spans"].alias("spans")))
        return ordered_moves(without_overlaps(numbered), packs[column], F.col(text))

    def finish(raw: Column) -> Column:
        marked = cited_marks(at_least(raw), after, text)
        return let(marked, lambda m: F.struct(*(own(m, column).alias(column) for column in packs)))

    found = _raw_spans(df, list(enumerate(shared.values())), domain, text, "_both", finish)
    kept = [c for c in df.columns if c not in packs]
    return found.select(*kept, REJECT_REASON, *(F.col(f"_both.{column}") for column in packs))


def scan(
    df: DataFrame,
    pack: RulePack | None = None,
    domain: str | Column | None = None,
    text: str = "text",
) -> DataFrame:
    """The nested result: version, fingerprint, moves and counts per text, or the reason why it was not scanned."""
    pack = pack or bundled_pack()
    found = with_moves(df, pack, domain, text)
    return stamp(found.withColumn("counts", tier_counts(F.col("moves"))), pack)


def moves(
    df: DataFrame,
    keys: list[str],
    pack: RulePack | None = None,
    domain: str | Column | None = None,
    text: str = "text",
) -> DataFrame:
    """One row per move, with ``move_no`` from 1. Texts without moves have none."""
    return move_rows(with_moves(df, pack, domain, text), keys)


def move_rows(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """The ``moves`` column of scanned texts as one row per move.

    The outer form of explode: for the inner one Spark adds a filter on the
    array's size, and would work the whole scan out twice to test it.
    """
    rows = scanned.select(*keys, F.posexplode_outer("moves").alias("at", "move"))
    return rows.where(F.col("at").isNotNull()).select(
        *keys, (F.col("at") + 1).alias("move_no"), "move.*"
    )


def rule_ids(moves: Column) -> Column:
    """Sorted distinct rule ids of a moves column."""
    return F.array_sort(F.array_distinct(F.transform(moves, lambda m: m["rule_id"])))


def raw_rows(df: DataFrame, keys: list[str], pack: RulePack, *extra: str) -> DataFrame:
    """``_raw`` as one row per span, for reports on a single step."""
    ids = F.expr(f"array({', '.join(sql_string(r['id']) for r in pack.rules)})")
    per_rule = df.select(*keys, F.explode_outer("_raw").alias("r")).where(F.col("r").isNotNull())
    return per_rule.select(
        *keys,
        F.get(ids, F.col("r.ord")).alias("rule_id"),
        *(F.col(f"r.{name}").alias(name) for name in extra),
        F.inline_outer(F.col("r.spans").cast(f"array<{SPAN}>")),
    )
