"""Comparison jobs: swapped pairs, expected moves, two packs, two engines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayscan.functions.plain import plain_letters
from swayscan.functions.regex import SPACE
from swayscan.functions.spans import drop_overlaps, let
from swayscan.operators.corpus import quoted_examples
from swayscan.plans import scan as plan
from swayscan.sources.pack import DOMAINS, RulePack

# --- swapped pairs ------------------------------------------------------------


def fill_template(template: Column, name: Column) -> Column:
    """Fill ``{X}`` (capitalized), ``{x}`` (as is) and ``{b}`` (without "the ")."""
    capitalized = F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 2**30))
    bare = F.when(name.startswith("the "), F.substring(name, 5, 2**30)).otherwise(name)
    filled = F.replace(template, F.lit("{X}"), capitalized)
    return F.replace(F.replace(filled, F.lit("{x}"), name), F.lit("{b}"), bare)


def make_pairs(swaps: DataFrame, templates: list[str], org_templates: list[str], keys: list[str]) -> DataFrame:
    """Both sides of every template for every swap ``(keys, is_org, a, b)``.

    Templates are a short fixed list, so each row is expanded where it lies.
    """
    listed = F.array(*(F.struct(F.lit(n).alias("template_no"), F.lit(t).alias("template"))
                       for n, t in enumerate(templates + org_templates)))
    usable = F.filter(listed, lambda t: F.col("is_org") | (t["template_no"] < len(templates)))
    rows = swaps.withColumn("t", F.explode(usable)).select("*", "t.*")
    return rows.select(
        *keys, "template_no",
        fill_template(F.col("template"), F.col("a")).alias("text_a"),
        fill_template(F.col("template"), F.col("b")).alias("text_b"),
    )


def scanned_texts(rows: DataFrame, columns: list[str], pack: RulePack, domain: str = "all") -> DataFrame:
    """Every different text of some columns, scanned once: ``(digest, rule_ids, reject_reason)``; nulls are left out.

    Equal texts meet before the scan, and few texts are still spread over many tasks: scanning takes far longer than
    moving them.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    listed = rows.select(F.explode_outer(F.array_distinct(F.array(*columns))).alias("text")).where("text is not null")
    texts = listed.distinct().repartition(tasks, "text")
    scanned = plan.with_moves(texts, pack, domain)
    return scanned.select(text_digest("text").alias("digest"), plan.rule_ids(F.col("moves")).alias("rule_ids"), plan.REJECT_REASON)


def text_digest(text: str) -> Column:
    """What stands for a text in joins."""
    return F.unhex(F.sha2(text, 256))


def scan_sides(pairs: DataFrame, keys: list[str], pack: RulePack, domain: str = "all") -> DataFrame:
    """Add ``ids_a`` and ``ids_b``, the sets of rules each side raises; null for a side that was not scanned.

    Texts of pairs repeat, so a dictionary of the different ones is scanned once and joined to both sides; the second
    join reuses the first one's exchange.
    """
    found = scanned_texts(pairs, ["text_a", "text_b"], pack, domain)
    rows = pairs.select(*keys, *(text_digest(f"text_{side}").alias(f"digest_{side}") for side in "ab"))
    for side in "ab":
        named = found.select(
            F.col("digest").alias(f"digest_{side}"), F.col("rule_ids").alias(f"ids_{side}"), F.col(plan.REJECT_REASON).alias(f"reject_{side}")
        )
        rows = rows.join(named, f"digest_{side}", "left")
    reasons = (F.when(F.col(f"digest_{side}").isNull(), "text is null").otherwise(F.col(f"reject_{side}")) for side in "ab")
    return rows.select(*keys, "ids_a", "ids_b", F.coalesce(*reasons).alias(plan.REJECT_REASON))


NOT_SCANNED = "not scanned"


def _unless_rejected(verdict: Column) -> Column:
    """``verdict``, or that a text was not scanned; a rejected case must not pass unseen."""
    return F.when(F.col(plan.REJECT_REASON).isNotNull(), NOT_SCANNED).otherwise(verdict)


def symmetry_check(sides: DataFrame, must_raise: Column | bool = True) -> DataFrame:
    """Verdict per pair: the same set of rules on both sides, and not none."""
    only_a = F.array_except("ids_a", "ids_b")
    only_b = F.array_except("ids_b", "ids_a")
    must = F.lit(must_raise) if isinstance(must_raise, bool) else must_raise
    verdict = (
        F.when((F.size(only_a) > 0) | (F.size(only_b) > 0), "differs")
        .when(must & (F.size("ids_a") == 0), "raises nothing")
        .otherwise("same")
    )
    return sides.withColumns({"only_a": only_a, "only_b": only_b, "verdict": _unless_rejected(verdict)})


def known_limits_check(sides: DataFrame) -> DataFrame:
    """Pairs that are known to differ: one that no longer does is unexpected."""
    same = F.sort_array("ids_a") == F.sort_array("ids_b")
    verdict = F.when(same, "unexpected pass").otherwise("known limit")
    return sides.withColumn("verdict", _unless_rejected(verdict))


def pair_registry_audit(registry: DataFrame, reasons: DataFrame) -> DataFrame:
    """Problems in a table of pairs ``(a, b, status, reason)``.

    A limit or retired pair needs a listed reason, every reason is used, no
    pair is listed twice and none has two statuses.
    """
    with_reason = registry.where(F.col("status") != "running")
    unknown = with_reason.join(reasons.withColumnRenamed("reason_status", "status"), ["status", "reason"], "left_anti")
    unused = reasons.withColumnRenamed("reason_status", "status").join(
        with_reason, ["status", "reason"], "left_anti"
    )
    per_status = registry.groupBy("a", "b", "status").agg(F.count("*").alias("n"))
    per_pair = per_status.groupBy("a", "b").agg(
        F.max("n").alias("most"), F.count("*").alias("statuses")
    )
    pair = F.concat_ws(" / ", "a", "b")
    return (
        unknown.select(F.lit("no such reason").alias("problem"), pair.alias("item"))
        .unionByName(unused.select(F.lit("unused reason").alias("problem"), F.col("reason").alias("item")))
        .unionByName(per_pair.where("most > 1").select(F.lit("listed twice").alias("problem"), pair.alias("item")))
        .unionByName(per_pair.where("statuses > 1").select(F.lit("two statuses").alias("problem"), pair.alias("item")))
    )


def rule_coverage(rules: DataFrame, raised: DataFrame) -> DataFrame:
    """Rules of the pack that no row raised."""
    return rules.select("rule_id").join(raised.select("rule_id").distinct(), "rule_id", "left_anti")


# --- expected moves -----------------------------------------------------------


def golden_check(expected: DataFrame, actual: DataFrame, src: str, text: str = "match") -> DataFrame:
    """Expected and actual moves side by side: ok, missing, extra, or at the same place with another text."""
    key = [src, "rule_id", "start", "end"]
    sides = expected.select(*key, F.lit(1).alias("n"), F.col(text).alias("want"), F.lit(None).cast("string").alias("got"))
    sides = sides.unionByName(
        actual.select(*key, F.lit(-1).alias("n"), F.lit(None).cast("string").alias("want"), F.col(text).alias("got"))
    )
    return _golden_status(sides, key)


def golden_check_of_both(scanned: DataFrame, src: str) -> DataFrame:
    """``golden_check`` of texts that carry ``moves_before``, the expected moves, and ``moves_after``.

    Both lie in the text's own row, so that the texts are scanned once.
    """
    def side(column: str, n: int) -> Column:
        def entry(m):
            none = F.lit(None).cast("string")
            texts = (m["match"], none) if n > 0 else (none, m["match"])
            return F.struct(m["rule_id"], m["start"], m["end"], F.lit(n).alias("n"), texts[0].alias("want"), texts[1].alias("got"))

        return F.transform(column, entry)

    each = F.concat(side("moves_before", 1), side("moves_after", -1))
    rows = scanned.select(src, F.explode_outer(each).alias("m")).where("m is not null").select(src, "m.*")
    return _golden_status(rows, [src, "rule_id", "start", "end"])


def _golden_status(sides: DataFrame, key: list[str]) -> DataFrame:
    totals = sides.groupBy(*key).agg(F.sum("n").alias("n"), F.max("want").alias("want"), F.max("got").alias("got"))
    status = (
        F.when(F.col("n") > 0, "missing").when(F.col("n") < 0, "extra")
        .when(F.col("want") != F.col("got"), "other text").otherwise("ok")
    )
    return totals.select(*key, status.alias("status"))


def golden_from_spans(stored: DataFrame, src: str, pack: RulePack) -> DataFrame:
    """Ordered moves re-derived from stored raw spans.

    ``stored`` has ``spans map<rule_id, array<struct<start,end>>>`` per source.
    """
    order = F.create_map(*(F.lit(v) for n, r in enumerate(pack.rules) for v in (r["id"], n)))
    kept = F.transform(
        F.map_entries("spans"),
        lambda e: F.transform(
            drop_overlaps(e["value"]),
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("back"),
                F.element_at(order, e["key"]).alias("ord"), e["key"].alias("rule_id"),
            ),
        ),
    )
    rows = stored.select(src, F.posexplode_outer(F.array_sort(F.flatten(kept))).alias("at", "m"))
    return rows.where(F.col("at").isNotNull()).select(
        src, (F.col("at") + 1).alias("move_no"), F.col("m.rule_id").alias("rule_id"),
        F.col("m.start").alias("start"), (-F.col("m.back")).alias("end"),
    )


# --- two packs ----------------------------------------------------------------


def _spans_by_rule(moves: Column) -> Column:
    ids = F.array_distinct(F.transform(moves, lambda m: m["rule_id"]))
    return F.map_from_entries(
        F.transform(
            ids,
            lambda rule: F.struct(
                rule,
                F.transform(
                    F.filter(moves, lambda m: m["rule_id"] == rule),
                    lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")),
                ),
            ),
        )
    )


def pack_changes(df: DataFrame, keys: list[str], before: RulePack, after: RulePack,
                 domain: str = "all", text: str = "text") -> DataFrame:
    """One row per text and rule that either pack raises, with what changed.

    Both packs are run on the row itself, so nothing has to be joined.
    """
    both = plan.with_moves_of_both(df, before, after, domain, text)
    # Cut once per text, before its rules become rows, which then carry the snippet and not the text.
    raised = F.size("moves_before") + F.size("moves_after") > 0
    snippet = F.when(raised, F.left(F.regexp_replace(text, f"[{SPACE}]+", " "), F.lit(110)))
    mapped = both.select(
        *keys, snippet.alias("snippet"),
        _spans_by_rule(F.col("moves_before")).alias("before"),
        _spans_by_rule(F.col("moves_after")).alias("after"),
    )
    rules = F.array_union(F.map_keys("before"), F.map_keys("after"))
    rows = mapped.withColumn("rule_id", F.explode_outer(rules)).where(F.col("rule_id").isNotNull())
    old, new = F.try_element_at("before", "rule_id"), F.try_element_at("after", "rule_id")
    change = (
        F.when(old.isNull(), "gained").when(new.isNull(), "lost").when(old != new, "other spans").otherwise("same")
    )
    return rows.select(*keys, "rule_id", change.alias("change"), "snippet")


def pack_diff(changes: DataFrame) -> DataFrame:
    """Per rule: texts before and after, gained, lost, same text with other spans."""

    def texts(*kinds):
        return F.count_if(F.col("change").isin(*kinds))

    return changes.groupBy("rule_id").agg(
        texts("lost", "same", "other spans").alias("texts_before"),
        texts("gained", "same", "other spans").alias("texts_after"),
        texts("gained").alias("gained"),
        texts("lost").alias("lost"),
        texts("other spans").alias("other_spans"),
    )


# --- domains and engines ------------------------------------------------------


def domain_independence(df: DataFrame, keys: list[str], pack: RulePack, text: str = "text") -> DataFrame:
    """Is the scan of every domain the scan of all rules, filtered by rule domain? Five rows ``(keys, domain, n_moves, same)`` per text.

    The patterns run once, and each rule's citations are looked up once. Each rule carries a bit for every domain that
    uses it; by these bits the raw spans go through overlaps and order once per domain. A rejected text has nulls.
    """
    bits = {d: {n for n, _ in pack.select(d)} for d in DOMAINS}
    masks = F.array(*(F.lit(sum(1 << k for k, d in enumerate(DOMAINS) if n in bits[d])) for n in range(len(pack.rules))))

    def finished(passed: Column) -> Column:
        return plan.ordered_moves(plan.without_overlaps(passed), pack, F.col(text))

    each = F.array(*(F.struct(F.lit(1 << k).alias("bit"), F.lit(d).alias("domain")) for k, d in enumerate(DOMAINS)))

    def verdict(passed: Column, moves: Column, of: Column) -> Column:
        used = F.filter(passed, lambda r: F.get(masks, r["ord"]).bitwiseAND(of["bit"]) != 0)
        filtered = F.filter(moves, lambda m: (of["domain"] == "all") | (m["domain"] == "general") | (m["domain"] == of["domain"]))
        return let(
            finished(used), lambda own: F.struct(of["domain"].alias("domain"), F.size(own).alias("n_moves"), (own == filtered).alias("same"))
        )

    # In the text's own row: the texts are not repeated for each domain.
    passed = plan.raw_spans(df, pack, "all", text, "_passed", lambda raw: plan.uncited(plan.at_least(raw), pack, text))
    moves = passed.withColumn("_moves", finished(F.col("_passed")))
    verdicts = F.transform(each, lambda of: verdict(F.col("_passed"), F.col("_moves"), of))
    return moves.select(*keys, F.explode_outer(verdicts).alias("d")).select(*keys, "d.*")


RAW_HITS = "array<struct<ord:int,spans:array<struct<start:int,end:int>>,cited:boolean>>"


def arrow_raw(text: Column, pack: RulePack, domain: str | Column | None = "all") -> Column:
    """Raw spans and citation verdicts by Python's ``re``, in Arrow batches.

    ``domain`` is that of all texts or a column; null counts as general.
    A second way to match, for checking the first. Everything after matching
    is the same columns as in the scan. Patterns are left out by ``plain_letters``,
    which has nothing in common with the literals of the scan.
    """
    import re

    from swayscan.functions.regex import flag_bits
    from swayscan.sources.pack import CITATION_REACH

    rules = [
        (n, r["min_matches"], r["suppress_if_cited"],
         [(re.compile(p, flag_bits(r["flags"])), plain_letters(p)) for p in r["indicators"]], r["domain"])
        for n, r in pack.select("all" if isinstance(domain, Column) else domain)
    ]
    given = domain if isinstance(domain, Column) else F.lit("all")
    window = pack.citations["window"]
    cites = [(re.compile(p, flag_bits(pack.citations["flags"])), plain_letters(p)) for p in pack.citations["patterns"]]
    # The characters that ignore-case matching reads as ASCII.
    odd = str.maketrans("ſ\u212aıİ", "skii")

    def plain(text):
        return text.translate(odd).lower()

    def found(patterns, text, lowered):
        usable = (p for p, parts in patterns if not parts or any(part in lowered for part in parts))
        every = (m for p in usable for m in p.finditer(text))
        return [m.span() for m in every if m.group()]

    def quiet(text, spans):
        """Has each wording a citation beside its first place?"""
        lowered, places = text.lower(), {}
        for start, end in spans:
            places.setdefault((text[start:end].lower(), end - start))
        for wording, size in places:
            at = lowered.find(wording)
            reach = range(max(at - window, 0), min(at + size + window, len(text)))
            shift = max(reach.start - CITATION_REACH, 0)
            nearby = text[shift : reach.stop + CITATION_REACH]
            beside = found(cites, nearby, plain(nearby)) if at >= 0 else ()
            if not any(shift + start < reach.stop and shift + end > reach.start for start, end in beside):
                return False
        return True

    def hits(text, wanted):
        lowered = plain(text)
        for order, least, quiets, patterns, area in rules:
            if area != "general" and wanted not in ("all", area):
                continue
            spans = found(patterns, text, lowered)
            if spans and len(spans) >= least:
                cited = quiets and quiet(text, spans)
                yield {"ord": order, "spans": [{"start": s, "end": e} for s, e in spans], "cited": cited}

    @F.pandas_udf(RAW_HITS)
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, domains in batches:
            yield pd.Series([[] if t is None else list(hits(t, d)) for t, d in zip(texts, domains)])

    return match(text, given)


def engine_parity(
    df: DataFrame, keys: list[str], pack: RulePack, domain: str | Column | None = "all"
) -> DataFrame:
    """Per text: moves by either engine, and whether they are identical; neither scans a rejected text."""
    native = plan.with_moves(df, pack, domain).withColumnRenamed("moves", "moves_native")
    scanned = F.col(plan.REJECT_REASON).isNull()
    raw = native.withColumn("_raw", arrow_raw(F.when(scanned, F.col("text")), pack, domain))
    passed = raw.withColumn("_raw", F.filter("_raw", lambda r: ~r["cited"]))
    kept = plan.without_overlaps(F.col("_raw"))
    other = passed.withColumn("moves_arrow", F.when(scanned, plan.ordered_moves(kept, pack, F.col("text"))))
    return other.select(
        *keys,
        F.size("moves_native").alias("n_native"),
        F.size("moves_arrow").alias("n_arrow"),
        F.col("moves_native").eqNullSafe(F.col("moves_arrow")).alias("same"),
    )


# --- examples and expectations ------------------------------------------------


def expected_rules_check(df: DataFrame, keys: list[str], pack: RulePack, want: str, domain: str = "all") -> DataFrame:
    """Does each text raise exactly this multiset of rules?"""
    scanned = plan.with_moves(df, pack, domain)
    got = F.array_sort(F.transform("moves", lambda m: m["rule_id"]))
    verdict = F.when(got == F.array_sort(want), "as expected").otherwise("differs")
    tiers = F.array_sort(F.array_distinct(F.transform("moves", lambda m: m["tier"])))
    return scanned.select(
        *keys, _unless_rejected(verdict).alias("verdict"), F.size("moves").alias("n_moves"), tiers.alias("tiers")
    )


def polarity_check(df: DataFrame, keys: list[str], pack: RulePack, domain: str = "all") -> DataFrame:
    """Cases ``(rule_id, polarity, text)``: positive ones raise the rule, others do not."""
    scanned = plan.with_moves(df, pack, domain)
    raised = F.exists("moves", lambda m: m["rule_id"] == F.col("rule_id"))
    verdict = F.when(raised == F.col("polarity"), "holds").otherwise("fails")
    return scanned.select(
        *keys, "rule_id", "polarity", raised.alias("raised"), _unless_rejected(verdict).alias("verdict")
    )


def guide_check(entries: DataFrame, key: str, pack: RulePack, rules: DataFrame) -> DataFrame:
    """Problems in guide entries, one row each.

    An entry is ``(key, id, pit_tier, domain, example, flagged_span, honest,
    fair_use, fair_use_flagged)``. Its example raises its own rule on the
    flagged span and no other rule of its domain; the honest version raises
    none; fair use is marked as stated. A text that is not scanned and a domain
    that does not exist are problems too. ``rules`` is the pack's rule table.
    """
    parts = F.array(
        *(F.struct(F.lit(kind).alias("kind"), F.col(column).alias("text"))
          for kind, column in (("example", "example"), ("honest", "honest"), ("fair use", "fair_use")))
    )
    known = rules.select(
        F.col("rule_id").alias("id"), F.col("pit_tier").alias("pack_tier"), F.col("domain").alias("pack_domain")
    )
    texts = entries.join(known, "id", "left").withColumn("part", F.explode(parts)).select("*", "part.*")
    scanned = plan.with_moves(texts.drop("part", "example", "honest", "fair_use"), pack, F.col("domain"))
    own = F.filter("moves", lambda m: m["rule_id"] == F.col("id"))
    others = F.filter("moves", lambda m: m["rule_id"] != F.col("id"))
    at = F.instr("text", F.col("flagged_span")) - 1
    on_span = F.exists(own, lambda m: (m["start"] < at + F.length("flagged_span")) & (m["end"] > at))
    kind = F.col("kind")
    example = kind == "example"
    reason = F.col(plan.REJECT_REASON)
    unknown = reason == "domain is unknown"
    checks = (
        (example & unknown, "domain is unknown"),
        (reason.isNotNull() & ~unknown, F.concat(F.lit("the "), kind, F.lit(" was not scanned"))),
        (example & F.col("pack_tier").isNull(), "not in the pack"),
        (example & (F.col("pack_tier") != F.col("pit_tier")), "other tier in the pack"),
        (example & (F.col("pack_domain") != F.col("domain")), "other domain in the pack"),
        (example & (F.size(own) == 0), "the example is not marked"),
        (example & (at < 0), "the flagged span is not in the text"),
        (example & (at >= 0) & ~on_span, "the flagged span is not marked"),
        (example & (F.size(others) > 0), "the example raises another rule"),
        ((kind == "honest") & (F.size("moves") > 0), "the honest version is marked"),
        ((kind == "fair use") & ((F.size(own) > 0) != F.col("fair_use_flagged")), "the fair use verdict is wrong"),
        ((kind == "fair use") & (F.size(others) > 0), "the fair use raises another rule"),
    )
    found = F.filter(F.array(*(F.when(test, label) for test, label in checks)), lambda p: p.isNotNull())
    rows = scanned.select(key, "id", F.explode_outer(found).alias("problem"))
    return rows.where(F.col("problem").isNotNull())


def corpus_facts(cases: DataFrame, file: str, src: str, prefix: str) -> DataFrame:
    """Cases and cases under a source prefix, per file and in all."""
    return cases.rollup(file).agg(
        F.count("*").alias("cases"),
        F.count_if(F.col(src).startswith(prefix)).alias("prefixed"),
        F.count_if(F.size("moves") > 0).alias("flagged"),
    )


def fact_cube(cases: DataFrame, file: str, src: str, prefix: str, text: str = "text") -> DataFrame:
    """Cases per file and rule with file totals, rule totals and the grand total, in one pass.

    ``cases`` has ``moves`` and the text. ``rule_id`` is null where cases count whatever they raise; ``all_files`` says
    that a row is over all files, since a file may be null itself. ``texts`` counts different texts, exactly: digests
    are made distinct before they travel.
    """
    ids = F.coalesce(F.transform("moves", lambda m: m["rule_id"]), F.array().cast("array<string>"))

    def counted(ids: Column) -> Column:
        of_rule = F.transform(
            F.array_distinct(ids), lambda r: F.struct(r.alias("rule_id"), F.size(F.filter(ids, lambda i: i == r)).alias("n"))
        )
        return F.concat(F.array(F.struct(F.lit(None).cast("string").alias("rule_id"), F.size(ids).alias("n"))), of_rule)

    rows = cases.select(
        F.col(file).alias("file"), F.col(src).startswith(prefix).alias("prefixed"), text_digest(text).alias("digest"),
        F.explode_outer(let(ids, counted)).alias("c"),  # the outer form, or the scan would run twice
    )
    counted_rows = rows.select("file", "prefixed", "digest", "c.rule_id", "c.n")
    sets = [[F.col("file"), F.col("rule_id")], [F.col("rule_id")]]
    cube = counted_rows.groupingSets(sets, "file", "rule_id").agg(
        F.grouping("file").alias("g"), F.count("*").alias("cases"), F.count_if("prefixed").alias("prefixed"),
        F.count_distinct("digest").alias("texts"), F.sum("n").alias("n_moves"),
    )
    return cube.select("file", (F.col("g") == 1).alias("all_files"), "rule_id", "cases", "prefixed", "texts", "n_moves")


def rule_facts(cases: DataFrame) -> DataFrame:
    """Texts and moves per rule, and in all (null rule); ``cases`` has ``moves``."""
    def counted(ids):
        of_rule = F.transform(
            F.array_distinct(ids),
            lambda rule: F.struct(rule.alias("rule_id"), F.size(F.filter(ids, lambda i: i == rule)).alias("n")),
        )
        in_all = F.array(F.struct(F.lit(None).cast("string").alias("rule_id"), F.size(ids).alias("n")))
        return F.when(F.size(ids) > 0, F.concat(of_rule, in_all))

    ids = F.transform("moves", lambda m: m["rule_id"])
    rows = cases.select(F.explode_outer(let(ids, counted)).alias("c")).select("c.*").where("n > 0")
    return rows.groupBy("rule_id").agg(F.count("*").alias("texts"), F.sum("n").alias("n_moves"))


def pair_facts(registry: DataFrame, kind: str, group: str) -> DataFrame:
    """Pairs by kind, with the groups they come from, and in all (null kind)."""
    return registry.rollup(kind).agg(F.count("*").alias("pairs"), F.count_distinct(group).alias("groups"))


def guide_checks(checks: DataFrame, keys: list[str], pack: RulePack) -> DataFrame:
    """Verdict of each check ``(text, domain, rule, flagged)`` of a guide; rule ``*`` stands for any."""
    scanned = plan.with_moves(checks, pack, F.col("domain"))
    raised = F.exists("moves", lambda m: (F.col("rule") == "*") | (m["rule_id"] == F.col("rule")))
    verdict = F.when(raised == F.col("flagged"), "holds").when(raised, "is marked").otherwise("is not marked")
    return scanned.select(*keys, "rule", _unless_rejected(verdict).alias("verdict"))


def guide_registry_audit(entries: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Rules with two entries, and quoted examples of ``misses`` that no check of their entry covers.

    ``entries`` has the key, ``id`` and ``misses``; ``checks`` the key and ``text``.
    """
    twice = entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    quotes = entries.select(key, F.explode_outer(quoted_examples(F.col("misses"))).alias("text")).where("text IS NOT NULL")
    open_quotes = quotes.join(checks.select(key, "text"), [key, "text"], "left_anti")
    return twice.select(F.lit("two entries").alias("problem"), F.col("id").alias("item"), F.col("n")).unionByName(
        open_quotes.groupBy("text").agg(F.count("*").alias("n")).select(
            F.lit("quoted without a check").alias("problem"), F.col("text").alias("item"), "n"
        )
    )
