"""Evaluation against labelled spans: by span, by sentence and by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swayscan.operators.evaluate import label_eval, rule_outcomes
from swayscan.sources.pack import RulePack, stamp

BLOCK = 512
"""Characters of a block of offsets."""
MASK_BITS = 62
"""Rules that one mask column holds."""


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs of spans with the same keys that share characters: ``(keys, left, right, common)``.

    Both sides have ``start`` and ``end``; ``left`` and ``right`` are structs of each side's other columns with them.
    Spans meet by key and block of offsets, so that a text with many spans is shared among tasks and spans far apart
    never meet. A span lies in every block it reaches into; a pair is reported in the block where its common part
    begins, hence once. Empty spans and spans with a null share nothing.

    The join sorts and merges: spans come from arrays that lie packed in files, so Spark takes them for far fewer
    bytes than they are, and would send a whole side through the driver.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        whole = F.struct(*(c for c in df.columns if c not in keys)).alias(name)
        rows = df.where(F.col("start") < F.col("end"))
        first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
        return rows.select(*keys, whole, F.explode(F.sequence(first, last)).alias("_block"))

    begin = F.greatest("left.start", "right.start")
    end = F.least("left.end", "right.end")
    both = dealt(left, "left").hint("merge").join(dealt(right, "right").hint("merge"), [*keys, "_block"])
    met = both.where((begin < end) & (F.floor(begin / block) == F.col("_block")))
    return met.select(*keys, "left", "right", (end - begin).alias("common"))


def joined_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with the same keys, those that share characters joined to one: ``(keys, start, end)``."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = spans.where("start < end").select(*keys, "start", "end")
    apart = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    numbered = rows.withColumn("_apart", apart).withColumn("_island", F.count_if("_apart").over(running))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def matched(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches per key: ``(keys, hits)``. ``pairs`` is of ``overlap_pairs`` with disjoint spans on each side.

    Pairs are taken from left to right; each span is used once. For disjoint spans this is the largest matching.
    """
    places = F.array_sort(F.collect_list(F.struct(F.col("left.start").alias("a"), F.col("right.start").alias("b"))))
    seed = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).cast("bigint").alias("n"))

    def take(state: Column, pair: Column) -> Column:
        free = (pair["a"] > state["a"]) & (pair["b"] > state["b"])
        used = F.struct(pair["a"].alias("a"), pair["b"].alias("b"), (state["n"] + 1).alias("n"))
        return F.when(free, used).otherwise(state)

    listed = pairs.groupBy(*keys).agg(places.alias("places"))
    return listed.select(*keys, F.aggregate("places", seed, take)["n"].alias("hits"))


def _rates(counts: DataFrame) -> DataFrame:
    return counts.select(
        "*", F.try_divide("hits", "raised").alias("precision"), F.try_divide("hits", "labelled").alias("recall")
    )


def span_eval(labels: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """Per rule: spans labelled, raised and matched one to one, and the characters of each side and of both.

    ``labels`` and ``moves`` have ``keys``, ``rule_id``, ``start`` and ``end``. Overlapping spans of one rule and text
    count as one.
    """
    by = [*keys, "rule_id"]
    wanted, found = joined_spans(labels, by), joined_spans(moves, by)
    pairs = overlap_pairs(wanted, found, by)
    facts = ("hits", "raised", "labelled", "labelled_chars", "raised_chars", "common_chars")

    def side(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("rule_id", *(values.get(f, F.lit(0)).cast("bigint").alias(f) for f in facts))

    size = F.col("end") - F.col("start")
    rows = (
        side(wanted, labelled=F.lit(1), labelled_chars=size)
        .unionByName(side(found, raised=F.lit(1), raised_chars=size))
        .unionByName(side(pairs, common_chars=F.col("common")))
        .unionByName(side(matched(pairs, by), hits=F.col("hits")))
    )
    return _rates(rows.groupBy("rule_id").agg(*(F.sum(f).alias(f) for f in facts)))


def sentence_eval(sentences: DataFrame, labels: DataFrame, moves: DataFrame, keys: list[str], rules: list[str]) -> DataFrame:
    """Per rule: sentences labelled, raised, and both. A span counts for every sentence it reaches into.

    ``sentences`` has ``keys``, ``start`` and ``end``. The rules of a sentence are bit masks, in the order of
    ``rules``; equal pairs of masks are counted together before they are taken apart.
    """
    words = range((len(rules) + MASK_BITS - 1) // MASK_BITS)
    order = F.create_map(*(F.lit(x) for n, r in enumerate(rules) for x in (r, n)))

    def marks(spans: DataFrame, name: str) -> DataFrame:
        numbered = spans.select(*keys, "start", "end", F.try_element_at(order, F.col("rule_id")).alias("n")).where("n is not null")
        met = overlap_pairs(sentences, numbered, keys).select(*keys, F.col("left.start").alias("start"), F.col("right.n").alias("n"))
        bit = F.expr(f"shiftleft(1L, n % {MASK_BITS})")
        here = [F.when(F.expr(f"n div {MASK_BITS} = {w}"), bit).otherwise(F.lit(0).cast("bigint")).alias(f"{name}{w}") for w in words]
        other = "labelled" if name == "raised" else "raised"
        return met.select(*keys, "start", *here, *(F.lit(0).cast("bigint").alias(f"{other}{w}") for w in words))

    columns = [f"{name}{w}" for name in ("raised", "labelled") for w in words]
    rows = marks(moves, "raised").unionByName(marks(labels, "labelled"))
    masks = rows.groupBy(*keys, "start").agg(*(F.bit_or(c).alias(c) for c in columns))
    kinds = masks.groupBy(*columns).agg(F.count("*").alias("n"))

    def has(name: str, number: int) -> str:
        return f"{name}{number // MASK_BITS} & shiftleft(1L, {number % MASK_BITS}) != 0"

    each = F.expr(
        "array(" + ", ".join(
            f"named_struct('rule_id', '{r}', 'r', {has('raised', n)}, 'l', {has('labelled', n)})" for n, r in enumerate(rules)
        ) + ")"
    )
    bits = kinds.select("n", F.explode(F.filter(each, lambda b: b["r"] | b["l"])).alias("b")).select("n", "b.*")
    counts = bits.groupBy("rule_id").agg(
        F.sum(F.when(F.col("r") & F.col("l"), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("r"), F.col("n")).otherwise(0)).alias("raised"),
        F.sum(F.when(F.col("l"), F.col("n")).otherwise(0)).alias("labelled"),
    )
    return _rates(counts)


def level_eval(
    sentences: DataFrame, labels: DataFrame, moves: DataFrame, keys: list[str], technique_rules: DataFrame, pack: RulePack
) -> DataFrame:
    """The same labels and moves measured at three levels: span, sentence and document.

    ``labels`` has ``keys``, ``technique``, ``start`` and ``end``; ``moves`` has ``keys``, ``rule_id``, ``start`` and
    ``end``; ``technique_rules`` maps techniques to rules. Techniques without a rule are rows of their own, at level
    ``uncovered``, with the spans labelled. Character counts belong to the span level. Every row carries the pack's
    version and fingerprint. Choose the sealed half before, by ``evaluate.sealed``, on all three tables.
    """
    # a pack's few rows are what is sent around, whatever Spark takes the labels for
    technique_rules = F.broadcast(technique_rules)
    mapped = labels.join(technique_rules, "technique").select(*keys, "rule_id", "start", "end")
    per_text = [side.select(*keys, "rule_id").distinct() for side in (moves, mapped)]
    raised = per_text[0].select(*keys, F.array("rule_id").alias("rule_ids"), F.array().cast("array<string>").alias("techniques"))
    wanted = per_text[1].select(*keys, F.array().cast("array<string>").alias("rule_ids"), F.array("rule_id").alias("techniques"))
    same = technique_rules.select(F.col("rule_id").alias("technique"), "rule_id").distinct()
    texts = label_eval(rule_outcomes(raised.unionByName(wanted), keys, same))
    per_technique = labels.groupBy("technique").agg(F.count("*").alias("labelled"))
    uncovered = per_technique.join(technique_rules, "technique", "left_anti").where("technique is not null")
    spans = span_eval(mapped, moves, keys)
    ids = [r["id"] for r in pack.rules]
    levels = {"span": spans, "sentence": sentence_eval(sentences, mapped, moves, keys, ids), "document": texts, "uncovered": uncovered}
    whole = None
    for name, df in levels.items():
        part = df.withColumn("level", F.lit(name))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return stamp(whole, pack)
