"""Tables for display, derived from scanned texts.

All but the catalog join work inside a text's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayscan.functions.sentences import sentence_no, sentence_starts
from swayscan.functions.spans import collect_fold

_CLUSTER = "struct<start:int,end:int,tier:int,first:int,members:int>"
_FAR = 2**31 - 1


def clusters(moves: Column) -> Column:
    """Runs of overlapping moves across rules, each with its first move's tier.

    ``moves`` must be in move order. Moves that only touch stay apart.
    """
    spans = F.transform(
        moves, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["tier"].alias("tier"))
    )
    # A last span far behind the text closes the last cluster.
    closing = F.array(F.struct(F.lit(_FAR).alias("start"), F.lit(_FAR).alias("end"), F.lit(0).alias("tier")))

    def step(open_, span):
        opens = span["start"] >= open_["end"]
        fresh = F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            span["tier"].alias("tier"),
            (open_["first"] + open_["members"]).alias("first"),
            F.lit(1).alias("members"),
        )
        wider = F.struct(
            open_["start"].alias("start"),
            F.greatest(open_["end"], span["end"]).alias("end"),
            open_["tier"].alias("tier"),
            open_["first"].alias("first"),
            (open_["members"] + 1).alias("members"),
        )
        finished = F.when(opens & (open_["members"] > 0), open_)
        return F.when(opens, fresh).otherwise(wider), finished

    nothing = F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("tier"),
        F.lit(0).alias("first"), F.lit(0).alias("members"),
    )
    return collect_fold(F.concat(spans, closing), nothing, step, _CLUSTER)


def cluster_rows(scanned: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per cluster, with its phrase and the rules in it."""
    rows = scanned.withColumn("clusters", clusters(F.col("moves"))).select(
        *keys, text, "moves", F.posexplode_outer("clusters").alias("at", "c")
    )
    members = F.slice("moves", F.col("c.first") + 1, F.col("c.members"))
    return rows.where(F.col("at").isNotNull()).select(
        *keys,
        (F.col("at") + 1).alias("cluster_no"),
        F.col("c.start").alias("start"),
        F.col("c.end").alias("end"),
        F.col("c.tier").alias("tier"),
        F.transform(members, lambda m: m["rule_id"]).alias("rule_ids"),
        F.substring(text, F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("phrase"),
    )


def annotate_segments(scanned: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per segment; ``tier`` is null for plain text."""
    cut = scanned.withColumn("clusters", clusters(F.col("moves")))
    # The clusters become a column first, so that they are worked out once.
    rows = cut.withColumn("segments", _segments_of(F.col("clusters"), F.col(text))).select(
        *keys, text, F.posexplode_outer("segments").alias("at", "p")
    )
    return rows.where(F.col("at").isNotNull()).select(
        *keys,
        (F.col("at") + 1).alias("segment_no"),
        F.col("p.tier").alias("tier"),
        F.substring(text, F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("segment"),
    )


def _segments_of(found: Column, text: Column) -> Column:
    """Plain and marked pieces that cover the text exactly."""
    none = F.lit(None).cast("int")

    def piece(start, end, tier):
        return F.struct(start.alias("start"), end.alias("end"), tier.alias("tier"))

    def around(c, at):
        before = F.when(at == 0, F.lit(0)).otherwise(F.get(found, at - 1)["end"])
        return F.array(piece(before, c["start"], none), piece(c["start"], c["end"], c["tier"]))

    last = F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0))
    cuts = F.concat(F.flatten(F.transform(found, around)), F.array(piece(last, F.length(text), none)))
    return F.filter(cuts, lambda p: p["end"] > p["start"])


def move_labels(scanned: DataFrame, keys: list[str], catalog: DataFrame, tiers: dict) -> DataFrame:
    """One line per move, in plain words: "Move i of n: name, Tier t (alias), ...".

    The catalog holds one row per rule of a pack.
    """
    rows = scanned.select(
        *keys, F.size("moves").alias("n"), F.posexplode_outer("moves").alias("at", "m")
    ).where(F.col("at").isNotNull())
    rows = rows.select(*keys, "n", (F.col("at") + 1).alias("move_no"), "m.rule_id", "m.tier", "m.match")
    named = rows.join(catalog.withColumnRenamed("name", "plain_name"), "rule_id", "left")
    alias = F.element_at(
        F.create_map(*(F.lit(v) for t, tier in tiers.items() for v in (int(t), tier["alias"]))), F.col("tier")
    )
    line = F.format_string(
        'Move %d of %d: %s, Tier %d (%s), "%s"', "move_no", "n", "plain_name", "tier", alias, "match"
    )
    return named.select(*keys, "move_no", "rule_id", "short", line.alias("line"))


def move_sentences(scanned: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Moves of scanned texts with the number of their sentence, from 1, and whether it is the text's first.

    A move lies in the sentence where it begins. Sentences are cut by ``sentence_starts``.
    """
    starts = sentence_starts(F.col(text))
    rows = scanned.select(*keys, starts.alias("_starts"), F.posexplode_outer("moves").alias("at", "move")).where("at is not null")
    number = sentence_no(F.col("_starts"), F.col("move.start"))
    return rows.select(*keys, (F.col("at") + 1).alias("move_no"), "move.rule_id", "move.start", "move.end",
                       number.alias("sentence_no"), (number == 1).alias("first_sentence"))


def missed_spans(scanned: DataFrame, keys: list[str], quote: str, text: str = "text") -> DataFrame:
    """For a quoted phrase per text: is it there, and does no move touch it?"""
    at = F.instr(F.col(text), F.col(quote)) - 1
    touched = F.exists(
        "moves", lambda m: (m["start"] < at + F.length(quote)) & (m["end"] > at)
    )
    verdict = (
        F.when(at < 0, "not in the text").when(touched, "marked").otherwise("missed")
    )
    return scanned.select(*keys, quote, at.alias("at"), verdict.alias("verdict"))
