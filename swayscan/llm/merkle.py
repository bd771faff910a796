"""Merkle manifest of a dataset by rolling nested structs up: rank digits are grouped away, proofs are unnested.

A group's nodes are numbered from 0. The digits of a number in base ``FAN`` say where its path to the root turns.
``DIGITS`` digits are grouped away one after another inside a block of ``FAN ** DIGITS`` nodes; each step nests the
structs of a run into its parent's. A block is one row of bounded size, and its root is a node of the next level.
Going down, each block takes the path above it and unnests into its nodes with their own paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayscan.llm.tables import written

FAN = 3  # consecutive nodes that become one
DIGITS = 6  # levels of a block, which holds 729 nodes at most
STEP = "struct<before:string,behind:string>"
_PART = 2**33  # row numbers of monotonically_increasing_id within a partition


def digest_of(*values: Column) -> Column:
    """SHA-256 over values: ``-`` for null, else bytes, a colon and the value."""

    def shown(value):
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(shown, values)), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` within ``group``, from 0 in the given order with nulls first, and ``size``, the group's rows.

    Rows are sorted across partitions, so that a large group takes many tasks. What is summed up per group is one row
    for each partition that the group reaches into.
    """
    keys = ["group", *order, "row"]
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()))  # equal rows need an order too
    spread = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(spread.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.expr(f"at div {_PART}")))
    runs = placed.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.selectExpr(
        "group as g", "part as p",
        "first - coalesce(sum(n) over (partition by group order by part rows between unbounded preceding and 1 preceding), 0) as base",
        "sum(n) over (partition by group) as size",
    )
    joined = placed.join(runs, F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.select(*rows.columns, (F.col("at") - F.col("base")).alias("rank"), "size")


def _levels(size: Column) -> Column:
    """How often nodes become fewer until one is left."""
    powers = F.array(*(F.lit(FAN**k).cast("long") for k in range(40) if FAN**k < 2**63))
    return F.size(F.filter(powers, lambda power: power < size))


def _nested(nodes: DataFrame) -> DataFrame:
    """``(group, rank, levels, digest, item)`` to one row per block: ``(group, block, levels, digest, run)``.

    ``run`` holds the block's upper nodes, each with the run below it. All steps group within the blocks, so that
    rows move once.
    """
    names = [f"d{k}" for k in range(DIGITS)]
    digits = {name: F.expr(f"int(rank div {FAN**k} % {FAN})") for k, name in enumerate(names)}
    keys = ["group", "block", "levels"]
    rows = nodes.withColumns({"block": F.expr(f"rank div {FAN**DIGITS}"), **digits})
    rows = rows.repartition("group", "block").select(*keys, *names, "digest", F.col("item").alias("below"))
    for k, name in enumerate(names):
        run = F.array_sort(F.collect_list(F.struct(F.col(name).alias("at"), "digest", "below")))
        rows = rows.groupBy(*keys, *names[k + 1 :]).agg(run.alias("below"))
        joined = F.sha2(F.array_join(F.transform("below", lambda n: n["digest"]), ""), 256)
        alone = F.get(F.col("below"), F.lit(0))["digest"]
        rows = rows.withColumn("digest", F.when(F.col("levels") > k, joined).otherwise(alone))
    return rows.select(*keys, "digest", F.col("below").alias("run"))


def _unnested(run: Column, above: Column, levels: Column, k: int) -> Column:
    """The block's nodes with their paths, own level first: ``array<struct<item, digest, path>>``."""

    def joined(nodes):
        return F.array_join(F.transform(nodes, lambda n: n["digest"]), "")

    def down(node):
        before = joined(F.filter(run, lambda other: other["at"] < node["at"]))
        behind = joined(F.filter(run, lambda other: other["at"] > node["at"]))
        step = F.struct(before.alias("before"), behind.alias("behind"))
        path = F.when(levels > k, F.concat(F.array(step), above)).otherwise(above)
        if k == 0:
            return F.struct(node["below"].alias("item"), node["digest"].alias("digest"), path.alias("path"))
        # the path is worked out once for all nodes below
        return F.flatten(F.transform(F.array(path), lambda p: _unnested(node["below"], p, levels, k - 1)))

    return F.transform(run, down) if k == 0 else F.flatten(F.transform(run, down))


def _climbed(nodes: DataFrame, tops: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(group, rank, levels, digest, item)`` to ``(group, item, digest, path, subroot, root)``.

    ``tops`` takes ``(group, digest)`` of each group's last node to ``(group, path, subroot, root)``.
    """
    blocks = written(_nested(nodes))
    if blocks.filter("block > 0").isEmpty():
        upper = tops(blocks.select("group", "digest")).withColumn("block", F.lit(0).cast("long"))
    else:
        left = F.greatest(F.col("levels") - DIGITS, F.lit(0))
        higher = blocks.select("group", F.col("block").alias("rank"), left.alias("levels"), "digest", F.struct("block").alias("item"))
        upper = _climbed(higher, tops).select("group", "item.block", "path", "subroot", "root")
    facts = ["levels", "run", "path", "subroot", "root"]
    both = blocks.select("group", "block", "levels", "run").unionByName(upper, allowMissingColumns=True)
    whole = both.groupBy("group", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in facts))
    found = whole.select(
        "group", "subroot", "root", F.explode(_unnested(F.col("run"), F.col("path"), F.col("levels"), DIGITS - 1)).alias("n")
    )
    return found.select("group", "n.*", "subroot", "root")


def _as_nodes(rows: DataFrame, digest: str, *items: str) -> DataFrame:
    levels = _levels(F.col("size"))
    return rows.select("group", "rank", levels.alias("levels"), F.col(digest).alias("digest"), F.struct(*items).alias("item"))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, roots and proof of every row of ``docs(doc_id, source, lang, n_chars, text)``.

    Returns ``(doc_id, source, leaf, subroot, root, path, folded_root, verified)``: ``path`` has a step per level, from the
    leaf to the root, with the digests before and behind the row's own node in its run. ``folded_root`` is what the
    path makes of the leaf with ``tampered`` as its text (unchanged if None), ``verified`` says if it is the root.

    Every row is a leaf, repeated rows too. Rows of a source are ordered by doc_id, null first; rows of one id by
    leaf. A null source is a source of its own and comes first. Nulls and empty texts count as such in a leaf. Other
    columns are left alone; long texts are only read where they lie, since digests alone move on. No rows, no result.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    leaves = docs.select(
        F.col("source").alias("group"), "doc_id", digest_of(*fields, text).alias("leaf"),
        digest_of(*fields, text if tampered is None else tampered).alias("forged"),
    )
    nodes = _as_nodes(ranked(leaves, ["doc_id", "leaf"]), "leaf", "doc_id", "forged")
    empty = F.array().cast(f"array<{STEP}>")

    def root_of(top: DataFrame) -> DataFrame:
        return top.select("group", empty.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def sources(subroots: DataFrame) -> DataFrame:
        # one group, whose nodes are the sources
        one = subroots.select(F.lit(0).alias("group"), F.col("group").alias("source"), "digest")
        high = _climbed(_as_nodes(ranked(one, ["source"]), "digest", "source"), root_of)
        return high.select(F.col("item.source").alias("group"), "path", F.col("digest").alias("subroot"), "root")

    found = _climbed(nodes, sources)
    folded = F.aggregate(
        "path", F.col("item.forged"), lambda acc, step: F.sha2(F.concat(step["before"], acc, step["behind"]), 256)
    )
    rows = found.select(
        "item.doc_id", F.col("group").alias("source"), F.col("digest").alias("leaf"), "subroot", "root", "path",
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all digests of a path, level by level and left to right."""
    steps = F.transform(path, lambda step: F.concat(step["before"], step["behind"]))
    return F.sha2(F.array_join(steps, ""), 256)
