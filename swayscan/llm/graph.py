"""Connected components of links between keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayscan.llm.tables import written


def _ordered(pairs: DataFrame) -> DataFrame:
    return (
        pairs.filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` to ``(node, root)``: nodes have the same root if links join them.

    Each round every node moves to its least neighbour and the links are rewritten to the nodes they moved to,
    until no link is left. "Least" is by value in even rounds, which folds a star in one round, and by a hash that
    changes in odd ones, which shortens long chains by a constant share. Only written tables carry over between
    rounds. Loops and repeated links are ignored; nodes without a link to another node are not returned.
    """
    level, moves = written(_ordered(links)), []
    while not level.isEmpty():
        ends = level.select(F.col("a").alias("node"), F.col("b").alias("other")).union(level.select("b", "a"))
        if len(moves) % 2 == 0:
            moved = ends.groupBy("node").agg(F.min("other").alias("other")).select(
                "node", F.least("node", "other").alias("to")
            )
        else:
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("h"), F.col(c).alias("to"))
            moved = ends.select("node", rank("other").alias("other")).groupBy("node").agg(F.min("other").alias("other"))
            moved = moved.select("node", F.least("other", rank("node")).alias("least")).select("node", "least.to")
        moved = written(moved)
        moves.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = moved.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        level = written(
            _ordered(level.join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")))
        )
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = moves[0].select("node", F.col("to").alias("root"))
    for moved in moves[1:]:
        step = moved.select(F.col("node").alias("root"), "to")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return roots
