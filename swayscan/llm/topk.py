"""Exact top-k inner-product search by a three-phase uniform threshold."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swayscan.llm.tables import written

SCALE = 256
ROWS = 4096  # vectors of a block
QUERIES = 1024  # queries of a block
LISTED = 8  # times the number of wanted rows: length of a list in phase 1; longer lists give a higher threshold


def whole_numbers(vector: str, width: int) -> Column:
    """Components times 256, rounded down; null if the vector or a component is null or not finite.

    Components are held within the range in which every inner product of ``width`` of them fits 64 bits.
    """
    bad = f"exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    most = math.isqrt((2**63 - 1) // max(width, 1))
    held = f"greatest({-most}, least({most}, bigint(least(9e18D, greatest(-9e18D, floor({SCALE}D * double(x)))))))"
    return F.expr(f"if({bad}, null, transform({vector}, x -> {held}))")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of numbers, filled up with zeros to the same width."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a and b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _parts(queries: pd.DataFrame, rows: pd.DataFrame, cuts: list[tuple[int, int]]):
    """Scores of each block of dimensions, for some queries at a time: (query positions, block, scores)."""
    q, r = _matrix(queries["v"], cuts[-1][1]), _matrix(rows["v"], cuts[-1][1])
    for start in range(0, len(q), 256):
        for j, (a, b) in enumerate(cuts):
            yield np.arange(start, min(start + 256, len(q))), j, _products(q[start : start + 256, a:b], r[:, a:b])


def _local_lists(n: int, cuts: list[tuple[int, int]]):
    """Phase 1 of one cell: the n best of each list, and the least score of the list (its row has no class)."""

    def cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            names, of = rows["cls"].to_numpy(), queries["q"].to_numpy()
            for at, j, scores in _parts(queries, rows, cuts):
                best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
                top = np.take_along_axis(scores, best, 1)
                found.append(pd.DataFrame({"q": of[at].repeat(best.shape[1]), "j": j, "cls": pd.array(names[best].ravel(), "Int64"), "s": top.ravel()}))
                found.append(pd.DataFrame({"q": of[at], "j": j, "cls": pd.array([None] * len(at), "Int64"), "s": scores.min(axis=1)}))
        return pd.concat(found) if found else pd.DataFrame({"q": [], "j": [], "cls": [], "s": []})

    return cell


def _entries(cuts: list[tuple[int, int]]):
    """Phase 2 of one cell: every entry at or above its list's share of the query's threshold."""

    def cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            names, of = rows["cls"].to_numpy(), queries["q"].to_numpy()
            floors, share = _matrix(queries["floors"], len(cuts)), queries["share"].to_numpy()
            for at, j, scores in _parts(queries, rows, cuts):
                x, y = np.nonzero(scores >= (floors[at, j] + share[at])[:, None])
                found.append(pd.DataFrame({"q": of[at][x], "j": j, "cls": names[y], "s": scores[x, y]}))
        return pd.concat(found) if found else pd.DataFrame({"q": [], "j": [], "cls": [], "s": []})

    return cell


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    blocks: int = 2,
) -> DataFrame:
    """The k rows of highest inner product for every row that meets ``queries`` (a condition on ``vectors``).

    Components count as ``floor(256 * x)``. Returns ``query_id, rank, <id>, score``; equal scores are ranked by id; a
    row is no candidate for its own id. Null ids and vectors that are null or hold null or non-finite components take
    no part; of repeated ids the least vector counts; shorter vectors are filled up with zeros.

    Equal vectors form one class that is searched once; its ``k + 1`` smallest ids stand for it. Classes and queries
    meet block by block. Each of ``blocks`` runs of dimensions is one score list per query. Phase 1 takes the best of
    every list; the (k+1)-th best score of what it found is a safe threshold. Phase 2 sends each list its equal share
    of what the threshold lies above the lists' least scores, and gets every entry at or above it; a class that no
    list sends stays below the threshold. Phase 3 drops what cannot reach it and computes the missing scores.
    """
    n = k + 1
    width = vectors.agg(F.max(F.size(vector_col))).first()[0]
    width = max(width or 0, 1)
    at = [round(i * width / blocks) for i in range(blocks + 1)]
    cuts = [(a, b) for a, b in zip(at, at[1:]) if b > a]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"), queries.alias("is_query"))
    rows = rows.select("id", whole_numbers("x", width).alias("v"), "is_query").filter("id is not null and v is not null")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    rows = written(rows.withColumn("h", F.xxhash64("v")))
    same = Window.partitionBy("h", "v").orderBy("id")
    members = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= n)
    classes = members.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = written(classes.select(F.col("ids")[0].alias("cls"), "h", "v", "ids"))
    asked = rows.filter("is_query")
    wanted = written(
        asked.select("h", "v").distinct().join(classes, ["h", "v"]).select(F.col("cls").alias("q"), "v")
    )

    def resolved(pairs: DataFrame) -> DataFrame:
        """Whole scores of ``pairs(q, cls, have, known)``: known is the sum of the lists whose bits are set in have."""
        pairs = pairs.join(wanted.select("q", F.col("v").alias("qv")), "q").join(classes.select("cls", "v", "ids"), "cls")
        terms = [
            f"if(have & {1 << j}L <> 0, 0L, aggregate(zip_with(slice(qv, {a + 1}, {b - a}), slice(v, {a + 1}, "
            f"{b - a}), (x, y) -> coalesce(x * y, 0L)), 0L, (t, p) -> t + p))"
            for j, (a, b) in enumerate(cuts)
        ]
        return pairs.select("q", "cls", "ids", F.expr(f"known + {' + '.join(terms)}").alias("score"))

    row_blocks, query_blocks = -(-classes.count() // ROWS) or 1, -(-wanted.count() // QUERIES) or 1
    grid_rows = classes.select("cls", "v", F.expr(f"int(pmod(xxhash64(cls), {row_blocks}))").alias("rb"))
    grid_rows = grid_rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def over_cells(frame: DataFrame, work) -> DataFrame:
        frame = frame.withColumn("qb", F.expr(f"int(pmod(xxhash64(q), {query_blocks}))"))
        frame = frame.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        pairs = frame.groupBy("rb", "qb").cogroup(grid_rows.groupBy("rb", "qb"))
        return pairs.applyInPandas(work, "q long, j int, cls long, s long")

    first = written(over_cells(wanted, _local_lists(LISTED * n, cuts)))
    floors = first.filter("cls is null").groupBy("q", "j").agg(F.min("s").alias("floor"))
    in_list = Window.partitionBy("q", "j").orderBy(F.desc("s"), "cls")
    lists = first.filter("cls is not null").withColumn("nth", F.row_number().over(in_list)).filter(F.col("nth") <= LISTED * n)
    listed = lists.select("q", "cls").distinct().selectExpr("q", "cls", "0L as have", "0L as known")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    nth = resolved(listed).withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") == n)
    by_block = F.transform(F.sort_array(F.collect_list(F.struct("j", "floor"))), lambda x: x["floor"])
    cut = floors.groupBy("q").agg(by_block.alias("floors"), F.sum("floor").alias("least"))
    cut = cut.join(nth.select("q", "score"), "q", "left")
    cut = cut.select("q", "floors", F.expr("coalesce(score - least, 0L)").alias("need"))
    cut = written(cut.withColumn("share", F.expr(f"(need + {len(cuts) - 1}) div {len(cuts)}")))

    sent = written(over_cells(wanted.join(cut, "q"), _entries(cuts)))
    seen = sent.join(cut, "q").groupBy("q", "cls", "need", "share").agg(
        F.sum(F.expr("s - floors[j]")).alias("sum"), F.sum("s").alias("known"),
        F.sum(F.expr("shiftleft(1L, j)")).alias("have"),
    )
    alive = seen.filter(f"sum + ({len(cuts)} - bit_count(have)) * greatest(share - 1, 0) >= need")
    scored = resolved(alive.select("q", "cls", "have", "known"))
    scored = scored.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= n)
    found = scored.select("q", "score", F.explode("ids").alias("id"))
    by_member = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.withColumn("nth", F.row_number().over(by_member)).filter(F.col("nth") <= n)
    answer = written(found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("best")))

    to_class = classes.select(F.col("cls").alias("q"), "h", "v")
    answers = asked.select(F.col("id").alias("query_id"), "h", "v").join(to_class, ["h", "v"]).join(answer, "q")
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(own).alias("pos", "hit")).select(
        "query_id", F.expr("pos + 1").alias("rank"), F.col("hit.id").alias(id_col), F.col("hit.score").alias("score")
    )
