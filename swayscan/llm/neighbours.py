"""Near-duplicate embeddings by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from swayscan.llm.graph import components
from swayscan.llm.tables import written

TILE = 2048  # vectors of a tile, about; a task compares tiles two by two
RUN = 256  # vectors of a tile that are compared, or left out, together
MOST = 13  # a vector's number is its tile's, and its place there in so many bits
SLACK = 1e-6  # on squared distances, for each dimension, for rounding in single precision; cosines are checked without it


@lru_cache(maxsize=8)
def rotation(width: int) -> np.ndarray:
    """A fixed random rotation, so that no block of dimensions holds most of the distance."""
    q, r = np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(vectors, dtype=np.float64)
    # components far from 1 are scaled first, so that squares neither vanish nor overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def _cuts(width: int, blocks: int) -> list[tuple[int, int]]:
    at = [round(i * width / blocks) for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(at, at[1:]) if b > a]


class _Side:
    """A tile made ready: its vectors in order of their grid cells, and per block what a run of them lies between."""

    def __init__(self, tile: int, rows, vectors, blocks: int, distance2: float):
        width = len(vectors[0])
        if len(vectors) >> MOST:
            raise ValueError(f"a tile of {len(vectors)} vectors")
        values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)
        plain, unit = _unit(values)
        spun, cuts = unit @ rotation(width), _cuts(width, blocks)
        self.limits = [distance2 * (b - a) / width + SLACK * (b - a + 8) for a, b in cuts]
        cells = [np.floor(spun[:, a] / np.sqrt(limit)) for (a, _), limit in zip(cuts, self.limits)]
        order = np.lexsort(cells[::-1])
        self.cls = (tile << MOST) + order
        self.rows, self.plain, spun = rows.to_numpy(zero_copy_only=False)[order], plain[order], spun[order]
        self.norms = np.sqrt((self.plain**2).sum(axis=1))
        self.starts = range(0, len(order), RUN)
        parts = [spun[:, a:b] for a, b in cuts]
        self.low = [np.minimum.reduceat(p, self.starts) for p in parts]
        self.high = [np.maximum.reduceat(p, self.starts) for p in parts]
        # the product of a left and a right row is their squared distance
        squares, one = [(p**2).sum(axis=1, keepdims=True) for p in parts], np.ones((len(order), 1))
        self.left = [np.hstack([p, s, one]).astype(np.float32) for p, s in zip(parts, squares)]
        self.right = [np.hstack([-2 * p, one, s]).astype(np.float32) for p, s in zip(parts, squares)]


def _near(a: _Side, b: _Side, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of vectors in two tiles that keep to the budget in one block at least, some at a time."""
    gaps = []
    for la, ha, lb, hb, limit in zip(a.low, a.high, b.low, b.high, a.limits):
        gap = np.maximum(0, np.maximum(la[:, None] - hb[None], lb[None] - ha[:, None]))
        gaps.append((gap**2).sum(axis=2) <= limit)
    for i, at in enumerate(a.starts):
        for k in range(i if same else 0, len(b.starts)):
            hit = None
            for j, (limit, open_) in enumerate(zip(a.limits, gaps)):
                if open_[i, k]:
                    close = a.left[j][at : at + RUN] @ b.right[j][b.starts[k] : b.starts[k] + RUN].T <= limit
                    hit = close if hit is None else hit | close
            if hit is None or not hit.any():
                continue
            x, y = np.nonzero(hit)
            x, y = x + at, y + b.starts[k]
            if same:
                x, y = x[x < y], y[x < y]
            for n in range(0, len(x), 8192):
                yield x[n : n + 8192], y[n : n + 8192]


def _links_of(blocks: int, distance2: float, least: float):
    """Links within tiles, or between two: per vector the rows it links with (``n``), and a spanning forest (``other``)."""

    def links(a: _Side, b: _Side | None) -> pa.RecordBatch:
        same = b is None
        b = a if same else b
        cls = a.cls if same else np.concatenate([a.cls, b.cls])
        shift = 0 if same else len(a.cls)
        label, linked = np.arange(len(cls)), np.zeros(len(cls), np.int64)
        for x, y in _near(a, b, same):
            keep = (a.plain[x] * b.plain[y]).sum(axis=1) / (a.norms[x] * b.norms[y]) >= least
            x, y = x[keep], y[keep]
            np.add.at(linked, x, b.rows[y])
            np.add.at(linked, y + shift, a.rows[x])
            y = y + shift
            while len(x):  # least label of linked vectors, until nothing changes
                low = np.minimum(label[x], label[y])
                np.minimum.at(label, label[x], low)
                np.minimum.at(label, label[y], low)
                while not np.array_equal(label, up := label[label]):
                    label[:] = up
                keep = label[x] != label[y]
                x, y = x[keep], y[keep]
        some = np.flatnonzero(linked)
        return pa.RecordBatch.from_pydict({"cls": cls[some], "n": linked[some], "other": cls[label[some]]})

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, _Side] | None = None
        for batch in it:
            for i in range(batch.num_rows):
                side = [batch.column(f"tile{k}")[i].as_py() if f"tile{k}" in batch.schema.names else None for k in (1, 2)]
                made = lambda k: _Side(side[k - 1], batch.column(f"rows{k}")[i].values, batch.column(f"v{k}")[i].values, blocks, distance2)
                if held is None or held[0] != side[0]:  # a tile meets many in a row
                    held = side[0], made(1)
                yield links(held[1], None if side[1] is None else made(2))

    return solve


def _tiles(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """``tile, label, width, slots, slot, digest[], first[], rows[], v[]``: equal vectors once, about TILE of them a row.

    The vectors of a label and width are one row, or are dealt out to as many slots as they fill.
    """
    alike = members.filter("good").select("label", "width", "digest").distinct()
    sizes = alike.groupBy("label", "width").agg(F.expr(f"int(ceil(count(*) / {TILE}))").alias("slots"))
    # only full ones, which are a row for TILE vectors at most
    dealt = vectors.join(F.broadcast(written(sizes.filter("slots > 1"))), ["label", "width"], "left")
    dealt = dealt.withColumn("slots", F.coalesce("slots", F.lit(1))).withColumn("slot", F.expr("int(pmod(xxhash64(digest), slots))"))
    group = ["label", "width", "slots", "slot"]
    classes = dealt.groupBy(*group, "digest", "v").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    packed = classes.groupBy(*group).agg(F.collect_list(F.struct("digest", "first", "rows", "v")).alias("x"))
    return written(packed.select(F.monotonically_increasing_id().alias("tile"), *group, "x.digest", "x.first", "x.rows", "x.v"))


def _links(tiles: DataFrame, blocks: int, least: float) -> DataFrame:
    """``cls, n, other`` of each tile, and of each two of a label and width.

    Tiles meet as two tables are read beside each other, task by task, so that no vector is written for a pair.
    """
    solve, schema = _links_of(blocks, 2 - 2 * least, least), "cls long, n long, other long"
    within = tiles.select(F.col("tile").alias("tile1"), F.col("rows").alias("rows1"), F.col("v").alias("v1"))
    found = within.mapInArrow(solve, schema)
    full = tiles.filter("slots > 1")
    if not (n := full.count()):
        return found
    sides = [
        full.coalesce(max(-(-n // 16), min(-(-n // 2), 16))).select(
            *(F.col(c).alias(f"{c}{k}") for c in ("label", "width", "slot", "tile", "rows", "v"))
        )
        for k in (1, 2)
    ]
    meet = F.expr("label1 = label2 and width1 = width2 and slot1 < slot2")
    pairs = sides[0].hint("shuffle_replicate_nl").join(sides[1], meet)
    return found.union(pairs.select("tile1", "rows1", "v1", "tile2", "rows2", "v2").mapInArrow(solve, schema))


def near_duplicates(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", blocks: int = 4,
) -> DataFrame:
    """``<id>, n_links, component_id, kept`` for every row: rows of one label whose cosine reaches ``least`` link.

    n_links counts the other rows linked directly, component_id is the smallest id that links reach, kept marks it.
    A vector that is null, empty, zero or holds null or non-finite components, or has a null label, links with
    nothing, and vectors of different length do not link; such a row is its own component. Repeated rows are rows of
    their own, linked with each other. Null ids take part but are no component's name unless all its ids are null.

    Equal vectors of a label form one class. Unit vectors within the cosine lie within ``2 - 2 * least`` squared.
    After a rotation each of ``blocks`` blocks of dimensions has its share of that budget in proportion to its width,
    and a pair must keep to the budget in one block at least. The classes of a label lie in tiles, ordered by grid
    cells of the blocks' leading coordinates; runs of them are left out in a block whose bounds are too far apart
    there, and candidates are checked by their cosine. Two tiles meet in one task for all blocks, so tasks return
    counts and forests instead of pairs, and a vector is shuffled twice at most, however large its label.
    """
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("v"), F.col(label_col).alias("label")
    )
    good = (
        "v is not null and label is not null and not exists(v, x -> x is null or isnan(x) or "
        "abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )
    rows = rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    # + 0 makes -0.0 equal to 0.0
    rows = rows.withColumns({"v": F.expr(f"transform(v, x -> x + {'float' if single else 'double'}(0))"), "width": F.size("v")})
    rows = rows.withColumn("digest", F.when(F.col("good"), F.unhex(F.sha2(F.col("v").cast("string"), 256))))
    members = written(rows.drop("v"))
    tiles = _tiles(rows.filter("good"), members)
    found = written(_links(tiles, blocks, least))

    each = tiles.select("tile", "label", F.posexplode(F.arrays_zip("digest", "first", "rows")).alias("at", "c"))
    classes = each.select(F.expr(f"shiftleft(tile, {MOST}) + at").alias("cls"), "label", "c.*")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    of_class = classes.join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    of_class = written(of_class.select(
        "label", "digest", "first", F.expr("coalesce(n, 0L) + rows - 1").alias("n_links"), F.coalesce("root", "cls").alias("root")
    ))
    names = of_class.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(names, "root").select("label", "digest", "n_links", "component_id")
    linked = members.filter("good").join(written(of_class), ["label", "digest"]).select("id", "n_links", "component_id")
    alone = members.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
