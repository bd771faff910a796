"""SimHash near-duplicates found with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayscan.llm.graph import components
from swayscan.llm.tables import keep_only, written

BITS = 64
LEAF = 8  # fingerprints of a lowest group; also the groups below a node
TILE = 4096  # fingerprints of a node that are compared in one task
PAIRS = 1 << 20  # pairs held at once
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of a text as an unsigned number (see ``fingerprints``)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(part, 42) for part in parts]), np.uint8).reshape(-1, 8)
    set_bits = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65536):
        set_bits += np.unpackbits(hashes[start : start + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp long)``, one row per row of ``docs``; fp holds the 64 bits as a signed number.

    Letters A-Z are lowered, words are runs of characters other than ASCII white space, shingles of that many words
    count as often as they occur. A text of fewer words is one shingle; a null text, or one without words, has
    fingerprint zero. A bit is 1 if it is set in more than half of the shingles' XXH64 values (seed 42).
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in it:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(batches, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def masks(limit: int) -> list[int]:
    """Masked patterns of the index's top level.

    The bits fall into ``limit + 2`` segments. At most ``limit`` of them hold a difference, so two codes within the
    limit agree on two whole segments at least: they meet in one node of these masks with no difference so far.
    """
    cuts = [round(i * BITS / (limit + 2)) for i in range(limit + 3)]
    segment = [((1 << (b - a)) - 1) << (BITS - b) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(segment, 2)]


class _Levels:
    """Groups of Gray-ordered codes; each knows the bits all its codes share and their values."""

    def __init__(self, fps: np.ndarray):
        self.levels = [(np.full(len(fps), ~np.uint64(0)), fps)]
        both, either = fps, fps
        while len(both) > LEAF:
            starts = np.arange(0, len(both), LEAF)
            both, either = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts)
            self.levels.append((~(both ^ either), both))

    def near(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions i < j whose codes differ in at most ``limit`` bits, in chunks."""
        top = len(self.levels) - 1
        size = len(self.levels[top][0])
        i, j = np.triu_indices(size)
        stack = [(top, i, j, np.zeros(len(i), np.uint8), np.zeros(len(i), np.uint64))]
        while stack:
            level, i, j, spent, seen = stack.pop()
            mask, value = self.levels[level]
            shared = mask[i] & mask[j]
            spent = spent + np.bitwise_count((value[i] ^ value[j]) & shared & ~seen)  # only bits not counted above
            keep = spent <= limit
            i, j, spent, seen = i[keep], j[keep], spent[keep], shared[keep]
            if level == 0:
                keep = i < j
                yield i[keep], j[keep]
                continue
            below = len(self.levels[level - 1][0])
            for at in range(0, len(i), PAIRS // LEAF**2):
                part = slice(at, at + PAIRS // LEAF**2)
                a = (i[part, None, None] * LEAF + np.arange(LEAF)[None, :, None]).repeat(LEAF, 2).ravel()
                b = (j[part, None, None] * LEAF + np.arange(LEAF)[None, None, :]).repeat(LEAF, 1).ravel()
                ok = (a < below) & (b < below) & (a <= b)
                rows = np.repeat(np.arange(len(i))[part], LEAF**2)[ok]
                stack.append((level - 1, a[ok], b[ok], spent[rows], seen[rows]))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked positions the least label among them, until nothing changes."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(label, up := label[label]):
            label[:] = up
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]


def forest(fps: np.ndarray, run: np.ndarray, limit: int) -> np.ndarray:
    """Least position that links join each position to; codes compare only within equal, adjacent ``run`` values."""
    label = np.arange(len(fps))
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(fps)])
    small = np.repeat(sizes <= LEAF, sizes)
    for step in range(1, LEAF):  # runs of one leaf
        i = np.flatnonzero(small[:-step] & (run[step:] == run[:-step])) if len(fps) > step else np.empty(0, int)
        near = np.bitwise_count(fps[i] ^ fps[i + step]) <= limit
        _merge(label, i[near], i[near] + step)
    for start, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        for i, j in _Levels(fps[start : start + size]).near(limit):
            _merge(label, i + start, j + start)
    return label


def near_links(codes: DataFrame, limit: int = 4) -> DataFrame:
    """``codes(fp long)``, all different, to links ``(a, b)`` that join every two codes within ``limit`` bits.

    Links within a node are returned as a spanning forest, so copies by the thousand give links in proportion.
    Nodes of more than ``TILE`` codes are compared tile by tile in separate tasks; none is cut short.
    """
    top = F.array(*(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in masks(limit)))
    rows = codes.select("fp", F.posexplode(top).alias("mask_no", "mask")).select(
        "fp", "mask_no", F.expr("fp & mask").alias("pattern")
    )
    nodes = rows.groupBy("mask_no", "pattern").count().filter("count > 1")
    nodes = written(nodes.select("mask_no", "pattern", F.expr(f"int(ceil(count / {TILE}))").alias("tiles")))
    placed = rows.join(nodes, ["mask_no", "pattern"]).withColumn("tile", F.expr("int(pmod(xxhash64(fp, 7), tiles))"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).select(
        "fp", "mask_no", "pattern", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2")
    )
    key = ["mask_no", "pattern", "t1", "t2"]
    task = F.xxhash64(*key).alias("task")
    placed = placed.select(task, *key, "fp").repartition("task").sortWithinPartitions("task", *key)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            cols = [table.column(k).to_numpy() for k in key]
            fps = table.column("fp").to_numpy().view(np.uint64)
            changed = np.zeros(len(fps), bool)
            for c in cols:
                changed[1:] |= c[1:] != c[:-1]
            run = np.cumsum(changed)
            order = np.lexsort((gray_rank(fps), run))
            fps = fps[order]
            root = forest(fps, run, limit)
            linked = root != np.arange(len(root))
            a, b = fps[root[linked]].view(np.int64), fps[linked].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in it:
            held.append(batch)
            count += batch.num_rows
            if count < 1 << 17:
                continue
            table = pa.Table.from_batches(held)
            end = table.num_rows
            last = [table.column(k)[end - 1].as_py() for k in key]
            same = np.ones(end, bool)
            for k, v in zip(key, last):
                same &= table.column(k).to_numpy() == v
            cut = int(np.argmax(same))  # the last run may go on in the next batch
            if cut:
                yield solve(table.slice(0, cut))
                held, count = table.slice(cut).combine_chunks().to_batches(), end - cut
        if count:
            yield solve(pa.Table.from_batches(held))

    return placed.mapInArrow(batches, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = 4
) -> DataFrame:
    """``(id, fingerprint, component_id)``: groups of documents whose fingerprints are joined by links.

    Fingerprints link at ``limit`` or fewer differing bits; component_id is the smallest id that links reach. Equal
    fingerprints always link, fingerprint zero of texts without words too. Repeated rows each keep a row. A null id
    is no candidate for component_id; a component of null ids alone has a null component_id.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle))
    codes = written(fps.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(near_links(codes.select("fp"), limit))
    joined = codes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    joined = written(joined.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    members = written(joined.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return fps.join(members, "fp").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
