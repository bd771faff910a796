"""Byte-level byte-pair encoding of overlapping chunks, stitched where pre-token boundaries resynchronise."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swayscan.llm.tables import keep_only, written

CHUNK = 1 << 16  # characters of a chunk
AHEAD = 1 << 10  # characters of the next chunk that a chunk sees
SETTLED = 4  # characters behind a boundary that may still move it: the pattern looks no further
BATCH = 1 << 20  # ids of a result batch
KEPT = 100_000  # pieces that a worker remembers since it last set the older ones aside
LONGEST = 64  # characters of the longest piece that is remembered

# Letters and numbers of Unicode 17 and later, which the library's Unicode 16 takes for other characters.
NEWER = (
    "՘֋֌࢏౜೜₏₝-₟꟎꟏꟒꟔꟝꟢꟱꭬꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
KINDS = {"L": rf"[\p{{L}}--[{NEWER}]]+", "N": rf"[\p{{N}}--[{NEWER}]]+", "s": r"\s+"}
"""What a splitting pattern may name as ``\\p{L}``, ``\\p{N}`` and ``\\s``."""


def _ranges(kind: str, limit: int) -> str:
    """The characters of a kind below a limit, as the inside of a character class."""
    every = "".join(map(chr, [*range(min(limit, 0xD800)), *range(0xE000, limit)]))
    runs = regex.findall(KINDS[kind], every, flags=regex.VERSION1)
    return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in runs)


def splitter(pattern: str, limit: int) -> re.Pattern:
    """A splitting pattern with its kinds spelled out, for texts of characters below a limit: plain classes are faster."""
    out, in_class = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        kind = part[3] if part.startswith("\\p") else part[1:] if part in (r"\s", r"\S") else ""
        if kind:
            inside = _ranges(kind if kind != "S" else "s", limit)
            part = inside if in_class and kind != "S" else f"[^{inside}]" if kind == "S" else f"[{inside}]"
        elif part in "[]":
            in_class = part == "["
        out.append(part)
    return re.compile("".join(out))


class _Memory(dict):
    """Ids by piece. Recent ones are kept, and as many older ones that move up when they are met again."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = np.array(self.make(piece.encode("utf-8")), np.int32).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class ByteTokenizer:
    """Ranks of byte strings read from a rank file, and the pattern that splits texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, file))}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.ascii, self.plane, self.every = (splitter(pattern, limit) for limit in (0x80, 0x10000, 0x110000))
        self.seen = _Memory(self.merged)

    def pieces(self, text: str, start: int = 0) -> list[str]:
        """Pre-tokens from ``start`` on; together they are the text."""
        if text.isascii():
            return self.ascii.findall(text, start)
        in_plane = len(text.encode("utf-16-le")) == 2 * len(text)
        return (self.plane if in_plane else self.every).findall(text, start)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of least rank merges first, of equal ones that further left."""
        ranks, size = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        return self._few(piece) if size <= LONGEST else self._many(piece)

    def _few(self, piece: bytes) -> list[int]:
        """Looks through all pairs for each merge."""
        ranks = self.ranks
        none = len(self.tokens)
        parts = [piece[at : at + 1] for at in range(len(piece))]
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < none:
            at = pairs.index(least)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        return [ranks[part] for part in parts]

    def _many(self, piece: bytes) -> list[int]:
        """Keeps the pairs in a heap, for long pieces."""
        ranks, size = self.ranks, len(piece)
        stop_of = list(range(1, size + 1))  # end of the part that begins here; 0 inside a part
        before = list(range(-1, size))
        heap = [(ranks[pair], at, at + 2) for at in range(size - 1) if (pair := piece[at : at + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, at, stop = heapq.heappop(heap)
            middle = stop_of[at]
            if not middle or middle >= size or stop_of[middle] != stop:
                continue  # one of the two has merged with another since
            stop_of[at], stop_of[middle], before[stop] = stop, 0, at
            if stop < size and (rank := ranks.get(piece[at : stop_of[stop]])) is not None:
                heapq.heappush(heap, (rank, at, stop_of[stop]))
            left = before[at]
            if left >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (rank, left, stop))
        out, at = [], 0
        while at < size:
            out.append(ranks[piece[at : stop_of[at]]])
            at = stop_of[at]
        return out

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.seen.__getitem__, pieces)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return keep_only(("bytebpe", path, pattern), lambda: ByteTokenizer(path, pattern))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)])))


def _encoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows whose last columns are ``text``, ``start`` and ``spare``, with these replaced by ``ids``.

    Pieces are taken from ``start`` on, up to ``spare`` characters before the end, where a boundary must be.
    """
    kept = rows.columns[:-3]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in it:
            found, since, size = [], 0, 0
            texts, starts, spares = (batch.column(len(kept) + k) for k in range(3))
            for at in range(batch.num_rows):
                pieces, spare = tokenizer.pieces(texts[at].as_py() or "", starts[at].as_py()), spares[at].as_py()
                while spare > 0:
                    spare -= len(pieces.pop())
                found.append(tokenizer.ids(pieces))
                size += len(found[-1])
                if size >= BATCH or at == batch.num_rows - 1:
                    columns = [batch.column(k).slice(since, len(found)) for k in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*columns, _lists(found)], names=[*kept, "ids"])
                    found, since, size = [], at + 1, 0

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(batches, f"{fields}, ids array<int>")


def _cut(rows: DataFrame, chunk: int, ahead: int) -> DataFrame:
    """Long texts in chunks: ``(key, no, id, body, next)``; ``next`` is what a chunk sees of the next one."""
    bodies = rows.withColumn("key", F.monotonically_increasing_id()).select(
        "key", "id", F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{chunk}}})"), 1).alias("bodies")
    )

    def part(no):
        following = F.coalesce(F.get("bodies", no + 1), F.lit(""))
        return F.struct(no.alias("no"), F.get("bodies", no).alias("body"), F.left(following, F.lit(ahead)).alias("next"))

    parts = F.transform(F.sequence(F.lit(0), F.size("bodies") - 1), part)
    return bodies.select("key", "id", F.explode(parts).alias("c")).select("key", "c.no", "id", "c.body", "c.next")


def _boundaries(chunks: DataFrame, path: str, pattern: str, ahead: int) -> DataFrame:
    """Boundaries where neighbours overlap: ``(key, no, head, tail)``.

    ``head`` counts from the chunk's own beginning, ``tail`` from the next chunk's. A boundary counts as settled
    if the text behind it cannot move it.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in it:
            heads, tails = [], []
            for body, following in zip(batch.column("body"), batch.column("next")):
                body, following = body.as_py(), following.as_py()
                pieces = tokenizer.pieces(body + following)
                ends = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
                ends = ends[ends <= len(body) + len(following) - SETTLED]
                heads.append(ends[ends <= ahead])
                tails.append(ends[ends >= len(body)] - np.int32(len(body)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("no"), _lists(heads), _lists(tails)], names=["key", "no", "head", "tail"]
            )

    return chunks.mapInArrow(batches, "key long, no int, head array<int>, tail array<int>")


def _stitched(chunks: DataFrame, path: str, pattern: str, ahead: int) -> DataFrame:
    """Chunks with the stretch that each one encodes: ``(key, no, id, text, start, spare)``.

    Splitting only looks forward. So where the splits of two neighbours share a boundary they agree behind it, and if
    all neighbours do, each chunk's own split holds from the boundary it shares with the chunk before. Chunks that
    share none with the one before (a piece longer than the overlap) are joined to it and split again.
    """
    while True:
        marks = written(_boundaries(chunks, path, pattern, ahead))
        order = Window.partitionBy("key").orderBy("no")
        shared = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
        starts = marks.select("key", "no", F.when(F.lag("no").over(order).isNull(), 0).otherwise(shared).alias("start"))
        following = F.coalesce(F.lead("start").over(order), F.lit(0))
        unit = F.count("start").over(order)
        seams = written(starts.select("key", "no", "start", unit.alias("unit"), following.alias("following")))
        rows = chunks.join(seams, ["key", "no"])
        if seams.filter("start is null").isEmpty():
            text, spare = F.concat("body", "next"), F.length("next") - F.col("following")
            return rows.select("key", "no", "id", text.alias("text"), "start", spare.cast("int").alias("spare"))
        joined = rows.groupBy("key", "unit").agg(
            F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("no", "body", "next"))).alias("c")
        )
        body = F.array_join(F.transform("c", lambda c: c["body"]), "")
        last = F.element_at("c", -1)["next"]
        chunks = written(joined.select("key", F.col("unit").cast("int").alias("no"), "id", body.alias("body"), last.alias("next")))


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, ahead: int = AHEAD,
) -> DataFrame:
    """``(id, ids array<int>)`` per row of ``docs``, for the rank file at ``path`` and the splitting ``pattern``.

    ids are those of the tiktoken library without special tokens. A text of more than ``chunk`` characters is cut
    into chunks that tasks share; what comes back together is one text's ids. ``pattern`` must look no further than
    SETTLED characters behind a boundary, must not look back, and must leave no character out. A null text counts as
    empty and gives no ids; rows with a null or repeated id, and equal rows, are each encoded; other columns are left
    alone. The path must be readable on every worker.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    whole = source.filter(F.length("text") <= chunk).select("id", "text", F.lit(0).alias("start"), F.lit(0).alias("spare"))
    long = source.filter(F.length("text") > chunk)
    chunks = written(_cut(long, chunk, ahead).repartition("key", "no"))
    parts = _encoded(_stitched(chunks, path, pattern, ahead), path, pattern)
    together = parts.groupBy("key").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("c"))
    ids = F.flatten(F.transform("c", lambda c: c["ids"]))
    return _encoded(whole, path, pattern).unionByName(together.select("id", ids.alias("ids")))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded``, the bytes of the column ``ids`` one after another. Null ids give null."""
    kept = encoded.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for batch in it:
            ids = batch.column(kept.index("ids"))
            shown = [None if not row.is_valid else tokenizer.decode(row.values.to_numpy()) for row in ids]
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(shown[at : at + 1000], pa.binary())], names=[*kept, "decoded"]
                )

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.mapInArrow(batches, f"{fields}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of rows with ``ids`` and ``decoded``."""
    return decoded.select(
        "id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
