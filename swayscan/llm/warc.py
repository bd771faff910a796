"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swayscan.llm.tables import shared_folder, written

LINES = 1000  # captures of a compressed index block
ROWS = 20_000  # captures of an index file, about; more once there are FILES of them
FILES = 4096  # index files at most, so that a list of them is small
FILE = 1 << 28  # bytes after which a task begins another archive
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HAS_ID, _LOW = 1 << 64, (1 << 64) - 1


class Archive(NamedTuple):
    """Where an archive lies: ``directory`` has a row per index block, ``captures`` one per record."""

    directory: DataFrame
    captures: DataFrame


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and folder of a path, for any store that Arrow knows."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def sort_key(url: str | None, page_id: int | None) -> str:
    """Host parts in reverse, path and query, then the id: captures of a site sort together, in a total order."""
    try:
        parts = urlsplit(url or "")
        host, path = parts.hostname or "", (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:  # no valid address
        host, path = "", url or ""
    host = re.sub(r"^www\d*\.", "", host)
    surt = quote(f"{','.join(reversed(host.split('.')))}){path}", safe="/:?&=,;@!$'()*+~#[]%")
    return f"{surt} {'-' if page_id is None else f'{page_id + 2**63:020d}'}"


@F.arrow_udf(T.StringType())
def _sort_keys(urls: pa.Array, ids: pa.Array) -> pa.Array:
    return pa.array(map(sort_key, urls.to_pylist(), ids.to_pylist()), pa.string())


def _record_id(page_id: int | None) -> str:
    number = 0 if page_id is None else _HAS_ID | (page_id & _LOW)
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def _page_id(record_id: str | None) -> int | None:
    number = uuid.UUID(record_id[len("<urn:uuid:") : -1]).int if record_id else 0
    low = number & _LOW
    return None if not number & _HAS_ID else low - (1 << 64) if low >> 63 else low


def record(url: str | None, page_id: int | None, payload: bytes, first: int | None) -> bytes:
    """One record: a response, or a revisit without payload if ``first`` is another page's id."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = first is not None and first != page_id
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": _record_id(first) if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items() if value is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _page_id(fields.get("WARC-Refers-To")),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def write(pages: DataFrame, folder: str | None = None) -> Archive:
    """Write a record for every row of ``pages(page_id, url, html)`` and index them.

    The payload is the html in UTF-8 (null: empty). Of equal payloads the smallest page_id is a response, the others
    are revisits that refer to it; rows that repeat the smallest id are responses too, and rows with a null id are
    responses only if no row of their payload has an id. A null url is left out of the record.

    A task writes its own archive under a name no other attempt uses and returns where each record lies; only what
    successful tasks return is indexed, so lost executors leave at most files that nothing names.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    source = source.withColumn("digest", F.sha1("payload"))
    firsts = source.groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = source.join(firsts, "digest").select("url", "page_id", "payload", "first")

    def archives(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _folder(folder)
        out, name, at = None, None, 0
        for batch in it:
            rows = []
            for url, page_id, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= FILE:
                    if out:
                        out.close()
                    store.create_dir(base, recursive=True)
                    name, at = f"records-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = gzip.compress(record(url, page_id, payload, first), 6, mtime=0)
                out.write(data)
                rows.append((sort_key(url, page_id), name, at, len(data)))
                at += len(data)
            if out:
                out.flush()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "file", "at", "size"])
        if out:
            out.close()

    captures = written(joined.mapInArrow(archives, "key string, file string, at long, size long"))
    return Archive(_index(captures, folder), captures)


def _index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures by key into compressed blocks; a row of the directory has a block's first key and place."""
    files = min(FILES, max(1, -(-captures.count() // ROWS)))
    ordered = captures.repartitionByRange(files, "key", "file", "at").sortWithinPartitions("key", "file", "at")

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _folder(folder)
        name, at, rows, held = f"index-{uuid.uuid4().hex}.cdx.gz", 0, [], []
        lines = (line for batch in it for line in zip(*(c.to_pylist() for c in batch.columns)))
        line = next(lines, None)
        if line is None:
            return
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            while line is not None:
                held.append(line)
                line = next(lines, None)
                if len(held) == LINES or line is None:
                    text = "\n".join(f"{key}\t{file}\t{start}\t{size}" for key, file, start, size in held)
                    data = gzip.compress(text.encode("utf-8", "surrogatepass"), 6, mtime=0)
                    out.write(data)
                    rows.append((name, held[0][0], held[-1][0], at, len(data)))
                    at += len(data)
                    held = []
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*rows)], names=["file", "first_key", "last_key", "at", "size"]
        )

    schema = "file string, first_key string, last_key string, at long, size long"
    directory = written(ordered.mapInArrow(blocks, schema))
    return directory.withColumn("folder", F.lit(folder))


class _Reader:
    """Lookups of one task: the sparse directory of the files in reach, and the blocks and archives last used."""

    def __init__(self, folder: str, directory: list[tuple[str, str, str, int, int]]):
        self.store, self.base = _folder(folder)
        self.blocks = directory  # by first key
        self.firsts = [b[1] for b in directory]
        self.open: OrderedDict[str, fs.NativeFile] = OrderedDict()
        self.block, self.keys, self.lines = -1, [], []

    def _range(self, name: str, at: int, size: int) -> bytes:
        file = self.open.pop(name, None) or self.store.open_input_file(f"{self.base}/{name}")
        self.open[name] = file
        if len(self.open) > 32:
            self.open.popitem(last=False)[1].close()
        return gzip.decompress(file.read_at(size, at))

    def captures(self, key: str) -> Iterator[dict]:
        """Records of a key: binary search in the directory, in the block, then a range read of each record."""
        n = max(bisect_left(self.firsts, key) - 1, 0)  # repeated keys can begin at a block's end
        while n < len(self.blocks) and self.firsts[n] <= key:
            name, _, last, at, size = self.blocks[n]
            if last >= key:
                if n != self.block:
                    text = self._range(name, at, size).decode("utf-8", "surrogatepass")
                    self.lines = [line.split("\t") for line in text.split("\n")]
                    self.block, self.keys = n, [line[0] for line in self.lines]
                for line in self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]:
                    yield parse(self._range(line[1], int(line[2]), int(line[3])))
            n += 1


def read(archive: Archive, wanted: DataFrame) -> DataFrame:
    """Records of every capture whose ``url`` and ``page_id`` are among the rows of ``wanted``.

    Returns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` with a row per record;
    what is not in the archive gives no row. A key goes to the index file whose keys enclose it. There the sparse
    directory is searched for the block, the block for the lines, and the lines say which bytes of which archive to
    read. Keys come in the order of the index, so each block is read once.
    """
    keys = wanted.select(_sort_keys("url", "page_id").alias("key")).distinct()
    directory = archive.directory
    folder = directory.select("folder").first()
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    if folder is None:
        return wanted.sparkSession.createDataFrame([], fields)
    folder = folder[0]
    # a file's stretch of the directory travels with the keys that can be in it, and is read before them
    spread = directory.select("file", "first_key", "last_key", "at", "size")
    files = spread.groupBy("file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
    bounds = sorted((r["low"], r["high"], r["file"]) for r in files.collect())  # one row per index file
    lows = [b[0] for b in bounds]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def holders(keys: pa.Array) -> pa.Array:
        found = []
        for key in keys.to_pylist():
            n = bisect_right(lows, key)
            mine = []
            while n and bounds[n - 1][1] >= key:
                mine.append(bounds[n - 1][2])
                n -= 1
            found.append(mine)
        return pa.array(found, pa.list_(pa.string()))

    routed = keys.select("key", F.explode(holders("key")).alias("file"))
    rows = routed.select("file", "key", F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("size"), F.lit(1).alias("kind"))
    rows = rows.union(spread.select("file", "first_key", "last_key", "at", "size", F.lit(0)))
    # a number of its own, since a lookup is more work than its few bytes tell
    rows = rows.repartition(4 * len(bounds) or 1, "file").sortWithinPartitions("file", "kind", "key")

    def lookups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks, reader, out, held = None, [], None, [], 0
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in it:
            for file, key, last, at, size, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if file != current:
                    current, blocks, reader = file, [], None
                if kind == 0:
                    blocks.append((file, key, last, at, size))
                    continue
                reader = reader or _Reader(folder, blocks)
                for found in reader.captures(key):
                    out.append(found)
                    held += len(found["payload"] or b"")
                if held > 1 << 24 or len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(lookups, fields)
