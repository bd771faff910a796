"""Text sources and sinks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swayscan.functions.text import MAX_CHARS

MAX_BYTES = 4 * MAX_CHARS
"""Byte ceiling of a text file; a longer one cannot be a text the scan accepts."""


def decoded(content: Column) -> tuple[Column, Column]:
    """Text and reject reason of a file's bytes; line endings stay as they are."""
    valid = F.is_valid_utf8(content)
    text = F.when(valid, F.decode(content, "UTF-8"))
    reason = (
        F.when(F.octet_length(content) > MAX_BYTES, "too many bytes")
        .when(~valid, "not valid UTF-8")
        .when(F.length(text) > MAX_CHARS, "text is too long")
    )
    return F.when(F.octet_length(content) <= MAX_BYTES, text), reason


def read_utf8_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``path, text, reject_reason``; line endings stay as they are.

    The ceiling is tested on the file's length, which Spark knows before it
    reads the content, so oversized files are never loaded. Spark's reader
    leaves out files of no bytes.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= MAX_BYTES).select("path", "content")
    text, reason = decoded(F.col("content"))
    read = small.select("path", text.alias("text"), reason.alias("reject_reason"))
    large = files.where(F.col("length") > MAX_BYTES).select(
        "path", F.lit(None).cast("string").alias("text"), F.lit("too many bytes").alias("reject_reason")
    )
    return read.unionByName(large)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder, in any store that Arrow knows."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


def write_files(files: DataFrame, folder: str) -> int:
    """Rows ``name, content`` as a file each, in place of all that the folder held; how many there are.

    Names are unique and may hold folders. Spark's writer takes a folder, a checksum and, without native libraries, a
    process for each file. A file gets its name when it is whole, so an attempt that is repeated leaves the same files.
    """
    store, base = _store(folder)
    store.delete_dir_contents(base, missing_dir_ok=True)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
        made = set()
        for batch in it:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                path = f"{base}/{name}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/_{uuid.uuid4().hex}"  # which Spark's readers leave out
                with store.open_output_stream(part, compression=None) as out:
                    out.write(content.as_buffer())
                store.move(part, path)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return files.select("name", "content").mapInArrow(each, "n long").agg(F.sum("n")).first()[0] or 0


def ascii_json(value) -> F.Column:
    """JSON text with every character outside ASCII escaped as UTF-16 units."""
    text = F.to_json(value)
    letters = F.split(text, "")
    escaped = F.transform(
        letters,
        lambda c: F.when(F.octet_length(c) == 1, c).otherwise(
            F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        ),
    )
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.array_join(escaped, ""))


def result_json() -> F.Column:
    """A scanned row's result as one JSON object, fields in their fixed order."""
    counts = F.create_map(
        *(v for t in (1, 2, 3) for v in (F.lit(str(t)), F.col(f"counts.tier_{t}")))
    )
    return ascii_json(F.struct("rules_version", "rules_hash", "moves", counts.alias("counts")))


def write_scan_json(scanned: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON result per line, in as many files as there are partitions."""
    scanned.select(result_json().alias("value")).write.mode(mode).text(path)


def write_moves(moves: DataFrame, path: str, mode: str = "error") -> None:
    """Move rows as parquet."""
    moves.write.mode(mode).parquet(path)
