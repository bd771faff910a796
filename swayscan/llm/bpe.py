"""Byte-pair encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayscan.llm.tables import keep_only

ROWS = 1000  # documents of a result batch
KEPT = 100_000  # words and chunks that a worker remembers since it last set the older ones aside
PAIRS = 20_000  # tokens whose tests a worker remembers
LONGEST = 64  # characters of the longest chunk or word that is remembered
_NOT_SPLIT = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the pattern does not


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of every byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {b: hidden.get(b, chr(b)) for b in range(256)}


class _Memory(dict):
    """Results by text. The most recent are kept, and as many older ones that move up when they are met again."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Tokenizer:
    """A word BPE read from a tokenizers file with byte-level symbols and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in chain(self.ids.items(), self.special.items())}
        self.names = np.array([tokens.get(i) for i in range(max(tokens) + 1)], object)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bytes = _byte_characters()
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.rank, self.halves = {}, {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (self.ids[p] for p in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = self.ids[tokens[left] + tokens[right]]
            self.rank[left, right] = rank
            self.halves[whole] = (left, right, rank)
        self.whole: dict[int, bool] = {}
        self.fits: dict[int, dict[int, bool]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if self._whole(i):
                closed = token.endswith(self.end)
                body = token[: -len(self.end)] if closed else token
                # the newline, which stands for no byte, closes a word and adds no symbol
                self.automaton.add_word(body + "\n" * closed, (i, len(body), 1 - closed))
        self.automaton.make_automaton()
        self.seen = _Memory(self._chunk)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Parts of a token along its left (0) or right (1) edge, each with the rank of the merge that consumes it."""
        edge, used = [], float("inf")
        while True:
            edge.append((token, used))
            if token not in self.halves:
                return edge
            *halves, used = self.halves[token]
            token = halves[side]

    def _fits(self, x: int, y: int, joined: bool = False) -> bool:
        """True if merging never crosses the border of two neighbouring tokens (``joined``: before they merge).

        Parts on both sides of the border merge if their pair's rank comes before the merges that consume them
        inside their own token. At equal rank the merge further left comes first.
        """
        right = self._edge(y, 0)
        for a, a_used in self._edge(x, 1):
            for b, b_used in right:
                if joined and (a, b) == (x, y):
                    continue
                rank = self.rank.get((a, b))
                if rank is not None and rank < a_used and rank <= b_used:
                    return False
        return True

    def _whole(self, token: int) -> bool:
        """True if the token's own characters are encoded as the token."""
        known = self.whole.get(token)
        if known is None:
            known = True
            if token in self.halves:
                left, right, _ = self.halves[token]
                known = self._whole(left) and self._whole(right) and self._fits(left, right, True)
            self.whole[token] = known
        return known

    def word(self, word: str) -> list[int]:
        """Ids of one word: for each prefix the one last token that fits, then back along the prefixes."""
        symbols = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes)
        size, fits = len(symbols), self.fits
        last: list[int | None] = [None] * (size + 1)
        start = [0] * (size + 1)
        for at, (token, length, opened) in self.automaton.iter(symbols + "\n"):
            stop = at + opened
            if last[stop] is not None or (opened and stop == size):
                continue
            before = stop - length
            if before:
                previous = last[before]
                try:
                    fit = fits[previous][token]
                except KeyError:
                    fit = previous is not None and self._fits(previous, token)
                    fits.setdefault(previous, {})[token] = fit
                if not fit:
                    continue
            last[stop], start[stop] = token, before
        if len(fits) > PAIRS:
            fits.clear()
        out, at = [], size
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def _chunk(self, chunk: str) -> bytes:
        """Ids, 32 bits each, of a word, or of other characters without white space between them."""
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        words = self.pattern.findall(text.lower())
        if words == [chunk]:
            return np.array(self.word(chunk), np.int32).tobytes()
        return b"".join([self.seen[word] for word in words])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, piece by piece. Words never reach across white space or special tokens."""
        found = []
        for part in self.special_pattern.split(text) if "<|" in text else (text,):
            if part in self.special:
                found.append(np.int32(self.special[part]).tobytes())
            elif _NOT_SPLIT.search(part):
                found.extend(map(self._chunk, filter(None, regex.split(r"\p{White_Space}+", part))))
            else:
                found.extend(map(self.seen.__getitem__, part.split()))
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids) -> str:
        """The file has no decoder: tokens are joined by a space as they stand in the vocabulary."""
        return " ".join(filter(None, self.names[np.asarray(ids, np.int64)]))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` per row of ``docs``, for the tokenizer file at ``path``.

    ids are those that the tokenizers library gives without adding special tokens, truncation or padding; special
    tokens that a text holds are recognised. decoded is what the ids decode to, special tokens included. A null text
    counts as empty and gives no ids and an empty decoded text. Every row is encoded by itself: repeated rows repeat.
    The path must be readable on every worker. Texts are taken whole; a worker remembers a bounded number of chunks.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = keep_only(("bpe", path), lambda: Tokenizer(path))
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, decoded = [], []
                for text in part.column(1).to_pylist():
                    ids.append(tokenizer.encode(text or ""))
                    decoded.append(tokenizer.decode(ids[-1]))
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"]
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(batches, f"id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of encoded rows."""
    return encoded.select(
        "id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
