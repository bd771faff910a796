"""Secret scans: fixed patterns, and literals assigned to sensitive names."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swayscan.llm.tables import keep_only

KINDS = ("assign", "access", "hex", "literal")
LEAST = 0.5  # score from which an assigned literal is reported
SPACED = 0.6  # what a literal with spaces scores of one without, so that only the surest names report it
HEAD = 256  # bytes of a value that placeholders are told by

# The contract's patterns (fixed values). Letters match in either case for the first only.
_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_LEAST = {"assign": 6, "access": 20, "hex": 24}
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_ONLY_HEX = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
_OPERATOR = re.compile(rb":=|=>|[=:]")
_NAME = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-.$")
_SPACE = frozenset(b" \t")
_QUOTED = re.compile(rb'"((?:[^"\\\n]|\\.)*+)"|\'((?:[^\'\\\n]|\\.)*+)\'|`((?:[^`\\\n]|\\.)*+)`')
_WORD = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$.]*+")
_BARE = re.compile(rb"[^\s\"'`,;#(){}\[\]<>=:]++(?:={1,2}(?=[\s,;]|\Z))?")
_PLUS = re.compile(rb"[ \t]*+(?:\+|\.\.)[ \t]*+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLAIN = re.compile(
    rb"(?i)(?:true|false|null|none|undefined|changeme|example|placeholder|your(?:[ _.-]*+(?:api|app|client|account|access|private|"
    rb"secret|token|key|password|passwd|passphrase|pass|pwd|auth|user|name|id|value|string|own|new|here|goes))*+[ _.-]*+|"
    rb"(?:please |enter |type |choose |forgot )+your .*|x+|\*+|\.+|[0-9.:-]+)\Z"
)
#: A type between a name's colon and an equals sign, as in "pwd: Optional[str] = "; a colon ends it, so that scans stay linear.
_TYPED = re.compile(
    rb"""[ \t]*+&?(?:'static[ \t]++)?([A-Za-z_][\w.]*+(?:::[A-Za-z_]\w*+){0,8})(?:\[[^\n=;:]*+|<[^\n=;:]*+>)?(?:[ \t]*+\|[ \t]*+\w++){0,8}[?!]?[ \t]*+(?==(?![=>]))"""
)
_TYPES = frozenset(
    b"str string bytes bytearray char text varchar any object final optional option secretstr cow std::string std::string::string".split()
)
_ALIKE = [frozenset(x) for x in (b"xX", b"*", b".", b"0123456789.:-")]
_KEY = re.compile(rb"""(?:\"\"\"|\'\'\'|["'`])\s*+(-----BEGIN [A-Z0-9 ]*KEY-----[^"'`]*?-----END [A-Z0-9 ]*KEY-----)""")

#: Parts of a target's name, and how surely a literal bound to it is a secret.
_NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "credential": 1.0,
    "credentials": 1.0, "apikey": 1.0, "pass": 0.7, "bearer": 0.7, "auth": 0.6, "authorization": 0.7, "pin": 0.5,
}
_BEFORE_KEY = {"api", "access", "private", "secret", "signing", "encryption", "auth", "master", "account"}


class Span(NamedTuple):
    kind: str
    start: int  # code points
    end: int
    value_start: int
    value_end: int


def _ascii(text: str) -> bytes:
    """One byte for each code point; what is not ASCII becomes a question mark, which no pattern names."""
    return text.encode("ascii", "replace")


def base_spans(data: bytes) -> list[Span]:
    """Leftmost, non-overlapping matches of each kind that are long enough, by start and then kind."""
    found = []
    lower = data.lower()
    if any(hint in lower for hint in _HINTS):
        for m in _ASSIGN.finditer(data):
            if len(m[2]) >= _LEAST["assign"]:
                found.append(Span("assign", m.start(), m.end(), m.start(2), m.end(2)))
    if b"AKIA" in data:
        found += [Span("access", *m.span(), *m.span()) for m in _ACCESS.finditer(data) if len(m[0]) >= _LEAST["access"]]
    if b"h" * _LEAST["hex"] in data.translate(_ONLY_HEX):
        found += [Span("hex", *m.span(), *m.span()) for m in _HEX.finditer(data) if len(m[0]) >= _LEAST["hex"]]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def name_score(name: str) -> float:
    """How sensitive a target's name is: the strongest of its parts, split at case, digits and punctuation."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    score = max((_NAMES.get(p, 0.0) for p in parts), default=0.0)
    if any(a in _BEFORE_KEY and b == "key" for a, b in zip(parts, parts[1:])):
        score = 1.0
    return score


class Value:
    """What a name is bound to: how often each byte occurs, the beginning, and the places of its literals.

    A joined value refers to the places of its parts instead of copying them, so a chain of joins costs the same at
    every step.
    """

    __slots__ = ("counts", "size", "head", "tree")

    def __init__(self, data: bytes = b"", place: tuple[int, int] | None = None):
        self.counts: dict[int, float] = Counter(data)
        self.size, self.head, self.tree = float(len(data)), data[:HEAD], [] if place is None else [place]

    @classmethod
    def joined(cls, values: list[Value]) -> Value:
        if len(values) == 1:
            return values[0]
        whole = cls()
        for v in values:
            for byte, n in v.counts.items():
                whole.counts[byte] = whole.counts.get(byte, 0) + n
            whole.size += v.size
            if len(whole.head) < HEAD:
                whole.head = (whole.head + v.head)[:HEAD]
            whole.tree.append(v.tree)
        if whole.size > 1e200:  # of names that double again and again; only shares count there
            whole.counts = {byte: n * 1e-150 for byte, n in whole.counts.items()}
            whole.size *= 1e-150
        return whole

    def places(self) -> Iterator[tuple[int, int]]:
        """Places of literals that were not given before."""
        stack: list = [self.tree]
        while stack:
            item = stack.pop()
            if isinstance(item, tuple):
                yield item
            else:
                stack += item[::-1]
                item.clear()


def literal_score(value: Value) -> float:
    """How much a literal looks like a secret: long enough, varied, no placeholder; less if it has spaces."""
    if value.size < 6 or _placeholder(value):
        return 0.0
    shares = [n / value.size for n in value.counts.values()]
    bits = -sum(p * math.log2(p) for p in shares if p > 0)
    return min(1.0, bits / 2.5) * (SPACED if value.counts.get(32) else 1.0)


def _placeholder(value: Value) -> bool:
    if value.size <= HEAD:
        return _PLAIN.match(value.head) is not None
    return any(value.counts.keys() <= alike for alike in _ALIKE)  # of one kind of filler throughout




def _target(data: bytes, at: int) -> str:
    """The name left of an operator, with or without quotes and brackets around it."""
    while at and data[at - 1] in _SPACE:
        at -= 1
    while at and data[at - 1] in b"\"'`]":
        at -= 1
    end = at
    while at and data[at - 1] in _NAME:
        at -= 1
    return data[at:end].decode("ascii")


def _operands(data: bytes, at: int) -> Iterator[tuple[str, int, int]]:
    """Literals and names joined by a plus from ``at``: ("text" or "name" or "bare", start, end)."""
    while True:
        if m := _KEY.match(data, at):
            yield "text", *m.span(1)
        elif m := _QUOTED.match(data, at):
            yield "text", *m.span(m.lastindex)
        elif m := _WORD.match(data, at):
            bare = _BARE.match(data, at)
            if bare and bare.end() > m.end():  # as in "abc-1=": no name of a program
                m = bare
                yield "bare", *m.span()
            else:
                yield "name", *m.span()
        elif m := _BARE.match(data, at):
            yield "bare", *m.span()
        else:
            return
        plus = _PLUS.match(data, m.end())
        if not plus:
            return
        at = plus.end()


def assigned_spans(data: bytes) -> list[Span]:
    """Literals that reach a sensitive name, directly or through names that hold them.

    Each ``name = value``, ``name: value``, ``name => value`` and ``name := value`` binds the name to the literals of
    the value, and so does ``name: type = value``; a name in a value stands for what it was last bound to. A literal
    is reported once, where it stands, if the product of the target's and the value's scores is high enough.
    """
    bound: dict[str, Value] = {}
    found: dict[tuple[int, int], Span] = {}
    typed: dict[int, str] = {}  # the name with a type before an equals sign at that place
    for m in _OPERATOR.finditer(data):
        if data[m.end() : m.end() + 1] == b"=" or data[m.start() - 1 : m.start()] in (b"=", b"!", b"<", b">"):
            if m.start() not in typed:  # after a type in angle brackets it assigns
                continue  # a comparison
        name = _target(data, m.start())
        names = [typed.pop(m.start(), ""), name]
        if m[0] == b":":
            name = name or _target(data, m.start() - (data[m.start() - 1 : m.start()] in (b"?", b"!")))
            if name and (t := _TYPED.match(data, m.end())):
                typed[t.end()] = name
                if t[1].lower() in _TYPES:
                    continue
            names = [name]
        elif names[0] and names[1].encode().lower() in _TYPES:
            names.pop()
        names = list(dict.fromkeys(filter(None, names)))
        if not names:
            continue
        at = m.end()
        while data[at : at + 1] in (b" ", b"\t"):
            at += 1
        parts: list[Value] = []
        for kind, start, end in _operands(data, at):
            known = bound.get(data[start:end].decode("ascii")) if kind == "name" else None
            if known:
                parts.append(known)
            elif kind != "name" or not parts:
                parts.append(Value(data[start:end], (start, end)))
        if not parts:
            continue
        value = Value.joined(parts)
        bound |= dict.fromkeys(names, value)
        if max(map(name_score, names)) * literal_score(value) >= LEAST:
            for start, end in value.places():
                found[start, end] = Span("literal", start, end, start, end)
    return list(found.values())


def scan(text: str) -> list[Span]:
    """All spans of a text. A literal that a base span covers is not reported again."""
    data = _ascii(text)
    base = base_spans(data)
    if b"=" not in data and b":" not in data:
        return base
    starts = [s.start for s in base]
    reach = [0, *accumulate((s.end for s in base), max)]  # furthest end of the first spans
    added = [s for s in assigned_spans(data) if reach[bisect_right(starts, s.start)] < s.end]
    return sorted(base + added, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int64()) for n in Span._fields[1:])]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` per row of ``docs``; spans is an array of ``kind, start, end, value_start, value_end``.

    Offsets are code points, ends exclusive; the value is the part to hide. A null or empty text has no spans;
    repeated rows repeat. Kinds assign, access and hex are fixed patterns, literal comes from assignments. Whole
    texts are scanned.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in it:
            spans = [[s._asdict() for s in scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["id", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    fields = "kind string, " + ", ".join(f"{n} long" for n in Span._fields[1:])
    return source.mapInArrow(batches, f"id {kind}, spans array<struct<{fields.replace(' ', ':').replace(',:', ', ')}>>")


def hide(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with the value of every span replaced; values that overlap are replaced together."""
    out, at = [], 0
    for start, end in sorted((s.value_start, s.value_end) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


@F.arrow_udf(T.StringType())
def _hidden(texts: pa.Array) -> pa.Array:
    keep_only()
    values = (t.as_py() for t in texts)
    return pa.array((t if t is None else hide(t, scan(t)) for t in values), pa.string(), size=len(texts))


def hidden(text: Column | str) -> Column:
    """A text column with secrets replaced by ``[secret]``; null stays null."""
    return _hidden(text)


def digests(found: DataFrame) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)`` of found rows; spans as ``kind:start:end`` by start."""
    line = "concat_ws(':', s.kind, s.start, s.end)"
    counts = [F.expr(f"bigint(size(filter(spans, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.expr(f"array_join(transform(filter(spans, s -> s.kind <> 'literal'), s -> {line}), ',')")
    every = F.expr(f"array_join(transform(spans, s -> {line}), ',')")
    return found.select("id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
