"""Whitening, Merkle manifests and byte-level encoding against plain definitions."""

import base64
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from swayscan.llm import bytebpe, merkle, whitening
from swayscan.llm.queries import QUERIES

# --- whitening ----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x string, id string, z string, n string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in rows], VECTORS)


def whitened(spark, rows):
    return whitening.whiten(vectors(spark, rows)).collect()


def whole(v):
    return [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]


def check_against_numpy(rows, got, components):
    x = {i: whole(v) for i, v in rows}
    n, width = len(rows), len(next(iter(x.values())))
    sums = [sum(v[k] for v in x.values()) for k in range(width)]
    centred = {i: np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums)]) for i, v in x.items()}
    table = np.array(list(centred.values()))
    values = np.linalg.eigvalsh(table.T @ table / n)[::-1]
    assert {r.component for r in got} == set(range(1, components + 1)) and len(got) == n * components
    for r in got:
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.id], sums))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    by_component = {c: {r.id: r.whitened for r in got if r.component == c} for c in range(1, components + 1)}
    z = np.array([[by_component[c][i] for i in centred] for c in by_component]).T
    # each component is an eigenvector: the covariance with the data gives it back
    for c in range(components):
        direction = z[:, c] @ table / n / np.sqrt(values[c])
        assert np.linalg.norm(direction) == pytest.approx(1, rel=1e-9)
        assert np.allclose(table @ direction / np.sqrt(values[c]), z[:, c], atol=1e-7)
    return values


def test_whitening_meets_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(size=11) * np.arange(1, 12)]) for i in range(400)]
    check_against_numpy(rows, whitened(spark, rows), 8)


def test_whitening_of_repeated_and_missing_eigenvalues(spark):
    # a cross: the first three variances are equal, the rest is constant
    rows = [(2 * k + s, [0.0] * k + [float(1 - 2 * s)] + [0.0] * (5 - k)) for k in range(3) for s in range(2)]
    values = check_against_numpy(rows, whitened(spark, rows), 3)
    assert np.allclose(values[:3], values[0])


def test_whitening_leaves_out_what_takes_no_part(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(size=3)]) for i in range(20)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 2.0]), (54, [float("inf"), 0.0, 0.0]),
           (55, [1.0, 2.0]), (56, [1e30, 0.0, 0.0])]
    check_against_numpy(rows, whitened(spark, rows + odd), 3)
    assert whitened(spark, []) == [] and whitened(spark, odd[:2]) == []
    assert whitened(spark, rows[:1]) == [] and whitened(spark, [rows[0]] * 5) == []
    repeated = whitened(spark, [*rows, rows[3], (None, rows[4][1])])
    assert len(repeated) == 22 * 3 and repeated[0].n == 22


def test_whitening_of_long_numbers(spark):
    rows = [(i, [float(np.float32(1e12 * (i * i % 7 - 3))), float(i * i), float(np.float32(-1e9 * i))]) for i in range(9)]
    got = whitened(spark, rows)
    x = {i: whole(v) for i, v in rows}
    sums = [sum(v[k] for v in x.values()) for k in range(3)]
    exact = {i: sum((9 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    assert {r.id: r.deviation for r in got} == {i: v if v < 2**63 else None for i, v in exact.items()}
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-4


def test_scatter_and_polynomial_are_exact(spark):
    rng = random.Random(2)
    rows = [[rng.randint(-(2**k), 2**k) for k in (3, 19, 21, 45, 61)] for _ in range(60)]
    n, sums, matrix = whitening.scatter(spark.createDataFrame([(r,) for r in rows], "x array<long>"))
    assert n == 60 and sums == [sum(r[k] for r in rows) for k in range(5)]
    assert matrix == [[n * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j] for j in range(5)] for i in range(5)]
    poly = whitening.characteristic(spark, matrix)

    def determinant(m):
        m, out = [[Fraction(a) for a in row] for row in m], Fraction(1)
        for j in range(len(m)):
            at = next((i for i in range(j, len(m)) if m[i][j]), None)
            if at is None:
                return 0
            if at != j:
                m[at], m[j], out = m[j], m[at], -out
            out *= m[j][j]
            for i in range(j + 1, len(m)):
                m[i] = [a - m[i][j] / m[j][j] * b for a, b in zip(m[i], m[j])]
        return out

    for at in (0, 1, -7, 10**20, 3**60):
        value = determinant([[(at if i == j else 0) - matrix[i][j] for j in range(5)] for i in range(5)])
        assert value == sum(c * at**i for i, c in enumerate(poly))


def test_roots_are_counted_and_kept_apart():
    poly = [1]
    roots = [0, 0, 2, 2, 2, 5, 10**9, 10**9 + 1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - (r * poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert [whitening.roots_above(poly, a) for a in (-1, 0, 1, 2, 9, 10**9)] == [8, 6, 6, 3, 2, 1]
    simple = whitening.distinct_roots(poly)
    assert len(simple) == 6 and all(sum(c * r**i for i, c in enumerate(simple)) == 0 for r in set(roots))
    for number, (root, first, count) in enumerate([(10**9 + 1, 1, 1), (10**9, 2, 1), (5, 3, 1), (2, 4, 3), (2, 4, 3), (2, 4, 3)], 1):
        low, high, bits, *place = whitening.isolated(poly, simple, number)
        assert low < root << bits <= high and place == [first, count]


# --- Merkle manifest ----------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string, rank int, group string, leaf string, path int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proofs(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run = at[i] // 3 * 3
            path.append((nodes[run : at[i]], nodes[at[i] + 1 : run + 3]))
            at[i] //= 3
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def manifest_by_definition(rows):
    def leaf(*values):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups, out = {}, []
    for doc_id, source, lang, n_chars, text in rows:
        tampered = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            tampered = text.replace("\n", "")
        facts = (leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, tampered))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, *facts))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [proofs([r[2] for r in sorted(groups[s])]) for s in order]
    root, above = proofs([subroot for subroot, _ in trees])
    for source, (subroot, paths), upper in zip(order, trees, above):
        for (known, doc_id, first, forged), path in zip(sorted(groups[source]), paths):
            folded = forged
            for before, behind in path + upper:
                folded = sha(*before, folded, *behind)
            proof = sha(*(h for before, behind in path + upper for h in before + behind))
            out.append((doc_id if known else None, first, subroot, root, proof, folded, folded == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("digits", [6, 2])  # with two digits, blocks of nine meet in blocks above
def test_merkle_manifest_by_definition(spark, monkeypatch, tmp_path, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rng = random.Random(4)
    names = [None, "", "a", "b", "é", "zz", "Z"]
    rows = [
        (i if i % 50 else None, "hot" if i % 3 else rng.choice(names), rng.choice(["en", None]), i % 7 or None,
         rng.choice(["x\ny", "", None, "plain", "é\n"]))
        for i in range(900)
    ]
    rows += rows[:20] + [(7, "hot", "en", 1, "dd")] * 12 + [(901, "alone", "en", 1, "long\n" * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "g", "l", 2) for r in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert order(got) == order(manifest_by_definition(rows))
    assert {r.verified for r in got} == {True, False}


def test_merkle_manifest_of_few_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1, "g", "l", 2)], DOCS)
    only = merkle.manifest(docs).collect()[0]
    assert only.leaf == only.subroot == only.root == only.folded_root == sha("1:1----") and only.path == [] and only.verified
    assert merkle.manifest(docs.limit(0)).count() == 0


# --- byte-level encoding ------------------------------------------------------

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = "doc_id long, text string, ids string, decoded string, key string, no string"


def library(ranks=None):
    if ranks is None:
        with open(PATH, "rb") as file:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(spark, texts, **sizes):
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)], TEXTS)
    return bytebpe.decode(bytebpe.encode(docs, PATH, PATTERN, **sizes), PATH, PATTERN)


@pytest.mark.parametrize("chunk, ahead", [(bytebpe.CHUNK, bytebpe.AHEAD), (40, 16), (16, 8)])
def test_byte_ids_are_those_of_the_library(spark, chunk, ahead):
    rng, own = random.Random(8), library()
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'r", "e", "'re", "'", "1", "23", "!", "é", "😀", "\U00018e27", "中", "\x1c",
             "\xa0", "word ", " the", "\t", "....", "x" * 50, " " * 40, "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 150))) for _ in range(150)]
    texts += ["", None, "a" * 3000, " " * 3000, "\n" * 500 + "x", "é" * 400, texts[0]]
    got = encoded(spark, texts, chunk=chunk, ahead=ahead).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.id] or ""
        assert list(r.ids) == own.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_byte_ids_of_very_long_texts(spark):
    texts = ["ab" * 150_000, "the quick fox's  \n" * 20_000, "z" * (bytebpe.CHUNK + 1)]
    own = library()
    for r in encoded(spark, texts).collect():
        assert list(r.ids) == own.encode_ordinary(texts[r.id]) and bytes(r.decoded) == texts[r.id].encode()
    assert encoded(spark, ["x"]).limit(0).count() == 0
    assert encoded(spark, ["x"]).filter("id > 5").count() == 0


def test_every_character_is_of_the_library_s_kind():
    """A letter joins a letter, a number a number and another character its like; joined pieces merge here."""
    ranks = {bytes([b]): b for b in range(256)}
    for first in "a1!":
        for lead in range(0xC2, 0xF5):
            ranks[first.encode() + bytes([lead])] = len(ranks)
    own = library(ranks)
    tokenizer = bytebpe.ByteTokenizer(PATH, PATTERN)
    for code in [*range(128, 0xD800), *range(0xE000, 0x110000)]:
        text = f"a{chr(code)} 1{chr(code)} !{chr(code)}"
        pieces = tokenizer.pieces(text)
        assert "".join(pieces) == text
        joined = [len(p) for p in ("a", "1", "!") for q in pieces if q.strip(" ") == p + chr(code)]
        assert len(own.encode_ordinary(text)) == len(text.encode()) - len(joined), hex(code)


def test_byte_digests(spark, tmp_path):
    texts = ["one two", None, "é" * 10]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    own = library()
    want = []
    for i, text in enumerate(texts):
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert order(QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect()) == order(want)
