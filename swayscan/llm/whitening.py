"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors become whole numbers, so their scatter is exact. Its characteristic polynomial is worked out modulo many primes
(Hessenberg form, one prime a task) and put together by Chinese remainders. All its roots are real and none is
negative, so signs of its shifted coefficients count the roots above any number exactly: roots are isolated without
rounding. Inverse iteration next to a root, in as many digits as the distance of the other roots asks for, gives its
null space.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swayscan.llm.tables import written

SCALE, SHIFT = 1024, 100_000
LIMB = 32  # bits of each part that sums are sent in
LIMBS = 7
ROWS = 4096  # rows whose products are added in one step
MARGIN = 64  # binary digits by which a root's interval is narrower than the way to the next root
SURE = 96  # binary digits of a root


# --- exact sums ---------------------------------------------------------------


def _usable(vector: Column) -> Column:
    """There are entries, all finite, and their whole numbers fit a long."""
    limit = 2.0**62 / SCALE
    return (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < limit, F.lit(False)))


def _products(rows: np.ndarray) -> np.ndarray:
    """``rows.T @ rows`` as Python integers, of whole numbers (int64).

    Rows are split into parts of 20 bits. Products of two parts are below 2**40, so that 4,096 of them add up without
    rounding in doubles.
    """
    parts, rest = [], rows
    while True:
        low = rest & 0xFFFFF if (np.abs(rest) >= 1 << 20).any() else rest
        parts.append(low.astype(np.float64))
        if low is rest:
            break
        rest = rest >> 20
    total = np.zeros((rows.shape[1],) * 2, object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) << 20 * (i + j)
    return total


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per width of vectors: the count (cell -1), sums (cells below the width) and sums of products (the rest)."""
    count: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in it:
        for at in range(0, batch.num_rows, ROWS):
            column = batch.column(0).slice(at, ROWS)
            widths = column.value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                rows = column.filter(pa.array(widths == width)).flatten().to_numpy().reshape(-1, width)
                if width not in sums:
                    count[width], sums[width] = 0, np.zeros(width + width * (width + 1) // 2, object)
                count[width] += int((widths == width).sum())
                upper = np.triu_indices(width)
                # sums of whole numbers below 2**62 need two halves
                plain = rows.astype(object).sum(axis=0) if (np.abs(rows) >= 1 << 48).any() else rows.sum(axis=0).astype(object)
                sums[width] += np.concatenate([plain, _products(rows)[upper]])
    for width, values in sums.items():
        cells = [count[width], *values.tolist()]
        low = (1 << LIMB) - 1
        parts = [[v >> LIMB * k & low for k in range(LIMBS - 1)] + [v >> LIMB * (LIMBS - 1)] for v in cells]
        yield pa.RecordBatch.from_arrays(
            [pa.array([width] * len(cells), pa.int32()), pa.array(range(-1, len(cells) - 1), pa.int32()), pa.array(parts, pa.list_(pa.int64()))],
            names=["width", "cell", "parts"],
        )


def scatter(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and scatter (``n * sum of products - product of sums``) of ``vectors(x array<long>)``.

    Only vectors of the commonest width count (of equally common ones, the widest). What comes to the driver has the
    size of the scatter, whatever the number of rows.
    """
    partial = vectors.mapInArrow(_sums, "width int, cell int, parts array<long>")
    totals = written(
        partial.groupBy("width", "cell").agg(F.array(*(F.sum(F.get("parts", F.lit(k))) for k in range(LIMBS))).alias("parts"))
    )

    def whole(parts: list[int]) -> int:
        return sum(p << LIMB * k for k, p in enumerate(parts))

    counts = totals.filter("cell = -1")
    first = counts.orderBy(F.get("parts", F.lit(1)).desc(), F.get("parts", F.lit(0)).desc(), F.desc("width")).first()
    if first is None:
        return 0, [], []
    width, n = first["width"], whole(first["parts"])
    cells = {r["cell"]: whole(r["parts"]) for r in totals.filter(F.col("width") == width).collect()}
    sums = [cells[i] for i in range(width)]
    matrix = [[0] * width for _ in range(width)]
    for at, (i, j) in enumerate(zip(*np.triu_indices(width))):
        matrix[i][j] = matrix[j][i] = n * cells[width + at] - sums[i] * sums[j]
    return n, sums, matrix


# --- characteristic polynomial ------------------------------------------------


def _is_prime(n: int) -> bool:
    """Exact below 3.2e9 with these bases."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """Primes below 2**31, largest first, whose product exceeds the bound."""
    found, product, at = [], 1, 2**31 + 1
    while product <= bound:
        at -= 2
        if _is_prime(at):
            found.append(at)
            product *= at
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, lowest first, of the characteristic polynomial modulo a prime below 2**31, by Hessenberg form."""
    h, d = matrix.copy(), len(matrix)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        at = j + 1 + below[0]
        if at != j + 1:
            h[[at, j + 1]] = h[[j + 1, at]]
            h[:, [at, j + 1]] = h[:, [j + 1, at]]
        u = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - u[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * u % p).sum(axis=1)) % p
    known = np.zeros((d + 1, d + 1), np.int64)  # polynomial of each leading block
    known[0, 0] = 1
    for k in range(d):
        now = (np.concatenate([[0], known[k, :-1]]) - h[k, k] * known[k] % p) % p
        path = 1
        for i in range(k - 1, -1, -1):
            path = path * int(h[i + 1, i]) % p
            if path == 0:
                break
            now = (now - path * int(h[i, k]) % p * known[i] % p) % p
        known[k + 1] = now
    return known[d].tolist()


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, lowest first, of the characteristic polynomial of a scatter. Primes are shared among tasks."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # eigenvalues are at least 0 and add up to the trace
    primes = primes_above(2 * (1 + trace // d + 1) ** d)

    def polynomials(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array(matrix, object)
        for part in it:
            for p in part["id"]:
                found = polynomial_modulo((whole % int(p)).astype(np.int64), int(p))
                yield pd.DataFrame({"p": [p], "found": [found]})

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame([(p,) for p in primes], "id long").repartition(tasks)
    residues = {r["p"]: r["found"] for r in listed.mapInPandas(polynomials, "p long, found array<long>").collect()}
    whole, product = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(product, -1, p)
        whole = [w + product * ((r - w) * inverse % p) for w, r in zip(whole, residues[p])]
        product *= p
    return [w - product if w > product // 2 else w for w in whole]


# --- roots --------------------------------------------------------------------


def roots_above(poly: list[int], at: int, bits: int = 0) -> int:
    """How many roots, with multiplicity, lie above ``at / 2**bits``, for a polynomial whose roots are all real."""
    d = len(poly) - 1
    c = [x << bits * (d - i) for i, x in enumerate(poly)]
    for i in range(d):  # Taylor shift
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(poly: list[int], at: int, bits: int) -> int:
    d, out = len(poly) - 1, 0
    for i in range(d, -1, -1):
        out = out * at + (poly[i] << bits * (d - i))
    return out


def _divided(a: list[int], b: list[int], p: int) -> list[int]:
    """Remainder modulo p of polynomials, lowest first; b is not zero."""
    a, inverse = a[:], pow(b[-1], -1, p)
    while len(a) >= len(b):
        factor = a[-1] * inverse % p
        for i in range(len(b)):
            a[len(a) - len(b) + i] = (a[len(a) - len(b) + i] - factor * b[i]) % p
        while a and a[-1] == 0:
            a.pop()
    return a


def _common(poly: list[int], p: int) -> list[int]:
    """Greatest common divisor modulo p of a polynomial and its derivative, leading coefficient 1."""
    a = [x % p for x in poly]
    b = [i * x % p for i, x in enumerate(poly)][1:]
    while b and b[-1] == 0:
        b.pop()
    while b:
        a, b = b, _divided(a, b, p)
    inverse = pow(a[-1], -1, p)
    return [x * inverse % p for x in a]


def distinct_roots(poly: list[int]) -> list[int]:
    """The polynomial with the same roots, each once; leading coefficients are 1."""
    d = len(poly) - 1
    bound = 2 ** (d + 1) * sum(map(abs, poly))
    common: list[int] = []
    product = 1
    for p in primes_above(bound):
        found = _common(poly, p)
        if len(found) == 1:
            return poly
        if common and len(found) > len(common):
            continue  # this prime hides a difference of roots
        if len(found) < len(common):
            common, product = [], 1
        inverse = pow(product, -1, p) if common else 0
        common = [c + product * ((f - c) * inverse % p) for c, f in zip(common, found)] if common else found
        product *= p
    common = [c - product if c > product // 2 else c for c in common]
    rest, quotient = poly[:], [0] * (d - len(common) + 2)
    for at in range(len(quotient) - 1, -1, -1):
        quotient[at] = rest[at + len(common) - 1]
        for i, c in enumerate(common):
            rest[at + i] -= quotient[at] * c
    return quotient


def isolated(poly: list[int], simple: list[int], number: int) -> tuple[int, int, int, int, int]:
    """The root with this number, from 1 for the largest: ``(low, high, bits, first, count)``.

    The root lies above ``low / 2**bits`` and not above ``high / 2**bits``; it is the only one there and far around.
    ``first`` and ``count`` say which numbers it has, more than one if it is repeated.
    """
    low, high, bits = 0, 1, 0
    while roots_above(poly, high):
        high *= 2

    def halves():
        nonlocal low, high, bits
        low, high, bits = 2 * low, 2 * high, bits + 1
        return (low + high) // 2

    while roots_above(simple, low, bits) - roots_above(simple, high, bits) > 1:
        middle = halves()
        if roots_above(poly, middle, bits) >= number:
            low = middle
        else:
            high = middle
    beyond = roots_above(poly, high, bits)
    count = roots_above(poly, low, bits) - beyond
    sign = -1 if roots_above(simple, high, bits) % 2 else 1  # of the values between the root and ``high``
    while True:
        for _ in range(32):
            middle = halves()
            if sign * _value(simple, middle, bits) >= 0:
                high = middle
            else:
                low = middle
        width = high - low
        around = width << MARGIN
        alone = roots_above(simple, low - around, bits) - roots_above(simple, high + around, bits) == 1
        if alone and width << SURE <= high:
            return low, high, bits, beyond + 1, count


# --- components ---------------------------------------------------------------


def _solver(matrix: np.ndarray, tiny: Decimal):
    """``solve(right sides)`` by triangular factors with row exchange; a pivot of zero becomes ``tiny``."""
    a, d = matrix.copy(), len(matrix)
    order = list(range(d))
    for j in range(d):
        at = max(range(j, d), key=lambda i: abs(a[i, j]))
        if at != j:
            a[[at, j]] = a[[j, at]]
            order[at], order[j] = order[j], order[at]
        if a[j, j] == 0:
            a[j, j] = tiny
        a[j + 1 :, j] = a[j + 1 :, j] / a[j, j]
        if j + 1 < d:
            a[j + 1 :, j + 1 :] = a[j + 1 :, j + 1 :] - np.multiply.outer(a[j + 1 :, j], a[j, j + 1 :])

    def solve(right: np.ndarray) -> np.ndarray:
        x = right[order]
        for j in range(d):
            x[j + 1 :] = x[j + 1 :] - np.multiply.outer(a[j + 1 :, j], x[j])
        for j in range(d - 1, -1, -1):
            x[j] = x[j] / a[j, j]
            x[:j] = x[:j] - np.multiply.outer(a[:j, j], x[j])
        return x

    return solve


def _orthonormal(columns: np.ndarray) -> np.ndarray:
    """Columns made orthonormal one after another, twice against rounding."""
    done: list[np.ndarray] = []
    for k in range(columns.shape[1]):
        v = columns[:, k]
        for _ in range(2):
            for u in done:
                v = v - u * (u * v).sum()
            v = v / (v * v).sum().sqrt()
        done.append(v)
    return np.array(done, object).T


def component(matrix: list[list[int]], poly: list[int], simple: list[int], number: int) -> tuple[float, float, list[float]]:
    """``(eigenvalue, share of the trace, unit vector)`` of one component, by inverse iteration in enough digits."""
    low, high, bits, first, count = isolated(poly, simple, number)
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    with localcontext(Context(prec=60 + (trace.bit_length() + bits) * 31 // 100, Emax=10**9, Emin=-(10**9))) as context:
        root = Decimal(low + high) / Decimal(2) ** (bits + 1)
        shifted = np.array([[Decimal(x) for x in row] for row in matrix], object)
        for i in range(d):
            shifted[i, i] -= root
        solve = _solver(shifted, Decimal(10) ** -context.prec)
        chance = random.Random(d)
        columns = np.array([[Decimal(chance.randint(-(10**6), 10**6)) for _ in range(count)] for _ in range(d)], object)
        for _ in range(4):
            columns = _orthonormal(solve(columns))
        vector = [float(x) for x in columns[:, number - first]]
        sign = -1.0 if max(vector, key=abs) < 0 else 1.0
        return float(root), float(root / trace), [sign * x for x in vector]


def components(spark: SparkSession, matrix: list[list[int]], most: int) -> list[tuple[float, float, list[float]]]:
    """The first components with a positive eigenvalue, one a task."""
    if not matrix or not any(matrix[i][i] for i in range(len(matrix))):
        return []
    poly = characteristic(spark, matrix)
    simple = distinct_roots(poly)
    known = min(most, roots_above(poly, 0))

    def found(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for k in part["id"]:
                value, share, vector = component(matrix, poly, simple, int(k))
                yield pd.DataFrame({"k": [k], "value": [value], "share": [share], "vector": [vector]})

    listed = spark.range(1, known + 1, 1, known)
    rows = listed.mapInPandas(found, "k long, value double, share double, vector array<double>").collect()
    return [(r["value"], r["share"], r["vector"]) for r in sorted(rows, key=lambda r: r["k"])]


# --- whitening ----------------------------------------------------------------


def _projected(rows: DataFrame, n: int, sums: list[int], found: list[tuple[float, float, list[float]]]) -> DataFrame:
    """``(id, x)`` to ``(id, deviation, z)``: whitened values, and the exact squared deviation where it fits a long."""
    means = [s // n for s in sums]
    rests = np.array([s % n for s in sums], object)  # n * (x - mean) = n * (x - floor of the mean) - rest
    fraction = np.array([float(r / Decimal(n)) for r in rests])
    # e = value / n**2, so that whitened = (x - S/n) . vector * n / sqrt(value)
    weights = np.array([[c * n / np.sqrt(value) for c in vector] for value, _, vector in found]).T
    base, rest_square = np.array(means, object), int((rests * rests).sum())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                raw = part.column(1).flatten().to_numpy().reshape(-1, len(sums))
                small = (np.abs(raw) < 1 << 24).all() and max(map(abs, means)) < 1 << 24 and n < 1 << 31
                x = raw - np.array(means) if small else raw.astype(object) - base
                square = (x * x).sum(axis=1)
                if small:  # |x| < 2**25 and rests < 2**31: sums over up to 2**7 dimensions fit a long
                    cross = np.array([sum(p) for p in zip(*((x[:, k : k + 64] * rests[k : k + 64].astype(np.int64)).sum(axis=1).tolist() for k in range(0, len(sums), 64)))], object)
                else:
                    cross = (x * rests).sum(axis=1)
                exact = (n * n * square.astype(object) - 2 * n * cross + rest_square).tolist()
                z = (x.astype(np.float64) - fraction) @ weights
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([v if v < 2**63 else None for v in exact], pa.int64()),
                        pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64())),
                    ],
                    names=["id", "deviation", "z"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"id {kind}, deviation long, z array<double>")


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 8) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` per usable row and component.

    Entries c become ``floor(SCALE * c) + SHIFT``. Rows take no part whose vector is null or empty, holds null or non-finite
    entries or entries of 2**62 / SCALE and beyond, or has another width than most vectors (of equally common widths
    the greatest counts). Components are those of the rows that take part, by falling eigenvalue; those of eigenvalue
    0 cannot be whitened and are left out, so equal vectors, a single one or none give no rows. Equal eigenvalues share
    their space between orthogonal vectors. ``deviation`` is null where it does not fit a long. Rows with a null or
    repeated id, and equal rows, each count and each return; other columns are left alone.
    """
    spark = rows.sparkSession
    numbers = F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    vectors = rows.filter(_usable(F.col(vec_col))).select(F.col(id_col).alias("id"), numbers.alias("x"))
    n, sums, matrix = scatter(vectors.select("x"))
    found = components(spark, matrix, most)
    kind = rows.schema[id_col].dataType.simpleString()
    if not found:
        schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], f"id {kind}, {schema}")
    done = written(_projected(vectors.filter(F.size("x") == len(sums)), n, sums, found))
    z = [F.get("z", F.lit(k)) for k in range(len(found))]
    pairs = [(i, j) for i in range(len(found)) for j in range(i, len(found))]
    moments = done.agg(*(F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(moments[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    shares = F.array(*(F.lit(share) for _, share, _ in found))
    flat = done.select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return flat.select(
        "id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
