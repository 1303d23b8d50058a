"""Whitening of integer vectors by an exact characteristic polynomial.

Vectors become integers, so their scatter ``A = n * sum(x x') - S S'`` (n squared times
the covariance) is exact. Its characteristic polynomial is computed modulo many primes
by reduction to Hessenberg form, one Spark task for some of them each, and joined by
Chinese remainders. Roots are isolated and refined with integer arithmetic: as all of
them are real, the sign changes of the shifted polynomial count the roots above a point
exactly. Components are null vectors of ``A - root``, found by inverse iteration in long
decimals. What reaches the driver are sums over dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakegraph.llm.common import carried, map_columns
from lakegraph.session import cut

#: Entries beyond this many units cannot be whole numbers as doubles; rows that hold one take no part.
LARGEST = 2 ** 53
#: Bits to which a root is refined, relative to the largest one; closer roots count as one of higher multiplicity.
ROOT_BITS = 200
#: Decimal digits of the inverse iteration.
DIGITS = 120
#: Rows whose products are summed at once.
CHUNK = 2048


# -- vectors ----------------------------------------------------------------

def integers(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Adds ``x``: ``floor(scale * entry)`` as longs, null where a row takes no part.

    That is a null or empty vector, one with a null, non-finite or too large entry, and one of another
    length than most valid vectors have (of equally common lengths the smallest counts).
    """
    entry = lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))
    sound = F.forall(vector, lambda v: F.coalesce(
        v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(F.lit(float(scale)) * v.cast("double")) < LARGEST), F.lit(False)))
    rows = vectors.withColumn("x", F.when(sound & (F.size(vector) > 0), F.transform(vector, lambda v: entry(v).cast("bigint"))))
    lengths = rows.where("x IS NOT NULL").groupBy(F.size("x").alias("d")).count()
    usual = lengths.orderBy(F.desc("count"), "d").first()
    return rows.withColumn("x", F.when(F.size("x") == F.lit(usual.d if usual else 0), F.col("x")))


def _exact_products(block: np.ndarray) -> np.ndarray:
    """``block' block`` of integers, as Python integers."""
    most = int(np.abs(block).max(initial=0))
    if most * most * len(block) < LARGEST:
        as_double = block.astype(np.float64)
        return (as_double.T @ as_double).astype(np.int64).astype(object)
    if most * most * len(block) < 2 ** 63:
        return (block.T @ block).astype(object)
    as_object = block.astype(object)
    return as_object.T @ as_object


def moments(distinct: DataFrame, column: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums per dimension and sums of products of the vectors, exact. A task sends one row per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                rows = batch.column(0).slice(begin, CHUNK)
                block = rows.flatten().to_numpy().reshape(len(rows), -1)
                n += len(block)
                sums = sums + block.astype(object).sum(axis=0)
                products = products + _exact_products(block)
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()),
                pa.array([Decimal(int(s)) for s in sums], kind),
                pa.array([[Decimal(int(v)) for v in row] for row in products], pa.list_(kind))], names=["i", "n", "s", "row"])

    parts = distinct.select(column).mapInArrow(run, "i int, n bigint, s decimal(38,0), row array<decimal(38,0)>")
    long = parts.select("i", "n", "s", F.posexplode("row").alias("j", "v"))
    summed = long.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if not summed:
        return 0, np.zeros(0, object), np.zeros((0, 0), object)
    d = max(r.i for r in summed) + 1
    s, products = np.zeros(d, object), np.zeros((d, d), object)
    for r in summed:
        s[r.i], products[r.i, r.j] = int(r.s), int(r.v)
    return int(summed[0].n), s, products


# -- the polynomial ---------------------------------------------------------

def primes_below(top: int, wanted: int) -> list[int]:
    """The largest ``wanted`` primes below ``top``."""
    small = [p for p in range(2, isqrt(top) + 1) if all(p % q for q in range(2, isqrt(p) + 1))]
    found, high = [], top
    while len(found) < wanted:
        low = max(2, high - (1 << 16))
        prime = np.ones(high - low, bool)
        for p in small:
            start = max(p * p, -(-low // p) * p)
            prime[start - low::p] = False
        found += (np.flatnonzero(prime) + low)[::-1].tolist()
        high = low
    return found[:wanted]


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of ``det(t - matrix)`` modulo a prime below 2**31, lowest power first."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        # Bring a non-zero entry below the diagonal, then clear what is under it by a similarity.
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        at = int(below[0]) + k + 1
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:, k:] = (h[k + 2:, k:] - factor[:, None] * h[k + 1, k:] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor % p).sum(axis=1)) % p
    # Leading blocks of a Hessenberg matrix: each polynomial follows from those before it.
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - int(h[k - 1, k - 1]) * polys[k - 1]) % p
        chain = 1
        for i in range(k - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if not chain:
                break
            polys[k] = (polys[k] - int(h[i - 1, k - 1]) * chain % p * polys[i - 1]) % p
    return polys[d]


def joined(residues: np.ndarray, primes: list[int]) -> list[int]:
    """Whole numbers of smallest size with the given residues: one column per number, one row per prime."""
    moduli, values = list(primes), [[int(v) for v in row] for row in residues]
    while len(moduli) > 1:
        next_moduli, next_values = [], []
        for i in range(0, len(moduli) - 1, 2):
            m, k = moduli[i], moduli[i + 1]
            inverse = pow(m, -1, k)
            next_moduli.append(m * k)
            next_values.append([a + m * ((b - a) * inverse % k) for a, b in zip(values[i], values[i + 1])])
        if len(moduli) % 2:
            next_moduli.append(moduli[-1])
            next_values.append(values[-1])
        moduli, values = next_moduli, next_values
    m = moduli[0]
    return [v - m if 2 * v > m else v for v in values[0]]


def characteristic_polynomial(spark: SparkSession, scatter: np.ndarray) -> list[int]:
    """Exact coefficients of ``det(t - scatter)``, lowest power first, of an integer matrix without negative roots.

    Sums of products of k roots out of d are at most ``comb(d, k) * (trace / d) ** k``, which says how many
    primes are needed. Each prime is a row of a Spark table; a task works on those it gets.
    """
    d, trace = len(scatter), int(np.trace(scatter))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_below(2 ** 31, (2 * bound + 1).bit_length() // 30 + 1)
    given = [[int(v) for v in row] for row in scatter]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                matrix = np.array([[v % p for v in row] for row in given], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([polynomial_mod(matrix, p)], pa.list_(pa.int64()))], names=["p", "residues"])

    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    found = {r.p: r.residues for r in rows.mapInArrow(run, "p bigint, residues array<bigint>").collect()}
    return joined(np.array([found[p] for p in primes], object), primes)


# -- roots ------------------------------------------------------------------

def roots_above(poly: list[int], point: int) -> int:
    """Roots larger than an integer point, with multiplicity, of a polynomial whose roots are all real."""
    c = list(poly)
    d = len(c) - 1
    for i in range(d):  # the coefficients of poly(t + point)
        for j in range(d - 1, i - 1, -1):
            c[j] += point * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], wanted: int, bits: int) -> list[int]:
    """The ``wanted`` largest positive roots times ``2 ** bits``, rounded up, falling and with multiplicity.

    Bisection on exact counts of roots above a point: first to whole numbers, then
    inside a unit by Newton steps where the root is alone and by halving where it is not.
    """
    d = len(poly) - 1
    while d and not poly[0]:
        poly, d = poly[1:], d - 1  # roots at 0 are exact
    wanted = min(wanted, d)
    high = -poly[d - 1] + 1 if d else 1  # all roots are positive, so none exceeds their sum
    ends: dict[int, int] = {}

    def above(point: int) -> int:
        if point not in ends:
            ends[point] = roots_above(poly, point)
        return ends[point]

    found = []
    for k in range(wanted):
        low, up = 0, high
        # Bounds known from earlier counts.
        for point, count in ends.items():
            if count > k:
                low = max(low, point)
            else:
                up = min(up, point)
        while up - low > 1:
            middle = (low + up) // 2
            if above(middle) > k:
                low = middle
            else:
                up = middle
        # The root lies in (low, up]. Scale so that its bits become whole numbers.
        found.append(_refined(poly, low, k, bits))
    return found


def _value(poly: list[int], point: int, bits: int) -> int:
    """``poly(point / 2**bits) * 2**(bits * degree)``."""
    value, scale = 0, 0
    for c in reversed(poly):
        value = value * point + (c << scale)
        scale += bits
    return value


def _refined(poly: list[int], low: int, k: int, bits: int) -> int:
    """The root number ``k`` (from the top) in ``(low, low + 1]``, as the smallest point of 2**-bits steps not below it."""
    alone = roots_above(poly, low) == k + 1 and roots_above(poly, low + 1) == k and _value(poly, low, 0) != 0
    if alone:
        # One simple root: the polynomial changes its sign there and nowhere else in the unit.
        a, b = low << bits, (low + 1) << bits
        sign = _value(poly, a, bits) > 0
        while b - a > 1:
            middle = (a + b) // 2
            value = _value(poly, middle, bits)
            if value and (value > 0) == sign:
                a = middle
            else:
                b = middle
        return b
    # Several roots share the unit: count them on the scaled polynomial.
    d = len(poly) - 1
    fine = [c << bits * (d - i) for i, c in enumerate(poly)]
    a, b = low << bits, (low + 1) << bits
    while b - a > 1:
        middle = (a + b) // 2
        if roots_above(fine, middle) > k:
            a = middle
        else:
            b = middle
    return b


# -- components -------------------------------------------------------------

def null_vectors(scatter: np.ndarray, root: Decimal, wanted: int) -> list[list[Decimal]]:
    """``wanted`` orthonormal vectors of the null space of ``scatter - root``, by inverse iteration in long decimals."""
    d = len(scatter)
    with localcontext() as context:
        context.prec = DIGITS
        m = np.array([[Decimal(int(v)) for v in row] for row in scatter], object)
        # Just beside the root the matrix has an inverse, and one step shrinks all but the null space.
        root = root + max(abs(root), Decimal(1)) * Decimal(10) ** (-DIGITS // 3)
        for i in range(d):
            m[i, i] -= root
        order = np.arange(d)
        for k in range(d - 1):
            at = k + int(np.argmax(np.abs(m[k:, k])))
            if at != k:
                m[[k, at]], order[[k, at]] = m[[at, k]], order[[at, k]]
            m[k + 1:, k] = m[k + 1:, k] / m[k, k]
            m[k + 1:, k + 1:] = m[k + 1:, k + 1:] - m[k + 1:, k, None] * m[k, k + 1:]
        found: list[np.ndarray] = []
        draw = np.random.default_rng(17)
        for _ in range(wanted):
            v = np.array([Decimal(int(x)) for x in draw.integers(-1000, 1001, d)], object)
            for _ in range(3):
                v = v[order].copy()
                for i in range(1, d):
                    v[i] -= (m[i, :i] * v[:i]).sum()
                for i in range(d - 1, -1, -1):
                    v[i] = (v[i] - (m[i, i + 1:] * v[i + 1:]).sum()) / m[i, i]
                for other in found:
                    v = v - other * (other * v).sum()
                v = v / (v * v).sum().sqrt()
            found.append(v)
        return [list(v) for v in found]


@dataclass
class Whitening:
    """What is learned from the distinct vectors: ``n``, the sums, the components (rows), their variances and shares."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def project(self, block: np.ndarray) -> np.ndarray:
        """Whitened values of integer vectors, one column per component."""
        mean = np.array([int(s) / self.n for s in self.sums])
        return (block - mean) @ self.components.T / np.sqrt(self.variances)


def learn(distinct: DataFrame, wanted: int = 4, column: str = "x") -> Whitening:
    """Components of distinct integer vectors of one length, by falling variance; those of variance 0 are left out.

    Components of equal variance (to ``ROOT_BITS`` bits) are an orthonormal basis of their common space.
    """
    n, sums, products = moments(distinct, column)
    scatter = products * n - np.multiply.outer(sums, sums) if n else products
    trace = sum(int(scatter[i, i]) for i in range(len(scatter)))
    if trace == 0:
        return Whitening(n, sums, np.zeros((0, len(sums))), np.zeros(0), np.zeros(0))
    poly = characteristic_polynomial(distinct.sparkSession, scatter)
    bits = max(0, ROOT_BITS - trace.bit_length())
    roots = largest_roots(poly, wanted, bits)
    components, at = [], 0
    with localcontext() as context:
        context.prec = DIGITS
        exact = [Decimal(r) / (1 << bits) for r in roots]
        while at < len(exact):
            same = 1
            while at + same < len(exact) and roots[at + same] == roots[at]:
                same += 1
            components += null_vectors(scatter, exact[at], same)
            at += same
        variances = np.array([float(e / (n * n)) for e in exact])
        explained = np.array([float(e / trace) for e in exact])
    return Whitening(n, sums, np.array([[float(v) for v in c] for c in components]), variances, explained)


def identity_error(distinct: DataFrame, model: Whitening, column: str = "x") -> float:
    """Largest absolute entry of the covariance of the whitened vectors, less the identity. 0 without components."""
    m = len(model.variances)
    if not m:
        return 0.0

    def sums_of(make):
        def run(batches):
            total = 0.0
            for batch in batches:
                block = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, len(model.sums))
                total = total + make(model.project(block))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

        parts = distinct.select(column).mapInArrow(run, "part array<double>")
        rows = parts.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r.v for r in sorted(rows, key=lambda r: r.i)])

    mean = sums_of(lambda w: w.sum(axis=0)) / model.n
    products = sums_of(lambda w: (w - mean).T @ (w - mean)).reshape(m, m) / model.n
    return float(np.abs(products - np.eye(m)).max())


def whiten(vectors: DataFrame, vector: str = "embedding", wanted: int = 4, keep: list[str] | None = None) -> DataFrame:
    """A row per valid row and component: ``component, n, deviation, whitened, explained, identity_error``.

    The model is learned from each distinct integer vector once; every row is projected, repeated ones as often
    as they stand there. ``deviation`` is the exact sum over dimensions of ``(n * x - S) ** 2``, null beyond a long. Rows
    of null, empty, non-finite or odd-length vectors give none (see ``integers``), nor does a table without variance,
    e.g. an empty one or one of equal vectors. Input columns named like a result column are replaced.
    """
    fields = [
        T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())]
    along = {f"_c{i}": c for i, c in enumerate(carried(vectors, keep, fields))}
    given = vectors.select(*(F.col(f"`{c}`").alias(n) for n, c in along.items()), F.col(vector).alias("_vector"))
    rows = cut(integers(given, "_vector").where("x IS NOT NULL").drop("_vector"))
    distinct = cut(rows.select("x").distinct())
    model = learn(distinct, wanted)
    error = identity_error(distinct, model)

    def make():
        def work(xs):
            block = np.array(xs, np.int64).reshape(len(xs), len(model.sums))
            far = model.n * int(np.abs(block).max(initial=0)) + max(map(abs, map(int, model.sums)), default=0)
            exact = np.int64 if far * far * max(1, block.shape[1]) < 2 ** 63 else object
            apart = block.astype(exact) * model.n - np.array(model.sums, exact)
            deviation = [int(v) for v in (apart * apart).sum(axis=1)]
            return {
                "deviation": [v if v < 2 ** 63 else None for v in deviation],
                "parts": [[{"component": i + 1, "whitened": float(v)} for i, v in enumerate(row)] for row in model.project(block)]}

        return work

    made = map_columns(rows, ["x"], make, [fields[2], T.StructField("parts", T.ArrayType(T.StructType([fields[0], fields[3]])))], list(along))
    shares = F.array(*(F.lit(float(e)) for e in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    return made.select(*along, "deviation", F.explode("parts").alias("_p")).select(
        *(F.col(n).alias(c) for n, c in along.items()), "_p.component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "_p.whitened",
        F.element_at(shares, F.col("_p.component")).alias("explained"), F.lit(error).alias("identity_error"))
