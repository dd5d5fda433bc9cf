"""Operator 12: embedding whitening through the exact characteristic polynomial.

Entries become whole numbers ``x = floor(256 c)``.  Over the distinct vectors, tasks sum
``x`` and ``x x'`` exactly; from these comes the integer scatter ``M = n Q - S S'``, which is
n^2 times the covariance.  Its characteristic polynomial is worked out modulo many primes, a
row of the job each (Hessenberg reduction and the recurrence of Hessenberg determinants), and
put together by Chinese remaindering, a coefficient each; one prime more than the bound on the
coefficients asks for must agree.  All roots are real, so the sign changes of the shifted
polynomial count the roots beyond a point exactly, multiple ones included: bisection isolates
the largest, and by signs of the polynomial narrows them far below double precision.  Each
component is the null vector of ``M - root``, by inverse iteration in whole-number fixed-point
arithmetic; a root of several equal ones takes as many orthogonal vectors from its null space.
Roots and components are a task each.

What the driver holds is made of dimensions, not of rows: the scatter, the polynomial, the
components.

Defined results: vectors that are null, hold null or non-finite entries, or lack entries that
the longest vector has, are dropped; repeated ids and repeated vectors keep their rows and
count once in the fit; a null id keeps its row; components whose eigenvalue is 0 cannot be
whitened and have no rows, so data of one vector, or none, give an empty result; entries
beyond a 64-bit integer stop at its ends; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, workers

COMPONENTS = 4
SCALE = 256
#: Bits of the fixed-point arithmetic, and bits below the size of the trace to which roots are narrowed.
BITS, NARROWED = 640, 300
#: Sums are sent as two numbers, so that they fit decimals of 38 digits.
LIMB = 60


def vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): whole-number vectors of the rows that stay."""
    entries = F.col(vector_col).cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.select(F.col(id_col).alias("vec_id"), entries.alias("c")).filter(F.col("c").isNotNull()).filter(~F.coalesce(bad, F.lit(True)))
    longest = good.agg(F.max(F.size("c"))).first()[0] or 0
    return good.filter(F.size("c") == longest).select("vec_id", F.transform("c", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, d)


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x'x and the column sums as Python integers, through doubles where no sum can reach 2^53."""
    most = int(np.abs(x).max(initial=0)) if x.min(initial=0) > -(1 << 63) else 1 << 63
    if max(most, 1) ** 2 * len(x) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object), x.sum(axis=0).astype(object)
    wide = x.astype(object)
    return wide.T @ wide, wide.sum(axis=0)


def moments(x: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and Q over the rows of ``x``: a task sends its sums, which are added by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("whitening")
        n, total = 0, np.zeros((d + 1, d), object)
        for batch in batches:
            part = _matrix(batch.column(0), d)
            for k in range(0, len(part), 4096):
                products, columns = _sums(part[k : k + 4096])
                total[:d] += products
                total[d] += columns
            n += len(part)
        cells = [(-1, -1, n), *((i, j, int(total[i, j])) for i in range(d + 1) for j in range(i if i < d else 0, d))] if n else []
        i, j, v = zip(*cells) if cells else ((), (), ())
        limb = lambda k: pa.array([Decimal((y >> LIMB) if k else y & ((1 << LIMB) - 1)) for y in v], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), limb(1), limb(0)], ["i", "j", "hi", "lo"])

    storage.prepare_python(x.sparkSession)
    sums = x.select("x").mapInArrow(run, "i int, j int, hi decimal(38,0), lo decimal(38,0)").groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    n, s, q = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, hi, lo in sums.collect():  # dimensions x dimensions
        value = (int(hi) << LIMB) + int(lo)
        if i < 0:
            n = value
        elif i == d:
            s[j] = value
        else:
            q[i][j] = q[j][i] = value
    return n, s, q


def scatter(n: int, s: list[int], q: list[list[int]]) -> list[list[int]]:
    """n^2 times the covariance."""
    return [[n * q[i][j] - s[i] * s[j] for j in range(len(s))] for i in range(len(s))]


def _is_prime(p: int) -> bool:
    """Strong tests to bases 2, 3, 5 and 7, which are certain below 3,215,031,751."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return p % 2 > 0 and all(any(pow(a, odd << j, p) == p - 1 for j in range(twos)) or pow(a, odd, p) == 1 for a in (2, 3, 5, 7))


def primes_below(limit: int, product: int) -> list[int]:
    """The largest primes below ``limit`` whose product exceeds ``product``."""
    found, reached, p = [], 1, limit
    while reached <= product:
        p -= 1
        if _is_prime(p):
            found.append(p)
            reached *= p
    return found


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """det(t - m) modulo ``p``, constant first: similarity to Hessenberg form, then the recurrence of its leading minors."""
    h = m % p
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1][None, :] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u[None, :] % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        now = np.roll(minors[k - 1], 1) - h[k - 1, k - 1] * minors[k - 1] % p
        chain = 1  # the product of the entries below the diagonal from row k - i to row k
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            now -= int(h[k - i - 1, k - 1]) * chain % p * minors[k - i - 1] % p
        minors[k] = now % p
    return minors[d]


def remaindered(residues: list[int], primes: list[int]) -> int:
    """The number of least size with these remainders."""
    value, product = 0, 1
    for r, p in zip(residues, primes):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value if 2 * value < product else value - product


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """det(t - m) for a positive semidefinite integer matrix, constant first."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bound = max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))  # elementary symmetric means of roots that are not negative
    primes = primes_below(1 << 31, 2 * bound)
    extra = next(p for p in range(primes[-1] - 1, 1, -1) if _is_prime(p))
    shared = spark.sparkContext.broadcast(m)  # dimensions x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("whitening")
        wide = np.array(shared.value, object)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = polynomial_mod((wide % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1), pa.int32()), pa.array(np.full(d + 1, p), pa.int64()), pa.array(found, pa.int64())], ["k", "p", "r"])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("p", ascending=False)
        r, p = own["r"].tolist(), own["p"].tolist()
        value = remaindered(r[:-1], p[:-1])
        if value % p[-1] != r[-1]:
            raise ArithmeticError("the polynomial is larger than its bound")
        return pd.DataFrame({"k": [int(own["k"].iloc[0])], "c": [str(value)]})

    asked = spark.createDataFrame([(p,) for p in [*primes, extra]], "p bigint").repartition(min(len(primes) + 1, 200))
    found = asked.mapInArrow(run, "k int, p bigint, r bigint").groupBy("k").applyInPandas(together, "k int, c string").collect()  # dimensions + 1 numbers
    return [int(c) for _, c in sorted(map(tuple, found))]


def _beyond(poly: list[int], at: int, bits: int) -> int:
    """How many roots exceed ``at`` / 2^bits, if all are real: the sign changes of the polynomial shifted there (Descartes' rule is exact then)."""
    even = min((at & -at).bit_length() - 1, bits) if at else bits
    at, bits, d = at >> even, bits - even, len(poly) - 1
    c = [x << bits * (d - k) for k, x in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], at: int, bits: int) -> int:
    value, d = 0, len(poly) - 1
    for k in range(d, -1, -1):
        value = value * at + (poly[k] << bits * (d - k))
    return (value > 0) - (value < 0)


def root(poly: list[int], k: int) -> tuple[int, int, int]:
    """The ``k``-th largest root (from 1), no root being negative: (at, bits, place).

    It lies within 2^-bits above ``at`` / 2^bits; ``place`` numbers it, from 1, among roots
    that lie there too, as equal roots do.
    """
    size = (abs(poly[-2]) + 1).bit_length()  # the roots add up to minus this coefficient
    bits = max(NARROWED - size, 0)
    low, high, above_low, above_high = -1, 1 << (size + bits), len(poly) - 1, 0
    while high - low > 1:
        mid = (low + high) >> 1
        if above_low - above_high == 1:  # isolated: signs do
            up = _sign(poly, mid, bits) == (1 if above_high % 2 else -1)
        else:
            count = _beyond(poly, mid, bits)
            up = count >= k
            above_low, above_high = (count, above_high) if up else (above_low, count)
        low, high = (mid, high) if up else (low, mid)
    return low, bits, k - above_high


def null_vectors(m: list[list[int]], at: int, bits: int, many: int) -> list[list[float]]:
    """``many`` orthogonal unit vectors of the space that ``m - at / 2^bits`` maps next to nothing, by inverse iteration with whole numbers."""
    d = len(m)
    size = max(sum(m[i][i] for i in range(d)).bit_length(), 1)
    frac = max(BITS - size, 8)
    lam = at << (frac - bits) if frac >= bits else at >> (bits - frac)
    a = np.array([[m[i][j] << frac for j in range(d)] for i in range(d)], object)
    for i in range(d):
        a[i, i] -= lam
    steps = []
    for k in range(d):  # elimination, the largest pivot first; a pivot of nothing becomes the least number
        r = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, r]] = a[[r, k]]
        a[k, k] = a[k, k] or 1
        f = np.array([(a[i, k] << BITS) // a[k, k] for i in range(k + 1, d)], object)
        steps.append((k, r, f))
        if k + 1 < d:
            a[k + 1 :, k:] -= f[:, None] * a[k, k:][None, :] >> BITS
    one = 1 << BITS

    def scaled(v: np.ndarray) -> np.ndarray:
        length = isqrt(int((v * v).sum()))
        return np.array([(int(y) << BITS) // max(length, 1) for y in v], object)

    def solved(v: np.ndarray) -> np.ndarray:
        v = v << size  # room for the quotients
        for k, r, f in steps:
            v[k], v[r] = v[r], v[k]
            if k + 1 < d:
                v[k + 1 :] -= f * v[k] >> BITS
        out = np.zeros(d, object)
        for k in range(d - 1, -1, -1):
            out[k] = ((int(v[k]) - int((a[k, k + 1 :] * out[k + 1 :]).sum() >> BITS)) << BITS) // int(a[k, k])
        return out

    found: list[np.ndarray] = []
    for c in range(many):
        v = scaled(np.array([pow(3, 7 + i * (c + 2), 1_000_003) - 500_001 for i in range(d)], object) * one)
        for _ in range(4):
            v = scaled(solved(v))
            for _ in range(2):
                for other in found:
                    v = v - (other * (int((v * other).sum()) >> BITS) >> BITS)
                v = scaled(v)
        found.append(v)
    return [[int(y) / one for y in v] for v in found]


def components(spark: SparkSession, m: list[list[int]], n: int, most: int = COMPONENTS) -> list[tuple[int, float, float, list[float]]]:
    """(component, eigenvalue of the covariance, share of its trace, unit vector), the largest first; those of eigenvalue 0 are left out."""
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return []
    poly = characteristic(spark, m)
    rank = len(poly) - 1 - next(k for k, c in enumerate(poly) if c)
    shared = spark.sparkContext.broadcast((m, poly))  # dimensions x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("whitening")
        m, poly = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at, bits, place = root(poly, k)
                vector = null_vectors(m, at, bits, place)[-1]
                value, share = at / (n * n << bits), at / (trace << bits)  # quotients of whole numbers, rounded once
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([value]), pa.array([share]), pa.array([vector], pa.list_(pa.float64()))], ["component", "e", "share", "vector"])

    count = min(most, rank)
    asked = spark.range(1, count + 1, 1, count).select(F.col("id").cast("int").alias("component"))
    return sorted(map(tuple, asked.mapInArrow(run, "component int, e double, share double, vector array<double>").collect()))  # a row a component


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) of every row that stays and component up to ``most``."""
    spark = rows.sparkSession
    kept = vectors(rows, id_col=id_col, vector_col=vector_col, scale=scale)
    id_type = rows.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    fit, _ = storage.written(kept.select("x").distinct(), "fit-list")
    first = fit.first()
    if first is None or not first[0]:
        return empty
    n, s, q = moments(fit, len(first[0]))
    found = components(spark, scatter(n, s, q), n, most)
    if not found:
        return empty
    d, names = len(s), [c for c, *_ in found]
    shared = spark.sparkContext.broadcast((np.array([v for *_, v in found]).T / np.sqrt([e for _, e, *_ in found]), s))  # dimensions x components

    def run(batches: Iterator[pa.RecordBatch], with_id: bool) -> Iterator[pa.RecordBatch]:
        workers.begin("whitening")
        axes, s = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            most = int(np.abs(x).max(initial=0)) if x.min(initial=0) > -(1 << 63) else 1 << 63
            narrow = d * (n * most + max(map(abs, s))) ** 2 < 1 << 63
            moved = x * n - np.array(s, np.int64) if narrow else x.astype(object) * n - np.array(s, object)
            squares = (moved * moved).sum(axis=1)
            white = (moved / n).astype(np.float64) @ axes
            if not with_id:
                yield pa.RecordBatch.from_arrays([pa.array(white[:, k]) for k in range(len(names))], [f"w{c}" for c in names])
                continue
            deviation = pa.array(squares, pa.int64()).cast(pa.decimal128(38, 0)) if narrow else pa.array([Decimal(int(y)) for y in squares], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], ["vec_id", "deviation", "white"])

    columns = [f"w{c}" for c in names]
    on_fit = fit.mapInArrow(lambda b: run(b, False), ", ".join(f"{c} double" for c in columns))
    # Spark's covariance is centred: it updates means and products of deviations from them.
    pairs = on_fit.agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for k, a in enumerate(columns) for b in columns[k:]]).first()
    error = max(abs(pairs[f"{a}{b}"] - (a == b)) for k, a in enumerate(columns) for b in columns[k:])
    out = kept.mapInArrow(lambda b: run(b, True), f"vec_id {id_type}, deviation decimal(38,0), white array<double>")
    shares = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(share).alias("explained")) for c, _, share, _ in found])
    each = F.explode(F.zip_with(shares, "white", lambda a, b: F.struct(a["component"].alias("component"), b.alias("whitened"), a["explained"].alias("explained"))))
    return out.select("vec_id", each.alias("w"), "deviation").select("vec_id", "w.component", F.lit(n).cast("long").alias("n"), "deviation", "w.whitened", "w.explained", F.lit(error).alias("identity_error"))
