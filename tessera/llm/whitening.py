"""Embedding whitening through an exact characteristic polynomial.

Vectors become whole numbers x = floor(256 * c). The fit list is every distinct
x once. With n vectors, sums S and products P = sum of x x', the scatter
n P - S S' is a matrix of whole numbers, n^2 times the covariance, and it is
summed without any rounding: tasks add up their share in whole numbers and hand
on limbs of 60 bits, which Spark sums as decimals.

Its characteristic polynomial is found modulo primes of 31 bits (reduction to
Hessenberg form, then the recurrence over leading blocks), each task taking some
of the primes, and put together by Chinese remaindering; the number of primes
follows from a bound on the coefficients. All roots of a symmetric matrix are
real, so by Descartes' rule the sign changes of p(x + a) count the roots above a
exactly: bisection with that count isolates the largest roots one by one and
narrows them to ROOT_BITS bits. For each root, inverse iteration on the scatter
less the root, in DIGITS decimal digits, gives the null vector. Roots that
ROOT_BITS bits don't tell apart are one root; its vectors are made orthogonal.

What reaches the driver is the scatter and polynomial: their size depends on the
number of dimensions alone. Rows are projected where they lie.

Edge cases: vectors that are null or hold a null or non-finite entry take no
part; shorter vectors count as padded with zeros; components of eigenvalue 0 are
left out, as they can't be scaled (so a table with one distinct vector, or none,
gives no rows); repeated rows are each returned; a deviation beyond a long is
null; entries whose 256-fold is beyond 2^62 stop there; a null id stays null;
only the id and vector columns are read, so other columns can't clash; texts
play no part, and ties (equal eigenvalues) are described above.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import write_table
from tessera.llm.topk import usable

SCALE = 256
COMPONENTS = 4
LIMB = 60                    # bits of a limb of a partial sum
ROOT_BITS = 220              # bits to which a root is narrowed
DIGITS = 90                  # decimal digits of inverse iteration
LARGEST = 1 << 62
EXACT = 1 << 53
PRIMES_PER_TASK = 16


def quantized(vector: str) -> Column:
    """The vector's whole numbers as longs."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * float(SCALE)
        return F.when(y >= float(LARGEST), F.lit(LARGEST)).when(y <= -float(LARGEST), F.lit(-LARGEST)).otherwise(F.floor(y))
    return F.transform(vector, whole)


# ---- exact sums -----------------------------------------------------------

def _vectors(column: pa.ListArray, width: int) -> np.ndarray:
    """(rows, width) longs, short vectors padded with zeros."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(len(values)) - np.repeat(offsets[:-1], lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = values
    return out


def _products(x: np.ndarray) -> np.ndarray:
    """x' x in whole numbers: through doubles while every sum is below 2^53."""
    top = int(np.abs(x).max(initial=0))
    if top * top * max(1, len(x)) < EXACT:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _partial_sums(width: int):
    """Per task the sums of (1, x) (1, x)' as limbs: (i, j, limb, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), object)
        for b in batches:
            x = _vectors(b.column(0), width)
            total += _products(np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
        rows = []
        for i in range(width + 1):
            for j in range(i, width + 1):
                v, limb = int(total[i, j]), 0
                while v:
                    low = v & ((1 << LIMB) - 1) if v > 0 else -(-v & ((1 << LIMB) - 1))
                    rows.append((i, j, limb, low))
                    v, limb = (v - low) >> LIMB, limb + 1
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["i", "j", "limb", "value"])
    return run


def scatter_of(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, n P - S S') of a frame with one column of long vectors."""
    parts = fit.mapInArrow(_partial_sums(width), "i int, j int, limb int, value long")
    sums = parts.groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    m = [[0] * (width + 1) for _ in range(width + 1)]
    for r in sums:
        m[r["i"]][r["j"]] += int(r["value"]) << (LIMB * r["limb"])
    n, s = m[0][0], m[0][1:]
    scatter = [[n * m[min(i, j) + 1][max(i, j) + 1] - s[i] * s[j] for j in range(width)] for i in range(width)]
    return n, s, scatter


# ---- the characteristic polynomial ----------------------------------------

def _is_prime(p: int) -> bool:
    """Miller-Rabin, exact below 3.2e9 with these bases."""
    d, r = p - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, p)
        if x in (1, p - 1):
            continue
        if not any((x := x * x % p) == p - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2^31, from the largest down, whose product has more bits than this."""
    out, p, have = [], (1 << 31) - 1, 0.0
    while have <= bits + 1:
        if _is_prime(p):
            out.append(p)
            have += math.log2(p)
        p -= 2
    return out


def coefficient_bits(m: list[list[int]]) -> int:
    """Bits of the largest coefficient at most: the k-th is a sum of products of
    k eigenvalues, all at least 0, so at most C(d, k) (trace / k)^k."""
    d, trace = len(m), max(1, sum(m[i][i] for i in range(len(m))))
    log = math.log2(trace) if trace < 1 << 1000 else trace.bit_length()
    return int(max(math.log2(math.comb(d, k)) + k * (log - math.log2(k)) for k in range(1, d + 1))) + 2


def polynomial_mod(m: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x - m) modulo the prime p, constant term first."""
    d = len(m)
    h = np.array([[v % p for v in row] for row in m], np.int64)
    for k in range(1, d - 1):
        rows = np.flatnonzero(h[k:, k - 1])
        if not len(rows):
            continue
        r = k + int(rows[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        f = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        # rows below lose f times row k; column k gains f times the columns beyond: a similar matrix
        h[k + 1:] = (h[k + 1:] - f[:, None] * h[k][None, :]) % p
        gain = np.zeros(d, np.int64)
        for i in range(0, len(f), 2):           # two products of 62 bits fit an unsigned sum
            gain = (gain + (h[:, k + 1 + i:k + 3 + i].astype(np.uint64) * f[i:i + 2].astype(np.uint64)).sum(axis=1)
                    % np.uint64(p)).astype(np.int64) % p
        h[:, k] = (h[:, k] + gain) % p
    polys = [np.array([1], np.int64)]
    for k in range(d):
        q = np.zeros(k + 2, np.int64)
        q[1:] = polys[k]
        q[:-1] = (q[:-1] - int(h[k, k]) * polys[k]) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            c = below * int(h[i, k]) % p
            q[:i + 1] = (q[:i + 1] - c * polys[i]) % p
        polys.append(q % p)
    return [int(c) for c in polys[d]]


def _polynomials(m: list[list[int]]):
    def run(batches):
        for b in batches:
            p = b["p"].tolist()
            b["coefficients"] = [polynomial_mod(m, x) for x in p]
            yield b[["p", "coefficients"]]
    return run


def remaindered(found: list[tuple[int, list[int]]]) -> list[int]:
    """The whole coefficients, nearest to 0, from those modulo each prime."""
    value, modulus = [0] * len(found[0][1]), 1
    for p, c in found:
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((x - v) * inverse % p) for v, x in zip(value, c)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


def characteristic(spark, m: list[list[int]]) -> list[int]:
    """Coefficients of det(x - m), constant term first; the primes are dealt to tasks."""
    ps = primes(coefficient_bits(m))
    table = spark.createDataFrame([(p,) for p in ps], "p long").repartition(-(-len(ps) // PRIMES_PER_TASK))
    rows = table.mapInPandas(_polynomials(m), "p long, coefficients array<long>").collect()
    return remaindered(sorted((r["p"], list(r["coefficients"])) for r in rows))


# ---- roots ----------------------------------------------------------------

def roots_above(coefficients: list[int], a: int, shift: int) -> int:
    """Roots above a / 2^shift of a polynomial with only real roots: the sign
    changes of p(x + a / 2^shift), times a power of two."""
    d = len(coefficients) - 1
    c = [v << (shift * (d - k)) for k, v in enumerate(coefficients)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], count: int, bits: int = ROOT_BITS) -> list[tuple[Decimal, int]]:
    """(root, multiplicity) of the positive roots, falling, until ``count`` roots
    are told; each to ``bits`` bits of the largest one."""
    top = 1
    while roots_above(coefficients, top, 0):
        top <<= 1
    positive = roots_above(coefficients, 0, 0)
    shift = max(0, bits - top.bit_length())
    memo: dict[int, int] = {0: positive, top << shift: 0}

    def above(a: int) -> int:
        if a not in memo:
            # trailing zero bits of a are no part of the polynomial's scale
            s = shift
            while s and a % 2 == 0:
                a, s = a // 2, s - 1
            memo[a << (shift - s)] = roots_above(coefficients, a, s)
            a <<= shift - s
        return memo[a]

    out: list[tuple[Decimal, int]] = []
    told = 0
    while told < min(count, positive):
        # the interval (lo, hi] of the next root below those told: hi is the lowest point known to have `told` above
        lo = max(a for a, n in memo.items() if n > told)
        hi = min(a for a, n in memo.items() if n <= told)
        while hi - lo > 1:
            # the count alone steers: coarse points first, so that large numbers come late
            mid = (lo + hi) // 2
            step = 1 << max(0, (hi - lo).bit_length() - 3)
            mid = mid // step * step if lo < mid // step * step else mid
            if above(mid) > told:
                lo = mid
            else:
                hi = mid
        same = above(lo) - above(hi)
        with decimal.localcontext(prec=DIGITS + 20):
            out.append(((Decimal(2 * lo + 1) / 2) / Decimal(1 << shift), same))
        told += same
    return out


# ---- vectors --------------------------------------------------------------

def _solver(a: np.ndarray, tiny: Decimal):
    """LU of a matrix of Decimals by partial pivoting; a zero pivot counts as ``tiny``."""
    d, lu, order = len(a), a.copy(), list(range(len(a)))
    for k in range(d):
        r = max(range(k, d), key=lambda i: abs(lu[i, k]))
        lu[[k, r]] = lu[[r, k]]
        order[k], order[r] = order[r], order[k]
        if abs(lu[k, k]) < tiny:
            lu[k, k] = tiny
        lu[k + 1:, k] /= lu[k, k]
        lu[k + 1:, k + 1:] -= np.outer(lu[k + 1:, k], lu[k, k + 1:])

    def solve(y: np.ndarray) -> np.ndarray:
        y = y[order]
        for k in range(1, d):
            y[k] -= lu[k, :k] @ y[:k]
        for k in range(d - 1, -1, -1):
            if k + 1 < d:
                y[k] -= lu[k, k + 1:] @ y[k + 1:]
            y[k] /= lu[k, k]
        return y
    return solve


def null_vectors(m: list[list[int]], root: Decimal, count: int) -> list[np.ndarray]:
    """``count`` orthogonal unit vectors v with m v = root v, by inverse iteration."""
    with decimal.localcontext(prec=DIGITS):
        a = np.array([[Decimal(v) for v in row] for row in m], object)
        d = len(a)
        scale = max(abs(v) for v in a.ravel()) or Decimal(1)
        a[np.arange(d), np.arange(d)] -= root
        solve = _solver(a, scale * Decimal(10) ** (10 - DIGITS))
        found: list[np.ndarray] = []
        for c in range(count):
            y = np.array([Decimal((i * 7919 + c * 104729 + 17) % 1009 + 1) for i in range(d)], object)
            for _ in range(4):
                y = solve(y)
                for v in found:
                    y = y - (v @ y) * v
                y = y / (y @ y).sqrt()
            largest = max(range(d), key=lambda i: (abs(y[i]), -i))
            found.append(-y if y[largest] < 0 else y)
        return found


def principal(spark, n: int, m: list[list[int]], count: int) -> list[tuple[np.ndarray, float, float]]:
    """(unit vector, eigenvalue of the covariance, its share of the trace), falling."""
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return []
    out = []
    for root, same in largest_roots(characteristic(spark, m), count):
        for v in null_vectors(m, root, min(same, count - len(out))):
            with decimal.localcontext(prec=DIGITS):
                out.append((v.astype(np.float64), float(root / n / n), float(root / trace)))
    return out


# ---- the operator ---------------------------------------------------------

def _projections(width: int, mean: np.ndarray, maps: np.ndarray, schema: pa.Schema):
    """A batch's columns but the last, then the vector's whitened coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = (_vectors(b.column(b.num_columns - 1), width) - mean) @ maps
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(w), pa.list_(pa.float64()))], schema=schema)
    return run


def _projected(rows: DataFrame, width: int, mean, maps) -> DataFrame:
    """The rows with their last column, x, replaced by ``w``."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    out = T.StructType([*rows.schema.fields[:-1]]).add("w", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(_projections(width, mean, maps, to_arrow_schema(out)), out)


def deviation(n: int, sums: list[int]) -> Column:
    """Sum over the dimensions of (n x - S)^2 as a long, exactly; null beyond one."""
    wide = "decimal(38,0)"
    s = F.array(*[F.lit(str(v)).cast(wide) for v in sums])
    # whole in longs while every term and sum is; decimals beyond
    big = max([abs(v) for v in sums], default=0)
    part = F.zip_with("x", F.slice(s, 1, F.size("x")), lambda x, t: (x * F.lit(str(n)).cast(wide) - t).cast(wide))
    rest = F.lit(str(sum(v * v for v in sums))).cast(wide) if sum(v * v for v in sums) < 10 ** 38 else F.lit(None).cast(wide)
    padded = F.when(F.size("x") == len(sums), F.lit(0).cast(wide)).otherwise(
        rest - F.aggregate(F.slice(s, 1, F.size("x")), F.lit(0).cast(wide), lambda a, t: (a + t * t).cast(wide)))
    exact = F.aggregate(part, padded, lambda a, t: F.try_add(a, F.try_multiply(t, t)).cast(wide)).try_cast("long")
    if (big + n * (1 << 20)) ** 2 * max(1, len(sums)) < 1 << 63:
        longs = F.array(*[F.lit(v).cast("long") for v in sums])
        quick = F.aggregate(F.zip_with("x", longs, lambda x, t: x * F.lit(n).cast("long") - t),
                            F.lit(0).cast("long"), lambda a, t: a + t * t)
        small = (F.size("x") == len(sums)) & F.forall("x", lambda x: F.abs(x) < (1 << 20))
        return F.when(small, quick).otherwise(exact)
    return exact


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector)).select(F.col(id_col).alias("vec_id"), quantized(vector).alias("x"))
    rows = write_table(rows, "whiten-rows")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    # equal vectors of different length are one: the zeros at the end don't count
    bare = F.when(F.size("x") == width, F.col("x")).otherwise(
        F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    fit = write_table(rows.select(bare.alias("x")).distinct(), "whiten-fit")
    n, sums, m = scatter_of(fit, width) if width else (0, [], [])
    found = principal(spark, n, m, components) if n else []
    schema = f"component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not found:
        return rows.where(F.lit(False)).select("vec_id", *[
            F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")])
    mean = np.array([float(Decimal(s) / n) for s in sums])
    maps = np.stack([v / math.sqrt(e) for v, e, _ in found], axis=1)
    k = len(found)
    w = _projected(fit, width, mean, maps)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariances = w.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(covariances[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    out = _projected(rows.select("vec_id", deviation(n, sums).alias("deviation"), "x"), width, mean, maps)
    shares = F.array(*[F.lit(share) for _, _, share in found])
    return out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
