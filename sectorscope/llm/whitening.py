"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

1. Vectors become integers, ``floor(scale * c) + shift``. One pass sums them, a
   second sums the products of what is left after taking off the rounded mean,
   in exact arithmetic; Spark adds the parts of all tasks. The result is the
   integer matrix ``C = n * n * V`` of the covariance ``V``.
2. The characteristic polynomial of ``C`` is found modulo many primes (a Spark
   job over the primes: reduction to Hessenberg form, then the recurrence of
   its leading blocks) and put together by Chinese remaindering. The number of
   primes comes from a bound on the coefficients.
3. All roots are real, so the sign changes of the polynomial shifted by ``a``
   count its roots above ``a`` exactly, with multiplicity. Bisection by that
   count isolates the largest roots, bisection by sign refines single ones to
   ``bits`` relative bits.
4. A component spans the null space of ``C - root``: inverse iteration in
   fixed-point arithmetic of big integers (a Spark job over the roots). The
   vectors of a repeated root are orthogonalised against each other.

What reaches the driver depends on the dimension alone (``max_dim`` at most).

Defined results: rows whose vector is null or holds a null, a non-finite entry
or one whose integer has no place in a long are dropped, and so are those of
another length than the most frequent one (the shortest of equally frequent
ones; empty vectors never count). Repeated rows and repeated ids are all kept.
Components of eigenvalue zero cannot be whitened and are left out, so a
constant table, a table of one row and an empty one give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sectorscope.llm.common import row_struct, stored

#: Bits of one limb in exact products; a sum is cut at the same place to be added by Spark.
_LIMB, _CUT = 20, 62
_EXACT = 1 << 53


@dataclass(frozen=True)
class WhitenRules:
    components: int = 8
    scale: int = 1024
    shift: int = 100_000
    bits: int = 128      # relative precision of a root
    max_dim: int = 1024  # bounds what the driver holds


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``total``; ``eigen`` (floats, falling), unit ``vectors`` (rows), ``explained`` shares."""

    n: int
    total: tuple[int, ...]
    eigen: tuple[float, ...]
    vectors: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]


# ---- vectors as integers ----------------------------------------------------------------------------------------

def _usable(vec: Column, rules: WhitenRules) -> Column:
    """Whether all entries are finite and have an integer that fits a long."""
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(float(rules.scale))) >= float(1 << 61)))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True))


def integer_vectors(df: DataFrame, vec_col: str, carry: tuple[str, ...], rules: WhitenRules) -> tuple[DataFrame, int]:
    """``row`` and ``x`` (array of long) of the usable rows of the most frequent length, and that length."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    good = df.select(row_struct(carry), vec.alias("v")).where(_usable(F.col("v"), rules))
    found = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = found["d"] if found else 0
    if dim > rules.max_dim:
        raise ValueError(f"vectors of {dim} entries; max_dim is {rules.max_dim}")
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(rules.scale))) + F.lit(rules.shift).cast("bigint"))
    return good.where(F.size("v") == dim).select("row", x.alias("x")), dim


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def _cut(value: int) -> tuple[Decimal, Decimal]:
    return Decimal(value >> _CUT), Decimal(value & ((1 << _CUT) - 1))


def _add_up(parts: DataFrame, keys: list[str]) -> list[tuple]:
    """The keys and the exact sum (as a Python int) of the parts ``hi``, ``lo``."""
    rows = parts.groupBy(*keys).agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()
    return [(*[r[k] for k in keys], (int(r["hi"]) << _CUT) + int(r["lo"])) for r in rows]


def _sums(x: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Row count and the sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            m = _matrix(batch.column(0), dim)
            n += len(m)
            high, low = (m >> 31).sum(0).tolist(), (m & ((1 << 31) - 1)).sum(0).tolist()
            total = [t + (h << 31) + lo for t, h, lo in zip(total, high, low)]
        yield _parts({"i": list(range(-1, dim))}, [n, *total])

    found = dict(_add_up(x.select("x").mapInArrow(run, "i int, hi decimal(38,0), lo decimal(38,0)"), ["i"]))
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def _parts(keys: dict[str, list[int]], values: list[int]) -> pa.RecordBatch:
    hi, lo = zip(*map(_cut, values)) if values else ((), ())
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys.values()), pa.array(hi, kind), pa.array(lo, kind)],
                                      names=[*keys, "hi", "lo"])


def exact_gram(m: np.ndarray) -> np.ndarray:
    """``m.T @ m`` of an integer matrix as Python integers.

    Entries are cut into limbs whose products, summed over a block of rows, stay below 2**53, where float64 is exact.
    """
    dim = m.shape[1]
    out = np.zeros((dim, dim), object)
    top = max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if top < 1 << _LIMB:
        limbs, bound = [m], max(top, 1)
    else:
        limbs, bound, rest = [], 1 << _LIMB, m
        while top >= 1 << _LIMB:
            limbs.append(rest & ((1 << _LIMB) - 1))
            rest, top = rest >> _LIMB, (top >> _LIMB) + 1
        limbs.append(rest)
    block = max(1, _EXACT // (bound * bound) - 1)
    for at in range(0, len(m), block):
        part = [a[at:at + block].astype(np.float64) for a in limbs]
        for i, a in enumerate(part):
            for j in range(i, len(part)):
                product = (a.T @ part[j]).astype(np.int64).astype(object)
                out = out + ((product if i == j else product + product.T) * (1 << (_LIMB * (i + j))))
    return out


def scatter(x: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """``n``, sums and the matrix ``n * n * V`` of the covariance, exact; products are of rows with the rounded mean off."""
    n, total = _sums(x, dim)
    if not n:
        return 0, total, np.zeros((dim, dim), object)
    middle = [t // n for t in total]
    off = np.array(middle, np.int64)
    upper = [(i, j) for i in range(dim) for j in range(i, dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim), object)
        for batch in batches:
            gram = gram + exact_gram(_matrix(batch.column(0), dim) - off)
        yield _parts({"i": [i for i, _ in upper], "j": [j for _, j in upper]}, [int(gram[i, j]) for i, j in upper])

    rest = [t - n * m for t, m in zip(total, middle)]
    out = np.zeros((dim, dim), object)
    for i, j, value in _add_up(x.select("x").mapInArrow(run, "i int, j int, hi decimal(38,0), lo decimal(38,0)"), ["i", "j"]):
        out[i, j] = out[j, i] = n * value - rest[i] * rest[j]
    return n, total, out


# ---- characteristic polynomial ----------------------------------------------------------------------------------

def _is_prime(n: int) -> bool:
    """Miller-Rabin, certain for odd n from 9 below 3.2e9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(top: int, product: int) -> list[int]:
    """The largest primes below ``top`` whose product exceeds ``product``."""
    out, done, n = [], 1, top - 1 - top % 2
    while done <= product:
        if _is_prime(n):
            out.append(n)
            done *= n
        n -= 2
    return out


def coefficient_bound(dim: int, trace: int) -> int:
    """A bound on the coefficients' size: the k-th symmetric function of non-negative roots of that sum is largest if all are equal."""
    return max(math.comb(dim, k) * trace ** k // dim ** k for k in range(dim + 1)) + 1


def polynomials_mod(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Characteristic polynomial of an integer matrix modulo each prime (below 2**31), constant term first."""
    dim, count = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    h = np.stack([(matrix % q).astype(np.int64) for q in primes])
    p1, p2 = p[:, None], p[:, None, None]
    every = np.arange(count)
    for k in range(dim - 2):  # similarity transforms that clear column k below the subdiagonal
        pivot = (h[:, k + 1:, k] != 0).argmax(1) + k + 1
        rows, lead = h[every, pivot].copy(), h[:, k + 1].copy()
        h[every, pivot], h[:, k + 1] = lead, rows
        cols, lead = h[every, :, pivot].copy(), h[:, :, k + 1].copy()
        h[every, :, pivot], h[:, :, k + 1] = lead, cols
        inverse = np.array([pow(int(a), -1, q) if a else 0 for a, q in zip(h[:, k + 1, k], primes)], np.int64)
        factor = h[:, k + 2:, k] * inverse[:, None] % p1
        h[:, k + 2:, k:] = (h[:, k + 2:, k:] - factor[:, :, None] * h[:, k + 1:k + 2, k:]) % p2
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * factor[:, None, :] % p2).sum(2)) % p1
    polys = np.zeros((count, dim + 1, dim + 1), np.int64)
    polys[:, 0, 0] = 1
    for k in range(1, dim + 1):  # of the leading k x k block, by its last column
        weight = np.zeros((count, k), np.int64)
        chain = np.ones(count, np.int64)
        for i in range(k - 1, -1, -1):
            weight[:, i] = h[:, i, k - 1] * chain % p
            if i:
                chain = chain * h[:, i, i - 1] % p
        polys[:, k, 1:] = polys[:, k - 1, :-1]
        polys[:, k] = (polys[:, k] - (weight[:, :, None] * polys[:, :k] % p2).sum(1)) % p1
    return polys[:, dim]


def remainders_to_integers(primes: list[int], residues: np.ndarray) -> list[int]:
    """Chinese remaindering of each column, to the integer nearest zero."""
    whole = math.prod(primes)
    basis = [whole // q * pow(whole // q % q, -1, q) for q in primes]
    out = []
    for column in residues.T.tolist():
        value = sum(r * b for r, b in zip(column, basis)) % whole
        out.append(value - whole if 2 * value > whole else value)
    return out


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients (constant term first) of a symmetric non-negative integer matrix; one Spark job over the primes."""
    dim = len(matrix)
    primes = primes_below(1 << 31, 2 * coefficient_bound(dim, int(sum(matrix[i, i] for i in range(dim)))))
    plain = matrix.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_pylist()
            for at in range(0, len(mine), 16):
                found = polynomials_mod(np.array(plain, object), mine[at:at + 16])
                yield pa.RecordBatch.from_arrays([pa.array(mine[at:at + 16], pa.int64()),
                                                  pa.array(found.tolist(), pa.list_(pa.int64()))], names=["prime", "poly"])

    rows = (spark.createDataFrame([(q,) for q in primes], "prime long").repartition(-(-len(primes) // 16))
            .mapInArrow(run, "prime long, poly array<long>").collect())
    return remainders_to_integers([r["prime"] for r in rows], np.array([r["poly"] for r in rows], object))


# ---- roots ------------------------------------------------------------------------------------------------------

def roots_above(poly: list[int], a: int) -> int:
    """How many roots (with multiplicity) of a polynomial with real roots only exceed ``a``: sign changes after a shift by ``a``."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: list[int], a: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * a + c
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int, bits: int) -> tuple[list[tuple[int, int]], int]:
    """``(root, multiplicity)`` of the largest positive roots, at least ``count`` in all if there are, and their scale.

    A root is ``u / 2**scale`` within one step; the step is at most ``2**-bits`` of the smallest positive root.
    """
    while poly and poly[0] == 0:  # zero roots
        poly = poly[1:]
    dim = len(poly) - 1
    if dim < 1:
        return [], 0
    # 1 / smallest <= sum of 1 / root = |c1 / c0|
    small = abs(poly[0]).bit_length() - abs(poly[1]).bit_length() - 1
    scale = max(0, bits - small) + 1
    poly = [c << (scale * (dim - k)) for k, c in enumerate(poly)]
    top = 1 << (abs(poly[-2]).bit_length() + 1)  # the sum of the roots
    out: list[tuple[int, int]] = []
    todo = [(0, top, dim, 0)]  # roots in (lo, hi]: those above lo, those above hi
    while todo and sum(m for _, m in out) < count:
        lo, hi, above_lo, above_hi = todo.pop()
        inside = above_lo - above_hi
        if not inside:
            continue
        if inside == 1:
            out.append((_refine(poly, lo, hi), 1))
        elif hi - lo <= 2:
            out.append((lo + 1, inside))
        else:
            mid = (lo + hi) // 2
            above = roots_above(poly, mid)
            todo += [(lo, mid, above_lo, above), (mid, hi, above, above_hi)]
    return out, scale


def _refine(poly: list[int], lo: int, hi: int) -> int:
    """The only root in (lo, hi], a single one, to the next step."""
    if _sign(poly, hi) == 0:
        return hi
    side = _sign(poly, hi)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        s = _sign(poly, mid)
        if s == 0:
            return mid
        lo, hi = (lo, mid) if s == side else (mid, hi)
    return hi


# ---- components -------------------------------------------------------------------------------------------------

def null_vectors(matrix: np.ndarray, root: int, scale: int, count: int, bits: int) -> list[list[float]]:
    """``count`` orthonormal vectors for the root ``root / 2**scale``, by inverse iteration in fixed-point arithmetic."""
    dim = len(matrix)
    frac = 2 * bits + scale + 64
    one = 1 << frac
    a = matrix * one
    for i in range(dim):
        a[i, i] -= root << (frac - scale)
    order = list(range(dim))
    for k in range(dim):  # factors in place, rows ordered by pivot
        best = max(range(k, dim), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < dim:
            a[k + 1:, k] = a[k + 1:, k] * one // a[k, k]
            a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - (a[k + 1:, k:k + 1] * a[k:k + 1, k + 1:]) // one

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order]
        for k in range(dim - 1):
            y[k + 1:] = y[k + 1:] - a[k + 1:, k] * y[k] // one
        for k in range(dim - 1, -1, -1):
            y[k] = y[k] * one // a[k, k]
            y[:k] = y[:k] - a[:k, k] * y[k] // one
        return y * one // max(map(abs, y))

    found: list[np.ndarray] = []
    for c in range(count):
        # no symmetry of the matrix makes this start orthogonal to what is looked for
        v = np.array([one * pow(3, (i + 1) * (c + 1), 1_000_003) // 1_000_003 + one for i in range(dim)], object)
        for _ in range(4):
            v = solve(v)
            for u in found:
                v = v - u * int((v * u).sum()) // int((u * u).sum())
        found.append(v * one // max(map(abs, v)))
    out = []
    for v in found:
        length = math.isqrt(int((v * v).sum()))
        lead = max(range(dim), key=lambda i: (abs(v[i]), -i))
        sign = -1 if v[lead] < 0 else 1
        out.append([sign * int(e) / length for e in v])
    return out


def _components(spark: SparkSession, matrix: np.ndarray, roots: list[tuple[int, int]], scale: int, bits: int) -> list[list[float]]:
    """The unit vectors of all roots, in order; one Spark job over the roots."""
    plain = matrix.tolist()
    if not roots:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, root, times in zip(*(batch.column(c).to_pylist() for c in range(3))):
                vectors = null_vectors(np.array(plain, object), int(root), scale, times, bits)
                yield pa.RecordBatch.from_arrays([pa.array([at] * times, pa.int32()), pa.array(range(times), pa.int32()),
                                                  pa.array(vectors, pa.list_(pa.float64()))], names=["at", "nth", "vector"])

    rows = (spark.createDataFrame([(i, str(r), m) for i, (r, m) in enumerate(roots)], "at int, root string, times int")
            .repartition(len(roots)).mapInArrow(run, "at int, nth int, vector array<double>").collect())
    return [list(r["vector"]) for r in sorted(rows, key=lambda r: (r["at"], r["nth"]))]


# ---- the operator -----------------------------------------------------------------------------------------------

def fit(vectors: DataFrame, dim: int, rules: WhitenRules = WhitenRules()) -> Whitening:
    """The whitening of integer vectors (column ``x``) of ``dim`` entries; all of them are the fit list."""
    n, total, matrix = scatter(vectors, dim) if dim else (0, [], None)
    if not n:
        return Whitening(0, (), (), (), ())
    spark = vectors.sparkSession
    roots, scale = largest_roots(characteristic_polynomial(spark, matrix), rules.components, rules.bits)
    components = _components(spark, matrix, roots, scale, rules.bits)[:rules.components]
    each = [r for r, times in roots for _ in range(times)][:rules.components]
    trace = int(sum(matrix[i, i] for i in range(dim)))
    return Whitening(n, tuple(total), tuple(r / (n * n << scale) for r in each), tuple(map(tuple, components)),
                     tuple(r / (trace << scale) for r in each))


def deviations(off: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """Sum of ``(n * off - rest)**2`` over each row, exact."""
    top = n * max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0)))) + n
    if top < 1 << 52:
        t = off * n - np.array(rest, np.int64)
        if top * top * off.shape[1] < 1 << 63:
            return (t * t).sum(1).tolist()
        high, low = t >> 26, t & ((1 << 26) - 1)
        if off.shape[1] < 1 << 9:
            return [(a << 52) + (b << 27) + c for a, b, c in zip(*((u * v).sum(1).tolist() for u, v in (
                (high, high), (high, low), (low, low))))]
    t = off.astype(object) * n - np.array(rest, object)
    return (t * t).sum(1).tolist()


def apply(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``row``, ``deviation`` (decimal; null beyond 38 digits) and ``whitened`` (array) of integer vectors (``row``, ``x``)."""
    dim, n = len(model.total), max(model.n, 1)
    middle = [t // n for t in model.total]
    rest = [t - n * m for t, m in zip(model.total, middle)]
    weights = (np.array(model.vectors) / np.sqrt(np.array(model.eigen))[:, None]).T if model.eigen else np.zeros((dim, 0))
    schema = StructType([vectors.schema["row"], *StructType.fromDDL("deviation decimal(38,0), whitened array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = _matrix(batch.column(1), dim) - np.array(middle, np.int64)
            made = (off - np.array(rest, float) / n) @ weights
            exact = [Decimal(v) if v < 10 ** 38 else None for v in deviations(off, n, rest)]
            flat = pa.array(made.reshape(-1), pa.float64())
            at = pa.array(np.arange(len(off) + 1, dtype=np.int32) * made.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.decimal128(38, 0)),
                                              pa.ListArray.from_arrays(at, flat)], names=["row", "deviation", "whitened"])

    return vectors.select("row", "x").mapInArrow(run, schema)


def identity_error(whitened: DataFrame, count: int) -> float | None:
    """The largest absolute entry of the covariance of column ``whitened`` minus the identity; null without rows."""
    at = [F.col("whitened")[i] for i in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    if not pairs:
        return None
    row = whitened.agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max((abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if row[f"c{i}_{j}"] is not None), default=None)


def whiten(df: DataFrame, vec_col: str = "embedding", carry: tuple[str, ...] = ("vec_id",),
           rules: WhitenRules = WhitenRules()) -> DataFrame:
    """Per usable row and component: ``row`` (struct of ``carry``), ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``."""
    vectors, dim = integer_vectors(df, vec_col, carry, rules)
    model = fit(vectors, dim, rules)
    if not model.eigen:
        vectors = vectors.where(F.lit(False))
    done, _ = stored(apply(vectors, model), "whitened")
    error = identity_error(done, len(model.eigen))
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return (done.select("row", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("row", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
                    "whitened", F.get(explained, F.col("at")).alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))
