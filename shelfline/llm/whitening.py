"""Whitening of embeddings by an exact characteristic polynomial.

Entries become integers x = floor(scale * c) + shift. Over the distinct vectors x (the
fit list, n of them, sums S per dimension) the scatter n * sum(x x') - S S' is an
integer matrix: n squared times the covariance. Its characteristic polynomial is found
modulo primes below 2^31 by reduction to Hessenberg form, a task per group of primes,
and put together by Chinese remaindering up to a proven bound of its coefficients. All
roots are real, so the sign changes of the polynomial shifted to a (Descartes) count
its roots above a exactly: bisection isolates each eigenvalue to ``BITS`` binary places
of the trace. An eigenvector is the null space of the matrix less its eigenvalue, by
inverse iteration in fixed-point integers; a repeated root gets an orthonormal basis.

The scatter is summed exactly: values are cut into limbs small enough that products
of a block of rows are exact in double precision. Only matrices of the size of the
dimension squared reach the driver, never rows.

Defined results: rows take no part whose vector is null, empty, holds null or
non-finite entries, or has another length than most vectors have (on a tie, the
longer). Integers beyond 2^62 become 2^62, with their sign. A deviation that does
not fit in a long is null. Components with eigenvalue zero are left out: there is
nothing to divide by; a table of one distinct vector, or of none, returns no rows. Repeated rows give repeated results; two rows with one id and
different vectors are both returned; a null id stays null. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.sources.storage import materialise

SCALE, COMPONENTS = 64, 16
#: Binary places of the trace to which eigenvalues are isolated, and of the arithmetic on vectors.
BITS, WORK_BITS = 256, 640
#: Primes per task, and rows whose products are summed at once.
PRIMES_AT_ONCE, ROWS_AT_ONCE = 16, 8192
#: Bits of a limb: products of ROWS_AT_ONCE rows stay below 2^53.
LIMB = 20

#: Largest integer an entry becomes.
MOST = 2.0**62


# --- integers of the vectors -------------------------------------------------


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c) of finite doubles, without the shift, which no sum of differences needs."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * float(scale)), -MOST, MOST).astype(np.int64)


def _limbs(rows: np.ndarray) -> list[np.ndarray]:
    """Matrices of doubles below 2^LIMB in size whose weighted sum is ``rows``."""
    out = []
    while True:
        if not len(rows) or np.abs(rows.astype(np.float64)).max() < 1 << LIMB:
            return [*out, rows.astype(np.float64)]
        out.append((rows & ((1 << LIMB) - 1)).astype(np.float64))
        rows = rows >> LIMB


def products(rows: np.ndarray) -> np.ndarray:
    """rows' x rows of integers, exact, as Python integers."""
    total = np.zeros((rows.shape[1],) * 2, object)
    for at in range(0, len(rows), ROWS_AT_ONCE):
        limbs = _limbs(rows[at : at + ROWS_AT_ONCE])
        for i, left in enumerate(limbs):
            for j, right in enumerate(limbs):
                total += (left.T @ right).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


# --- characteristic polynomial ----------------------------------------------


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``limit`` (at most 2^31)."""
    out, n = [], limit - 1 - limit % 2
    while len(out) < count:
        # these three bases decide every number below 4,759,123,141
        d, r = n - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        if all(_passes(n, a, d, r) for a in (2, 7, 61)):
            out.append(n)
        n -= 2
    return out


def _passes(n: int, base: int, d: int, r: int) -> bool:
    x = pow(base, d, n)
    if x in (1, n - 1):
        return True
    for _ in range(r - 1):
        x = x * x % n
        if x == n - 1:
            return True
    return False


def _inverse(values: np.ndarray, p: np.ndarray) -> np.ndarray:
    """values^(p - 2) modulo p, zero for zero."""
    out, power, exponent = np.ones_like(values), values.copy(), p - 2
    while exponent.any():
        out = np.where(exponent & 1, out * power % p, out)
        power = power * power % p
        exponent = exponent >> 1
    return np.where(values == 0, 0, out)


def polynomials_modulo(h: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients, lowest first, of det(xI - H) modulo each prime; ``h``: a residue matrix per prime."""
    h, k, d = h.copy(), len(primes), h.shape[1]
    each, p, p3 = np.arange(k), primes[:, None], primes[:, None, None]
    for m in range(1, d - 1):
        below = h[:, m:, m - 1] != 0
        pivot = m + below.argmax(axis=1)
        for axis in (1, 2):
            x = h.swapaxes(1, axis)
            row = x[each, pivot].copy()
            x[each, pivot] = x[:, m]
            x[:, m] = row
        u = h[:, m + 1 :, m - 1] * _inverse(h[:, m, m - 1], primes)[:, None] % p
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, None, m] % p3) % p3
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % p3).sum(axis=2)) % p
    found = np.zeros((k, d + 1, d + 1), np.int64)
    found[:, 0, 0] = 1
    for m in range(1, d + 1):
        found[:, m, 1:] = found[:, m - 1, :-1]
        found[:, m] -= h[:, m - 1, m - 1, None] * found[:, m - 1] % p
        # products of the subdiagonal, from the last row upwards
        chain, factors = np.ones(k, np.int64), np.zeros((k, m - 1), np.int64)
        for i in range(m - 1, 0, -1):
            chain = chain * h[:, i, i - 1] % primes
            factors[:, i - 1] = h[:, i - 1, m - 1] * chain % primes
        if m > 1:
            found[:, m] -= (factors[:, :, None] * found[:, : m - 1] % p3).sum(axis=1)
        found[:, m] %= p
    return found[:, d]


def coefficient_bits(matrix: np.ndarray) -> int:
    """Bits that hold every coefficient with its sign: for eigenvalues that are not
    negative, the k-th is at most C(d, k) * (trace / d)^k."""
    d, trace = len(matrix), int(sum(matrix[i, i] for i in range(len(matrix))))
    most = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1))
    return most.bit_length() + 2


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients, lowest first, of det(xI - matrix) for a positive semidefinite
    integer matrix (Python integers)."""
    primes = primes_below(1 << 31, coefficient_bits(matrix) // 30 + 2)
    groups = [primes[i : i + PRIMES_AT_ONCE] for i in range(0, len(primes), PRIMES_AT_ONCE)]
    shared = spark.sparkContext.broadcast(matrix)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                p = np.array(group, np.int64)
                residues = np.stack([(shared.value % q).astype(np.int64) for q in group])
                out = polynomials_modulo(residues, p)
                yield pa.record_batch([pa.array(group, pa.int64()), pa.array(out.tolist(), pa.list_(pa.int64()))], names=["p", "c"])

    rows = spark.createDataFrame([(g,) for g in groups], "p array<long>").repartition(len(groups))
    found = rows.mapInArrow(task, "p long, c array<long>").collect()
    whole = math.prod(primes)
    total = [0] * (len(matrix) + 1)
    for p, c in found:
        rest = whole // p
        lift = rest * pow(rest, -1, p)
        total = [t + lift * x for t, x in zip(total, c, strict=True)]
    return [t - whole if 2 * t > whole else t for t in (t % whole for t in total)]


# --- eigenvalues and eigenvectors -------------------------------------------


def roots_above(polynomial: list[int], a: int, bits: int) -> int:
    """Number of roots above a / 2^bits, with multiplicity, of a polynomial whose roots are all real."""
    d = len(polynomial) - 1
    c = [x << (bits * (d - i)) for i, x in enumerate(polynomial)]  # of x * 2^bits
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def eigenvalues(polynomial: list[int], most: int, bits: int = BITS) -> tuple[list[tuple[int, int]], int]:
    """The ``most`` largest non-zero roots as (lower end of the interval, multiplicity),
    in units of 2^-places: [(a, m)], places. Intervals have length one, so equal ends
    are roots that ``bits`` places of the sum of all roots do not separate."""
    while len(polynomial) > 1 and polynomial[0] == 0:
        polynomial = polynomial[1:]
    d = len(polynomial) - 1
    if d < 1:
        return [], 0
    trace = -polynomial[-2]
    places = max(0, bits - trace.bit_length())
    high = 1 << (trace.bit_length() + places)
    known = {0: d, high: 0}
    coarse = max(0, high.bit_length() - 1 - 64)

    def above(a: int) -> int:
        if a not in known:
            down = (a & -a).bit_length() - 1 if a else 0
            down = min(down, places)
            known[a] = roots_above(polynomial, a >> down, places - down)
        return known[a]

    out = []
    while len(out) < most:
        done = sum(m for _, m in out)
        if done >= min(d, most):
            break
        low, top = 0, high
        while top - low > 1 << coarse:  # first to 64 places by counting
            middle = (low + top) // 2
            low, top = (middle, top) if above(middle) > done else (low, middle)
        if above(low) - above(top) == 1:
            low = _refined(polynomial, low, top, places)
        else:
            while top - low > 1:
                middle = (low + top) // 2
                low, top = (middle, top) if above(middle) > done else (low, middle)
        count = above(low) - done
        out.append((low, count))
    return out, places


def _value(polynomial: list[int], a: int, bits: int) -> int:
    total, scale = 0, 0
    for x in reversed(polynomial):
        total = total * a + (x << scale)
        scale += bits
    return total


def _refined(polynomial: list[int], low: int, top: int, places: int) -> int:
    """Lower end of the unit interval of the only root in (low, top], by signs."""
    sign = _value(polynomial, top, places) > 0
    if _value(polynomial, top, places) == 0:
        return top - 1
    while top - low > 1:
        middle = (low + top) // 2
        value = _value(polynomial, middle, places)
        if value == 0:
            return middle - 1
        low, top = (low, middle) if (value > 0) == sign else (middle, top)
    return low


def null_vectors(matrix: np.ndarray, at: int, places: int, multiplicity: int, work: int = WORK_BITS) -> np.ndarray:
    """Orthonormal rows that span the null space of ``matrix`` - (at + 1/2) / 2^places:
    inverse iteration with one triangular factorisation in integers of ``work`` places."""
    d = len(matrix)
    scale = max(int(matrix[i, i]) for i in range(d)).bit_length()
    unit = 1 << work
    a = (matrix * unit) >> scale
    shift = ((2 * at + 1) << work) >> (places + 1 + scale)
    for i in range(d):
        a[i, i] -= shift
    order = list(range(d))
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            factor = (a[k + 1 :, k] << work) // a[k, k]
            a[k + 1 :, k + 1 :] -= (factor[:, None] * a[None, k, k + 1 :]) >> work
            a[k + 1 :, k] = factor

    def solve(v: np.ndarray) -> np.ndarray:
        y = v[order].copy()
        for k in range(d):
            y[k + 1 :] -= (a[k + 1 :, k] * y[k]) >> work
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] << work) // a[k, k]
            y[:k] -= (a[:k, k] * y[k]) >> work
        return y

    def normal(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            largest = max(abs(x) for x in v) or 1
            v = (v << work) // largest
            for u in found:
                v = v - ((int((u * v).sum()) >> work) * u >> work)
            length = math.isqrt(int((v * v).sum())) or 1
            v = (v << work) // length
        return v

    found: list[np.ndarray] = []
    for j in range(multiplicity):
        # a fixed start without a pattern that an eigenvector could be orthogonal to
        v = np.array([(pow(3 + 2 * j, i + 1, 1_000_003) << work) // 1_000_003 + 1 for i in range(d)], object)
        for _ in range(3):
            v = normal(solve(normal(v, found)), found)
        found.append(v)
    return np.array([[x / unit for x in v] for v in found], np.float64).reshape(multiplicity, d)


def eigenpairs(spark: SparkSession, matrix: np.ndarray, most: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The ``most`` largest (eigenvalue, unit eigenvector) of a positive semidefinite
    integer matrix, without those of eigenvalue zero; a task per distinct eigenvalue."""
    found, places = eigenvalues(characteristic_polynomial(spark, matrix), most)
    if not found:
        return []
    shared = spark.sparkContext.broadcast(matrix)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, at, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vectors = null_vectors(shared.value, int(at), places, m)
                flat = [v.tolist() for v in vectors]
                yield pa.record_batch(
                    [pa.array([k] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(flat, pa.list_(pa.float64()))],
                    names=["k", "j", "v"],
                )

    rows = spark.createDataFrame([(k, str(at), m) for k, (at, m) in enumerate(found)], "k int, at string, m int")
    vectors = sorted(rows.repartition(len(found)).mapInArrow(task, "k int, j int, v array<double>").collect())
    value = [(2 * at + 1) / (1 << (places + 1)) for at, _ in found]
    return [(value[k], np.array(v)) for k, _, v in vectors][:most]


# --- whitening ----------------------------------------------------------------


def _complete(vectors: DataFrame, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.where(v.isNotNull() & (F.size(v) > 0) & whole)
    return kept.withColumn("__v", v)


def fit(vectors: DataFrame, scale: int = SCALE, vector: str = "v") -> tuple[DataFrame, int, list[int], np.ndarray]:
    """The fit list of complete ``vectors`` (column ``code``: integers without the shift),
    its length n, sums per dimension, and the scatter."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = integers(_vectors(batch.column(0), width), scale)
            size = np.abs(rows.astype(np.float64)).max(axis=1)
            # a vector always gets the same width, so that equal ones have equal codes
            codes = [r.astype(np.int8 if s < 100 else np.int32 if s < 2e9 else np.int64).tobytes() for r, s in zip(rows, size, strict=True)]
            yield pa.record_batch([pa.array(codes, pa.binary())], names=["code"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a column of ones makes the sums and the number of rows products as well
        cross = sum(products(np.insert(decode(b.column(0), width), width, 1, axis=1)) for b in batches)
        if not isinstance(cross, int):
            lines = [[str(x) for x in line] for line in cross]
            yield pa.record_batch([pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.list_(pa.string()))], names=["i", "line"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.array([int(x) for x in line], object) for line in table["line"].to_pylist())
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "line": [[str(x) for x in total]]})

    common = vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = common["d"] if common else 0
    if not width:
        return None, 0, [], np.zeros((0, 0), object)
    codes = vectors.where(F.size(vector) == width).select(vector).mapInArrow(encode, "code binary")
    distinct = materialise(codes.distinct(), "fit-list")
    schema = "i int, line array<string>"
    lines = sorted(distinct.mapInArrow(sums, schema).groupBy("i").applyInArrow(add, schema).collect())
    cross = np.array([[int(x) for x in line["line"]] for line in lines], object)
    n, total = cross[-1, -1], cross[-1, :-1]
    return distinct, n, total.tolist(), cross[:-1, :-1] * n - total[:, None] * total


def decode(column: pa.Array, width: int) -> np.ndarray:
    kinds = {width: np.int8, 4 * width: np.int32, 8 * width: np.int64}
    rows = [np.frombuffer(c.as_buffer(), kinds[len(c.as_buffer())]) for c in column]
    return np.array(rows, np.int64).reshape(-1, width)


def _centred(rows: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """x - S / n, and the sum of (n x - S)^2 per row, exact; null beyond a long."""
    s = np.array(total, object)
    small = not len(rows) or (np.abs(rows.astype(np.float64)).max() * n + max(map(abs, total))) ** 2 * rows.shape[1] < 2.0**62
    if small:
        moved = rows * n - s.astype(np.int64)
        return moved / n, (moved * moved).sum(axis=1).tolist()
    exact = rows.astype(object) * n - s
    deviation = [int(x) for x in (exact * exact).sum(axis=1)]
    return (exact / n).astype(np.float64), [x if x < 1 << 63 else None for x in deviation]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, identity: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per complete vector and component, by falling eigenvalue e of the fit
    list's covariance V: ``id``, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained`` (e / trace of V) and ``identity_error``, the largest entry of the
    whitened fit list's covariance less the identity.

    The shift of all entries cancels wherever a mean is subtracted, so none is added.
    """
    spark = vectors.sparkSession
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = _complete(vectors, vector).select(F.col(identity).cast("long").alias("id"), F.col("__v").alias("v"))
    distinct, n, total, scatter = fit(whole, scale)
    pairs = eigenpairs(spark, scatter, components) if n > 1 else []
    if not pairs:
        return spark.createDataFrame([], schema)
    width, k = len(scatter), len(pairs)
    trace = int(sum(scatter[i, i] for i in range(width)))
    explained = [e / trace for e, _ in pairs]
    # the scatter is n^2 V, so a component's deviation is sqrt(e) / n
    project = np.stack([v / (math.sqrt(e) / n) for e, v in pairs], axis=1)

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 1, k))
        for batch in batches:
            white = _centred(decode(batch.column(0), width), n, total)[0] @ project
            out[:k] += white.T @ white
            out[k] += white.sum(axis=0)
        flat = out.ravel().tolist()
        yield pa.record_batch([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["i", "x"])

    cells = distinct.mapInArrow(covariance, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros((k + 1) * k)
    sums[[c["i"] for c in cells]] = [c["x"] for c in cells]
    sums = sums.reshape(k + 1, k) / n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            centred, deviation = _centred(integers(_vectors(batch.column(1), width), scale), n, total)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array((centred @ project).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.record_batch(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.where(F.size("v") == width).mapInArrow(task, schema)
