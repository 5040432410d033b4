"""Embedding whitening: principal components by contour integration (FEAST).

1. **Moments** (two Spark passes).  Entries become integers; the first pass sums
   them, the second sums the products of entries less the rounded mean.  Both
   sums are exact integers (decimals in the aggregate), so the covariance does not
   depend on the order of tasks or on retries.  The remaining fraction of the mean
   is taken off exactly: ``n^2 V = n * sum(z z') - sum(z) sum(z)'``.  Only
   d * (d + 1) / 2 numbers reach the driver.
2. **Slices.**  The number of eigenvalues above a shift is the inertia of
   ``V - shift I`` (an LDL' factorisation with 1x1 and 2x2 pivots); halving finds
   shifts that enclose the wanted eigenvalues in intervals of few.
3. **FEAST** per interval: a Gauss-Legendre quadrature over a circle through its ends, each
   node a complex shifted solve ``(z I - V) X = Y``, projects a random block onto the
   interval's eigenspace; Rayleigh-Ritz on that space gives the pairs; repeated until
   the residuals stand at rounding level.  An interval must yield as many pairs as
   its inertia counts say, otherwise the block grows and the interval is done again.
4. **Whitening** (two passes): rows less the mean, projected and divided by the root of
   the eigenvalue; the first measures the covariance of exactly these values
   (``identity_error``), the second returns them.

Defined results: rows whose vector is null, empty, or has a null or non-finite entry, or
not the length most vectors have, are dropped, as are rows with an entry of 2**30 and more in
size (integers beyond 2**40 would leave no exact sums).  Rows without id stay, with a null id; repeated rows
count each time.  A component whose eigenvalue is below 1e-10 of the largest is zero to double
precision and is not returned (constant dimensions, fewer than nine rows): there may be fewer
than eight, and none for one row or equal rows.  ``deviation`` is null where the exact number does not
fit into a long (from some 3 million unit vectors on); ``deviation_exact`` always has it.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite, matrix

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100000
LARGEST = float(1 << 40)
#: eigenvalues below this share of the largest are zero to double precision
NEGLIGIBLE = 1e-10
NODES = 12
EXACT = 1 << 53


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(v * SCALE).astype(np.int64) + SHIFT


# ----------------------------------------------------------- exact moments

def _exact_products(z: np.ndarray) -> np.ndarray:
    """z' z of integers as Python integers, in blocks whose sums are exact in double precision."""
    d = z.shape[1]
    largest = int(np.abs(z).max(initial=0))
    out = np.zeros((d, d), object)
    if largest == 0:
        return out
    step = EXACT // (largest * largest)
    if step < 1:
        wide = z.astype(object)
        return wide.T.dot(wide)
    for a in range(0, len(z), min(step, 1 << 20)):
        block = z[a:a + min(step, 1 << 20)].astype(np.float64)
        out += (block.T @ block).astype(np.int64).astype(object)
    return out


def _sums(dim: int, centre: np.ndarray | None):
    """Per task: (i, -1, sum of entry i), and with a centre (i, j, sum of products), i <= j;
    (-1, -1, rows)."""
    def run(batches):
        rows, first, second = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            z = integers(matrix(batch.column("v"), dim))
            if centre is not None:
                z -= centre
                second += _exact_products(z)
            rows += len(z)
            first += z.sum(0).astype(object)
        if not rows:
            return
        i, j = [-1] + list(range(dim)), [-1] * (dim + 1)
        value = [rows, *first]
        if centre is not None:
            up, across = np.triu_indices(dim)
            i, j, value = i + up.tolist(), j + across.tolist(), value + second[up, across].tolist()
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
            "s": pa.array([Decimal(int(x)) for x in value], pa.decimal128(38, 0))})

    return run


def _collected(vectors: DataFrame, dim: int, centre: np.ndarray | None) -> dict[tuple[int, int], int]:
    rows = vectors.select("v").mapInArrow(_sums(dim, centre), "i int, j int, s decimal(38,0)") \
        .groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return {(r["i"], r["j"]): int(r["s"]) for r in rows}


def moments(vectors: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, per-dimension sums S and covariance V (divisor n) of the integer vectors."""
    found = _collected(vectors, dim, None)
    n = found.get((-1, -1), 0)
    if not n:
        return 0, [0] * dim, np.zeros((dim, dim))
    sums = [found[i, -1] for i in range(dim)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    found = _collected(vectors, dim, centre)
    rest = [found[i, -1] for i in range(dim)]
    V = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            V[i, j] = V[j, i] = float(Fraction(n * found[i, j] - rest[i] * rest[j], n * n))
    return n, sums, V


# ------------------------------------------------- eigenvalues by contour integration

def below(V: np.ndarray, shift: float) -> int:
    """Number of eigenvalues below the shift: negative pivots of an LDL' factorisation of
    V - shift I with diagonal pivoting (1x1 and 2x2 pivots)."""
    a = V - shift * np.eye(len(V))
    negative = 0
    ratio = (1 + 17 ** 0.5) / 8
    while len(a):
        n = len(a)
        size = np.abs(a)
        diagonal = int(size.diagonal().argmax())
        p, q = divmod(int(size.argmax()), n)
        if size[p, q] == 0:
            break
        if p == q or size[diagonal, diagonal] >= ratio * size[p, q]:
            rest = np.delete(np.arange(n), diagonal)
            pivot = a[diagonal, diagonal]
            negative += pivot < 0
            column = a[rest, diagonal]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / pivot
        else:
            # the pivot's off-diagonal dominates: one eigenvalue of each sign
            rest = np.delete(np.arange(n), [p, q])
            negative += 1
            columns = a[np.ix_(rest, [p, q])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_([p, q], [p, q])], columns.T)
        a = (a + a.T) / 2
    return int(negative)


def slices(V: np.ndarray, wanted: int, most: int = 6) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside), from the top, that together hold at least
    ``wanted`` eigenvalues; each holds at most ``most`` unless closer ends can't part them."""
    d = len(V)
    high = float(np.abs(V).sum(1).max()) * (1 + 1e-9) + 1e-300
    narrow = high * 1e-9
    whole = [(-narrow, high, d - below(V, -narrow))]
    out, held = [], 0
    while whole and held < wanted:
        low, top, count = whole.pop()
        if count == 0:
            continue
        if count <= most or top - low <= narrow:
            out.append((low, top, count))
            held += count
            continue
        half = (low + top) / 2
        under = below(V, half) - below(V, low)
        whole += [(low, half, under), (half, top, count - under)]
    return out


def feast(V: np.ndarray, low: float, high: float, count: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of V with low <= eigenvalue < high."""
    d, scale = len(V), np.abs(V).sum(1).max()
    points, weights = np.polynomial.legendre.leggauss(nodes)
    radius, middle = (high - low) / 2, (high + low) / 2
    block = min(d, count + max(4, count // 2))
    for attempt in range(8):
        Y = np.random.default_rng(attempt).standard_normal((d, block))
        before = np.inf
        for _ in range(30):
            Q = np.zeros((d, Y.shape[1]))
            for x, w in zip(points, weights):
                turn = radius * np.exp(-0.5j * np.pi * (x - 1))
                Q += w / 2 * np.real(turn * np.linalg.solve((middle + turn) * np.eye(d) - V, Y.astype(complex)))
            u, s, _ = np.linalg.svd(Q, full_matrices=False)
            basis = u[:, s > s[0] * 1e-14]
            values, mixed = np.linalg.eigh(basis.T @ V @ basis)
            Y = basis @ mixed
            residual = np.linalg.norm(V @ Y - Y * values, axis=0)
            inside = (values >= low) & (values < high) & (residual <= 1e-6 * scale)
            worst = residual[inside].max() if inside.any() else np.inf
            if inside.sum() == count and (worst <= 4e-15 * scale or worst >= before / 2 and worst <= 1e-12 * scale):
                # none missed: as many as the inertia counts say
                return values[inside], Y[:, inside]
            before = worst
        block = min(d, 2 * block)
    raise RuntimeError(f"FEAST found {int(inside.sum())} of {count} eigenvalues in [{low}, {high})")


def principal(V: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above zero, falling, and their unit vectors (columns);
    the largest entry of every vector is positive."""
    if not len(V) or not V.any():
        return np.zeros(0), np.zeros((len(V), 0))
    scale = np.abs(V).sum(1).max()
    found = [feast(V / scale, *part) for part in slices(V / scale, min(wanted, len(V)))]
    values = np.concatenate([v for v, _ in found])
    columns = np.concatenate([c for _, c in found], 1)
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > NEGLIGIBLE * values[order[0]]]
    # intervals are done one by one: take off what rounding left between them
    columns = np.linalg.qr(columns[:, order])[0]
    values = np.einsum("dk,de,ek->k", columns, V, columns)
    largest = columns[np.abs(columns).argmax(0), np.arange(len(values))]
    return values, columns * np.where(largest < 0, -1.0, 1.0)


# ------------------------------------------------------------------- whitening

def _whitened(v: np.ndarray, n: int, sums: list[int], values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    x = integers(v)
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return ((x - whole) - part) @ columns / np.sqrt(values)


def _second_moments(dim: int, fit):
    def run(batches):
        k = len(fit[2])
        rows, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _whitened(matrix(batch.column("v"), dim), *fit)
            rows, first, second = rows + len(w), first + w.sum(0), second + w.T @ w
        if rows:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(list(range(k)) + np.repeat(np.arange(k), k).tolist(), pa.int32()),
                "j": pa.array([-1] * k + np.tile(np.arange(k), k).tolist(), pa.int32()),
                "s": pa.array(first.tolist() + second.ravel().tolist(), pa.float64())})

    return run


def identity_error(vectors: DataFrame, dim: int, fit) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    n, k = fit[0], len(fit[2])
    rows = vectors.select("v").mapInArrow(_second_moments(dim, fit), "i int, j int, s double") \
        .groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    found = {(r["i"], r["j"]): r["s"] / n for r in rows}
    mean = np.array([found[i, -1] for i in range(k)])
    second = np.array([[found[i, j] for j in range(k)] for i in range(k)])
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n * x - S)^2."""
    far = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if far >= 1 << 62:
        y = x.astype(object) * n - np.array(sums, object)
    else:
        y = x * n - np.array(sums, np.int64)
        widest = int(np.abs(y).max(initial=0))
        if widest * widest * x.shape[1] < 1 << 62:
            return (y * y).sum(1).tolist()
        y = y.astype(object)
    return [int(s) for s in (y * y).sum(1)]


def _rows(dim: int, fit, explained: np.ndarray, error: float):
    n, sums, values, _ = fit
    k = len(values)
    most = 10 ** 38

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"), dim)
            w = _whitened(v, *fit)
            exact = deviations(integers(v), n, sums)
            repeat = np.repeat(np.arange(len(v)), k)
            with localcontext() as context:
                context.prec = 60
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").take(pa.array(repeat)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(v))),
                    "n": pa.array(np.full(len(repeat), n)),
                    "deviation": pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()).take(pa.array(repeat)),
                    "whitened": pa.array(w.ravel()),
                    "explained": pa.array(np.tile(explained, len(v))),
                    "identity_error": pa.array(np.full(len(repeat), error)),
                    "deviation_exact": pa.array([Decimal(e) if e < most else None for e in exact],
                                                pa.decimal128(38, 0)).take(pa.array(repeat))})

    return run


SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double, deviation_exact decimal(38,0)")


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row."""
    vectors = finite(rows).where(~F.exists("v", lambda c: F.abs(c) * SCALE >= LARGEST))
    first = vectors.first()
    if first is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    dim = len(first["v"])
    n, sums, V = moments(vectors, dim)
    values, columns = principal(V, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    fit = (n, sums, values, columns)
    error = identity_error(vectors, dim, fit)
    return vectors.mapInArrow(_rows(dim, fit, values / np.trace(V), error), SCHEMA)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
