"""Whitening of embeddings by block Jacobi-Davidson on distributed products.

The covariance is never formed.  Vectors are written once as integer blocks; a
product of the covariance with a few columns is one pass over them: each task
centres its rows exactly, multiplies, and returns one partial sum.

The solver keeps a subspace W and V W.  Rayleigh-Ritz gives the leading pairs;
pairs whose residual is down to double precision are locked: they stay in the
subspace and get no more corrections.  Each open pair's correction equation,
projected against all leading Ritz vectors, is solved roughly by MINRES, all
pairs side by side, so that a step of all of them is one pass.  The corrections
enlarge W, which restarts from its best vectors when it is full.

Rows whose vector is null, is empty, or holds a null or non-finite entry or one
of 2^30 or more in size are dropped; so are vectors of another length than the
most frequent one (of equals, the longest).  A null or repeated vec_id and
repeated vectors are rows like any others.  A component whose eigenvalue is
nought to double precision cannot be whitened and is left out, so one vector,
equal vectors or an empty table give no rows.  Equal eigenvalues have any
orthonormal basis of theirs.  `deviation` is null where it exceeds 64 bits.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, materialize, table

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 30
BLOCK_BYTES = 4_000_000
TASKS = 4096  # tasks of a pass at most: the driver adds up one partial sum of each
INNER = 6  # MINRES steps of a correction at most
OUTER = 200
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Product = Callable[[np.ndarray], np.ndarray]


# ---- solver -----------------------------------------------------------------------------------

def minres(product: Product, right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Rough solutions of symmetric systems, one a column; `product` applies each column's own matrix."""
    def over(a, b):
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.abs(b) > 1e-300)

    eta = first = np.linalg.norm(right, axis=0)
    v, v_old, beta = over(right, first), np.zeros_like(right), first
    x, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    cos, cos_old, sin, sin_old = np.ones_like(first), np.ones_like(first), np.zeros_like(first), np.zeros_like(first)
    beta = np.zeros_like(first)
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        delta = cos * alpha - cos_old * sin * beta
        r1, r2, r3 = np.hypot(delta, after), sin * alpha + cos_old * cos * beta, sin_old * beta
        cos_old, sin_old, cos, sin = cos, sin, over(delta, r1), over(after, r1)
        w, w_old = over(v - r3 * w_old - r2 * w, r1), w
        x = x + cos * eta * w
        eta = -sin * eta
        v_old, v, beta = v, over(p, after), after
        if (np.abs(eta) <= tolerance * first).all():
            break
    return x


def _extend(basis: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Orthonormal columns that widen the basis by the given ones; those inside it already are left out."""
    new = []
    for c in columns.T:
        size = np.linalg.norm(c)
        if not size:
            continue
        c = c / size
        for _ in range(3):
            before = np.linalg.norm(c)
            for q in (basis, np.array(new).T if new else basis[:, :0]):
                c = c - q @ (q.T @ c)
            if np.linalg.norm(c) > 0.7 * before:
                break
        if np.linalg.norm(c) > 1e-10:
            new.append(c / np.linalg.norm(c))
    return np.array(new).T if new else basis[:, :0]


def jacobi_davidson(product: Product, dimension: int, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric positive matrix, falling, and their unit eigenvectors."""
    count = min(count, dimension)
    random = np.random.default_rng(seed)
    widest, kept = min(dimension, 10 * count), min(dimension, 3 * count)
    basis = _extend(np.zeros((dimension, 0)), random.normal(size=(dimension, min(dimension, count + 4))))
    image = product(basis)
    for _ in range(OUTER):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, :count]
        left = image @ turn[:, :count] - ritz * values[:count]
        top = max(values[0], 0.0)
        enough = 2e-14 * np.sqrt(dimension) * top
        open_ = np.flatnonzero(np.linalg.norm(left, axis=0) > enough)  # all others are locked
        if not len(open_) or basis.shape[1] == dimension:
            break

        def outside(y):
            return y - ritz @ (ritz.T @ y)

        def projected(y):
            y = outside(y)
            return outside(product(y) - y * values[open_])

        step = outside(minres(projected, -outside(left[:, open_]), INNER, 0.1))
        if basis.shape[1] + len(open_) > widest:
            basis, image = basis @ turn[:, :kept], image @ turn[:, :kept]
        new = _extend(basis, step)
        if not new.shape[1]:  # corrections within rounding of the subspace: try another direction
            new = _extend(basis, random.normal(size=(dimension, 1)))
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    worst = np.linalg.norm(product(ritz) - ritz * values[:count], axis=0).max() if top else 0.0
    if worst > 1e-11 * top:
        raise ArithmeticError(f"an eigenvector's residual is still {worst / top:.1e} of the largest eigenvalue")
    return values[:count], ritz


# ---- distributed passes -------------------------------------------------------------------------

def integer_blocks(vectors: DataFrame) -> tuple[DataFrame, int]:
    """((vec_ids, x) with many vectors a row, x as packed longs; the dimension)."""
    vectors = keep_only(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    sound = vectors.filter(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LARGEST))) & (F.size("embedding") > 0))
    lengths = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = lengths["d"] if lengths else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOCK_BYTES // (8 * max(dimension, 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = np.floor(SCALE * part.column("embedding").flatten().to_numpy(zero_copy_only=False)).astype("<i8") + SHIFT
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("vec_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())],
                    ["vec_ids", "x"])

    blocks = sound.filter(F.size("embedding") == dimension).mapInArrow(run, "vec_ids array<long>, x binary")
    return materialize(blocks, "vector-blocks"), dimension


def partial_sums(blocks: DataFrame, dimension: int, part: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """The sum over each task's blocks of part(rows of longs), in the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("x"):
                value = part(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dimension))
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary()),
                                              pa.array([total.dtype.str]), pa.array([list(total.shape)], pa.list_(pa.int32()))],
                                             ["task", "total", "dtype", "shape"])

    found = blocks.select("x").coalesce(TASKS).mapInArrow(run, "task int, total binary, dtype string, shape array<int>").collect()
    return [np.frombuffer(r["total"], r["dtype"]).reshape(r["shape"]) for r in sorted(found, key=lambda r: r["task"])]


class Centred:
    """Rows of longs less their mean S / n: the whole part of the mean goes exactly, its fraction after that."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.fraction = np.array([s % n / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.fraction

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, exactly."""
        near = x - self.whole
        if x.shape[1] * (self.n * (float(np.abs(near).max(initial=0)) + 1)) ** 2 < 2.0 ** 62:
            rest = np.array([s % self.n for s in self.sums], np.int64)
            return pa.array(((self.n * near - rest) ** 2).sum(axis=1))
        rest = [s % self.n for s in self.sums]
        exact = (sum((self.n * a - b) ** 2 for a, b in zip(row, rest)) for row in near.tolist())
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whiten(vectors: DataFrame, count: int = 8) -> DataFrame:
    """Each vector's first `count` whitened components, with the figures of the contract."""
    spark = vectors.sparkSession
    blocks, dimension = integer_blocks(vectors)
    sums = partial_sums(blocks, dimension, lambda x: np.append(x.sum(axis=0), len(x)))
    if not sums:
        return spark.createDataFrame([], OUT)
    *total, n = [sum(int(s[d]) for s in sums) for d in range(dimension + 1)]
    centred = Centred(n, total)

    def product(columns: np.ndarray) -> np.ndarray:
        def part(x):
            a = centred(x)
            return a.T @ (a @ columns)
        return np.sum(partial_sums(blocks, dimension, part), axis=0) / n

    trace = float(np.sum(partial_sums(blocks, dimension, lambda x: np.array([(centred(x) ** 2).sum()])))) / n
    if not trace:
        return spark.createDataFrame([], OUT)
    values, axes = jacobi_davidson(product, dimension, count)
    sound = values > dimension * np.finfo(float).eps * trace
    values, axes = values[sound], axes[:, sound]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    turn = axes / np.sqrt(values)

    mean = np.sum(partial_sums(blocks, dimension, lambda x: (centred(x) @ turn).sum(axis=0)), axis=0) / n

    def spread(x):
        z = centred(x) @ turn - mean
        return z.T @ z

    error = float(np.abs(np.sum(partial_sums(blocks, dimension, spread), axis=0) / n - np.eye(len(values))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for vec_ids, x in zip(batch.column("vec_ids"), batch.column("x")):
                x = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dimension)
                row = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [vec_ids.values.take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), n)),
                     centred.deviation(x).take(row), pa.array((centred(x) @ turn).ravel()), pa.array(np.tile(values / trace, len(x))),
                     pa.array(np.full(len(row), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(run, OUT)


def op13_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 13: eight whitened components of every sound embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))
