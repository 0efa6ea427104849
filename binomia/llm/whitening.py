"""Whitening of embeddings: principal components by matrix-free block Lanczos.

Vectors become integers, so sums and deviations from the mean are exact. The covariance is
never formed: a pass over the rows multiplies it with a block of vectors,
``sum (x - mean) ((x - mean)' Q) / n``, a product of two small matrices per batch, and Spark
adds what the tasks found, one number per dimension and column of the block. The driver holds
the Krylov basis only: ``dimensions x (components + some blocks)`` numbers, whatever the rows.

Each new block is made orthogonal to the whole basis twice. Columns that vanish (an invariant
subspace, equal eigenvalues, constant dimensions) are drawn anew at random and the process
goes on. Ritz pairs come from the basis and its stored images; the process ends when the
residuals of all wanted pairs are small, and a block drawn at random changes none of them
(eigenvalues that occur more often than a block has columns would be missed), or when the
basis spans the space. A basis that grew too long shrinks to its best Ritz vectors and
continues from their residuals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, list_array

#: Components, columns of a block, and blocks of the basis besides the components before it shrinks.
COMPONENTS, BLOCK, BLOCKS = 32, 16, 12
#: Residual, relative to the largest eigenvalue, below which a pair is done; passes at most.
RESIDUAL, PASSES = 1e-13, 400
#: Eigenvalues below this share of the largest count as 0: their components don't exist.
ZERO = 1e-12
#: Vectors of one step of a task.
STEP = 4096
#: What an entry is multiplied with, what is added, and the largest product that fits.
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**52


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the usable rows: x is floor(64 c) + 1000000 of every entry c, as longs.

    Rows go whose vector is null or empty, or has a null, non-finite or overly large entry
    (64 |c| above 2^52, where doubles have no units), and rows of another length than most
    (of two equally frequent lengths the longer one counts).
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) <= LARGEST)
    v = v.filter(F.size("v") > 0).filter(F.forall("v", lambda c: F.coalesce(sound(c), F.lit(False))))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            yield b.slice(at, STEP)


def _added(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """``part`` of the matrix in the last column of each batch, summed over all rows: one number per position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in _rows(batches):
            new = part(_matrix(b.column(b.num_columns - 1))).ravel()
            total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    sums = df.mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(sums.num_rows, np.int64 if kind == "long" else float)
    out[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    return out


def _orthogonal(w: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns in place of those of ``w``, orthogonal to ``basis``; vanishing ones are drawn anew."""
    room, out = len(basis) - basis.shape[1], []
    for k in range(min(w.shape[1], room)):
        c, size = w[:, k], scale
        for _ in range(20):
            known = np.column_stack([basis, *out])
            for _ in range(2):
                c = c - known @ (known.T @ c)
            norm = np.linalg.norm(c)
            if norm > 1e-14 * size:
                c = c / norm
                c = c - known @ (known.T @ c)
                out.append(c / np.linalg.norm(c))
                break
            c, size = rng.standard_normal(len(c)), 1.0
    return np.column_stack(out) if out else np.empty((len(basis), 0))


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, block: int = BLOCK, blocks: int = BLOCKS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    ``times`` multiplies the matrix with a block of columns.
    """
    rng = np.random.default_rng(seed)
    k, block = min(k, dims), min(block, dims)
    basis, images = np.empty((dims, 0)), np.empty((dims, 0))
    fresh = lambda: rng.standard_normal((dims, block))
    new, known = _orthogonal(fresh(), basis, 1.0, rng), None
    for _ in range(PASSES):
        basis, images = np.column_stack([basis, new]), np.column_stack([images, times(new)])
        inner = basis.T @ images
        e, s = np.linalg.eigh((inner + inner.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        rest = images @ s[:, :k] - basis @ s[:, :k] * e[:k]
        size = max(float(np.abs(e).max()), np.finfo(float).tiny)
        done = basis.shape[1] >= k and np.linalg.norm(rest, axis=0).max() <= RESIDUAL * size
        if basis.shape[1] == dims or (done and known is not None and np.abs(e[:k] - known).max() <= 1e-10 * size):
            return e[:k], np.linalg.qr(basis @ s[:, :k])[0]
        known = e[:k] if done else known
        if basis.shape[1] + block > k + blocks * block:  # shrink, then go on from the largest residuals
            keep = k + block
            rest = images @ s[:, :keep] - basis @ s[:, :keep] * e[:keep]
            basis, images = basis @ s[:, :keep], images @ s[:, :keep]
            new = rest[:, np.argsort(-np.linalg.norm(rest[:, :k], axis=0))[:block]]
        else:
            new = images[:, -new.shape[1] :]
        new = _orthogonal(fresh() if done else new, basis, size, rng)
    raise RuntimeError(f"no convergence in {PASSES} passes")


def _whole_means(n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means rounded to whole numbers, and what n times these leave of the sums."""
    mean = (sums + n // 2) // n
    return mean, sums - n * mean


def _deviations(n: int, sums: np.ndarray):
    """Exact squared deviations: with whole means m and remainders r, n x - S is n (x - m) - r."""
    mean, rest = _whole_means(n, sums)
    square = int(sum(int(r) ** 2 for r in rest.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            u = _matrix(b.column(1)) - mean
            wide = u.size and float(np.abs(u).max()) ** 2 * u.shape[1] >= 2.0**62 or float(np.abs(rest).max()) * float(np.abs(u).max(initial=0)) * max(1, u.shape[1]) >= 2.0**62
            u, r = (u.astype(object), rest.astype(object)) if wide else (u, rest)
            a, c = (u * u).sum(1).tolist(), (u * r).sum(1).tolist()
            d = [n * n * int(x) - 2 * n * int(y) + square for x, y in zip(a, c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.decimal128(38, 0))], ["vec_id", "x", "deviation"])

    return run


def _projected(centred: Callable[[np.ndarray], np.ndarray], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            w = centred(_matrix(b.column(1))) @ weights
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), list_array(list(w), pa.float64())], ["vec_id", "deviation", "whitened"])

    return run


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row (see :func:`integer_vectors`) and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Components are unit eigenvectors of the covariance (divisor n) of all usable rows, from 1
    by falling eigenvalue, as many as ``components`` and the rank allow (eigenvalues below
    10^-12 of the largest count as 0). ``deviation`` (decimal) is the exact sum over
    dimensions of (n x - S)^2, ``whitened`` the projection of x - S/n over the root of the
    eigenvalue, ``explained`` the eigenvalue's share of the trace, which is the sum of all
    deviations over n^3, ``identity_error`` the largest entry of the covariance of ``whitened``
    minus the identity, as measured. Equal eigenvalues have any orthonormal basis of their
    space. No usable row, or only equal ones, give no rows. Repeated rows and rows without id
    count and are returned as often as they come; other columns are ignored.
    """
    spark, tables = vectors.sparkSession, Scratch(vectors.sparkSession, "whitening")
    x, p_x = tables.put(integer_vectors(vectors, id_col, vector_col))
    sizes = x.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if sizes is None:
        tables.drop(p_x)
        return spark.createDataFrame([], schema)
    dims, n = sizes["dims"], sizes["n"]
    x = x.filter(F.size("x") == dims)
    sums = _added(x, lambda m: m.sum(0), "long")
    whole, rest = _whole_means(n, sums)
    rest = rest / n
    centred = lambda m: (m - whole) - rest
    x, p_dev = tables.put(x.mapInArrow(_deviations(n, sums), "vec_id long, x array<long>, deviation decimal(38,0)"))
    trace = int(x.agg(F.sum("deviation")).first()[0]) / n**3
    tables.drop(p_x)

    def times(q: np.ndarray) -> np.ndarray:
        part = lambda m: (c := centred(m)).T @ (c @ q)
        return _added(x.select("x"), part, "double").reshape(dims, -1) / n

    e, vectors_ = block_lanczos(times, dims, components, block) if trace > 0 else (np.empty(0), np.empty((dims, 0)))
    real = e > ZERO * max(e.max(initial=0), 0)
    e, vectors_ = e[real], vectors_[:, real]
    k = len(e)
    if not k:
        tables.drop(p_dev)
        return spark.createDataFrame([], schema)
    white, _ = tables.put(x.mapInArrow(_projected(centred, vectors_ / np.sqrt(e)), "vec_id long, deviation decimal(38,0), whitened array<double>"))
    tables.drop(p_dev)
    centre = _added(white, lambda w: w.sum(0), "double") / n
    cov = _added(white, lambda w: (c := w - centre).T @ c, "double").reshape(k, k) / n
    error = float(np.abs(cov - np.eye(k)).max())
    share = F.array(*[F.lit(float(v)) for v in e / trace])
    out = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
