"""Whitening of vectors by their leading principal components.

Matrix-free block subspace iteration: no covariance matrix is built.  A pass
over the vectors computes X'(XQ) on centred rows for a block Q of directions.
Products of earlier passes are kept: Rayleigh-Ritz works in the span of all
blocks since the last restart, and the next block is the orthonormalised (QR)
residuals of the leading Ritz pairs.  Without that, spectra as flat as those of
near-random vectors (eigenvalues 8 and 33 apart by 6 %) take some 450 passes to
double precision; with it, as many as blocks fit into the length or few more.
The passes end when the residual norms of all k components are at most
``TOLERANCE`` of the largest eigenvalue; a restart keeps the leading Ritz
vectors once ``BASIS`` directions are held.

Components are integers, x = floor(1024 * c) + 100000, so n and the sums S are
exact, and rows are centred as (n * x - S) / n: the difference is exact too.
Each task gives one matrix of length x block (``summed`` merges them as a
stream); the driver holds length x BASIS numbers, nothing that grows with rows.
The sign of a component is such that its largest entry by absolute value is
positive.

Nulls: vectors that are null or hold null or non-finite components are left out.
Repeated rows and vec_ids, and rows without a vec_id, count each.  Components
beyond the length are not returned; those of no variance (at most 1e-12 of the
whole) have ``whitened`` null and take no part in ``identity_error``.
``explained`` is 0 where nothing varies.  Vectors of another length than most
have, empty ones included, are no part of the fit and are returned with
``deviation`` and ``whitened`` null.  floor(1024 * c) is held within +-2**31
(2**21 in c), so sums of 2**31 rows stay in 64 bits; a deviation that leaves 64
bits is null.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .vectors import chunks, integers, kept_vectors, summed

COMPONENTS = 8
OFFSET = 100_000
BOUND = 1 << 31
#: Directions a pass, for each component asked for.
BLOCK = 4
BASIS = 512
TOLERANCE = 1e-13
PASSES = 200
#: A component of a smaller share of the variance has none.
NOTHING = 1e-12
LONGEST = (1 << 63) - 1


@dataclass
class Whitening:
    """A fitted map: d numbers a vector to k uncorrelated ones of variance 1."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def varies(self) -> np.ndarray:
        return self.values > NOTHING * self.trace if self.trace > 0 else np.zeros(len(self.values), bool)


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact in 64 bits, or in integers of any size beyond them."""
    if n * int(np.abs(x).max(initial=0)) >= LONGEST:
        return x.astype(object) * n - sums.astype(object)
    return x * np.int64(n) - sums


def _centred(batches: Iterator[pa.RecordBatch], d: int, n: int, sums: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for batch in chunks(batches, max(d, width)):
        yield differences(integers(batch.column("v"), d, BOUND, OFFSET), n, sums).astype(np.float64) / n


def _moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros(d + 1, np.int64)
        for batch in chunks(batches, d):
            total[0] += batch.num_rows
            total[1:] += integers(batch.column("v"), d, BOUND, OFFSET).sum(0)
        return {0: total}

    total = summed(rows, run, np.int64)[0]
    return int(total[0]), total[1:]


def _products(rows: DataFrame, d: int, n: int, sums: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """(V * block, trace of V) in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast((sums, block))

    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums, q = shared.value
        total, trace = np.zeros(q.shape), 0.0
        for x in _centred(batches, d, n, sums, q.shape[1]):
            total += x.T @ (x @ q)
            trace += float((x * x).sum())
        return {0: np.append(total.reshape(-1), trace)}

    total = summed(rows, run, np.float64)[0] / n
    shared.unpersist()
    return total[:-1].reshape(block.shape), float(total[-1])


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what block adds to the basis."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
        q, r, rest = *np.linalg.qr(block), basis.shape[0] - basis.shape[1]
        block = q[:, np.abs(np.diag(r)) > 1e-10][:, :rest]
        if not block.size:
            break
    return block


def leading(multiply, d: int, k: int, block: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, eigenvectors as columns, passes) of a symmetric
    matrix known by its products with blocks."""
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    q = np.linalg.qr(np.random.default_rng(13).normal(size=(d, min(block, d))))[0]
    best, stale = np.inf, 0
    for passes in range(1, PASSES + 1):
        basis, images = np.hstack([basis, q]), np.hstack([images, multiply(q)])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1][:, : max(block, k)]
        values = values[::-1][: turn.shape[1]]
        ritz = basis @ turn
        residual = images @ turn - ritz * values
        worst = float(np.linalg.norm(residual[:, :k], axis=0).max())
        stale = 0 if worst < best / 2 else stale + 1
        best = min(best, worst)
        # at the last digit of the sums nothing more is to be had
        if worst <= tolerance * max(values[0], 0.0) or (stale >= 8 and worst <= 1e-11 * values[0]):
            return values[:k], ritz[:, :k], passes
        if basis.shape[1] + block > BASIS and basis.shape[1] < d:
            keep = turn[:, : min(2 * block, turn.shape[1])]
            basis, images = basis @ keep, images @ keep
        q = _orthonormal(residual[:, : min(block, residual.shape[1])], basis)
        if not q.size:
            # the basis spans all: refine from the Ritz vectors themselves
            basis, images, q = np.zeros((d, 0)), np.zeros((d, 0)), np.linalg.qr(ritz)[0]
    raise RuntimeError(f"components did not settle in {PASSES} passes")


def fit_whitening(rows: DataFrame, d: int, k: int = COMPONENTS) -> Whitening:
    """From all rows, whose vectors ``v`` have length d."""
    rows, k = rows.select("v"), min(k, d)
    n, sums = _moments(rows, d)
    found = {}

    def multiply(q: np.ndarray) -> np.ndarray:
        image, found["trace"] = _products(rows, d, n, sums, q)
        return image

    values, axes, passes = leading(multiply, d, k, min(d, BLOCK * k))
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    model = Whitening(n, sums, np.maximum(values, 0.0), axes, found["trace"], 0.0, passes)
    model.identity_error = _identity_error(rows, d, model)
    return model


def _whiten(x: np.ndarray, model: Whitening) -> np.ndarray:
    return (x @ model.vectors) / np.sqrt(np.where(model.varies(), model.values, np.nan))


def _identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the
    identity, over the components that vary."""
    on = model.varies()
    k = int(on.sum())
    if not k:
        return 0.0
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        model = shared.value
        square, first = np.zeros((k, k)), np.zeros(k)
        for x in _centred(batches, d, model.n, model.sums, k):
            w = _whiten(x, model)[:, on]
            square += w.T @ w
            first += w.sum(0)
        return {0: np.append(square.reshape(-1), first)}

    total = summed(rows, run, np.float64)[0] / model.n
    square, mean = total[: k * k].reshape(k, k), total[k * k :]
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, d: int, model: Whitening) -> DataFrame:
    """Rows with ``deviation`` and ``whitened``, an array by component, in place
    of v."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = [c for c in rows.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, d):
            far = differences(integers(batch.column("v"), d, BOUND, OFFSET), model.n, model.sums)
            near = far.astype(np.float64)
            exact = far if float(np.abs(near).max(initial=0)) ** 2 * d < 2**62 else far.astype(object)
            total = [int(t) if t <= LONGEST else None for t in (exact * exact).sum(1)]
            w = _whiten(near / model.n, model)
            made = pa.FixedSizeListArray.from_arrays(pa.array(w.reshape(-1), from_pandas=True), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch({**{c: batch.column(c) for c in others}, "deviation": pa.array(total, pa.int64()), "whitened": made})

    kinds = dict(rows.dtypes)
    return rows.select(*others, "v").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", deviation long, whitened array<double>")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """One row a vector and component, of all rows of embeddings."""
    rows, d = kept_vectors(table(spark, sf_dir, "embeddings"), [F.col("vec_id").cast("long")])
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    fit, k = rows.filter(F.size("v") == d), min(COMPONENTS, d)
    model = fit_whitening(fit, d, k)
    explained = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]
    odd = rows.filter(F.size("v") != d).select("vec_id", F.lit(None).cast("long").alias("deviation"), F.array_repeat(F.lit(None).cast("double"), k).alias("whitened"))
    out = whiten(fit, d, model).unionByName(odd).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
