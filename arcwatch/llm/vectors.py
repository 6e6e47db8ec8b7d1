"""What the operators on whole vector tables share: which rows count, integer
components, and sums of matrices over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First-level groups of a merge: a group holds a row of one task in so many.
SALTS = 64
#: Numbers of a matrix that are worked on at once.
AT_ONCE = 1 << 21


def kept_vectors(vectors: DataFrame, extra: list, parts: int = 1) -> tuple[DataFrame, int]:
    """(v and the extra columns of all rows whose vector is neither null nor
    holds null or non-finite components, the common length).

    The common length is that of most kept vectors, of those that the number of
    parts divides (ties: the longest); 0 if there is none.
    """
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col("embedding").alias("v"), *extra).filter(F.col("v").isNotNull() & finite)
    sizes = rows.groupBy(F.size("v").alias("d")).count().filter((F.col("d") > 0) & (F.col("d") % parts == 0))
    best = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return rows, best["d"] if best else 0


def integers(column: pa.Array, d: int, bound: int, offset: int = 0) -> np.ndarray:
    """floor(1024 * x) + offset of every component, one vector a row; beyond the
    bound on either side it is the bound."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    return np.clip(np.floor(1024.0 * x), -bound, bound).astype(np.int64) + offset


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact int64 matrix product.  Doubles carry it where no sum of it can
    reach 2**53, as every sum is then a whole number that a double holds."""
    if not a.size or not b.size:
        return a @ b
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows x width stays within AT_ONCE."""
    rows = max(1, AT_ONCE // max(width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def summed(rows: DataFrame, of_task: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], dtype: type) -> dict[int, np.ndarray]:
    """The sum by key of the arrays that of_task gives for each task's rows.

    One array a task and key is shuffled, merged as a stream in groups of a
    SALTS-th of the tasks and once more by key, so a merging task holds one
    array, and the driver gets one a key, however many tasks there are.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = of_task(batches)
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.record_batch({"k": pa.array(list(found), pa.int64()), "salt": pa.array([salt] * len(found), pa.int32()), "m": pa.array([a.astype(dtype).tobytes() for a in found.values()], pa.binary())})

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column("m"):
                array = np.frombuffer(cell.as_buffer(), dtype)
                total = array.copy() if total is None else total + array
        yield pa.record_batch({"k": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    merge.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = rows.mapInArrow(emit, "k long, salt int, m binary").groupBy("k", "salt").applyInArrow(merge, "k long, m binary")
    return {r["k"]: np.frombuffer(bytes(r["m"]), dtype) for r in parts.groupBy("k").applyInArrow(merge, "k long, m binary").collect()}
