"""Whitening of vectors through the singular values of their centred rows.

Entries become whole numbers x = floor(1024 c) + 100000, so that sums are exact. Every task
reduces its centred rows block by block to the triangular factor of a QR decomposition; factors
are stacked and reduced again, a bounded number at a time, until one d x d factor R of all rows
is left (d: dimensions). Only R, the sums and the row count reach the driver. R is brought to
bidiagonal form by Householder reflections, dqds gives the singular values, twisted
factorisations give the directions (bidiagonal.py). The covariance of the whitened rows is then
measured over all rows.

Defined cases: rows with a null vector, null or non-finite entries, or entries beyond 2**40 (their
x is not exact) are dropped; so are rows whose vector has not the most frequent length of the
others (the smaller one of equals). Zero vectors, repeated rows and null ids stay. A component without variance (all
rows equal, fewer rows than dimensions) has no whitened value and no row. `deviation` is null
where it does not fit a long. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.bidiagonal import right_vectors
from wardline.llm.common import Steps
from wardline.llm.vectors import dimension, matrix

COMPONENTS = 8
#: Triangular factors that one task stacks and reduces.
FAN_IN = 16
#: Rows of one block of the QR decomposition, at least twice the dimensions.
BLOCK_ROWS = 4096
_SCALE, _OFFSET, _LARGEST = 1024, 100_000, float(1 << 40)
#: A variance below this part of the largest is rounding.
_NOTHING = 1e-14


def usable(table: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows with whole vectors of the usual length, and that length."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= _LARGEST))
    rows = table.filter(x.isNotNull() & F.coalesce(fine, F.lit(False)))
    d = dimension(rows)
    return rows.filter(F.size("embedding") == d).select("vec_id", x.alias("vector")), d


def _whole(batch) -> np.ndarray:
    return np.floor(matrix(batch.column("vector")) * _SCALE).astype(np.int64) + _OFFSET


def _sums(batches):
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _whole(batch)
            n += len(x)
            total = x.sum(axis=0) + (0 if total is None else total)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [total.tolist()]})


def _factors(n: int, sums: np.ndarray):
    """One triangular factor per task: blocks of centred rows under the factor so far."""
    def run(batches):
        r = None
        for batch in batches:
            x = _whole(batch)
            step = max(BLOCK_ROWS, 2 * x.shape[1])
            for at in range(0, len(x), step):
                block = (n * x[at:at + step] - sums) / n
                r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part": [int(r.shape[0])], "r": [r.ravel().tolist()]})
    return run


def _stack(d: int):
    def run(key, table):
        r = np.linalg.qr(np.vstack([matrix_of(v, d) for v in table.column("r")]), mode="r")
        return pa.table({"part": [key[0].as_py()], "r": [r.ravel().tolist()]})
    return run


def matrix_of(value, d: int) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).reshape(-1, d)


def triangular_factor(rows: DataFrame, n: int, sums: np.ndarray, steps: Steps) -> np.ndarray:
    """R of all centred rows; a tree of tasks with at most FAN_IN factors each."""
    d = len(sums)
    schema = "part long, r array<double>"
    now = steps.put("factors", rows.mapInArrow(_factors(n, sums), schema).withColumn(
        "part", F.spark_partition_id().cast("long")))
    while (most := now.agg(F.max("part")).first()[0]) > 0:
        now = steps.put("factors", now.select(F.floor(F.col("part") / FAN_IN).alias("part"), "r")
                        .groupBy("part").applyInArrow(_stack(d), schema))
        if most < FAN_IN:
            break
    r = np.array(now.first()["r"]).reshape(-1, d)
    return np.linalg.qr(np.vstack([r, np.zeros((d, d))]), mode="r")


def _projected(n: int, sums: np.ndarray, w: np.ndarray):
    def run(batch):
        return ((n * _whole(batch) - sums) / n) @ w
    return run


def _moments(project):
    """Sums over a task's whitened rows: the values, then their products."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = project(batch)
                now = np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_pydict({"n": [0], "sums": [total.tolist()]})
    return run


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum of (n x - S)^2 per row, exact; null beyond a long."""
    if n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0)) < 1 << 62:
        far = n * x - sums
        if x.shape[1] * int(np.abs(far).max(initial=0)) ** 2 < 1 << 63:
            return pa.array((far * far).sum(axis=1))
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _rows(n, sums, project, explained, error):
    k = len(explained)

    def run(batches):
        for batch in batches:
            y, m = project(batch), batch.num_rows
            far = _deviations(_whole(batch), n, sums)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)), far.take(each), pa.array(y.ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, "
          "explained double, identity_error double")


def _total(parts: DataFrame, kind: str) -> np.ndarray:
    """The element-wise sum of the tasks' arrays, one row per element."""
    each = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("v").cast(kind)).alias("v")).orderBy("at")
    return np.array([r["v"] for r in each.collect()])


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable
    row and each of its first components."""
    spark = table.sparkSession
    steps = Steps(spark)
    rows, d = usable(table)
    if not d:
        return spark.createDataFrame([], RESULT)
    parts = steps.put("sums", rows.mapInArrow(_sums, "n long, sums array<long>"))
    n, sums = parts.agg(F.sum("n")).first()[0], _total(parts, "long")
    r = triangular_factor(rows, n, sums, steps)
    values, vectors = right_vectors(r, components)
    variance, whole = values ** 2 / n, (r ** 2).sum() / n
    fine = variance > _NOTHING * max(whole, 1e-300)
    if not fine.any():
        return spark.createDataFrame([], RESULT)
    variance, vectors = variance[fine], vectors[:, fine]
    project = _projected(n, sums, vectors / np.sqrt(variance))
    k = len(variance)
    seen = _total(rows.mapInArrow(_moments(project), "n long, sums array<double>"), "double") / n
    covariance = seen[k:].reshape(k, k) - np.outer(seen[:k], seen[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    steps.drop("sums", "factors")
    return rows.mapInArrow(_rows(n, sums, project, variance / whole, error), RESULT)
