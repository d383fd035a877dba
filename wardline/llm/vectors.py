"""Vectors of a table as classes of equal vectors: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Steps


def valid(column: str = "embedding"):
    """Vectors without nulls and non-finite components, and with a length above zero."""
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(x, lambda v: v != 0)


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _least(k):
    """Rows of one batch that are equal become one row per vector and one of its least ids."""
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vector"))
            ids = batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            order = np.argsort(ids, kind="stable")
            raw = np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
            _, inverse = np.unique(raw, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            at = np.arange(len(by)) - np.searchsorted(inverse[by], inverse[by])
            yield batch.take(pa.array(order[by[at < k]]))
    return run


def dimension(rows: DataFrame) -> int:
    """The most frequent length of the valid vectors (the smaller one of equals), 0 for none."""
    found = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(
        F.desc("count"), "d").first()
    return found["d"] if found else 0


def usable(table: DataFrame, steps: Steps) -> tuple[DataFrame, int]:
    """(vec_id, vector as doubles) of the valid rows of the usual length, -0.0 being 0.0."""
    rows = table.filter(valid() & F.col("vec_id").isNotNull())
    d = dimension(rows)
    return rows.filter(F.size("embedding") == d).select("vec_id", F.transform(
        F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0)).alias("vector")), d


def classes(rows: DataFrame, steps: Steps, k: int) -> DataFrame:
    """(node, ids, vector): one row per distinct vector, named by its least id; ids are its k
    least ids in order. Equal rows are first reduced in the tasks, so that a vector that a third
    of all rows share stays small."""
    few = rows.mapInArrow(_least(k), "vec_id long, vector array<double>")
    return steps.put("classes", few.groupBy("vector").agg(F.slice(F.array_sort(F.collect_set(
        "vec_id")), 1, k).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "vector"))
