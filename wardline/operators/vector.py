"""Semantic top-k by cosine similarity over stored vectors."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from wardline.operators.pairs import top_k
from wardline.sources.layers import cut

# Query vectors sent to every task when there are no more than this many.
QUERIES_PER_BLOCK = 2048
# Vectors of one part of a cell; vectors the centres are fitted on; cells at most.
VECTORS_PER_GROUP, FIT_ROWS, MOST_CELLS = 20_000, 20_000, 1024
SCORED_AT_ONCE = 128

OUT = "query_id bigint, vec_id bigint, score double"

# tasks get the scoring functions themselves, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(np.float64))


def _best(query_ids, q, vec_ids, v, k, skip_same) -> pd.DataFrame:
    """The k best vectors of one batch per query, ties by id, scores to 4 decimals."""
    by_id = np.argsort(vec_ids, kind="stable")
    vec_ids, v = vec_ids[by_id], v[by_id]
    out = []
    for start in range(0, len(query_ids), SCORED_AT_ONCE):
        ids = query_ids[start:start + SCORED_AT_ONCE]
        scores = np.round(q[start:start + SCORED_AT_ONCE] @ v.T, 4)
        if skip_same:
            scores[ids[:, None] == vec_ids[None, :]] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        out.append(pd.DataFrame({
            "query_id": np.repeat(ids, order.shape[1]),
            "vec_id": vec_ids[order].ravel(),
            "score": np.take_along_axis(scores, order, axis=1).ravel(),
        }))
    best = pd.concat(out)
    return best[np.isfinite(best["score"])]


def _merged(a: pd.DataFrame | None, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows per query of both, ties by id."""
    if a is None:
        return b
    both = pd.concat([a, b]).sort_values(["score", "vec_id"], ascending=[False, True], kind="stable")
    return both.groupby("query_id", sort=False).head(k)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 50,
                 where: Column | None = None, skip_same: bool = True) -> DataFrame:
    """Per query vector the k nearest vectors: query_id, rank, vec_id, score (4 decimals).

    queries: query_id, embedding.  vectors: vec_id, embedding (plus columns for `where`,
    which is applied before any distance is computed).  A counted, small set of queries
    goes to every task and the vectors are scanned without a shuffle; a larger one goes
    through the inverted file, which is exact as well.  A task keeps k rows per query.
    """
    if where is not None:
        vectors = vectors.where(where)
    vectors = vectors.select("vec_id", "embedding")
    vectors = vectors.where(F.col("embedding").isNotNull())
    queries = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    few = queries.limit(QUERIES_PER_BLOCK + 1).toPandas()
    if few.empty:
        return vectors.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score double")
    if len(few) > QUERIES_PER_BLOCK:
        return search_cells(queries, build_cells(vectors), k, skip_same)
    return _ranked(_scan(few, vectors, k, skip_same), k)


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("vec_id")]
    return top_k(partial, ["query_id"], order, k, "vec_id").select(
        "query_id", "rank", "vec_id", "score")


def _scan(few: pd.DataFrame, vectors: DataFrame, k: int, skip_same: bool) -> DataFrame:
    """The counted query vectors against every batch; the lists stay flat Arrow buffers."""
    q, ids = _matrix(few["embedding"]), few["query_id"].to_numpy()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            if b.num_rows:
                flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
                v = _unit(flat.reshape(b.num_rows, -1).astype(np.float64))
                kept = _merged(kept, _best(ids, q, b.column("vec_id").to_numpy(), v, k, skip_same), k)
        if kept is not None:
            yield pa.RecordBatch.from_pandas(kept, preserve_index=False)

    return vectors.mapInArrow(score, OUT)


# --- inverted file -----------------------------------------------------------------------

class Cells(NamedTuple):
    """vectors: cell, part, vec_id, embedding (of length one); centres, and per cell the
    number of parts and the angle to its farthest vector."""

    vectors: DataFrame
    centres: np.ndarray
    parts: np.ndarray
    angles: np.ndarray


def _fit_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centres are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def build_cells(vectors: DataFrame, cells: int | None = None) -> Cells:
    """Vectors by the nearest of `cells` centres (by default the square root of their number,
    at most MOST_CELLS). The centres are fitted on at most FIT_ROWS vectors, the first by a hash
    of the id; every vector is put into a cell, and a large cell is split into parts."""
    rows = vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    fit = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()
    if fit.empty:
        return Cells(rows.selectExpr("0 AS cell", "0 AS part", "vec_id", "embedding"),
                     np.zeros((0, 1)), np.zeros(0, int), np.zeros(0))
    wanted = cells or min(MOST_CELLS, int(np.sqrt(rows.count())) + 1)
    centres = _fit_centres(_matrix(fit["embedding"]), min(wanted, len(fit)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
                v = _unit(flat.reshape(b.num_rows, -1).astype(np.float64))
                near = v @ centres.T
                cell = near.argmax(axis=1)
                yield pa.RecordBatch.from_pydict({
                    "cell": cell.astype(np.int32), "cosine": near[np.arange(len(v)), cell],
                    "vec_id": b.column("vec_id"), "embedding": list(v)})

    placed = cut(rows.mapInArrow(place, "cell int, cosine double, vec_id bigint, embedding array<double>"))
    parts, angles = np.zeros(len(centres), int), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c")).collect():
        parts[r["cell"]] = -(-r["n"] // VECTORS_PER_GROUP)
        angles[r["cell"]] = np.arccos(np.clip(r["c"], -1, 1)) + 1e-6
    split = F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell"))
    return Cells(placed.select("cell", F.pmod(F.xxhash64("vec_id"), split).cast("int").alias("part"),
                               "vec_id", "embedding"), centres, parts, angles)


def _wanted(centres: np.ndarray, parts: np.ndarray, angles: np.ndarray, probes: int, later: bool):
    """Rows (query_id, asked, cell, part) of the cells a query opens: the `probes` whose best
    possible cosine is highest, or, later, those of the others that could still hold an answer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
            q = _unit(flat.reshape(b.num_rows, -1).astype(np.float64))
            apart = np.arccos(np.clip(q @ centres.T, -1, 1))
            most = np.cos(np.maximum(apart - angles, 0))
            most[:, parts == 0] = -np.inf
            place = np.argsort(np.argsort(-most + 1e-9 * apart, axis=1, kind="stable"), axis=1, kind="stable")
            opens = (place < probes) & (parts > 0)
            if later:
                least = b.column("least").to_numpy(zero_copy_only=False)
                opens = (place >= probes) & (parts > 0) & (most >= least[:, None] - 1e-4)
            at, cell = np.nonzero(opens)
            again = np.repeat(np.arange(len(at)), parts[cell])
            part = np.arange(len(again)) - np.searchsorted(again, again)
            at, cell = at[again], cell[again]
            yield pa.RecordBatch.from_pydict({
                "query_id": b.column("query_id").take(pa.array(at)), "asked": pa.array(list(q[at]), pa.list_(pa.float64())),
                "cell": cell.astype(np.int32), "part": part.astype(np.int32)})
    return run


def _opened(queries: DataFrame, index: Cells, k: int, skip_same: bool, probes: int,
            later: bool) -> DataFrame:
    """The k best vectors per query, cell and part. Vectors stay where they are: once per part."""
    wanted = queries.mapInArrow(_wanted(index.centres, index.parts, index.angles, probes, later),
                                "query_id bigint, asked array<double>, cell int, part int")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(a["query_id"].to_numpy(), np.stack(a["asked"].to_numpy()),
                     b["vec_id"].to_numpy(), np.stack(b["embedding"].to_numpy()), k, skip_same)

    return wanted.groupBy("cell", "part").cogroup(index.vectors.groupBy("cell", "part")) \
        .applyInPandas(score, OUT)


def search_cells(queries: DataFrame, index: Cells, k: int = 50, skip_same: bool = True,
                 probes: int = 8, exact: bool = True) -> DataFrame:
    """vector_top_k through an inverted file: each query opens the `probes` cells that could hold
    the nearest vectors, whose vectors are compared exactly. `exact` then opens every other cell
    whose best possible cosine reaches the k-th answer; without it some answers may be missed
    (see `recall`). Query ids are expected to be distinct."""
    queries = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    if not len(index.centres):
        return queries.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score double")
    first = _ranked(_opened(queries, index, k, skip_same, probes, False), k)
    if not exact or (index.parts > 0).sum() <= probes:
        return first
    first = cut(first)
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    rest = _opened(open_, index, k, skip_same, probes, True)
    return _ranked(first.drop("rank").unionByName(rest), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact answers that were found, over all queries."""
    hit = exact.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)),
                     ["query_id", "vec_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("answers"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def exemplars(vectors: DataFrame, by: str = "label") -> DataFrame:
    """The vector with the lowest id of every group, as query vectors."""
    return vectors.groupBy(by).agg(F.min_by(
        F.struct("vec_id", "embedding"), "vec_id").alias("v")).select(
        F.col("v.vec_id").alias("query_id"), F.col("v.embedding").alias("embedding"), by)
