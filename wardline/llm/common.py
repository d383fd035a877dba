"""Shared helpers of the operators: vectorised words of whole texts, hashes, stored steps
and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.sources import layers

#: Bytes of text that one numpy step handles; a longer text is a step of its own.
SLICE_BYTES = 2 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def text_slices(column: pa.Array):
    """(first row, rows, bytes, row offsets) for runs of rows of about SLICE_BYTES."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, n)
        yield first, last - first, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Start and end byte of every word, and words before each row (rows + 1 numbers)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lowered first where asked)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    values = _BYTE_VALUE[_LOWER] if lower else _BYTE_VALUE
    np.cumsum(values[data] * up[:len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Steps:
    """Stored intermediate tables of one run, in the cluster's shared folder. A table that
    a later step replaces is deleted, and shuffle files of finished steps are released."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = layers.scratch_path(self.spark, name)
        df.write.parquet(path)
        old = self.paths.pop(name, None)
        self.paths[name] = path
        if old:
            layers.delete(self.spark, old)
        layers.release_shuffles(self.spark)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                layers.delete(self.spark, path)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text (whatever else the table holds is dropped) with `row_key`: equal for
    rows with equal id and text only, so that repeated ids with other texts stay apart."""
    return docs.select(*columns, F.xxhash64("doc_id", "text").alias("row_key"))


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node that
    can be reached. Alternating large and small stars: every round hooks nodes to the
    smallest neighbour seen, so that long chains shrink quickly; a round is stored."""
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                         F.least("a", "b").alias("b")).distinct()
    now = steps.put("stars", both)
    size = -1
    while True:
        # large star: larger neighbours of a node hang on to its smallest neighbour
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = steps.put("large", sides.filter("b > a").join(least, "a")
                          .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: smaller neighbours of a node, and the node, hang on to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = steps.put("stars", small.filter("a > b").distinct())
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                        F.max(F.lit(1))).first()
        if tuple(found) == size:
            break
        size = tuple(found)
    steps.drop("large")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
