"""Nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long hash string: symbol after symbol, the axis of a random
rotation along which the vector is longest, with its sign. The rows of a tree that share a first
symbol stand together as a sorted array of strings. A query descends to the rows that share the
longest prefix with it and then ascends in all trees at the same time: to the deepest prefix
length at which the trees together hold `wanted` rows, or to the root (all rows) where even the
first symbols do not. Rows found are ranked by their exact distance.

`wanted` is not fixed: AUDIT queries (a documented bound) are compared with all rows, and the
least value is taken with which they find RECALL of their true neighbours.

Arrays of frequent first symbols are dealt to several tasks by id, so no array outgrows a task.
Equal vectors are one row of the forest with their least ids, all that a result can need.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or have an
unusual length take no part; equal distances go to the smaller id; with fewer candidates than
k all are returned; rows with equal id are candidates once; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardline.llm.common import Steps
from wardline.llm.vectors import classes, matrix, usable

TREES = 48
SYMBOLS = 6
SEED = 20240229
#: Rows of one array in one task, about.
ARRAY_ROWS = 50_000
#: Queries whose true neighbours are looked up to choose how far the others ascend.
AUDIT = 64
RECALL = 0.96


class _Hashes:
    """Hash strings: for each tree SYMBOLS bytes, the first one highest."""

    def __init__(self, d: int, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees, self.d = trees, d
        self.turns = [[np.linalg.qr(rng.standard_normal((d, d)))[0][:, :min(d, 64)]
                       for _ in range(SYMBOLS)] for _ in range(trees)]

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for turn in self.turns[tree]:
            p = x @ turn
            axis = np.abs(p).argmax(axis=1)
            out = (out << 8) | (2 * axis + (p[np.arange(len(x)), axis] > 0))
        return out


def _prefix(strings, length):
    return strings >> (8 * (SYMBOLS - length))


def _first_counts(shared):
    def run(batches):
        hashes = shared.value
        total = np.zeros((hashes.trees, 256), np.int64)
        for batch in batches:
            x = matrix(batch.column("vector"))
            for t in range(hashes.trees) if len(x) else ():
                total[t] += np.bincount(_prefix(hashes.strings(x, t), 1), minlength=256)
        t, s = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(s.astype(
            np.int32)), pa.array(total[t, s])], ["tree", "symbol", "n"])
    return run


def _planted(shared, parts):
    """Rows of the arrays: rows are packed per batch, tree and array, queries are also sent to
    every part of their array."""
    def run(batches):
        hashes = shared.value
        for batch in batches:
            x = matrix(batch.column("vector"))
            ids = batch.column("node").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            for t in range(hashes.trees) if len(x) else ():
                s = hashes.strings(x, t)
                symbol = _prefix(s, 1)
                many = parts.value[t][symbol]
                part = ids % many
                rows = [(0, np.arange(len(ids)), part)]
                q = np.flatnonzero(asks)
                rows.append((1, np.repeat(q, many[q]), np.concatenate(
                    [np.arange(m) for m in many[q]]) if len(q) else q))
                for role, at, p in rows:
                    order = np.lexsort((p, symbol[at]))
                    at, p = at[order], p[order]
                    cuts = np.flatnonzero(np.append(True, (symbol[at][1:] != symbol[at][:-1])
                                                    | (p[1:] != p[:-1]))) if len(at) else []
                    if not len(cuts):
                        continue
                    ends = np.append(cuts[1:], len(at))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(cuts), t, np.int32)),
                        pa.array(symbol[at[cuts]].astype(np.int32)),
                        pa.array(p[cuts].astype(np.int64)),
                        pa.array(np.full(len(cuts), role, np.int32)),
                        *[pa.array([v[at[a:b]].tobytes() for a, b in zip(cuts, ends)], pa.binary())
                          for v in (ids, s, x)]],
                        ["tree", "symbol", "part", "role", "ids", "strings", "vectors"])
    return run


def _nearest(x, ids, q, own, k):
    """k nearest rows of x for each query vector: their places and distances."""
    out = []
    for v, me in zip(q, own):
        far = np.sqrt(((x - v) ** 2).sum(axis=1))
        far[ids == me] = np.inf
        if len(far) > 4 * k:
            edge = np.partition(far, k)[k]
            at = np.flatnonzero(far <= edge)
        else:
            at = np.arange(len(far))
        at = at[np.lexsort((ids[at], far[at]))][:k]
        out.append((at[far[at] < np.inf], far))
    return out


def _searched(k, d):
    """Per query of an array, and prefix length: rows that share it, and the k nearest."""
    def run(key, table):
        def part(role, name, dtype):
            blobs = [b.as_buffer() for b, r in zip(table.column(name), roles) if r == role]
            return np.concatenate([np.frombuffer(b, dtype) for b in blobs]) if blobs \
                else np.zeros(0, dtype)
        roles = table.column("role").to_pylist()
        ids, s = part(0, "ids", np.int64), part(0, "strings", np.int64)
        x = part(0, "vectors", np.float64).reshape(-1, d)
        order = np.argsort(s, kind="stable")
        ids, s, x = ids[order], s[order], x[order]
        asks, words = part(1, "ids", np.int64), part(1, "strings", np.int64)
        q = part(1, "vectors", np.float64).reshape(-1, d)
        out = [[], [], [], [], []]
        for me, word, v in zip(asks, words, q):
            seen = -1
            for length in range(SYMBOLS, 0, -1):
                step = 8 * (SYMBOLS - length)
                low = np.searchsorted(s, (word >> step) << step)
                high = np.searchsorted(s, ((word >> step) + 1) << step)
                others = high - low - int((ids[low:high] == me).any())
                if others == 0 or others == seen:
                    continue  # nothing there, or nothing new on the way up
                seen = others
                at, far = _nearest(x[low:high], ids[low:high], [v], [me], k)[0]
                for column, value in zip(out, (me, length, others, ids[low:high][at].tolist(),
                                               far[at].tolist())):
                    column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                         pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64())),
                         pa.array(out[4], pa.list_(pa.float64()))],
                        names=["query", "length", "n", "near", "far"])
    return run


def _scan(queries, k):
    """The k nearest rows of each batch for a bounded set of queries (ids, vectors)."""
    def run(batches):
        asks, q = queries.value
        for batch in batches:
            x, ids = matrix(batch.column("vector")), batch.column("node").to_numpy()
            if len(ids):
                got = _nearest(x, ids, q, asks, k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(asks, [len(a) for a, _ in got])),
                    pa.array(np.concatenate([ids[a] for a, _ in got])),
                    pa.array(np.concatenate([f[a] for a, f in got]))], ["query", "node", "far"])
    return run


def _depths(found: DataFrame) -> DataFrame:
    """Rows per query and prefix length over all trees; lengths without change are filled."""
    per = found.groupBy("query", "tree", "length").agg(F.sum("n").alias("n"))
    # a tree without a row for a length holds there what the next longer prefix holds
    each = per.groupBy("query", "tree").agg(F.map_from_entries(F.collect_list(F.struct(
        "length", "n"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(1), F.lit(SYMBOLS)), lambda i: F.coalesce(F.array_max(
        F.map_values(F.map_filter("m", lambda k, _: k >= i))), F.lit(0)))
    return each.select("query", F.posexplode(filled).alias("i", "n")).groupBy("query", "i").agg(
        F.sum("n").alias("n")).select("query", (F.col("i") + 1).alias("length"), "n")


def search(table: DataFrame, k: int = 10, every: int = 100, trees: int = TREES,
           seed: int = SEED, audit: int = AUDIT, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row of table
    (vec_id, embedding) whose id is divisible by `every`."""
    spark = table.sparkSession
    steps = Steps(spark)
    rows, d = usable(table, steps)
    nodes = classes(rows, steps, k + 1)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not d:
        return empty
    queries = steps.put("queries", rows.filter(F.col("vec_id") % every == 0).distinct().join(
        nodes.select("vector", "node"), "vector").select("vec_id", "node"))
    asked = nodes.join(queries.select("node").distinct().withColumn("asks", F.lit(True)), "node",
                       "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    shared = spark.sparkContext.broadcast(_Hashes(d, trees, seed))
    counts = np.zeros((trees, 256), np.int64)  # trees x 256 sums at most
    for r in nodes.mapInArrow(_first_counts(shared), "tree int, symbol int, n long").groupBy(
            "tree", "symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["tree"], r["symbol"]] = r["n"]
    parts = spark.sparkContext.broadcast(np.maximum(1, -(-counts // ARRAY_ROWS)))
    planted = asked.mapInArrow(
        _planted(shared, parts), "tree int, symbol int, part long, role int, ids binary, "
                                 "strings binary, vectors binary")
    found = steps.put("found", planted.groupBy("tree", "symbol", "part").applyInArrow(
        lambda key, t: _with_tree(key, _searched(k, d)(key, t)),
        "tree int, query long, length int, n long, near array<long>, far array<double>"))
    depths = steps.put("depths", _depths(found))

    # how far to ascend: the audit queries' true neighbours and the longest prefixes they share
    some = asked.filter("asks").orderBy(F.xxhash64(F.lit(seed), "node")).limit(audit).select(
        "node", "vector").collect()
    asks, q = np.array([r["node"] for r in some]), np.array([r["vector"] for r in some])
    near = Window.partitionBy("query").orderBy("far", "node")
    truth = nodes.select("node", "vector").mapInArrow(_scan(spark.sparkContext.broadcast((asks, q)), k),
                                                      "query long, node long, far double") \
        .withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k) \
        .join(nodes.select("node", "vector"), "node").select("query", "vector").collect() if some else []
    wanted = _calibrated(shared.value, dict(zip(asks.tolist(), q)), truth, recall, {
        (r["query"], r["length"]): r["n"] for r in depths.filter(F.col("query").isin(
            asks.tolist())).collect()} if some else {})
    chosen = queries.select(F.col("node").alias("query")).distinct().join(
        depths.filter(F.col("n") >= wanted).groupBy("query").agg(F.max("length").alias("depth")),
        "query", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    chosen = steps.put("chosen", chosen)
    # below the chosen depth a tree's longest list at or above it counts
    hits = found.join(chosen, "query").filter("depth > 0 and length >= depth").select(
        "query", F.explode(F.arrays_zip("near", "far")).alias("z")).select(
        "query", F.col("z.near").alias("node"), F.col("z.far").alias("far"))
    # queries at the root meet all rows, in blocks of queries
    rooted = chosen.filter("depth = 0").select(F.col("query").alias("node")).join(nodes, "node") \
        .select("node", "vector")
    if not rooted.isEmpty():
        hits = hits.unionByName(_at_root(rooted, nodes, k, steps))
    best = hits.distinct().withColumn("rank", F.row_number().over(near)).filter(
        F.col("rank") <= k).select("query", "node", "far")
    # classes to ids: own copies first, then those of the neighbours
    ids = nodes.select("node", "ids")
    own = chosen.select("query", F.col("query").alias("node"), F.lit(0.0).alias("far"))
    lists = best.unionByName(own).join(ids, "node").select(
        "query", "far", F.explode("ids").alias("vec_id")).groupBy("query").agg(F.slice(F.array_sort(
            F.collect_list(F.struct("far", "vec_id"))), 1, k + 1).alias("list"))
    out = queries.join(lists.withColumnRenamed("query", "node"), "node").select(
        F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter(
            "list", lambda s: s["vec_id"] != F.col("vec_id")), 1, k)).alias("i", "s"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"),
                      F.col("s.vec_id").alias("vec_id"), F.col("s.far").alias("score"))


def _with_tree(key, out: pa.Table) -> pa.Table:
    return out.add_column(0, "tree", pa.array([key[0].as_py()] * len(out), pa.int32()))


def _calibrated(hashes, asks: dict, truth, recall: float, sums: dict) -> int:
    """The least number of rows to ascend for, so that the audit queries find `recall` of their
    neighbours: a neighbour is found once its longest prefix shared in any tree is reached."""
    if not truth:
        return 1
    of, x = [r["query"] for r in truth], np.array([r["vector"] for r in truth])
    q = np.array([asks[i] for i in of])
    shared = np.zeros(len(of), int)
    for t in range(hashes.trees):
        a, b = hashes.strings(q, t), hashes.strings(x, t)
        for length in range(1, SYMBOLS + 1):
            shared = np.maximum(shared, np.where(_prefix(a, length) == _prefix(b, length), length, 0))
    wanted = 64
    while True:
        depth = {i: max([n for n in range(1, SYMBOLS + 1) if sums.get((i, n), 0) >= wanted],
                        default=0) for i in asks}
        got = np.mean([s >= depth[i] for i, s in zip(of, shared)])
        if got >= recall or not any(depth.values()):
            return wanted
        wanted *= 2


def _at_root(rooted: DataFrame, nodes: DataFrame, k: int, steps: Steps) -> DataFrame:
    """Exact search for queries that ascend to the root: blocks of rows, each met by all blocks
    of queries; a task keeps k rows per query."""
    spark = nodes.sparkSession
    n, m = nodes.count(), rooted.count()
    rows = max(1, -(-n // ARRAY_ROWS))
    blocks = max(1, -(-m // 2048))
    left = nodes.select(F.pmod(F.xxhash64("node"), F.lit(rows)).alias("r"), F.explode(F.sequence(
        F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(0).alias("role"), "node", "vector")
    right = rooted.select(F.explode(F.expr(f"sequence(0L, {rows - 1}L)")).alias("r"),
                          F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("b"),
                          F.lit(1).alias("role"), "node", "vector")

    def run(key, table):
        role = table.column("role").to_numpy()
        x, ids = matrix(table.column("vector")), table.column("node").to_numpy()
        a, b = role == 0, role == 1
        got = _nearest(x[a], ids[a], x[b], ids[b], k)
        return pa.table({
            "query": pa.array(np.repeat(ids[b], [len(i) for i, _ in got])),
            "node": pa.array(np.concatenate([ids[a][i] for i, _ in got] or [ids[:0]])),
            "far": pa.array(np.concatenate([f[i] for i, f in got] or [np.zeros(0)]))})
    return left.unionByName(right).groupBy("r", "b").applyInArrow(
        run, "query long, node long, far double")
