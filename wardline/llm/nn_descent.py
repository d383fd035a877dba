"""Near-duplicate vectors by NN-descent.

Every distinct vector keeps a list of its K nearest vectors so far. The first lists come from
neighbours in the sorted order of random hash strings. A round brings together, at each vector,
the vectors on its list and those that list it, and compares all that have not met there before:
neighbours of neighbours become neighbours. Vectors that very many others list deal these out in
groups of GROUP, anew each round. Rounds end when at most UPDATES of the list entries are new.

A list full of links is saturated: it may hide further ones, also to other groups. All members of
a group with a saturated list are compared with all vectors in blocks; counts and pairs of groups
leave a block, never pairs of vectors. An audit compares up to AUDIT vectors (a documented bound)
with all rows; as long as the share of its links that an audited vector has, on the mean over
those with few links or over those with many, is under RECALL, K is doubled and rounds go on.

Equal vectors are one vertex with a count. Defined cases: vectors that are null, zero, or hold
null or non-finite components, or have an unusual length link with nothing; rows with a null id
link with nothing and are kept; repeated rows link with each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Steps, components
from wardline.llm.lsh_forest import _Hashes
from wardline.llm.vectors import matrix, usable, valid

K = 8
TREES = 6
GROUP = 64
BLOCK = 2_000
AUDIT = 512
RECALL = 0.99
UPDATES = 0.001
MAX_ROUNDS = 10
SEED = 20240229
#: Descent works on single precision; links within this of the threshold are decided in double.
SLACK = 1e-4

_EDGES = "node long, v long, s float"


def _units(column) -> np.ndarray:
    x = matrix(column)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def _unit_rows(batches):
    for batch in batches:
        u = _units(batch.column("vector"))
        yield pa.RecordBatch.from_arrays([
            batch.column("node"), batch.column("n"), pa.array([r.tobytes() for r in u], pa.binary()),
            pa.array([r.tobytes() for r in u.astype(np.float32)], pa.binary())],
            ["node", "n", "unit", "single"])


def _stack(column, dtype) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    blobs = [b.as_buffer() for b in column]
    return np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1)


def _strings(shared):
    """Each vector once per tree, with its place: its tree's hash string."""
    def run(batches):
        hashes = shared.value
        for batch in batches:
            u = _stack(batch.column("unit"), np.float64)
            for t in range(hashes.trees) if len(u) else ():
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(u), t, np.int32)), pa.array(hashes.strings(u, t)),
                    batch.column("node"), batch.column("single")],
                    ["tree", "string", "node", "single"])
    return run


def _neighbours(reach):
    """Rows in sorted order: each is compared with the `reach` rows before it."""
    def run(batches):
        tail_ids, tail = np.zeros(0, np.int64), None
        for batch in batches:
            ids, x = batch.column("node").to_numpy(), _stack(batch.column("single"), np.float32)
            if not len(ids):
                continue
            if tail is not None:
                ids, x = np.append(tail_ids, ids), np.concatenate([tail, x])
            a, b, s = [], [], []
            for step in range(1, min(reach, len(ids) - 1) + 1):
                a.append(ids[step:])
                b.append(ids[:-step])
                s.append(np.einsum("ij,ij->i", x[step:], x[:-step]))
            tail_ids, tail = ids[-reach:], x[-reach:]
            if a:
                a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
                ok = a != b
                a, b, s = a[ok], b[ok], s[ok]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(a, b)), pa.array(np.append(b, a)), pa.array(np.append(s, s))],
                    ["node", "v", "s"])
    return run


def _best(node, v, s, k):
    """The k best distinct neighbours per node."""
    order = np.lexsort((v, node))
    node, v, s = node[order], v[order], s[order]
    new = np.append(True, (node[1:] != node[:-1]) | (v[1:] != v[:-1])) if len(node) else np.zeros(0, bool)
    node, v, s = node[new], v[new], s[new]
    order = np.lexsort((-s, node))
    node, v, s = node[order], v[order], s[order]
    place = np.arange(len(node)) - np.searchsorted(node, node)
    return node[place < k], v[place < k], s[place < k]


def _met(k):
    """Comparisons at each vector of all that meet there, one of the two being fresh; only
    neighbours better than the worst on a list are passed on."""
    def run(batches):
        for batch in batches:
            found = [[], [], []]
            for row in batch.column("here"):
                here = row.values
                ids = here.field("node").to_numpy()
                if len(ids) < 2:
                    continue
                fresh = here.field("fresh").to_numpy(zero_copy_only=False)
                worst = here.field("worst").to_numpy()
                x = _stack(here.field("single"), np.float32)
                s = x @ x.T
                ok = fresh[:, None] | fresh[None, :]
                ok &= (s > worst[:, None]) & (ids[:, None] != ids[None, :])
                i, j = np.nonzero(ok)
                for column, value in zip(found, (ids[i], ids[j], s[i, j])):
                    column.append(value)
            if found[0]:
                got = _best(*map(np.concatenate, found), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["node", "v", "s"])
    return run


def _merged(edges: DataFrame, k: int) -> DataFrame:
    """(node, list of (s, v, fresh)) from (node, v, s, fresh): the k best."""
    one = edges.groupBy("node", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    return one.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct(
        "s", "v", "fresh")), asc=False), 1, k).alias("list"))


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("node", F.explode("list").alias("e")).select("node", "e.v", "e.s", "e.fresh")


def _round(lists: DataFrame, units: DataFrame, k: int, turn: int) -> DataFrame:
    edges = _flat(lists)
    meet = edges.select(F.col("node").alias("center"), F.col("v").alias("node"), "fresh").unionByName(
        edges.select(F.col("v").alias("center"), "node", "fresh")).groupBy("center", "node").agg(
        F.max("fresh").alias("fresh"))
    groups = meet.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"),
                                        F.max("fresh").alias("any")).filter("any")
    worst = lists.select("node", F.when(F.size("list") >= k, F.element_at("list", -1)["s"])
                         .otherwise(-2.0).cast("float").alias("worst"))
    info = units.select("node", "single").join(worst, "node", "left").withColumn(
        "worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
    here = meet.join(groups, "center").withColumn("part", F.pmod(F.xxhash64(
        F.lit(turn), "node"), F.col("groups"))).join(info, "node").groupBy("center", "part").agg(
        F.collect_list(F.struct("node", "fresh", "worst", "single")).alias("here"))
    found = here.select("here").mapInArrow(_met(k), _EDGES).withColumn("fresh", F.lit(True))
    return _merged(edges.withColumn("fresh", F.lit(False)).unionByName(found), k)


def _exact(threshold):
    def run(batches):
        for batch in batches:
            a, b = (_stack(batch.column(c), np.float64) for c in ("x", "y"))
            ok = np.einsum("ij,ij->i", a, b) >= threshold if len(a) else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    return run


def _links(lists: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs a < b on the lists whose cosine in double reaches the threshold."""
    near = _flat(lists).filter(F.col("s") >= threshold - SLACK).select(
        F.least("node", "v").alias("a"), F.greatest("node", "v").alias("b")).distinct()
    return near.join(units.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a").join(
        units.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b").mapInArrow(
        _exact(threshold), "a long, b long")


def _block_counts(threshold):
    """Links of a block of members of saturated groups (side 0) with a block of all vectors (side
    1), for both ends, and the pairs of different groups that links join."""
    def run(table):
        side, wide = (table.column(c).to_numpy() for c in ("side", "wide"))
        ids, n, group = (table.column(c).to_numpy() for c in ("node", "n", "component"))
        u = _stack(table.column("unit"), np.float64)
        a, b = side == 0, side == 1
        ok = (u[a] @ u[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
        # vectors of saturated groups have their turn as side 0
        rest = ~wide[b]
        nodes = np.append(ids[a], ids[b][rest])
        links = np.append((ok * n[b]).sum(axis=1), (ok * n[a][:, None]).sum(axis=0)[rest])
        i, j = np.nonzero(ok & (group[a][:, None] != group[b][None, :]))
        pairs = np.unique(np.stack([group[a][i], group[b][j]], axis=1), axis=0)
        none, blank = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(nodes), pa.int64())
        return pa.table([
            pa.concat_arrays([pa.array(nodes), none]), pa.concat_arrays([pa.array(links), none]),
            *(pa.concat_arrays([blank, pa.array(pairs[:, c])]) for c in (0, 1))],
            ["node", "links", "a", "b"])
    return run


def _enlarged(placed: DataFrame, threshold: float) -> DataFrame:
    """(node, links) and (a, b), pairs of groups that a link joins, from the comparison of all
    vectors of groups with a saturated list with all vectors; placed: component, wide (of such a
    group), node, n, unit."""
    total, wide = placed.agg(F.count(F.lit(1)), F.count_if("wide")).first()
    rows, columns = -(-wide // BLOCK), -(-total // BLOCK)
    place = lambda n: F.pmod(F.xxhash64("node"), F.lit(max(1, n)))
    each = lambda n: F.explode(F.expr(f"sequence(0L, {max(1, n) - 1}L)"))
    kept = ["component", "wide", "node", "n", "unit"]
    asking = placed.filter("wide").select(place(rows).alias("i"), F.lit(0).alias("side"), *kept) \
        .select("*", each(columns).alias("j"))
    asked = placed.filter(F.lit(wide > 0)).select(
        place(columns).alias("j"), F.lit(1).alias("side"), *kept).select("*", each(rows).alias("i"))
    return asking.unionByName(asked).groupBy("i", "j").applyInArrow(
        _block_counts(threshold), "node long, links long, a long, b long")


def _recall(truth: dict, got: dict, k: int) -> float:
    """Mean share of an audited vector's links that were found; the smaller mean of the vectors
    with up to k and with more links."""
    share = [(t > k, min(got.get(i, 0), t) / t) for i, t in truth.items() if t]
    return min((float(np.mean(x)) for many in (False, True)
                if (x := [v for m, v in share if m == many])), default=1.0)


def _truth(sample, threshold):
    def run(batches):
        ids, u = sample.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            x = _stack(batch.column("unit"), np.float64)
            if len(x):
                ok = (u @ x.T >= threshold) & (ids[:, None] != batch.column("node").to_numpy())
                total += (ok * batch.column("n").to_numpy()).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "links"])
    return run


def near_vectors(table: DataFrame, threshold: float = 0.95, k: int = K, trees: int = TREES,
                 seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of table (vec_id, embedding)."""
    spark = table.sparkSession
    steps = Steps(spark)
    rows, d = usable(table, steps)
    rest = table.select("vec_id")
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
             F.lit(True).alias("kept")]
    if not d:
        return rest.select("vec_id", *alone)
    counted = rows.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))
    units = steps.put("units", counted.mapInArrow(
        _unit_rows, "node long, n long, unit binary, single binary"))
    shared = spark.sparkContext.broadcast(_Hashes(d, trees, seed))
    sorted_rows = units.mapInArrow(_strings(shared), "tree int, string long, node long, single binary") \
        .repartitionByRange("tree", "string", "node").sortWithinPartitions("tree", "string", "node")
    lists = steps.put("lists", _merged(sorted_rows.mapInArrow(
        _neighbours(k // 2), _EDGES).withColumn("fresh", F.lit(True)), k))
    sample = units.orderBy(F.xxhash64(F.lit(seed), "node")).limit(AUDIT).select(
        "node", "unit").collect()
    asked = np.array([r["node"] for r in sample]), np.array(
        [np.frombuffer(r["unit"]) for r in sample]).reshape(len(sample), d)
    truth = {r["node"]: r["links"] for r in units.mapInArrow(_truth(
        spark.sparkContext.broadcast(asked), threshold), "node long, links long").groupBy("node").agg(
        F.sum("links").alias("links")).collect()}
    vertices, turn = units.count(), 0
    while True:
        for _ in range(MAX_ROUNDS):
            turn += 1
            lists = steps.put("lists", _round(lists, units, k, turn))
            entries, fresh = _flat(lists).agg(F.count(F.lit(1)), F.count_if("fresh")).first()
            if fresh <= UPDATES * entries:
                break
        links = steps.put("links", _links(lists, units, threshold))
        groups = steps.put("groups", components(links, steps))
        full = lists.filter((F.size("list") >= k) & (F.element_at("list", -1)["s"] >= threshold - SLACK))
        grouped = units.select("node", "n", "unit").join(groups, "node", "left").withColumn(
            "component", F.coalesce("component", "node"))
        wide = steps.put("wide", grouped.join(full.select("node"), "node", "left_semi").select(
            "component", F.lit(True).alias("wide")).distinct())
        placed = steps.put("placed", grouped.join(wide, "component", "left").withColumn(
            "wide", F.coalesce("wide", F.lit(False))))
        blocks = steps.put("blocks", _enlarged(placed, threshold))
        # listed links of the other groups stay inside them, so that none is counted twice
        counts = steps.put("counts", links.select("a", "b").unionByName(links.select(
            F.col("b").alias("a"), F.col("a").alias("b"))).join(
            placed.filter("not wide").select(F.col("node").alias("a")), "a",
            "left_semi").join(units.select(F.col("node").alias("b"), "n"), "b").select(
            F.col("a").alias("node"), F.col("n").alias("links")).unionByName(
            blocks.filter("node is not null").select("node", "links")).groupBy("node").agg(
            F.sum("links").alias("links")))
        got = {r["node"]: r["links"] for r in counts.filter(F.col("node").isin(
            asked[0].tolist())).collect()}
        if k >= vertices or _recall(truth, got, k) >= RECALL:
            break
        k *= 2
        lists = lists.withColumn("list", F.transform("list", lambda e: F.struct(
            e["s"].alias("s"), e["v"].alias("v"), F.lit(True).alias("fresh"))))
    joined = steps.put("joined", components(blocks.filter("a is not null").select("a", "b"), steps)) \
        .select(F.col("node").alias("component"), F.col("component").alias("root"))
    ends = placed.select("node", "n", "component").join(joined, "component", "left").join(
        counts, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "component").alias("component_id"))
    # rows -> vertex by the vector itself
    vertex = steps.put("vertex", counted.select("vector", "node").join(ends, "node"))
    linked = rows.join(vertex, "vector").select("vec_id", "n_links", "component_id")
    rows_left = table.filter(~F.coalesce(
        valid() & F.col("vec_id").isNotNull() & (F.size("embedding") == d), F.lit(False))).select("vec_id", *alone)
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(rows_left)
