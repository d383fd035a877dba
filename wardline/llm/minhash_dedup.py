"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

A document's set holds the hashes of its distinct shingles. SuperMinHash draws for each element
a random permutation of the signature's places and, at its j-th place, a value in [j, j + 1);
the places keep the least value. Values of step j matter only to documents that still have a
place at j or above, which ends most documents after two or three steps. Rows of equal sets
become one class; bands of the signatures of classes give buckets.

Nothing is compared all against all: in a bucket every class is compared with the least one,
on full sets. Linked classes are grouped; where a bucket still holds several groups, classes
are compared with the least class of another group, and at last in blocks of BLOCK classes, of
which only links that join groups leave a task, so that no link between groups is missed, whatever
the bucket's size. Pairs inside a group need no comparison: they cannot change the result.

Defined cases: null texts and texts without words have no set and link with nothing; texts
shorter than a shingle are one shingle; rows with a null doc_id link with nothing and are kept;
repeated rows are one class; rows with equal id share their component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Steps, components, keyed, mix, powers, signed, text_slices, \
    word_hashes, word_spans

SHINGLE = 5
#: 24 bands of 5: a pair at similarity 0.85 shares no band with probability 8e-7, at 0.80 7e-5.
BANDS, ROWS = 24, 5
#: Rounds that compare a bucket's classes with one leader before blocks are compared.
STAR_ROUNDS = 2
#: Classes of one block; shingles that more of them hold are counted as a matrix.
BLOCK, OFTEN = 256, 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Sorted distinct shingle hashes of all rows, and where each row's begin (rows + 1)."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends, lower=True)
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], out=total[1:])
    n = max(0, len(h) - size + 1)
    long = mix((total[size:size + n] - total[:n]) * down[:n])
    sets, bounds = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            x = np.sort(long[a:b - size + 1])
            x = x[np.append(True, x[1:] != x[:-1])]
        elif b > a:
            x = mix((total[b:b + 1] - total[a:a + 1]) * down[a:a + 1] + np.uint64(b - a))
        else:
            x = long[:0]
        sets.append(x)
        bounds.append(bounds[-1] + len(x))
    return np.concatenate(sets) if sets else long[:0], np.array(bounds)


def super_minhash(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows x m) of sets of 64-bit elements."""
    docs = len(bounds) - 1
    least = np.full(docs * m, np.inf)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    places = None
    for j in range(m):
        draw = mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = (draw >> np.uint64(12)).astype(np.float64) * 2.0 ** -52 + j
        k = (j + (draw & np.uint64(0xFFF)) * np.uint64(m - j) // np.uint64(4096)).astype(np.int64) \
            if j == 0 else j + (mix(draw) % np.uint64(m - j)).astype(np.int64)
        row = np.arange(len(elements))
        if places is None:
            place = k
        else:
            place = places[row, k].astype(np.int64)
            places[row, k] = places[:, j]
        np.minimum.at(least, doc * m + place, value)
        going = least.reshape(docs, m).max(axis=1) >= j + 1
        stay = going[doc]
        if not stay.any():
            break
        elements, doc = elements[stay], doc[stay]
        if places is None:
            places = np.tile(np.arange(m, dtype=np.int16 if m > 255 else np.uint8),
                             (len(elements), 1))
            row = np.arange(len(elements))
            places[row, k[stay]] = 0
        else:
            places = places[stay]
    return least.reshape(docs, m)


def _sketches(size, bands, rows):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("row_key")
            for first, n, data, offsets in text_slices(batch.column("text")):
                elements, bounds = shingle_sets(data, offsets, size)
                sig = super_minhash(elements, bounds, bands * rows)
                bits = mix(sig.view(np.uint64)).reshape(n, bands, rows)
                weight = powers(rows + 1)[0][1:]
                band = mix((bits * weight).sum(axis=2, dtype=np.uint64)
                           + np.arange(bands, dtype=np.uint64))
                total = np.zeros((2, len(elements) + 1), np.uint64)
                np.cumsum(mix(elements), out=total[0, 1:])
                np.cumsum(mix(elements ^ np.uint64(0x5DEECE66D)), out=total[1, 1:])
                sums = total[:, bounds[1:]] - total[:, bounds[:-1]]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, n), keys.slice(first, n), pa.array(np.diff(bounds)),
                    pa.array(signed(sums[0])), pa.array(signed(sums[1])),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)),
                        pa.array(signed(band).ravel()))],
                    ["doc_id", "row_key", "n_shingles", "s1", "s2", "bands"])
    return run


def _sets(size):
    def run(batches):
        for batch in batches:
            for first, n, data, offsets in text_slices(batch.column("text")):
                elements, bounds = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([
                    batch.column("node").slice(first, n),
                    pa.array([elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])],
                             pa.binary())], ["node", "elements"])
    return run


def _linked(percent):
    """Pairs whose sets have 100 x intersection >= percent x union."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            out = batch.select(["a", "b"])
            yield out.filter(pa.array(keep, pa.bool_()))
    return run


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets."""
    n = len(sets)
    of = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, of = np.concatenate(sets)[order], of[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    count = np.diff(np.append(first, len(values)))
    out = np.zeros((n, n), np.int64)
    for df in range(2, OFTEN + 1):
        rows = of[first[count == df][:, None] + np.arange(df)]
        i, j = np.triu_indices(df, 1)
        np.add.at(out, (rows[:, i].ravel(), rows[:, j].ravel()), 1)
    out += out.T
    often = np.flatnonzero(count > OFTEN)
    for at in range(0, len(often), 4096):
        part = often[at:at + 4096]
        column = np.repeat(np.arange(len(part)), count[part])
        place = np.arange(len(column)) + np.repeat(first[part] - np.cumsum(count[part]) + count[part],
                                                   count[part])
        held = np.zeros((n, len(part)), np.float32)
        held[of[place], column] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def _joining(percent):
    """Of two blocks (or one) of a bucket: links that join groups, a spanning forest of them."""
    def run(table):
        nodes, groups = (table.column(c).to_numpy() for c in ("node", "component"))
        a, b = [], []
        if len(set(groups.tolist())) > 1:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements")]
            size = np.array([len(x) for x in sets])
            shared = _shared_counts(sets)
            linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
            same = groups[:, None] == groups[None, :]
            seen = np.zeros(len(nodes), bool)
            for start in range(len(nodes)):
                todo = [] if seen[start] else [start]
                seen[start] = True
                while todo:
                    x = todo.pop()
                    new = np.flatnonzero((linked[x] | same[x]) & ~seen)
                    seen[new] = True
                    todo += new.tolist()
                    cross = new[~same[x, new]]
                    a += [nodes[x]] * len(cross)
                    b += nodes[cross].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _block_links(at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join groups inside buckets; at: bucket, node, component. Buckets with
    the same classes are looked at once."""
    once = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias(
        "what"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("also")).groupBy("n", "what", "also").agg(
        F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = at.select("bucket", "node", "component").join(once, "bucket").withColumn(
        "mine", F.pmod(F.xxhash64("node"), "blocks"))
    sent = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        "node", "component")
    return sent.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(
        _joining(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    steps = Steps(docs.sparkSession)
    docs = keyed(docs, "doc_id", "text")
    sketches = steps.put("sketches", docs.mapInArrow(
        _sketches(shingle, bands, rows), "doc_id long, row_key long, n_shingles long, s1 long, "
        "s2 long, bands array<long>").withColumn("node", F.monotonically_increasing_id()))
    classes = steps.put("classes", sketches.filter("n_shingles > 0 and doc_id is not null")
                        .groupBy("n_shingles", "s1", "s2").agg(
        F.min_by(F.struct("node", "doc_id", "row_key", "bands"), "node").alias("r"),
        F.count(F.lit(1)).alias("n")).select("r.*", "n_shingles", "s1", "s2"))
    buckets = classes.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    found = steps.put("found", buckets.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"),
        F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
        .filter(f"n > 2 or n = 2 and 100 * least >= {percent} * most"))
    members = steps.put("members", buckets.join(
        found.filter("n > 2").select("bucket", F.col("a").alias("leader")), "bucket"))
    sizes = classes.select("node", "n_shingles")

    pairs = found.filter("n = 2").select("a", "b").unionByName(
        members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    asked = found.filter("n = 2").select(F.explode(F.array("a", "b")).alias("node")).unionByName(
        members.select("node")).distinct()
    wanted = classes.join(asked, "node", "left_semi").select("node", "doc_id", "row_key")
    sets = steps.put("sets", docs.join(wanted, ["doc_id", "row_key"]).dropDuplicates(
        ["node"]).select("node", "text").mapInArrow(_sets(shingle), "node long, elements binary"))

    def verify(pairs, name):
        """Pairs (a, b) that may reach the threshold by their sizes and do by their sets."""
        pairs = pairs.distinct()
        for side in "ab":
            pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("n_shingles").alias(
                "n" + side)), side)
        pairs = pairs.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
        pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a") \
            .join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
        return steps.put(name, pairs.mapInArrow(_linked(percent), "a long, b long"))

    links = verify(pairs, "links")
    groups = steps.put("groups", components(links, steps))
    for turn in range(STAR_ROUNDS + 1):
        # buckets that still hold several groups
        at = members.drop("leader").join(groups, "node", "left").select(
            "bucket", "node", F.coalesce("component", "node").alias("component"))
        open_ = at.groupBy("bucket").agg(F.min("component").alias("low"),
                                         F.max("component").alias("high")).filter("low <> high")
        at = steps.put("open", at.join(open_, "bucket"))
        if at.isEmpty():
            break
        if turn == STAR_ROUNDS:
            new = steps.put("more", _block_links(at, sets, percent))
        else:
            # the least class outside the first group against all other groups
            lead = at.filter("component <> low").groupBy("bucket").agg(F.min(
                F.struct("node", "component")).alias("lead"))
            pairs = at.join(lead, "bucket").filter("component <> lead.component").select(
                F.col("lead.node").alias("a"), F.col("node").alias("b"))
            new = verify(pairs, "more")
        if not new.isEmpty():
            links = steps.put("links", links.unionByName(new))
            groups = steps.put("groups", components(links, steps))
    steps.drop("sets", "members", "found", "more", "open")

    # rows -> class -> group; the component is the least id of the group
    rows_of = sketches.select("node", "doc_id", "n_shingles", "s1", "s2")
    leads = classes.select(F.col("node").alias("lead"), "n_shingles", "s1", "s2")
    whole = rows_of.filter("n_shingles > 0 and doc_id is not null").join(
        leads, ["n_shingles", "s1", "s2"]).select("doc_id", "n_shingles", "lead")
    whole = steps.put("whole", whole.join(groups.withColumnRenamed("node", "lead"), "lead", "left")
                      .select("doc_id", "n_shingles", F.coalesce("component", "lead").alias("group")))
    ids = whole.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = whole.join(ids, "group").select("doc_id", "n_shingles", "component_id")
    rest = rows_of.filter("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(
        F.col("doc_id") == F.col("component_id"), F.lit(True)))
