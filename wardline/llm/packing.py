"""Best-fit decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so best-fit decreasing depends only on how many
pieces have each length: at most `capacity` counts, summed by Spark. The plan is made from
these counts: bins with the same filling are one group, and a segment tree over remaining
capacities finds the tightest capacity that still holds a length in logarithmic time, for all
bins of the group at once. The number of groups is bounded by the capacity, not by the input.
Each piece then looks up its place by its length and its rank among pieces of that length;
ranks come from per-bucket counts, so no length is gathered in one task.

Token ids are those of the byte-level BPE vocabulary. Texts are encoded by the public tiktoken
library with the same ranks (five times as fast, equal ids: tests/llm compares them); a text
that spells a special token goes through the tokenizers library, which maps it.

Defined cases: null texts are empty (their end id alone); repeated rows are packed each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardline.llm.common import Steps

CAPACITY = 1024
END_ID = 2
#: Pieces in one bucket of the rank computation, about.
BUCKET_ROWS = 10_000
_SPECIAL = "<|endoftext|>"
_encoders: dict = {}


def _encoder(folder: str):
    """text -> ids, by the vocabulary files in the folder (None: the installed ones)."""
    if folder not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        path = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        with open(path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}).encode_ordinary
        slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
        _encoders[folder] = lambda t: (
            slow.encode(t, add_special_tokens=False).ids if _SPECIAL in t else fast(t))
    return _encoders[folder]


def _pieces(capacity, end_id, folder):
    def run(batches):
        encode = _encoder(folder)
        for batch in batches:
            out = [[], [], [], [], []]
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text")):
                tokens = array("I", encode(text.as_py() or ""))
                tokens.append(end_id)
                n, start, piece = len(tokens), 0, 0
                while start < n:
                    size = (n - start) % capacity or capacity
                    for column, x in zip(out, (doc_id, piece, start, size, zlib.crc32(
                            tokens[start:start + size].tobytes()))):
                        column.append(x)
                    start, piece = start + size, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


class _Tree:
    """Segment tree over capacities: the smallest one at or above a bound that is in use."""

    def __init__(self, capacity):
        self.size = 1 << capacity.bit_length()
        self.used = bytearray(2 * self.size)

    def mark(self, at, used):
        at += self.size
        self.used[at] = used
        while at > 1:
            at //= 2
            self.used[at] = self.used[2 * at] or self.used[2 * at + 1]

    def tightest(self, least):
        at = least + self.size
        while not self.used[at]:
            while at & 1:  # a right child: go up until there is something to the right
                at //= 2
                if not at:
                    return None
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the right edge
                return None
        while at < self.size:
            at = 2 * at if self.used[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces. Rows (length, rank, bins, sequence,
    offset): pieces of that length from that rank on go to `bins` sequences from `sequence`
    on, one each, at that offset."""
    tree, groups = _Tree(capacity), {}  # remaining capacity -> [(first sequence, bins)]
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # a full step of new bins; the tightest of them is used again while it holds more
                per = capacity // length
                bins = max(1, left // per)
                groups.setdefault(capacity, []).append((sequences, bins))
                tree.mark(capacity, 1)
                sequences += bins
                room = capacity
            first, bins = groups[room].pop()
            fits = room // length
            take = min(bins, max(1, left // fits)) if left >= fits else 1
            if take < bins:
                groups[room].append((first + take, bins - take))
            if not groups[room]:
                del groups[room]
                tree.mark(room, 0)
            # best fit keeps filling the bin it has just made tightest
            times = min(fits, left // take)
            for k in range(times):
                rows.append((length, rank, take, first, capacity - room + k * length))
                rank += take
            left -= take * times
            room -= times * length
            if room:
                groups.setdefault(room, []).append((first, take))
                tree.mark(room, 1)
    return rows


def _places(table):
    def run(batches):
        length, rank, first, offset = table.value
        keys = (length << 44) + rank
        for batch in batches:
            mine, place = (batch.column(c).to_numpy() for c in ("length", "place"))
            at = np.searchsorted(keys, (mine << 44) + place, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(first[at] + place - rank[at]),
                 pa.array(offset[at])], [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
         tokenizer_folder: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs
    (doc_id, text); only a document longer than the capacity is cut."""
    spark = docs.sparkSession
    steps = Steps(spark)
    pieces = steps.put("pieces", docs.select("doc_id", "text").mapInArrow(
        _pieces(capacity, end_id, tokenizer_folder),
        "doc_id long, piece int, start long, length long, ids_crc32 long"))
    buckets = max(1, -(-pieces.count() // BUCKET_ROWS))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"),
                                               F.lit(buckets)))
    counts = steps.put("counts", keyed.groupBy("bucket", "length").agg(
        F.count(F.lit(1)).alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = np.array(sorted(plan(total, capacity)), dtype=np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast((rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 4]))
    before = counts.select("bucket", "length", F.coalesce(F.sum("n").over(Window.partitionBy(
        "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "length").orderBy(
        "doc_id", "piece", "ids_crc32"))
    placed = keyed.withColumn("rank", rank).join(before, ["bucket", "length"]).withColumn(
        "place", F.col("before") + F.col("rank") - 1)
    return placed.mapInArrow(_places(table), "doc_id long, piece int, start long, length long, "
                             "ids_crc32 long, sequence_id long, offset long")
