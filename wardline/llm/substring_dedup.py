"""Removal of long repeated passages by recompression.

Texts are sequences of words. A round gives every run of one symbol, or every neighbouring
pair (left symbol, right symbol), a new name that is a hash of what it holds, so names agree
between documents without coordination: equal passages get equal symbols except near their
ends. Which symbols may be left or right of a pair is drawn per round from the name. Each
symbol also carries the span of words that decided it; a passage that contains this span
contains the symbol wherever it stands. Three uses follow:

1. A low-level symbol that occurs once rules out every window around its span.
2. A high-level symbol as long as a window that occurs again verifies all its words.
3. Windows that are left (ends of repeats) are compared by a 128-bit hash of their words.

Defined cases: null or empty texts have no words; texts shorter than a window lose nothing;
repeated rows are copies of each other; rows with one id and different texts are kept apart;
an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Steps, keyed, mix, powers, signed, text_slices, word_hashes, \
    word_spans

WINDOW = 35
#: Pair rounds before symbols are compared: symbols are then about five words long and nearly
#: every window of 35 words holds one with all that decided it.
LOW_ROUNDS = 6
_FAR = 1 << 29


def _sides(name: np.ndarray, round_no: int) -> np.ndarray:
    """True where a symbol may only be the right half of a pair in this round."""
    return (mix(name ^ np.uint64(round_no * 7919 + 13)) >> np.uint64(40)) & np.uint64(1) == 1


def _runs(name, start, end, doc):
    """Maximal runs of one symbol become one symbol named by symbol and count."""
    n = len(name)
    if n < 2:
        return name, start, end, doc, np.zeros(n, bool)
    same_doc = doc[1:] == doc[:-1]
    first = np.append(True, (name[1:] != name[:-1]) | ~same_doc)
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, n))
    last = at + count - 1
    out = np.where(count > 1, mix(name[at] * np.uint64(5) + count.astype(np.uint64)), name[at])
    return out, start[at], end[last], doc[at], count > 1


def _pairs(name, start, end, doc, round_no, span=None):
    """Every left symbol followed by a right symbol of its document becomes one symbol."""
    n = len(name)
    if n < 2:
        if span is not None and n:
            span = (np.full(n, -_FAR, np.int32), np.full(n, _FAR, np.int32))
        return name, start, end, doc, span, np.zeros(n, bool)
    right = _sides(name, round_no)
    after = np.append(doc[1:] == doc[:-1], False)
    at = np.flatnonzero(~right & after & np.append(right[1:], False))
    second = np.zeros(n, bool)
    second[at + 1] = True
    merged = np.zeros(n, bool)
    merged[at] = True
    if span is not None:
        # a pair is decided by its halves, a symbol that stays alone by its neighbour too
        lo, hi = span[0].copy(), span[1].copy()
        alone = ~(merged | second)
        for i, there, other in ((np.flatnonzero(alone & ~right), after, 1),
                                (np.flatnonzero(alone & right), np.append(False, after[:-1]), -1)):
            edge = i[~there[i]]
            i = i[there[i]]
            lo[i] = np.minimum(span[0][i], span[0][i + other])
            hi[i] = np.maximum(span[1][i], span[1][i + other])
            lo[edge], hi[edge] = -_FAR, _FAR
        lo[at] = np.minimum(span[0][at], span[0][at + 1])
        hi[at] = np.maximum(span[1][at], span[1][at + 1])
        span = (lo[~second], hi[~second])
    name, end = name.copy(), end.copy()
    name[at] = mix(name[at] * np.uint64(3) + mix(name[at + 1]))
    end[at] = end[at + 1]
    keep = ~second
    return name[keep], start[keep], end[keep], doc[keep], span, merged[keep]


class _Slice:
    """Words of some rows: hashes, document of each word, first word of each row."""

    def __init__(self, data, offsets):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(self.first))

    def low(self, window):
        """Low-level symbols (name, first word, document, span) decided within a window."""
        at = np.arange(len(self.hashes), dtype=np.int32)
        s = (self.hashes, at, at + 1, self.doc, (at, at + 1))
        for r in range(LOW_ROUNDS):
            s = _pairs(*s[:4], r, s[4])[:5]
        ok = s[4][1] - s[4][0] <= window
        return s[0][ok], s[1][ok], s[3][ok], s[4][0][ok], s[4][1][ok]

    def high(self, window, ranges):
        """Symbols (name, first word, last word + 1) of a window or more in the passages
        whose windows start in one of the ranges, each passage parsed on its own."""
        size = ranges[:, 1] - ranges[:, 0] + window - 1
        part = np.repeat(np.arange(len(size), dtype=np.int32), size)
        at = (np.arange(len(part)) + (ranges[:, 0] - np.cumsum(size) + size)[part]).astype(np.int32)
        s = _runs(self.hashes[at], at, at + 1, part)
        found, round_no = [], 0
        while len(s[0]) > 1 and (s[3][1:] == s[3][:-1]).any():
            *s, _, merged = _pairs(*s[:4], round_no)
            new = merged & (s[2] - s[1] >= window)
            found.append([x[new] for x in s[:3]])
            round_no += 1
            if round_no % 4 == 0:
                *s, merged = _runs(*s[:4])
                new = merged & (s[2] - s[1] >= window)
                found.append([x[new] for x in s[:3]])
        return [np.concatenate(x) for x in zip(*found)] if found else [at[:0]] * 3

    def windows(self, window):
        """128-bit hashes of the window at each word (rows are not minded)."""
        n = len(self.hashes) - window + 1
        up, down = powers(len(self.hashes) + 1)
        out = []
        for h in (self.hashes, mix(self.hashes ^ np.uint64(0xA5A5A5A5))):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[:len(h)], out=total[1:])
            out.append(mix((total[window:window + n] - total[:n]) * down[:n]))
        return out


def _ranges(flags: np.ndarray) -> np.ndarray:
    """Half-open runs of True as rows (from, to)."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _cover(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """True at every place in one of the half-open ranges."""
    d = np.bincount(lo, minlength=n + 1)[:n + 1] - np.bincount(hi, minlength=n + 1)[:n + 1]
    return np.cumsum(d)[:n] > 0


def _lists(column) -> list:
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column]


def _low_symbols(window):
    def run(batches):
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            for first, n, data, offsets in text_slices(batch.column("text")):
                s = _Slice(data, offsets)
                if len(s.hashes):
                    name, at, doc, _, _ = s.low(window)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(signed(name)), pa.array(keys[first:first + n][doc]),
                        pa.array((at - s.first[doc]).astype(np.int32))],
                        ["name", "row_key", "at"])
    return run


def _kept(s: _Slice, row: int, removed: np.ndarray | None) -> str:
    """Digest of the words that stay (bytes.split() splits at the same six characters)."""
    words = s.data[s.offsets[row]:s.offsets[row + 1]].tobytes().split()
    if removed is not None:
        words = compress(words, (~removed).tolist())
    return hashlib.sha256(b" ".join(words)).hexdigest()


_PARSED = ("doc_id long, row_key long, n_words long, kept_sha256 string, text string, "
           "open array<int>")


def _open_windows(window):
    """Rows that no window can touch are finished; others keep their text and the ranges of
    windows that no symbol occurring once rules out."""
    def run(batches):
        for batch in batches:
            once = _lists(batch.column("once"))
            ids, keys, texts = (batch.column(c) for c in ("doc_id", "row_key", "text"))
            for first, n, data, offsets in text_slices(texts):
                s = _Slice(data, offsets)
                _, at, doc, lo, hi = s.low(window)
                bound = np.searchsorted(doc, np.arange(n + 1))
                shas, kept, ranges = [], [], []
                for i in range(n):
                    a, size = s.first[i], int(s.first[i + 1] - s.first[i])
                    free = max(0, size - window + 1)
                    found = np.zeros((0, 2), int)
                    if free:
                        mine = slice(bound[i], bound[i + 1])
                        if once[first + i] is not None:
                            hit = np.isin(at[mine] - a, once[first + i])
                            u = np.maximum(hi[mine][hit] - a - window, 0)
                            v = np.minimum(lo[mine][hit] - a + 1, free)
                            fine = u < v
                            found = _ranges(~_cover(free, u[fine], v[fine]))
                        else:
                            found = np.array([[0, free]])
                    done = not len(found)
                    shas.append(_kept(s, i, None) if done else None)
                    kept.append(None if done else texts[first + i].as_py())
                    ranges.append(None if done else found.ravel().tolist())
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, n), keys.slice(first, n), pa.array(np.diff(s.first)),
                    pa.array(shas, pa.string()), pa.array(kept, pa.string()),
                    pa.array(ranges, pa.list_(pa.int32()))],
                    ["doc_id", "row_key", "n_words", "kept_sha256", "text", "open"])
    return run


def _high_symbols(window):
    """High-level symbols that lie in a range of open windows."""
    def run(batches):
        for batch in batches:
            keys, opened = batch.column("row_key").to_numpy(), _lists(batch.column("open"))
            for first, n, data, offsets in text_slices(batch.column("text")):
                s = _Slice(data, offsets)
                ranges = [opened[first + i].reshape(-1, 2) + s.first[i] for i in range(n)]
                name, a, b = s.high(window, np.concatenate(ranges))
                doc = s.doc[a]
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(name)), pa.array(keys[first:first + n][doc]),
                    pa.array((a - s.first[doc]).astype(np.int32)),
                    pa.array((b - s.first[doc]).astype(np.int32))],
                    ["name", "row_key", "at", "to"])
    return run


def _pairs_of(values) -> np.ndarray:
    return np.zeros((0, 2), np.int64) if values is None else np.asarray(values).reshape(-1, 2)


def _tops(window):
    """Of each row's repeated symbols (they nest) those that no other one holds; and, named by
    both, the words of the windows that cross from one of them into the next and lie in neither,
    where no word stands between the two."""
    def run(batches):
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            out = [[], [], [], []]
            for key, at, to, name in zip(keys, *(_lists(batch.column(c))
                                                 for c in ("at", "to", "name"))):
                order = np.lexsort((-to, at))
                reach = np.maximum.accumulate(to[order])
                top = order[np.append(True, to[order][1:] > reach[:-1])]
                name, at, to = name[top], at[top], to[top]
                over = to[:-1] - at[1:]
                meet = np.flatnonzero(over >= 0)
                u = name.view(np.uint64)
                both = mix(mix(u[meet] * np.uint64(7) + mix(u[meet + 1] ^ np.uint64(0x5C5C5C5C)))
                           + over[meet].astype(np.uint64))
                # the crossing windows start behind to - window and before the next symbol
                a, b = to[meet] - window + 1, at[meet + 1] + window - 1
                some = b - a >= window
                for column, x in zip(out, (np.append(name, signed(both[some])),
                                           np.full(len(name) + int(some.sum()), key),
                                           np.append(at, a[some]), np.append(to, b[some]))):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(x).astype(t)) for x, t in
                    zip(out, (np.int64, np.int64, np.int32, np.int32))],
                    ["name", "row_key", "at", "to"])
    return run


def _left_windows(window):
    """Hashes of open windows that hold a word no repeated symbol verifies, with their places;
    and without place those inside the one copy of each repeated symbol, or of each two that
    meet, that stands for all: none of these asks, but a window with a place may equal it."""
    def run(batches):
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            opened, covers, chosen = (_lists(batch.column(c))
                                      for c in ("open", "covers", "chosen"))
            for first, n, data, offsets in text_slices(batch.column("text")):
                s = _Slice(data, offsets)
                h1, h2 = s.windows(window)
                picked, docs, known = [], [], []
                for i in range(n):
                    size = int(s.first[i + 1] - s.first[i])
                    r, c = opened[first + i].reshape(-1, 2), _pairs_of(covers[first + i])
                    bare = np.zeros(size + 1, np.int64)
                    bare[1:] = ~_cover(size, c[:, 0], c[:, 1])
                    total = np.cumsum(bare)
                    free = size - window + 1
                    w = np.flatnonzero(_cover(free, r[:, 0], r[:, 1])
                                       & (total[window:] - total[:free] > 0))
                    picked.append(w + s.first[i])
                    docs.append(np.full(len(w), i))
                    c = _pairs_of(chosen[first + i])
                    known.append(np.flatnonzero(_cover(free, c[:, 0], c[:, 1] - window + 1))
                                 + s.first[i])
                at, doc = np.concatenate(picked), np.concatenate(docs)
                also = np.concatenate(known)
                both, none = np.append(at, also), pa.nulls(len(also), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(h1[both])), pa.array(signed(h2[both])),
                    pa.concat_arrays([pa.array(keys[first:first + n][doc]), none]),
                    pa.concat_arrays([pa.array((at - s.first[doc]).astype(np.int32)),
                                      none.cast(pa.int32())])],
                    ["h1", "h2", "row_key", "at"])
    return run


def _finish(window):
    def run(batches):
        for batch in batches:
            covers, starts = _lists(batch.column("covers")), _lists(batch.column("starts"))
            ids = batch.column("doc_id")
            for first, n, data, offsets in text_slices(batch.column("text")):
                s = _Slice(data, offsets)
                removed, shas, gone = [], [], []
                for i in range(n):
                    size = int(s.first[i + 1] - s.first[i])
                    c = _pairs_of(covers[first + i])
                    w = starts[first + i] if starts[first + i] is not None else c[:0, 0]
                    flags = _cover(size, np.append(c[:, 0], w).astype(int),
                                   np.append(c[:, 1], w + window).astype(int))
                    removed.append(int(flags.sum()))
                    shas.append(_kept(s, i, flags))
                    gone.append(_ranges(flags).ravel().tolist())
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, n), pa.array(np.diff(s.first)),
                    pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
                    pa.array(gone, pa.list_(pa.int32()))],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])
    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and `removed`,
    the removed word ranges [from, to, from, to, ...]. A word goes where a window of `window`
    words over it starts at another place as well."""
    steps = Steps(docs.sparkSession)
    docs = keyed(docs, "doc_id", "text")
    symbols = docs.mapInArrow(_low_symbols(window), "name long, row_key long, at int")
    # xor of one value is the value: a symbol that occurs once gives its place without a join
    once = steps.put("once", symbols.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("row_key").alias("row_key"),
        F.bit_xor("at").alias("at")).filter("n = 1")
        .groupBy("row_key").agg(F.collect_list("at").alias("once")))
    parsed = steps.put("parsed", docs.join(once, "row_key", "left").mapInArrow(
        _open_windows(window), _PARSED))
    steps.drop("once")
    left = parsed.filter("text is not null")

    high = steps.put("high", left.mapInArrow(
        _high_symbols(window), "name long, row_key long, at int, to int"))
    again = high.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = steps.put("found", high.join(again, "name", "left_semi"))
    steps.drop("high")
    covers = steps.put("covers", found.groupBy("row_key").agg(
        F.flatten(F.collect_set(F.array("at", "to"))).alias("covers")))
    tops = found.groupBy("row_key").agg(*[F.collect_list(c).alias(c) for c in ("at", "to", "name")])
    one = tops.mapInArrow(_tops(window), "name long, row_key long, at int, to int").groupBy("name").agg(
        F.min(F.struct("row_key", "at", "to")).alias("one")).select("one.*")
    chosen = one.groupBy("row_key").agg(F.flatten(F.collect_set(F.array("at", "to"))).alias("chosen"))

    windows = steps.put("windows", left.join(covers, "row_key", "left")
                        .join(chosen, "row_key", "left").mapInArrow(
        _left_windows(window), "h1 long, h2 long, row_key long, at int"))
    steps.drop("found")
    again = windows.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.count("at").alias("placed")) \
        .filter("placed > 0 and (n > 1 or placed < n)")
    starts = steps.put("starts", windows.filter("at is not null")
                       .join(again, ["h1", "h2"], "left_semi")
                       .groupBy("row_key").agg(F.collect_set("at").alias("starts")))
    steps.drop("windows")

    ended = left.join(covers, "row_key", "left").join(starts, "row_key", "left").mapInArrow(
        _finish(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                         "removed array<int>")
    return parsed.filter("text is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
        F.array().cast("array<int>").alias("removed")).unionByName(ended)
