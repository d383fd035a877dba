"""Search of very many queries at once: every text is scanned once for all their terms.

Each record keeps the numbers of the terms its text holds. Gold and silver records of a name meet
in bounded units, dealt into groups that are stored once, by term. A task answers a block of
queries: it reads one group after another and keeps the first k pairs of each query by bit masks
of its terms, so no more than these leave the task, and a group that cannot enter them is left.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from wardline.operators.pairs import top_k
from wardline.sources.layers import cut, delete, release_shuffles, scratch_path

# Terms looked for at once, bytes of texts and of marks (text by term) that a task handles at once.
TERMS_PER_SCAN, BYTES_PER_SCAN, MARKS_PER_SCAN = 1_000_000, 4 << 20, 16 << 20
# Records of either side in a unit (part of a name), records in a group, and queries it answers.
UNIT_ROWS, GROUP_ROWS, QUERIES_PER_TASK = 8_192, 49_152, 15_000
# Names of more than one part in so many of a group are dealt out by their size, others by hash.
LARGE_SHARE = 16
# Fewer queries or records than these are not worth a task of their own.
FEW_QUERIES, FEW_ROWS = 2_500, 16_384
# Records sorted at once by the terms they hold, places stored at once, and golds looked at once by trust.
SORTED_ROWS, STORED_PLACES, GOLD_STEP = 2048, 1 << 20, 512
# Queries whose terms are counted at once.
QUERIES_AT_ONCE = 32
# A term that one record in so many holds is stored as bits, others as places.
BITS_SHARE = 16
# Entries of caches by filters, each an array over the records of a group.
KEPT = 256
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

# tasks get the functions themselves, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _freed() -> None:
    """Gives unused memory back: workers stay for later tasks, beside steps that need it elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --- terms of a text -------------------------------------------------------------------

def _read_terms(path: str) -> pa.Array:
    """The stored terms; the number of a term is its place here."""
    store, folder = fs.FileSystem.from_uri(path)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet"))
    parts = [pq.read_table(n, filesystem=store, columns=["term"]).column("term") for n in names]
    return pa.concat_arrays([c.cast(pa.large_string()) for p in parts for c in p.chunks] or [
        pa.array([], pa.large_string())])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the borders between them."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    borders = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8), borders


def _marks(hashes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A table that tells most values that are not among the hashes, and the shift it is read with."""
    shift = np.uint64(64 - max(12, (8 * len(hashes)).bit_length()))
    table = np.zeros(1 << int(64 - shift), dtype=bool)
    table[(hashes * SPREAD) >> shift] = True
    return table, shift


class _Terms:
    """Terms by length and hash of their bytes, and the hashes of what longer terms begin with."""

    def __init__(self, terms: pa.Array, first: int):
        data, borders = _bytes_of(terms)
        at, end, number = borders[:-1], borders[1:], np.arange(len(terms)) + first
        hashes = np.zeros(len(at), dtype=np.uint64)
        self.of: list = []
        while (live := at + len(self.of) < end).any():
            at, end, number, hashes = at[live], end[live], number[live], hashes[live]
            n = len(self.of) + 1
            hashes = hashes * FACTOR + data[at + (n - 1)] + np.uint64(1)
            whole = np.flatnonzero(at + n == end)
            whole = whole[np.argsort(hashes[whole], kind="stable")]
            known = hashes[whole]
            alike = int(np.unique(known, return_counts=True)[1].max(initial=0))
            self.of.append((known, number[whole], data[at[whole][:, None] + np.arange(n)], _marks(known), alike,
                            _marks(np.unique(hashes[at + n < end]))))

    def held(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token, number) for every term that a token holds, some more than once."""
        data, borders = _bytes_of(tokens)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        a = 0
        while a < len(tokens):
            b = max(a + 1, int(np.searchsorted(borders, borders[a] + (1 << 18), side="right")) - 1)
            found += self._held(data, borders[a:b + 1], a)
            a = b
        return tuple(np.concatenate(c) for c in zip(*found))

    def _held(self, data: np.ndarray, borders: np.ndarray, first: int) -> list:
        out = []
        lengths = np.diff(borders)
        token = np.repeat(np.arange(first, first + len(lengths)), lengths)
        at, end = np.arange(borders[0], borders[-1]), np.repeat(borders[1:], lengths)
        hashes = np.zeros(len(at), dtype=np.uint64)
        for n, (known, numbers, letters, (marks, shift), alike, (longer, longer_shift)) in enumerate(self.of, 1):
            hashes = hashes * FACTOR + data[at + (n - 1)] + np.uint64(1)
            mixed = hashes * SPREAD
            if alike:
                near = np.flatnonzero(marks[mixed >> shift])
                place = np.searchsorted(known, hashes[near])
                for more in range(alike):
                    p = np.minimum(place + more, len(known) - 1)
                    same = known[p] == hashes[near]
                    i, p = near[same], p[same]
                    exact = (data[at[i][:, None] + np.arange(n)] == letters[p]).all(axis=1)
                    out.append((token[i[exact]], numbers[p[exact]]))
            live = np.flatnonzero(longer[mixed >> longer_shift] & (at + n < end))
            if not len(live):
                break
            at, end, token, hashes = at[live], end[live], token[live], hashes[live]
        return out


def _packed(numbers: np.ndarray) -> bytes:
    """Rising numbers as differences: the lowest bytes of all, then the next ones, as far as needed."""
    steps = np.diff(numbers, prepend=0).astype("<u4")
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([wide]) + steps.view(np.uint8).reshape(-1, 4).T[:wide].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.int64)
    planes = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(blob[0], -1)
    steps = planes[0].astype(np.int64)
    for i in range(1, blob[0]):
        steps += planes[i].astype(np.int64) << (8 * i)
    return np.cumsum(steps)


def _held_in(texts: pa.Array, scans: list[_Terms]) -> list[bytes]:
    """The packed numbers of the terms that each text holds. Terms hold no white space, so the distinct
    tokens of all texts are scanned once."""
    lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    coded = lists.values.dictionary_encode()
    found = [s.held(coded.dictionary) for s in scans]
    token, number = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    out = [b""] * len(texts)
    if not len(token):
        return out
    order = np.argsort(token, kind="stable")
    token = token[order]
    first = np.searchsorted(token, np.arange(len(coded.dictionary) + 1))
    used, local = np.unique(number[order], return_inverse=True)
    codes, borders = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    codes, borders = codes[borders[0]:], borders - borders[0]
    step = max(1, MARKS_PER_SCAN // len(used))
    for a in range(0, len(texts), step):
        b = min(len(texts), a + step)
        code = codes[borders[a]:borders[b]]
        row = np.repeat(np.arange(b - a), np.diff(borders[a:b + 1]))
        n = first[code + 1] - first[code]
        some = n > 0
        code, row, n = code[some], row[some], n[some]
        at = np.arange(n.sum()) + np.repeat(first[code] - (np.cumsum(n) - n), n)
        marks = np.zeros((b - a) * len(used), dtype=bool)
        marks[np.repeat(row * len(used), n) + local[at]] = True
        marked = np.flatnonzero(marks)
        ends = np.searchsorted(marked, np.arange(b - a + 1) * len(used))
        numbers = used[marked % len(used)]
        for i in range(b - a):
            if ends[i + 1] > ends[i]:
                out[a + i] = _packed(numbers[ends[i]:ends[i + 1]])
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about BYTES_PER_SCAN of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BYTES_PER_SCAN, side="right")))
        yield a, b
        a = b


def held_terms(records: DataFrame, terms: str) -> DataFrame:
    """The records with the packed numbers of the stored terms that their text holds instead of the
    text. Each text is scanned where it is read."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = None
        for batch in batches:
            if scans is None:
                all_terms = _read_terms(terms)
                scans = [_Terms(all_terms.slice(i, TERMS_PER_SCAN), i)
                         for i in range(0, len(all_terms), TERMS_PER_SCAN)]
            at = batch.schema.get_field_index("text")
            for a, b in _slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.set_column(at, "held", pa.array(_held_in(part.column(at), scans), pa.binary()))
            _freed()

    kinds = ", ".join("held binary" if c == "text" else f"{c} {kind}" for c, kind in records.dtypes)
    return records.mapInArrow(scan, kinds)


# --- groups of records -----------------------------------------------------------------

def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each first to its end, one range after another."""
    n = end - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _places_kind(n: int) -> np.dtype:
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def _by_term(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, how many records hold each, and the places of these, term after term."""
    kind = _places_kind(len(blobs))
    chunks, terms = [], []
    for a in range(0, len(blobs), SORTED_ROWS):
        lists = [_unpacked(b) for b in blobs.slice(a, SORTED_ROWS).to_pylist()]
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        keys = np.sort(np.concatenate(lists) * SORTED_ROWS + row)
        found, start = np.unique(keys // SORTED_ROWS, return_index=True)
        chunks.append((found, np.diff(np.append(start, len(keys))), (keys % SORTED_ROWS + a).astype(kind)))
        terms.append(found)
    every = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.int64)
    codes = [np.searchsorted(every, found) for found in terms]
    counts = np.zeros(len(every), dtype=np.int64)
    for code, (_, n, _) in zip(codes, chunks):
        counts[code] += n
    places = np.empty(counts.sum(), dtype=kind)
    cursor = np.cumsum(counts) - counts
    for code, (_, n, rows) in zip(codes, chunks):
        places[_ranges(cursor[code], cursor[code] + n)] = rows
        cursor[code] += n
    return every, counts, places


TERMS = pa.schema([(c, pa.large_binary()) for c in ("terms", "counts", "many", "few", "ones", "bits")])


def _stored_terms(terms: np.ndarray, counts: np.ndarray, places: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """The places of terms in steps of bounded size: bits of terms that many of the n records hold, and
    of others the bytes that are not empty, by place and value."""
    ends = np.cumsum(counts)
    a = 0
    while a < len(terms):
        before = ends[a] - counts[a]
        b = max(a + 1, int(np.searchsorted(ends, before + STORED_PLACES, side="right")))
        held, here = counts[a:b], places[before:ends[b - 1]]
        many = held * BITS_SHARE >= n
        bits = []
        for t in np.flatnonzero(many):
            row = np.zeros(n, dtype=np.uint8)
            row[here[ends[a + t] - held[t] - before:ends[a + t] - before]] = 1
            bits.append(np.packbits(row, bitorder="little"))
        of, few = (c[~np.repeat(many, held)] for c in (np.repeat(np.arange(b - a, dtype=np.int32), held), here))
        start = np.flatnonzero((np.diff(of, prepend=np.int32(-1)) != 0) | (np.diff(few >> 3, prepend=few.dtype.type(0)) != 0))
        ones = np.left_shift(1, few & 7).astype(np.uint8)
        ones = np.bitwise_or.reduceat(ones, start) if len(start) else ones
        # differences wrap around, also from one term to the next, and so do their sums
        steps = np.diff(few[start] >> 3, prepend=few.dtype.type(0))
        columns = (terms[a:b], np.bincount(of[start], minlength=b - a), many,
                   np.ascontiguousarray(steps.view(np.uint8).reshape(-1, few.dtype.itemsize).T), ones,
                   np.concatenate(bits) if bits else np.empty(0, np.uint8))
        yield pa.record_batch([pa.array([c.tobytes()], pa.large_binary()) for c in columns], schema=TERMS)
        a = b


def _write(out, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> None:
    with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        for batch in batches:
            stream.write_batch(batch)


def _store_group(records: pa.Table, folder: str) -> pa.Table:
    """Writes a group: silver records by unit and id with the places of each term, gold records by
    falling trust and by id with a number for each set of terms that one of them holds."""
    names = {"file": pa.string(), "best": pa.float64()}
    start = {"null_placement": "at_start"}
    gold = records.filter(pc.field("gold"))
    silver = records.filter(~pc.field("gold"))
    gold = gold.filter(pc.is_in(gold.column("unit"), pc.unique(silver.column("unit"))))
    silver = silver.filter(pc.is_in(silver.column("unit"), pc.unique(gold.column("unit"))))
    if not gold.num_rows:
        return pa.table({n: pa.array([], t) for n, t in names.items()})
    gold = gold.take(pc.sort_indices(gold, [("trust_score", "descending"), ("id", "ascending")], **start))
    silver = silver.take(pc.sort_indices(silver, [("unit", "ascending"), ("id", "ascending")], **start))
    units = pc.unique(silver.column("unit"))
    unit = {n: pc.index_in(side.column("unit"), units) for n, side in (("gold", gold), ("silver", silver))}
    sets = gold.column("held").combine_chunks().dictionary_encode()
    held = [_unpacked(b or b"") for b in sets.dictionary.to_pylist()]
    tables = [silver.select(["id", *SILVER_ASKS]).append_column("unit", unit["silver"]),
              gold.select(["id", "trust_score", "doctors", *FLAGS]).append_column("unit", unit["gold"])
              .append_column("set", sets.indices),
              pa.table({"set": pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]), pa.int64()),
                        "term": pa.array(np.concatenate(held) if held else [], pa.int64())})]
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{path}/{name}") as out:
        _write(out, TERMS, _stored_terms(*_by_term(silver.column("held")), silver.num_rows))
        for table in tables:
            _write(out, table.schema, table.to_batches())
    best = pc.max(gold.column("trust_score")).as_py()
    del gold, silver, tables
    _freed()
    return pa.table([pa.array([v], t) for v, t in zip((name, best), names.values())], names=list(names))


FLAGS = ["icu", "emergency", "open_24_7", "contradictions"]
GOLD_ASKS = ["min_trust", *FLAGS, "min_doctors"]
SILVER_ASKS = ["state", "city", "facility_type", "dialysis"]
FOUND = pa.schema([("qi", pa.int64()), ("gold_id", pa.string()), ("silver_id", pa.string()),
                   ("trust_score", pa.float64()), ("relevance_score", pa.int32())])


def _kept(cache: dict, key, make: Callable):
    if key not in cache:
        if len(cache) >= KEPT:
            cache.clear()
        cache[key] = make()
    return cache[key]


def _added(rows: np.ndarray) -> list[np.ndarray]:
    """How many of eight bits are set at each place, as the four bits of that number."""
    def add(a, b, c):
        odd = a ^ b
        return odd ^ c, (a & b) | (c & odd)

    a, b, c, d, e, f, g, h = (rows[:, i] for i in range(8))
    (one, two), (more, two_more) = add(a, b, c), add(d, e, f)
    one, also_two = add(one, more, g)
    first, last_two = one ^ h, one & h
    two, four = add(two, two_more, also_two)
    second, also_four = two ^ last_two, two & last_two
    return [first, second, four ^ also_four, four & also_four]


def _at_least(number: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """The places where a number, given by its bits, is not below the one wanted in its row."""
    above = np.zeros_like(number[0])
    same = ~above
    for i in range(3, -1, -1):
        wanted = np.where(least >> i & 1, ~np.uint64(0), np.uint64(0))[:, None]
        above |= same & number[i] & ~wanted
        same &= ~(number[i] ^ wanted)
    return above | same


def _bits_of(number: int) -> list[int]:
    return [i for i in range(8) if number >> i & 1]


class _Group:
    """A stored group, and what has been asked of it."""

    def __init__(self, store: fs.FileSystem, path: str):
        with store.open_input_stream(path) as file:
            terms = pa.ipc.open_stream(file).read_all().to_pylist()
            silver, gold, sets = (pa.ipc.open_stream(file).read_all().combine_chunks() for _ in range(3))
        one = lambda c, kind: np.frombuffer(b"".join(t[c] for t in terms), dtype=kind)
        self.terms, counts, many = one("terms", np.int64), one("counts", np.int64), one("many", bool)
        self.silver, self.n, self.gold, self.m = silver, silver.num_rows, gold, gold.num_rows
        kind = _places_kind(self.n)
        self.few = np.concatenate([np.cumsum(np.ascontiguousarray(np.frombuffer(t["few"], np.uint8).reshape(
            kind.itemsize, -1).T).view(kind).ravel(), dtype=kind) for t in terms] or [np.empty(0, kind)])
        self.ones = one("ones", np.uint8)
        self.bits = one("bits", np.uint8).reshape(-1, (self.n + 7) // 8)
        del terms
        self.end = np.cumsum(counts)
        self.first = self.end - counts
        self.row_of = np.where(many, np.cumsum(many) - 1, -1)
        self.width = (self.n + 63) // 64 * 8
        number = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        self.unit, self.gold_unit, self.set = number(silver, "unit"), number(gold, "unit"), number(gold, "set")
        units = np.arange(self.unit[-1] + 1)
        self.size = np.bincount(self.unit)
        self.by_unit = np.argsort(self.gold_unit, kind="stable")
        unit = self.gold_unit[self.by_unit]
        self.gold_first, self.gold_end = (np.searchsorted(unit, units, side=s) for s in ("left", "right"))
        self.trust = gold.column("trust_score").to_numpy().astype(float)
        self.ids = gold.column("id").chunk(0), silver.column("id").chunk(0)
        self.sets = self.set.max() + 1
        of_set, term = number(sets, "set"), number(sets, "term")
        order = np.argsort(term, kind="stable")
        self.set_of_term = of_set[order]
        self.gold_terms, first = np.unique(term[order], return_index=True)
        self.set_first = np.append(first, len(order)).tolist()
        self.caches: dict = {name: {} for name in ("gold", "silver", "sets", "held", "coded", "fitting")}

    def places(self, terms: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The place of each term in the group's, -1 where it is not there."""
        if not len(of):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(of, terms), len(of) - 1)
        return np.where(of[at] == terms, at, -1)

    def id(self, side: int, i: int) -> str:
        """The id of a record, as it is ordered: null ones first."""
        v = self.ids[side][i].as_py()
        return "" if v is None else "0" + v

    def rows(self, terms: np.ndarray) -> np.ndarray:
        """For each list of terms and each of its terms, the silver records that hold it, as bits."""
        flat = terms.ravel()
        out = np.zeros((len(flat), self.width), dtype=np.uint8)
        row = np.where(flat >= 0, self.row_of[flat] if len(self.row_of) else -1, -1)
        many = np.flatnonzero(row >= 0)
        out[many, :self.bits.shape[1]] = self.bits[row[many]]
        few = np.flatnonzero((flat >= 0) & (row < 0))
        first, end = self.first[flat[few]], self.end[flat[few]]
        at = _ranges(first, end)
        out.ravel()[np.repeat(few * self.width, end - first) + self.few[at]] = self.ones[at]
        return out.reshape(*terms.shape, self.width)

    def packed(self, ok: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, dtype=np.uint8)
        out[:(self.n + 7) // 8] = np.packbits(ok, bitorder="little")
        return out

    def unpacked(self, bits: np.ndarray) -> np.ndarray:
        return np.unpackbits(bits.view(np.uint8), count=self.n, bitorder="little")

    def fitting(self, name: str, test: Callable) -> np.ndarray:
        """Which silver records have a value that fits; each distinct one is looked at once."""
        def make():
            c = self.silver.column(name).chunk(0).dictionary_encode()
            return c.dictionary.to_pylist(), c.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        values, code = _kept(self.caches["coded"], name, make)
        return np.array([test(v) for v in values] + [False], dtype=bool)[code]

    def silver_passes(self, q: tuple) -> np.ndarray:
        """The silver records that pass, as bits."""
        state, city, kind, dialysis = q
        ok = np.ones(self.n, dtype=bool)
        for asked, name in ((state, "state"), (city, "city")):
            if asked is not None:
                ok &= _kept(self.caches["fitting"], (name, asked),
                            lambda: self.fitting(name, lambda v: asked in v))  # noqa: B023
        if kind is not None:
            ok &= self.fitting("facility_type", lambda v: v == kind)
        if dialysis is not False:
            ok &= self.silver.column("dialysis").to_numpy().astype(bool)
        return self.packed(ok)

    def gold_passes(self, q: tuple) -> tuple:
        """Which gold records pass, their places by falling trust, units and sets they have, the silver
        records of their units as bits, and trust and id of the first."""
        trust, *flags, doctors = q
        ok = np.ones(self.m, dtype=bool)
        if trust is not None:
            ok &= self.trust >= trust
        for asked, name in zip(flags, FLAGS):
            if asked is not False:
                ok &= self.gold.column(name).to_numpy().astype(bool)
        if doctors is not None:
            known = self.gold.column("doctors").to_pylist()
            ok &= np.array([d is not None and (d > doctors or d != d) for d in known], dtype=bool)
        at = np.flatnonzero(ok).astype(np.int32)
        both = np.unique(self.gold_unit[at] * self.sets + self.set[at])
        units, sets = both // self.sets, both % self.sets
        offered = np.zeros(len(self.size), dtype=bool)
        offered[units] = True
        first = (-float(self.trust[at[0]]), self.id(0, int(at[0]))) if len(at) else None
        return ok, at, units, sets, self.packed(np.repeat(offered, self.size)), first

    def gold_terms_of(self, terms: tuple, of_gold: tuple) -> tuple:
        """Which of the query's terms each set of gold records holds, and the units by what their passing
        gold records hold."""
        def marked():
            of_set = np.zeros(self.sets, dtype=np.uint8)
            for i, t in enumerate(terms):
                if t >= 0:
                    of_set[self.set_of_term[self.set_first[t]:self.set_first[t + 1]]] |= 1 << i
            return of_set
        of_set = _kept(self.caches["sets"], terms, marked)

        def having():
            _, _, units, sets, *_ = self.gold_of(of_gold)
            held, out = of_set[sets], {}
            for v in np.flatnonzero(np.bincount(held)).tolist():
                out[v] = np.zeros(len(self.size), dtype=bool)
                out[v][units[held == v]] = True
            return out, [v for v in out if not any(v & w == v and v != w for w in out)]
        return of_set, *_kept(self.caches["held"], (terms, of_gold), having)

    def gold_of(self, q: tuple) -> tuple:
        return _kept(self.caches["gold"], q, lambda: self.gold_passes(q))

    def answer(self, queries: list[tuple], k: int) -> Iterator[tuple[int, list[tuple]]]:
        """For queries (number, places of terms, of terms of gold, whether it has any, filters of both
        sides, its last pair) the pairs that can come before the last one: the first k, and a few more."""
        waiting = []
        for q in queries:
            number, terms, gold_terms, some, of_gold, of_silver, last = q
            first = self.gold_of(of_gold)[-1]
            if first is None:
                continue
            # at the last pair's number of terms the first gold record has to come before its one
            least = max(int(some), 0 if last is None else -last[0] + (first > last[1:3]))
            if sum(a >= 0 or b >= 0 for a, b in zip(terms, gold_terms)) >= least:
                waiting.append((q, least))
        for a in range(0, len(waiting), QUERIES_AT_ONCE):
            yield from self._answer(waiting[a:a + QUERIES_AT_ONCE], k)

    def _answer(self, waiting: list[tuple], k: int) -> Iterator[tuple[int, list[tuple]]]:
        held = [self.gold_terms_of(q[2], q[4]) for q, _ in waiting]
        usable = np.array([self.gold_of(q[4])[4] & _kept(
            self.caches["silver"], q[5], lambda: self.silver_passes(q[5])) for q, _ in waiting])  # noqa: B023
        terms = np.full((len(waiting), 8), -1)
        for i, (q, _) in enumerate(waiting):
            terms[i, :len(q[1])] = q[1]
        rows = self.rows(terms)
        # what a gold record holds counts for all; sets of terms within others tell nothing more
        of, values = (np.array(c) for c in zip(*((i, v) for i, h in enumerate(held) for v in h[2])))
        every = rows[of]
        for e in np.flatnonzero(values):
            every[e, _bits_of(int(values[e]))] = 255
        number = _added(every.view(np.uint64))
        least = np.array([n for _, n in waiting])[of]
        near = (_at_least(number, least) & usable[of].view(np.uint64)).any(axis=1)
        for i in np.unique(of[near]).tolist():
            bound = np.zeros(self.n, dtype=np.uint8)
            for e in np.flatnonzero(near & (of == i)):
                bound = np.maximum(bound, sum(self.unpacked(number[b][e]) << b for b in range(4)) + np.uint8(1))
            bound *= self.unpacked(usable[i])
            q, n = waiting[i]
            yield q[0], self._pairs(q, n, held[i], rows[i], bound, k)

    def _pairs(self, q: tuple, least: int, held: tuple, bits: np.ndarray, bound: np.ndarray, k: int) -> list[tuple]:
        """Pairs by falling number of terms, from records whose bound (by one more) allows it; at one
        number gold records go by trust and id (one that is in several units with all of them), and
        their silver records by id."""
        of_set, having, _ = held
        last_trust = q[6][1] if q[6] is not None and -q[6][0] == least else math.inf
        out: list[tuple] = []
        for now in range(int(bound.max()) - 1, least - 1, -1):
            at = np.flatnonzero(bound > now)
            masks = np.bitwise_or.reduce([(bits[b, at >> 3] >> (at & 7) & 1) << b for b in range(8)])
            unit = self.unit[at]
            hits = {}
            for v, units in having.items():
                fits = np.flatnonzero((np.bitwise_count(masks | np.uint8(v)) == now) & units[unit])
                if len(fits):
                    hits[v] = at[fits], unit[fits]
            if hits:
                self._take(out, now, hits, of_set, q[4], last_trust if now == least else math.inf, k)
            if len(out) >= k:
                break
        return out

    def _take(self, out: list, now: int, hits: dict, of_set: np.ndarray, of_gold: tuple, last_trust: float,
              k: int) -> None:
        """Adds the pairs of one number of terms by trust of the gold record, until there are k."""
        near, places, start, end = np.zeros((256, len(self.size)), dtype=bool), {}, {}, {}
        for v, (at, units) in hits.items():
            near[v, units] = True
            places[v] = at
            start[v], end[v] = (np.searchsorted(units, np.arange(len(self.size)), side=s) for s in ("left", "right"))
        last = None
        for at in self._by_trust(np.flatnonzero(near.any(axis=0)), of_gold):
            of = of_set[self.set[at]]
            fits = near[of, self.gold_unit[at]]
            for i, v, u in zip(at[fits].tolist(), of[fits].tolist(), self.gold_unit[at[fits]].tolist()):
                trust, gold_id = -float(self.trust[i]), self.id(0, i)
                if len(out) >= k and gold_id != last or trust > last_trust:
                    return
                last = gold_id
                out += [(-now, trust, gold_id, self.id(1, j)) for j in places[v][start[v][u]:end[v][u]][:k].tolist()]

    def _by_trust(self, units: np.ndarray, of_gold: tuple) -> Iterator[np.ndarray]:
        """The passing gold records of some units by trust, in steps."""
        ok, golds, *_ = self.gold_of(of_gold)
        first, end = self.gold_first[units], self.gold_end[units]
        if (end - first).sum() <= 4 * GOLD_STEP:
            at = self.by_unit[_ranges(first, end)]
            yield np.sort(at[ok[at]])
            return
        wanted = np.zeros(len(self.size), dtype=bool)
        wanted[units] = True
        a, step = 0, GOLD_STEP
        while a < len(golds):
            at = golds[a:a + step]
            yield at[wanted[self.gold_unit[at]]]
            a, step = a + step, 2 * step


# --- queries ---------------------------------------------------------------------------

def _answer(asks: pa.Table, terms: pa.Array, files: list[str], folder: str, k: int) -> pa.Table:
    """The first k pairs of each query over some groups, one group in memory at a time."""
    asks = asks.take(pc.sort_indices(asks, [(c, "ascending") for c in (*SILVER_ASKS, *GOLD_ASKS)]))
    lists = asks.column("terms").combine_chunks()
    numbers = pc.index_in(lists.flatten().cast(pa.large_string()), terms).to_numpy(zero_copy_only=False)
    n_terms = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    ends = np.cumsum(n_terms)
    wants = [list(zip(*(asks.column(c).to_pylist() for c in names))) for names in (GOLD_ASKS, SILVER_ASKS)]
    best: list[list] = [[] for _ in range(len(ends))]
    store, path = fs.FileSystem.from_uri(folder)
    for name in files:
        group = _Group(store, f"{path}/{name}")
        of_silver, of_gold = (group.places(numbers, t).tolist() for t in (group.terms, group.gold_terms))
        queries = [(q, tuple(of_silver[a:b]), tuple(of_gold[a:b]), b > a, wants[0][q], wants[1][q],
                    best[q][-1] if len(best[q]) >= k else None) for q, (a, b) in enumerate(zip(ends - n_terms, ends))]
        for q, new in group.answer(queries, k):
            best[q] = sorted(best[q] + new)[:k]
        del group, queries, of_silver, of_gold
        _freed()
    qi = np.repeat(asks.column("qi").to_numpy(), [len(b) for b in best])
    level, trust, gold, silver = zip(*(p for b in best for p in b)) if len(qi) else ((),) * 4
    named = lambda ids: pa.array([v[1:] if v else None for v in ids], pa.string())
    return pa.table([pa.array(qi, pa.int64()), named(gold), named(silver), pa.array([-t for t in trust], pa.float64()),
                     pa.array([-n for n in level], pa.int32())], schema=FOUND)


def _units(records: DataFrame) -> tuple[DataFrame, int, int]:
    """Names of many records, with their parts on both sides, rows of a unit and rows of those before
    them; how many groups these make, and how many all others."""
    parts = lambda side: F.greatest(F.ceil(F.count_if(side) / UNIT_ROWS), F.lit(1)).cast("int")
    names = records.groupBy("name").agg(
        parts(F.col("gold")).alias("of_gold"), parts(~F.col("gold")).alias("of_silver"),
        F.count_if("gold").alias("n"), F.count_if(~F.col("gold")).alias("m"))
    many = names.where((F.col("n") + F.col("m") > GROUP_ROWS // LARGE_SHARE) | (F.col("of_gold") + F.col("of_silver") > 2))
    rows = F.col("rows") * F.col("of_gold") * F.col("of_silver")
    before = F.sum(rows).over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1))
    # few enough for one task: a group holds some of them
    large = cut(many.withColumn("rows", F.ceil(F.col("n") / F.col("of_gold")) + F.ceil(F.col("m") / F.col("of_silver")))
                .withColumn("before", F.coalesce(before, F.lit(0))))
    of_large, taken = large.agg(F.max(F.col("before") + rows), F.sum(F.col("n") + F.col("m"))).collect()[0]
    rest = records.count() - (taken or 0)
    slots = records.sparkSession.sparkContext.defaultParallelism
    return large.drop("n", "m"), math.ceil((of_large or 0) / GROUP_ROWS), max(
        1, math.ceil(rest / GROUP_ROWS), min(slots, math.ceil(rest / FEW_ROWS)))


def _placed(records: DataFrame, large: DataFrame, of_large: int, of_others: int) -> DataFrame:
    """The records with their unit and group. Names of many records are split into parts of both
    sides, each pair of parts being a unit of its own."""
    gold = F.col("gold")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    named = records.withColumn("row", F.monotonically_increasing_id()).join(large, "name", "left") \
        .fillna(1, ["of_gold", "of_silver"])
    # a record is in one part of its own side and meets every part of the other
    own = F.pmod(F.xxhash64("row"), F.when(gold, F.col("of_gold")).otherwise(F.col("of_silver")))
    named = named.withColumn("own", own).withColumn(
        "other", numbers(F.when(gold, F.col("of_silver")).otherwise(F.col("of_gold"))))
    i, j = (F.when(gold, F.col(a)).otherwise(F.col(b)) for a, b in (("own", "other"), ("other", "own")))
    by_size = F.floor((F.col("before") + (i * F.col("of_silver") + j) * F.col("rows")) / F.lit(GROUP_ROWS))
    by_hash = F.lit(of_large) + F.pmod(F.xxhash64("name"), F.lit(of_others))
    return named.withColumn("unit", F.concat_ws("/", i, j, "name")).withColumn(
        "group", F.when(F.col("rows").isNotNull(), by_size).otherwise(by_hash).cast("int")) \
        .drop("name", "row", "own", "other", "of_gold", "of_silver", "rows", "before")


def search_many(gold: DataFrame, silver: DataFrame, specs: DataFrame, k: int) -> DataFrame:
    """qi, rank, gold_id, silver_id, trust_score, relevance_score: the first k pairs of every query.

    gold: name, id, text, trust_score, doctors and its flags; silver: name, id, text, state, city,
    facility_type and dialysis; flags are never null. specs: qi and spec. The texts stay where they
    are: only the numbers of their terms are shuffled, once, and the groups are deleted in the end."""
    spark = gold.sparkSession
    slots, spec = spark.sparkContext.defaultParallelism, F.col("spec")
    asks = cut(specs.select("qi", F.transform(spec.getField("terms"), lambda t: t.getField("term")).alias("terms"),
                            *[spec.getField(c).alias(c) for c in (*GOLD_ASKS, *SILVER_ASKS)]))
    terms, folder = scratch_path(spark, "terms"), scratch_path(spark, "groups")
    asks.select(F.explode("terms").alias("term")).distinct().orderBy("term").write.parquet(terms)

    records = gold.withColumn("gold", F.lit(True)).unionByName(
        silver.withColumn("gold", F.lit(False)), allowMissingColumns=True).where(F.col("name").isNotNull())
    large, *groups = _units(records.select("name", "gold"))
    stored = _placed(held_terms(records, terms), large, *groups).repartition(sum(groups), "group").groupBy("group") \
        .applyInArrow(lambda table: _store_group(table, folder), "file string, best double").collect()
    files = [r.file for r in sorted(stored, key=lambda r: -r.best)]
    release_shuffles(spark)

    count = asks.count()
    blocks = max(1, math.ceil(count / QUERIES_PER_TASK), min(2 * slots, math.ceil(count / FEW_QUERIES)))
    lanes = max(1, min(len(files), math.ceil(2 * slots / blocks)))
    dealt = asks.withColumn("block", F.pmod(F.xxhash64("qi"), F.lit(blocks)).cast("int")).withColumn(
        "lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        return _answer(asked, _read_terms(terms), files[key[1].as_py()::lanes], folder, k)

    found = dealt.repartition(blocks * lanes, "block", "lane").groupBy("block", "lane").applyInArrow(
        answer, "qi long, gold_id string, silver_id string, trust_score double, relevance_score int")
    order = [F.col("relevance_score").desc(), F.col("trust_score").desc(), F.col("gold_id"), F.col("silver_id")]
    first = cut(top_k(found, ["qi"], order, k))
    for path in (terms, folder):
        delete(spark, path)
    release_shuffles(spark)
    return first
