"""Pages to WARC archives and back, by an index of record places.

Writing: every task writes its rows as records into files of its own in the shared folder, each
record a gzip member, and returns one index row per record: file, offset, length, URL and
payload digest. The index is stored as a table; a file that a lost or repeated task left behind
is in no index row and so is never read. Of records with equal payloads (found by SHA-256 over
all rows) that with the largest page_id is a response, the others are revisits that name it and
carry no payload.

Reading: index rows, all or any selection of them, are dealt by file and block of the file,
sorted by offset, and neighbouring byte ranges are joined into few reads. Every record is
parsed from its bytes and a payload is held against its digest.

Defined cases: a null html is an empty payload; a null url leaves the field out and comes back
as null; control characters and spaces in a url are percent-encoded in its field; a null
page_id is smaller than any other; rows that share the largest page_id of their payload are
responses each; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import Steps
from wardline.sources import layers

#: A file is closed once it holds this many bytes.
FILE_BYTES = 1 << 30
#: Index rows whose records start in the same block of a file are read by one task.
BLOCK_BYTES = 64 << 20
#: Ranges with at most so many bytes between them are one read of at most READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Payload bytes that one batch of read records holds, about.
BATCH_BYTES = 32 << 20
#: Pages have no date, and equal input gives equal records.
DATE = "1970-01-01T00:00:00Z"
GZIP_LEVEL = 4

_VERSION, _END = b"WARC/1.1\r\n", b"\r\n\r\n"
_RECORD = "urn:wardline:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

INDEX = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
         "payload_bytes long, file string, offset long, length long")
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
           "payload_bytes long, payload string")


def digest(payload) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())


def record(page_id, url, payload, sha1: str, response: bool, refers_to) -> bytes:
    """One record: header fields, then the HTTP message (a revisit has its header only)."""
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    name = "" if page_id is None else page_id
    fields = [b"WARC-Type: " + (b"response" if response else b"revisit"),
              f"WARC-Record-ID: <{_RECORD}{name}>".encode(), f"WARC-Date: {DATE}".encode(),
              b"Content-Type: application/http; msgtype=response",
              f"WARC-Payload-Digest: sha1:{sha1}".encode(),
              b"WARC-Payload-Length: %d" % len(payload)]
    if url is not None:
        fields.append(b"WARC-Target-URI: " + _field(url))
    if not response:
        fields += [f"WARC-Refers-To: <{_RECORD}{refers_to}>".encode(),
                   f"WARC-Profile: {_PROFILE}".encode()]
    body = http + bytes(payload) if response else http
    fields.append(b"Content-Length: %d" % len(body))
    return _VERSION + b"\r\n".join(fields) + _END + body + _END


def parse(raw: bytes) -> dict:
    """A record's fields by lower-case name, and `payload`: bytes, or None for a revisit.
    Raises ValueError where the bytes are no whole record or break its digest."""
    head, _, rest = raw.partition(_END)
    if not head.startswith(_VERSION):
        raise ValueError("no WARC record")
    out = {k.decode().lower(): v.decode() for k, v in
           (line.split(b": ", 1) for line in head[len(_VERSION):].split(b"\r\n"))}
    size = int(out["content-length"])
    if rest[size:] != _END:
        raise ValueError("a WARC record of another length")
    out["payload"] = None
    if out["warc-type"] == "response":
        out["payload"] = rest[rest.index(_END) + len(_END):size]
        if f"sha1:{digest(out['payload'])}" != out["warc-payload-digest"]:
            raise ValueError("a payload that breaks its digest")
    return out


def _number(name: str | None):
    found = re.search(r"(-?\d+)>$", name or "")
    return int(found[1]) if found else None


class _File:
    """An archive under construction: warcinfo first, then records, each a gzip member."""

    def __init__(self, store, folder: str):
        self.name, self.offset = f"{uuid.uuid4().hex}.warc.gz", 0
        self.out = store.open_output_stream(f"{folder}/{self.name}", compression=None)
        body = b"software: wardline\r\nformat: WARC File Format 1.1\r\n"
        self.add(_VERSION + b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s"
                 b"\r\nContent-Type: application/warc-fields\r\nContent-Length: %d" % (
                     str(uuid.uuid4()).encode(), DATE.encode(), len(body)) + _END + body + _END)

    def add(self, raw: bytes) -> tuple[int, int]:
        packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        at = self.offset
        self.out.write(member)
        self.offset += len(member)
        return at, len(member)


def _writer(folder: str, file_bytes: int):
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        file = None
        for batch in batches:
            rows = []
            for page_id, url, html, top in zip(*(batch.column(c) for c in range(4))):
                page_id, url, top = page_id.as_py(), url.as_py(), top.as_py()
                payload = memoryview(html.as_buffer() or b"") if html.is_valid else b""
                sha1 = digest(payload)
                response = top is None or page_id == top
                if file is None:
                    file = _File(store, path)
                at, length = file.add(record(page_id, url, payload, sha1, response, top))
                rows.append((page_id, url, "response" if response else "revisit",
                             None if response else top, sha1, len(payload), file.name, at, length))
                if file.offset >= file_bytes:
                    file.out.close()
                    file = None
            yield _batch(rows, INDEX)
        if file is not None:
            file.out.close()
    return run


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [pa.field(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)],
                                      schema=pa.schema(fields))


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all pages (page_id, url, html) as records under folder; the stored index."""
    spark = pages.sparkSession
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    steps = Steps(spark)
    rows = pages.select("page_id", "url", "html", F.sha2(
        F.coalesce("html", F.lit("")).cast("binary"), 256).alias("same"))
    # only payloads that occur again need to know the largest page_id
    repeats = steps.put("repeats", rows.groupBy("same").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).filter("n > 1").drop("n"))
    index = rows.join(repeats, "same", "left").select("page_id", "url", "html", "top") \
        .mapInArrow(_writer(folder, file_bytes), INDEX)
    index.write.parquet(f"{folder}/index")
    steps.drop("repeats")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of an archive folder: one row per record."""
    return spark.read.parquet(f"{folder}/index")


def with_payload_places(selected: DataFrame, index: DataFrame) -> DataFrame:
    """The selected index rows, a revisit's place being that of the response it refers to."""
    owner = index.filter("record_type = 'response'").groupBy("page_id", "payload_digest").agg(
        F.min(F.struct("file", "offset", "length")).alias("at"))
    kept = selected.filter("record_type = 'response'")
    moved = selected.filter("record_type = 'revisit'").alias("s").join(
        owner.alias("o"), (F.col("s.refers_to") == F.col("o.page_id"))
        & (F.col("s.payload_digest") == F.col("o.payload_digest"))).select(
        *[F.col(f"s.{c}") for c in index.columns if c not in ("file", "offset", "length")], "o.at.*")
    return kept.unionByName(moved)


def ranges(places: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list:
    """Sorted (offset, length) places as reads: (first place, places, offset, length). A read
    joins places with at most `gap` bytes between them and stays within `most` bytes, unless
    one record is longer."""
    out = []
    for i, (at, length) in enumerate(places):
        if out:
            first, n, start, size = out[-1]
            end = max(start + size, at + length)
            if at - (start + size) <= gap and end - start <= most:
                out[-1] = (first, n + 1, start, end - start)
                continue
        out.append((i, 1, at, length))
    return out


def _reader(folder: str, payloads: bool):
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            files = batch.column(0).to_pylist()
            places = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            rows, held, i = [], 0, 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                with store.open_input_file(f"{path}/{files[i]}") as file:
                    for first, n, start, size in ranges(places[i:j]):
                        data = file.read_at(size, start)
                        for at, length in places[i + first:i + first + n]:
                            r = parse(zlib.decompress(data[at - start:at - start + length], 31))
                            body = r["payload"]
                            rows.append((
                                _number(r["warc-record-id"]), r.get("warc-target-uri"),
                                r["warc-type"], _number(r.get("warc-refers-to")),
                                digest(body) if body is not None
                                else r["warc-payload-digest"].removeprefix("sha1:"),
                                len(body) if body is not None else int(r["warc-payload-length"]),
                                body.decode(errors="replace") if payloads and body is not None else None))
                            held += len(body or b"") if payloads else 0
                            if held >= BATCH_BYTES:
                                yield _batch(rows, RECORDS)
                                rows, held = [], 0
                i = j
            yield _batch(rows, RECORDS)
    return run


def read(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, read back from the archives under folder:
    payload is null for revisits, and for all rows where payloads are not asked for."""
    spark = selected.sparkSession
    places = selected.select("file", "offset", "length").withColumn(
        "block", F.floor(F.col("offset") / BLOCK_BYTES))
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    return places.repartition(tasks, "file", "block").sortWithinPartitions("file", "offset") \
        .select("file", "offset", "length").mapInArrow(_reader(folder, payloads), RECORDS)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads all records back: page_id, payload_bytes, payload_digest (both of
    the full payload), record_type and refers_to (of a revisit: the response's page_id)."""
    folder = layers.scratch_path(pages.sparkSession, "warc")
    index = write(pages, folder)
    return read(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
