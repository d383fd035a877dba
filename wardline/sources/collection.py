"""A Spark sink that writes features as the parts of one GeoJSON object."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

HEADER, SEPARATOR, FOOTER = '{"type":"FeatureCollection","features":[', ",", "]}"
LAST = 10 ** 9


@dataclass
class Part(WriterCommitMessage):
    """A task's file; no name where the task had no rows."""

    at: int
    name: str | None


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path as Spark writes it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _named(at: int, kind: int, tag: str) -> str:
    return f"part-{at:010d}-{kind}-{tag}.json"


class FeatureCollection(DataSource):
    """Texts of one column, one per line, with a line for header, each separator and footer.
    The parts joined in the order of their names are one object, however many there are."""

    @classmethod
    def name(cls) -> str:
        return "wardline_feature_collection"

    def schema(self) -> str:
        return "feature string"

    def writer(self, schema: StructType, overwrite: bool) -> FeatureCollectionWriter:
        return FeatureCollectionWriter(self.options["path"])


class FeatureCollectionWriter(DataSourceArrowWriter):
    """Tasks write features and the separators between them; the commit adds header, footer and
    the separators between tasks, and deletes files that no finished task reported."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        at = TaskContext.get().partitionId() + 1
        files, folder = located(self.path)
        files.create_dir(folder, recursive=True)
        name, out = _named(at, 0, uuid.uuid4().hex), None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                text = f"\n{SEPARATOR}\n".join(batch.column(0).to_pylist()) + "\n"
                if out is None:
                    out = files.open_output_stream(f"{folder}/{name}")
                else:
                    text = f"{SEPARATOR}\n" + text
                out.write(text.encode())
        finally:
            if out is not None:
                out.close()
        return Part(at, name if out is not None else None)

    def commit(self, messages: list[Part]) -> None:
        files, folder = located(self.path)
        files.create_dir(folder, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.at)
        texts = {_named(0, 0, "header"): HEADER, _named(LAST, 0, "footer"): FOOTER}
        texts |= {_named(m.at, 1, "separator"): SEPARATOR for m in parts[:-1]}
        kept = {m.name for m in parts} | set(texts)
        for found in files.get_file_info(fs.FileSelector(folder)):
            if found.base_name.startswith("part-") and found.base_name not in kept:
                files.delete_file(found.path)
        for name, text in texts.items():
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(f"{text}\n".encode())

    def abort(self, messages: list[Part | None]) -> None:
        files, folder = located(self.path)
        for message in messages:
            if message is not None and message.name:
                files.delete_file(f"{folder}/{message.name}")
