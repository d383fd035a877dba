"""Records of CSV files whose quoted texts hold line breaks, read by many tasks per file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardline.sources.layers import cut

SPLIT = ["_file", "_start"]
# Kinds of rows: a whole record; the end of one that an earlier split began; the beginning of
# one that a later split ends; the number of records that begin in a split.
RECORD, HEAD, TAIL, COUNT = 0, 1, 2, 3
FOUND = "_file string, _start bigint, _at bigint, _kind int, _text string"
# Characters that a task holds before it hands rows on.
CHUNK = 4_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines by file split, in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), "value")


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _open_splits(lines: DataFrame) -> DataFrame:
    """Splits that begin inside a quoted text: those with an odd number of quotes before them."""
    odd = lines.groupBy(*SPLIT).agg((F.sum(_quotes(F.col("value"))) % 2).alias("_odd"))
    # one row per file split, not per line
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(
        Window.unboundedPreceding, -1)
    return odd.withColumn("_open", F.sum("_odd").over(before) % 2 == 1).where("_open").drop("_odd")


def _split_records(whole: bool):
    """Joins the lines of a split to records. With `whole` the records come out, else what is
    left over at both ends of the split and the number of records that begin in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, here, lines, at, inside, head = [], 0, None, [], 0, False, False

        def ended() -> list[tuple]:
            if here is None or whole:
                return []
            rest = [(*here, at, HEAD if head else TAIL, "\n".join(lines))] if lines else []
            return [*rest, (*here, at + bool(lines and not head), COUNT, None)]

        for batch in batches:
            for file, start, opened, value in zip(
                    batch["_file"], batch["_start"], batch["_open"], batch["value"]):
                if (file, start) != here:
                    out += ended()
                    here, lines, at, inside, head = (file, start), [], 0, opened, opened
                lines.append(value)
                inside ^= value.count('"') % 2 == 1
                if inside:
                    continue
                text = "\n".join(lines).removesuffix("\r")
                lines = []
                if head:
                    head = False
                    if not whole:
                        out.append((*here, at, HEAD, text))
                elif text:
                    if whole:
                        out.append((*here, at, RECORD, text))
                        size += len(text)
                    at += 1
                if size > CHUNK:
                    yield _frame(out)
                    out, size = [], 0
        yield _frame(out + ended())

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["_file", "_start", "_at", "_kind", "_text"])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """_index, _text: the records after each file's header, numbered in file order.

    A line break ends a record where the number of quotes before it is even, so a prefix sum of
    quote parity over the splits tells every task whether its split begins inside a quoted text.
    Three scans of the lines and no shuffle of them: parity, then leftovers and counts, then the
    records. A record that crosses splits is put together from leftovers, two for each split at
    most, and belongs to the split where it begins. Blank lines are no records. Quotes must be
    balanced (doubled inside quoted values); a file that ends inside quotes gives its rest as the last record.
    """
    lines = _lines(spark, path)
    # at most one short row per file split (128 MB by default), so 100 TB give under a million
    opened = F.broadcast(cut(_open_splits(lines)))
    # a broadcast keeps the order of the lines
    lines = lines.join(opened, SPLIT, "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
    rest = cut(lines.mapInPandas(_split_records(False), FOUND))
    in_order = Window.partitionBy("_file").orderBy("_start", "_kind")
    parts = rest.where(F.col("_kind") != COUNT).select(*SPLIT, "_kind")
    parts = parts.withColumn("_n", F.sum((F.col("_kind") == TAIL).cast("int")).over(in_order))
    crossing = rest.join(parts, [*SPLIT, "_kind"]).groupBy("_file", "_n").agg(
        F.min("_start").alias("_start"), F.min(F.when(F.col("_kind") == TAIL, F.col("_at"))).alias("_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_kind", "_text"))),
                                 lambda part: part.getField("_text")), "\n").alias("_text"))
    columns = [*SPLIT, "_at", "_text"]
    records = lines.mapInPandas(_split_records(True), FOUND).select(*columns) \
        .unionByName(crossing.select(*columns))
    counts = rest.where((F.col("_kind") == COUNT) & (F.col("_at") > 0)).select(*SPLIT, "_at")
    headed = F.col("_start") == F.min("_start").over(Window.partitionBy("_file"))
    # one row per file split, as above
    before = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_header", headed.cast("bigint"))
    offsets = cut(counts.select(*SPLIT, "_header", F.coalesce(
        F.sum(F.col("_at") - F.col("_header")).over(before), F.lit(0)).alias("_offset")))
    return records.join(offsets, SPLIT).where(F.col("_at") >= F.col("_header")).select(
        (F.col("_offset") + F.col("_at") - F.col("_header")).alias("_index"), "_text")
