"""Which needles occur in which texts: as an equi-join on short grams, or by an automaton."""

from __future__ import annotations

import sys

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from wardline.sources.layers import cut

GRAM = 3
SALTS = 8
# Needles in one automaton, and short texts that one task scans with it.
NEEDLES_PER_SCAN, TEXTS_PER_SCAN = 50_000, 500_000

# tasks get the scanning function itself, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def contains_join(texts: DataFrame, text_id: str, text: str,
                  needles: DataFrame, needle: str) -> DataFrame:
    """(text_id, needle) for every needle contained in the text; exact.

    A text holding a needle holds the needle's first gram, so texts meet needles on
    that gram and are then verified. Common grams are spread by a salt on the text id.
    The text itself is carried only by rows whose gram some needle starts with.
    """
    keyed = (
        needles.select(F.col(needle)).where(F.length(needle) > 0).distinct()
        .withColumn("_gram", F.substring(needle, 1, GRAM))
    )
    starts = keyed.select("_gram").distinct()
    grams = F.expr("explode(array_distinct(flatten(array(" + ", ".join(
        f"transform(sequence(1, greatest(length({text}) - {n - 1}, 1)), "
        f"i -> substring({text}, i, {n}))" for n in range(1, GRAM + 1)) + "))))")
    pieces = (
        texts.select(text_id, grams.alias("_gram")).join(starts, "_gram", "left_semi")
        .withColumn("_salt", F.pmod(F.xxhash64(text_id), F.lit(SALTS)))
    )
    spread = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    candidates = pieces.join(spread.withColumn("_salt", F.col("_salt").cast("bigint")),
                             ["_gram", "_salt"]).select(text_id, needle)
    return (
        candidates.join(texts.select(text_id, text), text_id)
        .where(F.col(text).contains(F.col(needle)))
        .select(text_id, needle)
    )


def _scan(_, texts: pa.Table, needles: pa.Table) -> pa.Table:
    out: set = set()
    if texts.num_rows and needles.num_rows:
        trie = ahocorasick.Automaton()
        for needle in needles.column("needle").to_pylist():
            trie.add_word(needle, needle)
        trie.make_automaton()
        for text in texts.column("text").to_pylist():
            out.update((text, needle) for _, needle in trie.iter(text))
    columns = list(zip(*out)) or [[], []]
    return pa.table([pa.array(c, pa.string()) for c in columns], names=["text", "needle"])


def contains_scan(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Distinct (text, needle) for every needle contained in a short text, each column under its
    own name: blocks of texts meet blocks of needles, each text is scanned once by an automaton.
    Null and empty needles are in no text."""
    needles = cut(needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct())
    parts = max(1, -(-needles.count() // NEEDLES_PER_SCAN))
    left = texts.select(F.col(text).alias("text")).where("text is not null")
    blocks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // TEXTS_PER_SCAN))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")) \
        .withColumn("part", spread(parts))
    right = needles.withColumn("part", F.pmod(F.xxhash64("needle"), F.lit(parts)).cast("int")) \
        .withColumn("block", spread(blocks))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        _scan, "text string, needle string")
    return found.distinct().select(F.col("text").alias(text), F.col("needle").alias(needle))
