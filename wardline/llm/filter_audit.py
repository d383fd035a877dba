"""Audit of how document filters interact, whatever the order they run in.

A filter is a condition of one document, but for the last one: a document also fails when a
smaller doc_id has the same text. That one is an existential self-join: documents whose text
hash occurs under several ids are stored, and a left-semi join on hash, exact text and smaller
doc_id marks them. Its right side is first reduced to the smallest id per text, which decides
the existence, and put once before every GROUP_ROWS rows of the left side, so that a text that a
third of all documents share is met in many tasks. The marked ids are united with the ids that
fail the other filters, one bit per filter; combinations of bits are counted per part. Every
order of the filters follows from these counts alone.

Defined cases: a null text is empty, so that it equals an empty one; a null source is the part
''; a null doc_id is neither smaller nor larger than any other, so that it never fails by the
last filter and makes no other fail; rows that repeat a doc_id and its text do not fail by each
other; a document's label is 1 where any of its label rows says so, and a null doc_id has none;
an empty table gives no part; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import Steps

#: A-E in this order; E is the copy test.
LETTERS = "ABCDE"
#: Rows of one text that meet its smallest id in one place; a larger group is split by a salt.
GROUP_ROWS = 256
_SPACES = "[\\x20\\x09-\\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """The filters that look at one document: true where it fails."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def copies(rows: DataFrame, narrow: DataFrame, steps: Steps) -> DataFrame:
    """(doc_id, part, h) of the rows (doc_id, part, h, text) whose text a smaller doc_id has.
    `narrow` holds doc_id and h of the same rows."""
    repeats = steps.put("repeats", narrow.groupBy("h").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("salts"))
        .filter("first < last").select("h", "salts"))
    same = steps.put("same", rows.join(repeats, "h").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), "salts").cast("int")))
    least = same.groupBy("h", "text").agg(
        F.min("doc_id").alias("first"), F.max("salts").alias("salts")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    a, b = same.alias("a"), least.alias("b")
    return a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.salt") == F.col("b.salt"))
                  & (F.col("a.text") == F.col("b.text"))
                  & (F.col("b.first") < F.col("a.doc_id")), "left_semi") \
        .select("doc_id", "part", "h")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: the filter LETTERS[i] fails), n, good, toxic: documents per part and
    combination of failing filters; mask 0 are the documents that pass all."""
    steps = Steps(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("h", F.xxhash64("text"))
    mask = sum((F.when(c, 1 << LETTERS.index(f)).otherwise(0)
                for f, c in conditions(F.col("text")).items()), F.lit(0))
    narrow = steps.put("audited", rows.select("doc_id", "part", "h", mask.alias("mask")))
    marked = copies(rows, narrow, steps)
    one = F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    failing = narrow.filter("mask > 0").select("doc_id", "part", "h", "mask", one.alias("n"), none.alias("m")) \
        .unionByName(marked.select("doc_id", "part", "h", F.lit(1 << 4).alias("mask"),
                                   none.alias("n"), one.alias("m")))
    # rows that repeat id, part and text fail alike, so either side counts all of them
    failing = failing.groupBy("doc_id", "part", "h").agg(
        F.bit_or("mask").alias("mask"), F.greatest(F.sum("n"), F.sum("m")).alias("n"))
    labelled = labels.groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    sides = F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))
    counted = failing.join(labelled, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * sides[0]).alias("good"),
        F.sum(F.col("n") * sides[1]).alias("toxic"))
    counted = steps.put("counted", counted)
    whole = narrow.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    lost = counted.groupBy("part").agg(F.sum("n").alias("lost"))
    passing = whole.join(lost, "part", "left").select(
        "part", F.lit(0).alias("mask"), (F.col("n") - F.coalesce("lost", none)).alias("n"),
        none.alias("good"), none.alias("toxic"))
    return counted.unionByName(passing)


def _orders() -> list[dict]:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    out = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for step, at in enumerate(order, 1):
            out.append({"o": "".join(LETTERS[i] for i in order), "s": step, "b": 1 << at, "p": before})
            before |= 1 << at
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley: one row per part, order of the five filters and step."""
    size = 1 << len(LETTERS)
    per_part = combinations(docs, labels).groupBy("part").agg(F.map_from_entries(F.collect_list(
        F.struct("mask", F.struct("n", "good", "toxic").alias("c")))).alias("by"))
    # one count per combination, zeros included, in the order of the masks
    for name in ("n", "good", "toxic"):
        per_part = per_part.withColumn(name, F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)),
            lambda m: F.coalesce(F.try_element_at("by", m).getField(name), F.lit(0).cast("long"))))
    steps = F.from_json(F.lit(json.dumps(_orders())),
                        "array<struct<o: string, s: int, b: int, p: int>>")
    rows = per_part.withColumn("at", F.explode(steps))
    bit, before = F.col("at.b"), F.col("at.p")

    def total(name: str, keep) -> Column:
        """Sum of the counts of the masks that `keep` takes."""
        return F.aggregate(
            F.transform(F.col(name), lambda c, m: F.when(keep(m), c).otherwise(0)),
            F.lit(0).cast("long"), lambda a, c: a + c)

    has = lambda m, b: m.bitwiseAND(b) != 0
    now = lambda m: has(m, bit) & ~has(m, before)
    orders = factorial(len(LETTERS))
    # a document that fails k filters is removed by each of them in one k-th of all orders
    shapley = F.aggregate(
        F.transform(F.col("n"), lambda c, m: F.when(has(m, bit), c * F.element_at(
            F.array(*[F.lit(orders // k).cast("long") for k in range(1, len(LETTERS) + 1)]),
            F.bit_count(m))).otherwise(0)),
        F.lit(0).cast("long"), lambda a, c: a + c)
    return rows.select(
        "part", F.col("at.o").alias("filter_order"), F.col("at.s").alias("step"),
        total("n", lambda m: ~has(m, bit.bitwiseOR(before))).alias("kept"),
        total("n", now).alias("removed"),
        total("n", lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", now).alias("good_lost"), total("toxic", now).alias("toxic_lost"),
        shapley.alias("shapley"))
