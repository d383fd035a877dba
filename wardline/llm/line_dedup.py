"""Removal of repeated runs of lines, by DataFrame functions only.

All lines of all documents form one sequence (places; a gap between documents), in order of
doc_id. Prefix doubling ranks its suffixes: the class of the first line, then of the first 2,
4, 8 ... lines, each class being a pair of classes of half the length. A class is an interval of
the suffix array whose suffixes share at least that many lines; its rank is its place in sorted
order, its first suffix the earliest copy. Suffixes that are alone in their class leave, so the
tables shrink with every round, and rounds end when nothing is repeated any more.

The way back, from the longest classes to single lines, splits each interval by the longest
prefix its suffixes have in common (`_longest`): it gives every place the length of the longest
run that starts there and also at an earlier place. Runs that no other run of their document
covers to its end are the maximal repeated runs.

Lines of maximal runs of at least min_lines lines go, and so do single repeated lines of at least
min_chars characters; the earliest copy stays.

Defined cases: null texts stay null and have no lines; empty lines are lines; a row whose id and
text both repeat an earlier row is one repeated run, and loses all lines if a run as long is
removed elsewhere; rows with null ids come first; an empty table gives an empty result; other
columns are kept where asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.llm.common import Steps

MIN_LINES = 2
MIN_CHARS = 40


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def _starts(steps: Steps, docs: DataFrame) -> DataFrame:
    """(row_key, id, start): the place of each document's first line, in order of ids."""
    spark = docs.sparkSession
    sizes = docs.filter("text is not null").select(
        _row_key().alias("row_key"), _id().alias("id"), (F.size(_lines()) + 1).alias("lines")) \
        .distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = steps.put("ordered", sizes.repartitionByRange(parts, "id", "row_key").withColumn(
        "part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.sum("lines").alias("lines")).select(
        "part", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("id", "row_key").rowsBetween(
        Window.unboundedPreceding, -1)
    return ordered.withColumn("inner", F.coalesce(F.sum("lines").over(inside), F.lit(0))).join(
        totals, "part").select("row_key", "id", (F.col("base") + F.col("inner")).alias("start"))


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks in the sorted order of the keys: range partitions, numbered in order."""
    return classes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "rank", F.monotonically_increasing_id())


def _longest(steps: Steps, levels: dict[int, DataFrame]) -> DataFrame:
    """(place, length): the longest run of lines that starts at the place and, whole, at an earlier
    place too; places without one are left out.

    A group is a set of places that share `length` lines; its first place, `lead`, is there as the
    earlier copy only, and names the group. From the largest size down, a group is split by the
    classes of the next `size` lines: places of a class that is not alone form a group that is
    longer by size. The first place of each class also stays behind, as it stands for its class
    towards the others. So every place with an earlier copy is in one group at a time, and stands
    in others only as their lead. Places enter at the size at which their class first has an
    earlier copy.
    """
    groups, above = None, None
    for size in sorted(levels, reverse=True):
        level = levels[size]
        fresh = level if above is None else level.join(
            above.filter("first < place").select("place"), "place", "left_anti")
        fresh = fresh.select(F.lit(size).alias("length"), "place", F.col("first").alias("lead"),
                             F.col("n").alias("members"))
        if groups is not None:
            by, columns = ["length", "lead", "next"], fresh.columns
            ahead = level.select(F.col("place").alias("at"), F.col("rank").alias("next"))
            looked = steps.put("looked", groups.withColumn("at", F.col("place") + F.col("length")).join(
                ahead, "at", "left").drop("at"))
            known = looked.filter("next is not null")
            classes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("head"))
            longer = F.when(F.col("n") > 1, F.struct(
                (F.col("length") + size).alias("length"), "place", F.col("head").alias("lead"),
                F.col("n").alias("members")))
            # where a whole group moved on, its lead has nobody left to stand for
            stay = F.when((F.col("head") == F.col("place")) & (F.col("n") < F.col("members")),
                          F.struct(*columns))
            split = known.join(classes, by).select(F.inline(F.array_compact(F.array(longer, stay))))
            fresh = fresh.unionByName(split).unionByName(looked.filter("next is null").select(columns))
        # the next size stores its rows, so that each is split once
        groups, above = fresh, level
    return groups.filter("place > lead").select("place", "length")


def line_dedup(docs: DataFrame, keep: list[str], min_lines: int = MIN_LINES,
               min_chars: int = MIN_CHARS) -> DataFrame:
    """Columns `keep` of docs (without text), text without repeated runs, n_lines, n_removed and
    longest_repeat: the lines of the document's longest run that has an earlier copy (0: none)."""
    steps = Steps(docs.sparkSession)
    starts = _starts(steps, docs)
    lines = docs.filter("text is not null").select(
        _row_key().alias("row_key"), _id().alias("id"), F.posexplode(_lines()).alias("pos", "line")) \
        .select("row_key", "id", "pos", F.xxhash64("line").alias("x"), F.hash("line").alias("y"),
                F.length("line").alias("chars"))
    lines = steps.put("lines", lines)
    steps.put("starts", starts)
    starts = docs.sparkSession.read.parquet(steps.paths["starts"])
    steps.drop("ordered")
    keys = ["x", "y", "chars"]
    placed = lines.join(starts, ["row_key", "id"]).select(
        "row_key", "id", "pos", (F.col("start") + F.col("pos")).alias("place"), *keys)
    # repeated rows (same id and text) stand there once
    placed = steps.put("placed", placed.dropDuplicates(["place"]))
    steps.drop("lines")

    def classes_of(rows, keys):
        return steps.put("classes", _ranked(rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).filter("n > 1"), keys))

    def level(rows, keys, size):
        return steps.put(f"level{size}", rows.join(classes_of(rows, keys), keys).select(
            "row_key", "id", "pos", "place", "chars", "rank", "first", "n"))

    def shifted(rows, by):
        """Rows with the class of the suffix `by` lines on."""
        return rows.withColumnRenamed("rank", "r1").drop("first", "n").join(rows.select(
            (F.col("place") - by).alias("place"), F.col("rank").alias("r2")), "place")

    levels, size = {}, 1
    now = single = level(placed, keys, 1)
    steps.drop("placed")
    while not now.isEmpty():
        levels[size] = now
        now, size = level(shifted(now, size), ["r1", "r2"], 2 * size), 2 * size

    if levels:
        runs = steps.put("runs", _longest(steps, levels).join(
            single.select("row_key", "id", "pos", "place"), "place").select(
            "row_key", "id", "pos", (F.col("pos") + F.col("length")).alias("end")))
        most = runs.groupBy("row_key", "id").agg(F.max(F.col("end") - F.col("pos")).cast("int").alias("longest"))
        # in order of its start, a run that ends later than all before it is maximal
        before = F.max("end").over(Window.partitionBy("row_key", "id").orderBy("pos").rowsBetween(
            Window.unboundedPreceding, -1))
        maximal = runs.filter(F.col("end") - F.col("pos") >= min_lines).withColumn(
            "before", F.coalesce(before, F.lit(0))).filter("end > before")
        gone = maximal.select("row_key", "id", F.greatest("pos", "before").alias("at"), "end")
        if min_chars:
            gone = gone.unionByName(single.filter(f"first < place and chars >= {min_chars}").select(
                "row_key", "id", F.col("pos").alias("at"), (F.col("pos") + 1).alias("end")))
        gone = gone.select("row_key", "id", F.explode(F.sequence("at", F.col("end") - 1)).alias("at")) \
            .groupBy("row_key", "id").agg(F.array_sort(F.collect_set("at")).alias("gone"))
        marks = most.join(gone, ["row_key", "id"], "left")
    else:
        marks = docs.sparkSession.createDataFrame(
            [], "row_key long, id long, longest int, gone array<int>")
    marks = steps.put("marks", marks)
    for k in list(steps.paths):
        if k.startswith("level") or k in ("classes", "looked", "runs"):
            steps.drop(k)

    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    whole = docs.select(*kept, F.col("text").alias("_text"), _row_key().alias("row_key"),
                        _id().alias("id")).join(marks, ["row_key", "id"], "left")
    copy = F.row_number().over(Window.partitionBy("row_key", "id").orderBy("row_key"))
    whole = whole.withColumn("copy", copy).withColumn("all", _lines("_text"))
    n = F.size("all")
    again = (F.col("copy") > 1) & ((n >= min_lines) | (
        (F.length("_text") >= min_chars) if min_chars else F.lit(False)))
    at = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    rest = F.flatten(F.zip_with(
        F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(n)),
        lambda a, b: F.slice(F.col("all"), a + 2, b - a - 1)))
    rest = F.when(again, F.array().cast("array<string>")).otherwise(rest)
    longest_here = F.when(F.col("copy") > 1, n).otherwise(F.coalesce("longest", F.lit(0)))
    is_text = F.col("_text").isNotNull()
    out = whole.withColumn("_rest", F.when(is_text, rest))
    return out.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        F.when(is_text, F.array_join("_rest", "\n")).alias("text"),
        F.when(is_text, n).otherwise(0).cast("long").alias("n_lines"),
        F.when(is_text, n - F.size("_rest")).otherwise(0).cast("long").alias("n_removed"),
        F.when(is_text, longest_here).otherwise(0).cast("long").alias("longest_repeat"))
