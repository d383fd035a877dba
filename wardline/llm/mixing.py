"""Mixing sources to target weights by capped water-filling, by DataFrame functions only.

The budget is shared by weight; a source whose share is above max_epochs times its size is
held there and the excess goes to the others by weight until no share is above. With sources
sorted by size per weight this is one running sum: the first k sources are held for the
smallest k for which the next one is not above. A source then repeats all its documents
floor(target / size) times and takes the rest once more: documents in seeded hash order until
the fraction's words are reached. The place of the cut is found by summing hash buckets twice
(1,024 and 1,024 x 1,024), so only the documents of one small bucket per source are ordered.

Defined cases: null texts have size 0; a null source is a source, last in order; a source
without words has target 0 and takes nothing; repeated rows are separate documents; an empty
table gives an empty result; other columns are kept where asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardline.llm.common import Steps

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text="text"):
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)),
                         ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    one = sizes.withColumn("weight", cycle.cast("double")).withColumn(
        "ceiling", (F.col("source_size") * max_epochs).cast("double"))
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    sort = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = sort.rowsBetween(Window.unboundedPreceding, -1)
    after = sort.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) \
        / F.sum("weight").over(after)
    one = one.withColumn("budget", budget).withColumn("level", level) \
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("ceiling")) \
        .withColumn("line", F.min(F.when(F.col("open"), F.struct(
            F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(
                Window.partitionBy()).getField("level"))
    target = F.least(F.coalesce(F.col("line") * F.col("weight"), F.col("ceiling")), F.col("ceiling"))
    return one.select("source", "source_size", target.alias("target"))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left with the row of its source, null being a source too."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")


def mix(docs: DataFrame, keep: list[str], weights=WEIGHTS, share: float = SHARE,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Columns `keep` of docs, size, source_size, target, copies and taken (size x copies)."""
    steps = Steps(docs.sparkSession)
    draw = F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.col("text").cast("binary")))
    inner = [c for c in keep if c not in ("doc_id", "source")]
    rows = steps.put("mixed", docs.select(
        "doc_id", "source", *inner, n_words().alias("_size"), draw.alias("_draw"),
        F.pmod(F.shiftrightunsigned(draw, 44), F.lit(1024)).alias("_one"),
        F.pmod(F.shiftrightunsigned(draw, 34), F.lit(1024)).alias("_two")))
    # sums per bucket; hot sources are added up in the tasks first
    fine = rows.groupBy("source", "_one", "_two").agg(F.sum("_size").alias("words"))
    fine = steps.put("fine", fine)
    coarse = fine.groupBy("source", "_one").agg(F.sum("words").alias("words"))
    aims = targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")),
                   weights, share, max_epochs)
    epochs = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(epochs + 1e-12)).otherwise(0)
    aims = steps.put("aims", aims.withColumn("whole", whole.cast("int")).withColumn(
        "part", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))))

    def cut(sums, by, *within):
        """The bucket that holds the cut of each source, and the words before it."""
        w = Window.partitionBy("source", *within).orderBy(by)
        run = sums.withColumn("upto", F.sum("words").over(w))
        return run.filter(F.col("upto") >= F.col("part")).groupBy("source").agg(
            F.min(F.struct(F.col(by).alias("at"), (F.col("upto") - F.col("words")).alias("words"),
                           "part")).alias("c")).select(
            F.col("source"), F.col("c.at").alias(by + "_cut"), F.col("c.words").alias("before"),
            F.col("c.part").alias("part"))

    first = cut(_by_source(coarse, aims).filter("part > 0"), "_one")
    at = _by_source(fine, first).filter("_one = _one_cut").select(
        "source", "_one_cut", "_two", "words", (F.col("part") - F.col("before")).alias("part"))
    w = Window.partitionBy("source").orderBy("_two")
    second = at.withColumn("upto", F.sum("words").over(w)).filter("upto >= part").groupBy(
        "source").agg(F.min(F.struct("_two", "_one_cut", (F.col("part") - F.col("upto") + F.col(
            "words")).alias("left"))).alias("c")).select(
        "source", F.col("c._one_cut").alias("_one_cut"), F.col("c._two").alias("_two_cut"),
        F.col("c.left").alias("left"))
    plan = steps.put("plan", _by_source(aims, second, "left").select(
        "source", "source_size", "target", "whole", "_one_cut", "_two_cut", "left"))
    joined = _by_source(rows, plan, "left")
    edge = (F.col("_one") == F.col("_one_cut")) & (F.col("_two") == F.col("_two_cut"))
    order = Window.partitionBy("source", "_one", "_two").orderBy("_draw", "doc_id")
    extra_edge = joined.filter(edge).withColumn("_upto", F.sum("_size").over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    # the document over the cut is taken where that comes nearer to the target
    near = (F.col("_upto") - F.col("_size") / 2 <= F.col("left"))
    settled = joined.filter(F.coalesce(~edge, F.lit(True)))
    under = F.coalesce((F.col("_one") < F.col("_one_cut")) | (
        (F.col("_one") == F.col("_one_cut")) & (F.col("_two") < F.col("_two_cut"))), F.lit(False))
    out = [*keep, F.col("_size").alias("size"), "source_size", "target"]
    copies = F.col("whole") + F.col("extra").cast("int")
    both = settled.withColumn("extra", under).select(*out, copies.alias("copies")).unionByName(
        extra_edge.withColumn("extra", near).select(*out, copies.alias("copies")))
    return both.withColumn("taken", F.col("size") * F.col("copies"))


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say (none: not at all)."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(
        F.lit(1), F.col("copies")))).drop("_copy")
