"""Filtered keyword search by an inverted index: any number of queries in one plan, ranked and
cut to top-k.

Names are dealt into blocks by the best trust of their records, so a block holds whole names of
about equal trust. The index lists, per token of the texts and per filter value, the blocks that
hold it. A search finds the tokens that hold a term, then for each query and block an upper
bound: the terms that occur in the block at all and its best trust. Blocks are opened best bound
first, and the records of opened blocks are looked at; blocks that cannot enter the top k any
more are never opened.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardline.functions import columns as X
from wardline.operators import intents
from wardline.operators.many import search_many
from wardline.operators.pairs import top_k
from wardline.operators.substring import contains_scan
from wardline.sources.layers import cut, scratch_path

KEPT_PER_QUERY = 100
# Records that one block holds, about; a name that many records share is a block of its own.
BLOCK_ROWS = 1024
# Records that one task indexes, about, on a table of any size.
TASK_ROWS = 8192
# Blocks a query opens first, and next; then all that could still hold an answer.
FIRST_BLOCKS, NEXT_BLOCKS = 32, 512
# More queries than this do not open blocks each: every text is scanned once for all of them.
MANY_QUERIES = 100
# Query terms have that many letters at least, so shorter tokens are not listed.
SHORTEST = 3
# Filters whose text may be any part of the value.
NAMED = ("state", "city")
# Bits of a mask: up to eight terms, then the filters a block can be skipped by.
TERM_BITS = 0xFF
FILTER_BITS = {"state": 1 << 8, "city": 1 << 9, "facility_type": 1 << 10, "icu": 1 << 11,
               "emergency": 1 << 12, "open_24_7": 1 << 13, "dialysis": 1 << 14,
               "contradictions": 1 << 15}

SPEC = """struct<query_id: bigint, state: string, city: string, facility_type: string,
 min_trust: double, icu: boolean, emergency: boolean, open_24_7: boolean, dialysis: boolean,
 contradictions: boolean, min_doctors: double, terms: array<struct<term: string, bit: int>>,
 any_terms: boolean>"""

SILVER_COLUMNS = ["facility_id", "name", "address_state", "address_city", "address_zip",
                  "facility_type", "latitude", "longitude", "specialties", "description",
                  "searchable_text"]
# Carried where the layer has them.
RECORD_COLUMNS = ["phone", "website", "email", "address_line", "operator_type", "year_established"]


def silver_view(gold: DataFrame) -> DataFrame:
    """The cleaned-record columns search reads, taken from the same stored layer."""
    return gold.select(*SILVER_COLUMNS, *[c for c in RECORD_COLUMNS if c in gold.columns])


# --- single predicates -----------------------------------------------------------------

def filter_state(state: str) -> Column:
    return F.col("address_state").contains(state)


def filter_city(city: str) -> Column:
    return F.col("address_city").contains(city)


def filter_type(kind: str) -> Column:
    return F.col("facility_type") == kind


def filter_min_trust(trust: float | None) -> Column:
    known = F.col("trust_score").isNotNull()
    return known & (F.col("trust_score") >= trust) if trust else known


def filter_flag(claim: str) -> Column:
    return F.coalesce(F.col(claim), F.lit(False))


def filter_dialysis() -> Column:
    return F.exists("specialties", lambda s: s.contains("nephrology") | s.contains("dialysis"))


def filter_contradictions() -> Column:
    return F.size("contradictions") > 0


def filter_min_doctors(n: int) -> Column:
    return F.coalesce(F.col("number_doctors"), F.col("inferred_doctors").cast("double")) > n


def relevance_score(terms: Column) -> Column:
    """Number of terms found in the text, the capabilities or the specialties."""
    hay = F.concat_ws("\n", "searchable_text", F.array_join("capabilities", "\n"),
                      F.array_join("specialties", "\n"))
    return F.size(F.filter(terms, lambda t: F.contains(hay, t)))


# --- batch search ----------------------------------------------------------------------

def search_specs(queries: DataFrame, use_24_7: bool = False) -> DataFrame:
    """One filter record per query row (columns of the parsed-query table)."""
    have = set(queries.columns)
    get = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    flag = lambda c: F.coalesce(get(c, "boolean"), F.lit(False))
    terms = intents.query_terms(get("search_text", "string"), get("specialties", "array<string>"))
    bits = F.transform(terms, lambda t, i: F.struct(
        t.alias("term"), F.pow(F.lit(2), i).cast("int").alias("bit")))
    return queries.select(F.struct(
        F.col("query_id").cast("bigint").alias("query_id"),
        get("state", "string").alias("state"),
        get("city", "string").alias("city"),
        get("facility_type", "string").alias("facility_type"),
        F.when(get("min_trust_score", "double") > 0, get("min_trust_score", "double"))
        .cast("double").alias("min_trust"),
        flag("requires_icu").alias("icu"),
        flag("requires_emergency").alias("emergency"),
        (flag("requires_24_7") if use_24_7 else F.lit(False)).alias("open_24_7"),
        flag("requires_dialysis").alias("dialysis"),
        intents.wants_contradictions(get("requires_contradictions", "boolean"),
                                     get("query", "string"), get("search_text", "string"))
        .alias("contradictions"),
        get("min_doctors", "double").cast("double").alias("min_doctors"),
        bits.alias("terms"),
        (F.size(terms) > 0).alias("any_terms"),
    ).alias("spec"))


def _silver_ok(q: Column) -> Column:
    def given(field, test):
        return q.getField(field).isNull() | F.coalesce(test, F.lit(False))
    return (
        given("state", F.contains(F.col("address_state"), q.getField("state")))
        & given("city", F.contains(F.col("address_city"), q.getField("city")))
        & given("facility_type", F.col("facility_type") == q.getField("facility_type"))
        & (~q.getField("dialysis") | F.coalesce(filter_dialysis(), F.lit(False)))
    )


def _gold_ok(q: Column) -> Column:
    def flagged(field, claim):
        return ~q.getField(field) | filter_flag(claim)
    return (
        (q.getField("min_trust").isNull() | (F.col("trust_score") >= q.getField("min_trust")))
        & flagged("icu", "has_icu") & flagged("emergency", "has_emergency")
        & flagged("open_24_7", "has_24_7")
        & (~q.getField("contradictions") | filter_contradictions())
        & (q.getField("min_doctors").isNull() | F.coalesce(
            F.coalesce(F.col("number_doctors"), F.col("inferred_doctors").cast("double"))
            > q.getField("min_doctors"), F.lit(False)))
    )


class SearchIndex(NamedTuple):
    """names: name, block and records; postings: kind, token, block; tokens: the distinct kinds and
    tokens; blocks: block and its best trust."""

    names: DataFrame
    postings: DataFrame
    tokens: DataFrame
    blocks: DataFrame


def _blocks(g: DataFrame, s: DataFrame) -> DataFrame:
    """name, block, best, n, parts: names on both sides, by whole points of their best trust and
    then by hash. A name of many records is indexed in parts."""
    names = g.groupBy("name").agg(F.max("trust_score").alias("best"), F.count(F.lit(1)).alias("n")) \
        .join(s.groupBy("name").agg(F.count(F.lit(1)).alias("m")), "name") \
        .select("name", "best", F.floor("best").alias("level"), (F.col("n") + F.col("m")).alias("n"))
    names = cut(names)
    levels = names.groupBy("level").agg(F.ceil(F.sum("n") / BLOCK_ROWS).alias("of"))
    place = F.pmod(F.xxhash64("name"), F.col("of"))
    return names.join(levels, "level").select(
        "name", (F.col("level") * F.lit(1 << 32) + place).alias("block"), "best", "n",
        F.ceil(F.col("n") / (4 * BLOCK_ROWS)).cast("int").alias("parts"))


def open_index(spark: SparkSession, folder: str) -> SearchIndex:
    """An index that build_index wrote to folder."""
    return SearchIndex(*[spark.read.parquet(f"{folder}/{part}") for part in SearchIndex._fields])


def build_index(gold: DataFrame, silver: DataFrame, folder: str | None = None,
                ignore_case: bool = False) -> SearchIndex:
    """The inverted index of both sides, written to folder (by default one in the shared
    folder). Terms hold no white space, so a text holds a term exactly where one of its tokens
    does."""
    spark = gold.sparkSession
    folder = folder or scratch_path(spark, "index")

    def store(part: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{part}")
        return spark.read.parquet(f"{folder}/{part}")

    g = gold.where(F.col("trust_score").isNotNull() & F.col("name").isNotNull())
    s = silver.where(F.col("name").isNotNull())
    names = store("names", _blocks(g.select("name", "trust_score"), s.select("name")))
    store("blocks", names.groupBy("block").agg(F.max("best").alias("best")))

    def entry(kind: str, token: Column, given: Column = F.lit(True)) -> Column:
        return F.when(given & token.isNotNull(), F.struct(F.lit(kind).alias("kind"), token.alias("token")))

    def entries(*marks: Column) -> Column:
        """Filter values of a record, and one entry that every block has."""
        return F.array_compact(F.array(entry("any", F.lit("")), *marks)).alias("marks")

    flag = F.lit("")
    left = g.select("name", "facility_id", F.array_join("capabilities", "\n").alias("text"), entries(
        entry("icu", flag, filter_flag("has_icu")),
        entry("emergency", flag, filter_flag("has_emergency")),
        entry("open_24_7", flag, filter_flag("has_24_7")),
        entry("contradictions", flag, F.coalesce(filter_contradictions(), F.lit(False)))))
    right = s.select("name", "facility_id", F.concat_ws(
        "\n", "searchable_text", F.array_join("specialties", "\n")).alias("text"), entries(
        entry("state", F.col("address_state")), entry("city", F.col("address_city")),
        entry("facility_type", F.col("facility_type")),
        entry("dialysis", flag, F.coalesce(filter_dialysis(), F.lit(False)))))
    part = F.pmod(F.xxhash64("facility_id"), F.col("parts"))
    # a number of tasks that keeps the tokens of each few, however large the table is
    tasks = math.ceil((names.agg(F.sum("n")).collect()[0][0] or 1) / TASK_ROWS)
    records = left.unionByName(right).join(names, "name").select(
        "block", part.alias("part"), "text", "marks").repartition(tasks, "block", "part")
    words = F.array_distinct(F.regexp_extract_all(
        F.lower("text") if ignore_case else F.col("text"), F.lit(rf"\S{{{SHORTEST},}}"), F.lit(0)))
    found = F.concat("marks", F.transform(words, lambda w: F.struct(F.lit("term").alias("kind"), w.alias("token"))))
    # records of a block are together already: one more exchange would only repeat that
    postings = store("postings", records.select("block", "part", F.explode(found).alias("e"))
                     .groupBy("block", "part", "e.kind", "e.token").agg(F.lit(1).alias("one"))
                     .select("kind", "token", "block"))
    store("tokens", postings.where(F.col("kind").isin("term", *NAMED)).select("kind", "token").distinct())
    return open_index(spark, folder)


def _asked_tokens(specs: DataFrame, index: SearchIndex) -> DataFrame:
    """(qi, kind, token, bit): index tokens that hold a term of the query or fit a filter of it.
    A query without terms asks for the entry that every block has."""
    q = F.col("spec")

    def want(kind: str, text: Column, bit) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(bit).alias("bit"))

    given = {k: q.getField(k) if k in (*NAMED, "facility_type") else F.when(q.getField(k), F.lit(""))
             for k in FILTER_BITS}
    wanted = F.concat(
        F.transform(q.getField("terms"), lambda t: F.struct(
            F.lit("term").alias("kind"), t.getField("term").alias("text"), t.getField("bit").alias("bit"))),
        F.array(*[want(k, text, FILTER_BITS[k]) for k, text in given.items()]),
        F.array(want("any", F.when(~q.getField("any_terms"), F.lit("")), 0)))
    wanted = cut(specs.select("qi", F.explode(wanted).alias("w")).select("qi", "w.*").where(
        F.col("text").isNotNull()))
    parts = F.col("kind").isin("term", *NAMED)
    named = wanted.where(parts & (F.col("text") != ""))
    held = contains_scan(index.tokens, "token", named.select("text").distinct(), "text")
    found = named.join(index.tokens.join(held, "token"), ["kind", "text"])
    columns = ["qi", "kind", "token", "bit"]
    return cut(wanted.where(~parts).withColumnRenamed("text", "token").select(*columns)
               .unionByName(found.select(*columns)))


def _bounds(specs: DataFrame, asked: DataFrame, index: SearchIndex) -> DataFrame:
    """(qi, block, most, best): blocks that can hold an answer, with the most terms and the best
    trust that one could have."""
    q = F.col("spec")
    need = F.lit(0)
    for kind, bit in FILTER_BITS.items():
        asks = F.length(q.getField(kind)) > 0 if kind in NAMED else \
            q.getField(kind).isNotNull() if kind == "facility_type" else q.getField(kind)
        need = need + F.when(asks, bit).otherwise(0)
    needs = specs.select("qi", need.alias("need"), q.getField("min_trust").alias("min_trust"),
                         q.getField("any_terms").alias("any_terms"))
    seen = index.postings.select("kind", "token", "block").join(asked, ["kind", "token"]) \
        .groupBy("qi", "block").agg(F.bit_or("bit").alias("bits"))
    most = F.bit_count(F.col("bits").bitwiseAND(F.lit(TERM_BITS)))
    return seen.join(needs, "qi").join(index.blocks, "block").where(
        (F.col("bits").bitwiseAND(F.col("need")) == F.col("need"))
        & ((most > 0) | ~F.col("any_terms"))
        & (F.col("min_trust").isNull() | (F.col("best") >= F.col("min_trust")))
    ).select("qi", "block", most.alias("most"), "best")


def _term_mask(q: Column, *texts: Column) -> Column:
    """The bits of the query's terms that one of the texts holds."""
    def held(t: Column) -> Column:
        tests = [F.coalesce(F.contains(text, t.getField("term")), F.lit(False)) for text in texts]
        return reduce(lambda a, b: a | b, tests)
    return F.aggregate(F.filter(q.getField("terms"), held), F.lit(0), lambda a, t: a + t.getField("bit"))


def _opened(blocks: DataFrame, specs: DataFrame, gold: DataFrame, silver: DataFrame,
            index: SearchIndex, k: int, ignore_case: bool) -> DataFrame:
    """The first k pairs of every query within the given (qi, block): name joins of records
    that pass the filters, a term found on either side."""
    lower = F.lower if ignore_case else (lambda c: c)
    # stored, so Spark sees how few they are and leaves the texts of the layers in place
    asks = cut(blocks.join(specs, "qi"))
    spec = F.col("spec")
    g = gold.where(F.col("trust_score").isNotNull()).select(
        "name", F.col("facility_id").alias("gold_id"), "trust_score", "has_icu", "has_emergency",
        "has_24_7", "number_doctors", "inferred_doctors", "contradictions",
        lower(F.array_join("capabilities", "\n")).alias("_text"))
    s = silver.select(
        "name", F.col("facility_id").alias("silver_id"), "address_state", "address_city",
        "facility_type", "specialties", lower(F.array_join("specialties", "\n")).alias("_listed"),
        lower(F.col("searchable_text")).alias("_text"))
    names = index.names.select("name", "block")
    g = g.join(names, "name").join(asks, "block").where(_gold_ok(spec)).select(
        "qi", "name", _term_mask(spec, F.col("_text")).alias("mask"), "gold_id", "trust_score")
    s = s.join(names, "name").join(asks, "block").where(_silver_ok(spec)).select(
        "qi", "name", _term_mask(spec, F.col("_text"), F.col("_listed")).alias("mask"), "silver_id")
    left = top_k(g, ["qi", "name", "mask"], [F.col("trust_score").desc(), F.col("gold_id")], k,
                 "gold_id", "_i").withColumnRenamed("mask", "gold_mask")
    right = top_k(s, ["qi", "name", "mask"], [F.col("silver_id")], k,
                  "silver_id", "_j").withColumnRenamed("mask", "silver_mask")
    right = right.withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("qi", "name", "silver_mask")))
    both = F.col("gold_mask").bitwiseOR(F.col("silver_mask"))
    return (
        left.join(right, ["qi", "name"])
        .where((F.col("_i") - 1) * F.col("_n") + F.col("_j") <= k)
        .join(specs.select("qi", spec.getField("any_terms").alias("any_terms")), "qi")
        .where((both > 0) | ~F.col("any_terms"))
        .select("qi", "gold_id", "silver_id", "trust_score",
                F.bit_count(both).alias("relevance_score"))
    )


def _of_many(gold: DataFrame, silver: DataFrame, specs: DataFrame, k: int, ignore_case: bool) -> DataFrame:
    """The answers of very many queries, from what each record tells about terms and filters."""
    lower = F.lower if ignore_case else (lambda c: c)
    g = gold.where(F.col("trust_score").isNotNull()).select(
        "name", F.col("facility_id").alias("id"), lower(F.array_join("capabilities", "\n")).alias("text"),
        "trust_score", F.coalesce(F.col("number_doctors"), F.col("inferred_doctors").cast("double")).alias("doctors"),
        filter_flag("has_icu").alias("icu"), filter_flag("has_emergency").alias("emergency"),
        filter_flag("has_24_7").alias("open_24_7"),
        F.coalesce(filter_contradictions(), F.lit(False)).alias("contradictions"))
    s = silver.select(
        "name", F.col("facility_id").alias("id"), lower(F.concat_ws(
            "\n", "searchable_text", F.array_join("specialties", "\n"))).alias("text"),
        F.col("address_state").alias("state"), F.col("address_city").alias("city"), "facility_type",
        F.coalesce(filter_dialysis(), F.lit(False)).alias("dialysis"))
    return search_many(g, s, specs, k)


def _ranked(found: DataFrame, specs: DataFrame) -> DataFrame:
    return found.join(specs.select("qi", F.col("spec.query_id").alias("query_id")), "qi").select(
        "query_id", "rank", "gold_id", "silver_id", "relevance_score", "trust_score",
        F.col("trust_score").alias("final_score"))


def hybrid_search(gold: DataFrame, silver: DataFrame, queries: DataFrame,
                  num_results: int = 20, use_24_7: bool = False,
                  ignore_case: bool = False, index: SearchIndex | None = None) -> DataFrame:
    """Top results of every query over gold JOIN silver ON name (repeated names multiply).

    Returns query_id, rank, gold_id, silver_id, relevance_score, trust_score, final_score.
    Any number of queries is one plan; query ids may repeat or be null. An index of the same
    tables, built before with the same ignore_case, spares building one.
    """
    specs = cut(search_specs(queries, use_24_7).withColumn("qi", F.monotonically_increasing_id()))
    if specs.count() > MANY_QUERIES:
        return _ranked(_of_many(gold, silver, specs, num_results, ignore_case), specs)
    index = index or build_index(gold, silver, ignore_case=ignore_case)
    asked = _asked_tokens(specs, index)
    left = cut(_bounds(specs, asked, index))
    best_first = [F.col("most").desc(), F.col("best").desc(), F.col("block")]
    order = [F.col("relevance_score").desc(), F.col("trust_score").desc(),
             F.col("gold_id"), F.col("silver_id")]
    k = max(KEPT_PER_QUERY, num_results)
    found = None
    few = index.blocks.limit(FIRST_BLOCKS + 1).count() <= FIRST_BLOCKS
    for blocks in (None,) if few else (FIRST_BLOCKS, NEXT_BLOCKS, None):
        now = left if blocks is None else cut(top_k(
            left, ["qi"], best_first, blocks, "block", "_rank").drop("_rank"))
        opened = _opened(now.select("qi", "block"), specs, gold, silver, index, k, ignore_case)
        if found is not None:
            opened = opened.unionByName(found.drop("rank"))
        found = cut(top_k(opened, ["qi"], order, num_results, "gold_id"))
        if blocks is None:
            break
        # what is left must beat, or tie with, the last answer of a full list
        last = found.where(F.col("rank") == num_results).select(
            "qi", F.col("relevance_score").alias("_terms"), F.col("trust_score").alias("_trust"))
        rest = left.join(now.select("qi", "block"), ["qi", "block"], "left_anti").join(last, "qi", "left")
        left = cut(rest.where(
            F.col("_terms").isNull() | (F.col("most") > F.col("_terms"))
            | ((F.col("most") == F.col("_terms")) & (F.col("best") >= F.col("_trust"))))
            .drop("_terms", "_trust"))
        if left.isEmpty():
            break
    return _ranked(found, specs)


def with_details(found: DataFrame, gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Adds the record columns to search hits.

    The hits (at most 100 per query) are stored first, so Spark sees how few they are and
    scans the wide tables in place instead of shuffling them. A silver side that brings its
    source text and the facts of it gives these instead of its whole texts.
    """
    found = cut(found)
    texts = [c for c in ("source_text", "text_facts") if c in silver.columns] or ["description", "searchable_text"]
    s = silver.select(
        F.col("facility_id").alias("silver_id"), "address_state", "address_city", "address_zip",
        "facility_type", "latitude", "longitude", "specialties", *texts,
        *[c for c in ("phone", "website") if c in silver.columns])
    g = gold.select(
        F.col("facility_id").alias("gold_id"), "name", "trust", "confidence", "capabilities",
        "extracted_equipment", "has_icu", "has_emergency", "has_24_7", "has_surgery",
        "inferred_doctors", "bed_count", "contradictions")
    return found.join(g, "gold_id").join(s, "silver_id")
