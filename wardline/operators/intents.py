"""User questions: intent, specialties, structured filters. Works on a table of questions."""

from __future__ import annotations

import sys

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import columns as X, vocab
from wardline.sources.layers import cut

# Place names in one automaton, and questions that one task scans with it.
NAMES_PER_SCAN, QUESTIONS_PER_SCAN = 50_000, 10_000

# tasks get the scanning functions themselves, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(X.text_or_empty(text)), r"\s+"), lambda w: w != "")


def literal_words(words: list[str]) -> Column:
    return F.expr("array(" + ", ".join(X.quoted(w) for w in words) + ")")


def useful_words(text: Column) -> Column:
    stop = literal_words(vocab.STOP_WORDS)
    return F.filter(words_of(text), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def query_terms(search_text: Column, specialties: Column) -> Column:
    """Words of the search text, then of the first four specialties: distinct, at most 8."""
    extra = F.flatten(F.transform(F.slice(F.coalesce(specialties, X.empty_strings()), 1, 4),
                                  useful_words))
    return F.slice(F.array_distinct(F.concat(useful_words(search_text), extra)), 1, 8)


def wants_contradictions(flag: Column, *texts: Column) -> Column:
    triggers = literal_words(vocab.CONTRADICTION_TRIGGERS)
    asked = F.coalesce(flag, F.lit(False))
    for t in texts:
        asked = asked | F.arrays_overlap(words_of(t), triggers)
    return asked


def is_gap_query(query: Column) -> Column:
    return X.any_phrase(F.lower(query), vocab.GAP_PHRASES)


def specialty_filters(query: Column, prefixes: dict[str, list[str]] | None = None) -> Column:
    """Specialty patterns of the words, in word order, without repeats."""
    prefixes = vocab.SPECIALTY_PREFIXES if prefixes is None else prefixes
    table = X.literal_table(
        [{"key": k, "patterns": v} for k, v in prefixes.items()],
        "struct<key: string, patterns: array<string>>")
    per_word = F.transform(
        words_of(query),
        lambda w: F.flatten(F.transform(
            F.filter(table, lambda e: F.startswith(w, e.getField("key"))),
            lambda e: e.getField("patterns"))))
    return F.array_distinct(F.flatten(per_word))


def needs_translation(query: Column, language: Column) -> Column:
    tagged = F.coalesce(language.isin(vocab.TRANSLATED_LANGUAGES), F.lit(False))
    return tagged | query.rlike(r"[^\x00-\x7F]")


def apply_ui_filters(questions: DataFrame) -> DataFrame:
    """Questions of three characters or more, with the chosen state appended if not named."""
    state, query = F.col("ui_state"), F.col("query")
    append = (state.isNotNull() & (state != "") & (state != "All")
              & ~F.contains(F.lower(query), F.lower(state)))
    kept = questions.where(F.length(F.trim(query)) >= 3)
    return kept.withColumn("query", F.when(append, F.concat(query, F.lit(" in "), state))
                           .otherwise(query))


def effective_min_trust(slider: Column, parsed: Column) -> Column:
    return F.when(slider > 0, slider).otherwise(parsed)


def route_queries(questions: DataFrame) -> DataFrame:
    """Adds the path each question takes."""
    return questions.withColumn(
        "route", F.when(is_gap_query(F.col("query")), "gap").otherwise("search"))


def _automaton(names: pa.Table) -> ahocorasick.Automaton:
    """All lowered names as one trie with failure links; each leads to its best name per kind."""
    trie = ahocorasick.Automaton()
    for kind, name, low in zip(*(names.column(c).to_pylist() for c in ("kind", "name", "low"))):
        best = trie.get(low, None)
        if best is None:
            best = {}
            trie.add_word(low, best)
        best[kind] = min(best.get(kind, (0, "")), (-len(name), name))
    trie.make_automaton()
    return trie


def _scan(_, texts: pa.Table, names: pa.Table) -> pa.Table:
    """One scan per text: the longest name of every kind that it holds."""
    out = []
    if names.num_rows and texts.num_rows:
        trie = _automaton(names)
        for row, text in zip(texts.column("row").to_pylist(), texts.column("text").to_pylist()):
            best: dict = {}
            for _, found in trie.iter(text):
                for kind, name in found.items():
                    best[kind] = min(best.get(kind, name), name)
            out += [(row, kind, neg, name) for kind, (neg, name) in best.items()]
    columns = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()))],
                    names=["row", "kind", "neg", "name"])


def find_places(questions: DataFrame, places: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Adds, per entry (column to add: table, its name column), the longest name the question
    contains, ignoring case; of equally long ones the first by name.

    Questions and names meet in blocks of bounded size, each scanned once by an automaton over
    its names, so any number of either takes the same path. Questions are told apart by row:
    their ids may repeat or be null. Null and blank names are no places; a null question holds
    none."""
    rows = cut(questions.withColumn("_row", F.monotonically_increasing_id()))
    names = None
    for kind, (table, column) in places.items():
        part = table.select(F.lit(kind).alias("kind"), F.col(column).alias("name")).where(
            F.trim("name") != "").distinct()
        names = part if names is None else names.unionByName(part)
    names = cut(names.withColumn("low", F.lower("name")))
    parts = max(1, -(-names.count() // NAMES_PER_SCAN))
    blocks = max(1, -(-rows.count() // QUESTIONS_PER_SCAN))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    texts = rows.select(F.col("_row").alias("row"), F.lower("query").alias("text")).where("text is not null") \
        .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("part", spread(parts))
    names = names.withColumn("part", F.pmod(F.xxhash64("low"), F.lit(parts)).cast("int")) \
        .withColumn("block", spread(blocks))
    found = texts.groupBy("part", "block").cogroup(names.groupBy("part", "block")).applyInArrow(
        _scan, "row long, kind string, neg int, name string")
    best = found.groupBy(F.col("row").alias("_row")).agg(*[
        F.min(F.when(F.col("kind") == kind, F.struct("neg", "name"))).getField("name").alias(kind)
        for kind in places])
    return rows.join(best, "_row", "left").drop("_row")


def longest_place(questions: DataFrame, places: DataFrame, place: str, out: str) -> DataFrame:
    """Adds the longest place name the question contains (ignoring case; ties by name)."""
    return find_places(questions, {out: (places, place)})


def parse_queries(questions: DataFrame, silver: DataFrame) -> DataFrame:
    """Question text to structured filters. A flag is true or unknown, never false."""
    located = find_places(questions, {"state": (silver, "address_state"),
                                      "city": (silver, "address_city")})
    low = F.lower("query")
    place_words = F.concat(words_of(F.col("state")), words_of(F.col("city")))
    stop = literal_words(vocab.STOP_WORDS)
    core = F.filter(words_of(F.col("query")),
                    lambda w: ~F.array_contains(stop, w) & ~F.array_contains(place_words, w))
    asked = wants_contradictions(F.lit(None).cast("boolean"), F.col("query"))
    return located.withColumns({
        "facility_type": X.first_word("lower(query)", vocab.FACILITY_TYPES),
        "specialties": specialty_filters(F.col("query")),
        "requires_icu": F.when(X.any_phrase(low, vocab.STANDARDS["has_icu"]), True),
        "requires_emergency": F.when(X.any_phrase(low, vocab.STANDARDS["has_emergency"]), True),
        "requires_24_7": F.when(X.any_phrase(low, vocab.STANDARDS["has_24_7"]), True),
        "requires_dialysis": F.when(X.any_phrase(low, vocab.CLAIMS["has_dialysis"]), True),
        "requires_contradictions": F.when(asked, True),
        "min_trust_score": X.blank_to_null(
            F.regexp_extract(low, r"trust\D*(\d+)", 1)).try_cast("double"),
        "search_text": F.array_join(core, " "),
    })
