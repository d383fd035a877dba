"""Questions and parsed queries to ranked, cited, validated and corrected answers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from wardline.operators import gaps as coverage, intents, present, search, trust, validate
from wardline.sources.layers import cut


# Records found, up to which their ids go to all tasks and the texts stay where they are.
FEW_FOUND = 200_000


def _with_facts(found: DataFrame, gold: DataFrame, silver: DataFrame, chars: int | None) -> DataFrame:
    """The silver records that were found, with the facts of their texts: many results share few
    records, and the capabilities to look for are those of the gold records they were found with.
    Where the records found are too many to go to all tasks, each text is shuffled once."""
    listed = gold.select(F.col("facility_id").alias("gold_id"), F.slice("capabilities", 1, 5).alias("c"))
    wanted = cut(found.select("gold_id", "silver_id").distinct().join(listed, "gold_id")
                 .select(F.col("silver_id").alias("facility_id"), F.explode_outer("c").alias("c"))
                 .groupBy("facility_id").agg(F.collect_set("c").alias("_wanted")))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_FOUND else wanted
    texts = silver.withColumn("source_text", present.source_snippet(None)).drop("description", "searchable_text")
    facts = validate.with_text_facts(texts.join(wanted, "facility_id"), "_wanted").drop("_wanted")
    return cut(facts if chars is None else facts.withColumn(
        "source_text", F.substring("source_text", 1, chars)))


def answer_batch(gold: DataFrame, silver: DataFrame, queries: DataFrame,
                 num_results: int = 10, index: search.SearchIndex | None = None,
                 chars: int | None = None) -> DataFrame:
    """Search keeps 2n candidates per query; the first n are formatted, checked and corrected.
    Checks read whole texts, once per record that was found; the answers carry the first `chars`
    of them (None: all)."""
    found = search.hybrid_search(gold, silver, queries, num_results * 2, index=index)
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    found = cut(found.withColumn("total_found", total).where(F.col("rank") <= num_results))
    details = search.with_details(found, gold, _with_facts(found, gold, silver, chars))
    formatted = present.format_results(details, keep=("total_found", "text_facts"))
    checked = validate.re_extract(validate.attach_verdict(formatted)).drop("text_facts")
    verdict, corrected = F.col("validation_verdict"), F.col("self_corrected")
    return checked.withColumns({
        "trust_score_display": trust.trust_display(F.col("trust_score"), verdict, corrected),
        "trust_score_warning": trust.trust_warning(verdict, corrected),
    })


class Answers(NamedTuple):
    """cards: one row per result; answers: a sentence and a trace per question."""

    cards: DataFrame
    answers: DataFrame


def answer_questions(gold: DataFrame, silver: DataFrame, gaps: DataFrame, questions: DataFrame,
                     num_results: int = 10, index: search.SearchIndex | None = None) -> Answers:
    """Users' questions (query_id, query; ui_state and ui_min_trust where the table has them) to
    cards, by the route each of them takes: questions about gaps look the coverage table up, all
    others are parsed and searched. The chosen state joins the question, and a slider above 0
    replaces the trust the question asks for.

    Both results have query_id, route and question, a number of the row: ids may repeat or be
    null. Questions of fewer than three characters, and null ones, have no answer. Without gaps
    or facilities every question still has its sentence."""
    optional = {"ui_state": "string", "ui_min_trust": "double"}
    asked = questions.select("query_id", "query", *[
        F.col(c).cast(kind) if c in questions.columns else F.lit(None).cast(kind).alias(c)
        for c, kind in optional.items()])
    asked = asked.withColumns({"_id": F.col("query_id"), "_said": F.col("query"),
                               "query_id": F.monotonically_increasing_id()})
    asked = cut(intents.route_queries(intents.apply_ui_filters(asked)))
    about_gaps, others = asked.where("route = 'gap'"), asked.where("route = 'search'")

    parsed = intents.parse_queries(others, silver)
    parsed = parsed.withColumn("min_trust_score", intents.effective_min_trust(
        F.col("ui_min_trust"), F.col("min_trust_score")))
    found = cut(answer_batch(gold, silver, parsed, num_results, index, present.CARD_CHARS))
    looked = cut(present.gap_cards(coverage.gap_lookup(about_gaps, gaps)))

    said = others.select("query_id", F.col("_said").alias("query"))
    by_search = present.answer_summary(said, found).join(
        present.query_trace(said, found), "query_id")
    by_gaps = present.gap_answers(about_gaps, looked).select(
        "query_id", F.col("gaps").alias("total_found"), "answer", F.col("gaps").alias("candidates"),
        F.lit(0.0).alias("avg_trust"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("verified", "disputed", "self_corrected", "tokens")])
    cards = present.result_cards(found).unionByName(
        present.gap_result_cards(looked), allowMissingColumns=True)

    def of_question(df: DataFrame) -> DataFrame:
        ids = asked.select("query_id", "_id", "route")
        return df.join(ids, "query_id").withColumnRenamed("query_id", "question") \
            .withColumnRenamed("_id", "query_id")

    return Answers(of_question(cards), of_question(by_search.unionByName(by_gaps)))
