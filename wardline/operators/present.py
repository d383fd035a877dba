"""Result records, citations, tags, cards, answer sentences and per-query traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import columns as X, vocab
from wardline.operators.intents import words_of

TRUST_PARTS = [("Completeness", "completeness", 25), ("Consistency", "consistency", 30),
               ("Verifiability", "verifiability", 25), ("Recency", "recency", 10),
               ("Digital presence", "digital", 10)]


# Characters of the source text that a card shows.
CARD_CHARS = 300


def yes(claim: str) -> Column:
    return F.coalesce(F.col(claim), F.lit(False))


def sentence_citations() -> Column:
    said = F.array_compact(F.array(
        F.when(yes("has_icu"), "ICU confirmed (extracted from facility text)"),
        F.when(yes("has_emergency"),
               "Emergency services confirmed (extracted from facility text)"),
        F.when(yes("has_24_7"), "24/7 availability confirmed (extracted from facility text)"),
        F.when(F.size("capabilities") > 0, F.concat(
            F.lit("Key capabilities extracted: "),
            F.array_join(F.slice("capabilities", 1, 3), ", "))),
        F.when(F.col("inferred_doctors") > 0, F.concat(
            F.col("inferred_doctors").cast("string"),
            F.lit(" doctors identified in facility text"))),
    ))
    fallback = F.array(F.lit(
        "Basic facility information — insufficient text for detailed citation"))
    return F.when(F.size(said) > 0, said).otherwise(fallback)


def source_snippet(chars: int | None = 400) -> Column:
    """The record's text, cut for display (None: whole)."""
    text = F.coalesce(X.blank_to_null(F.col("description")),
                      X.text_or_empty(F.col("searchable_text")))
    return text if chars is None else F.substring(text, 1, chars)


def trust_justification(legacy_labels: bool = False) -> Column:
    """Five sentences with the true maximum of each part; empty without a breakdown."""
    lines = F.array(*[
        F.concat(F.lit(f"{label}: "), F.col(f"trust.{part}").cast("string"),
                 F.lit(f"/{100 if legacy_labels else top}"))
        for label, part, top in TRUST_PARTS
    ])
    return F.when(F.col("trust").isNotNull(), lines).otherwise(X.empty_strings())


def coerce_contradictions(c: Column) -> Column:
    """JSON text as array<string>; null or unreadable text gives an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), X.empty_strings())


def format_results(details: DataFrame, num_results: int | None = None,
                   keep: tuple[str, ...] = (), chars: int | None = 400) -> DataFrame:
    """Ranked result records, 25 fields, for hits that carry their record columns. The source
    text is cut to `chars` for display; records that are checked against it take it whole, or
    bring it as source_text."""
    rows = details if num_results is None else details.where(F.col("rank") <= num_results)
    opt = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    cites = sentence_citations()
    return rows.select(
        "query_id", "rank", "name", "facility_type", F.col("address_state").alias("state"),
        F.col("address_city").alias("city"), F.col("address_zip").alias("pin_code"),
        opt("phone").alias("phone"), opt("website").alias("website"),
        "latitude", "longitude", "trust_score", "confidence",
        "has_icu", "has_emergency", "has_24_7",
        F.slice("capabilities", 1, 5).alias("key_capabilities"),
        F.col("inferred_doctors").alias("doctor_count"), "bed_count",
        F.array_join(cites, " | ").alias("citation"), cites.alias("sentence_citations"),
        F.col("source_text") if "source_text" in rows.columns else source_snippet(chars).alias("source_text"),
        F.lit("description + capability statements").alias("source_field"),
        trust_justification().alias("trust_justification"),
        "contradictions", F.col("trust").alias("trust_breakdown"), *keep,
    )


def result_tags() -> Column:
    def tag(label, warn):
        label = F.lit(label) if isinstance(label, str) else label
        return F.struct(label.alias("label"), F.lit(warn).alias("warn"))

    fixed = F.array_compact(F.array(
        F.when(F.col("validation_verdict") == "VERIFIED", tag("✅ Verified", False))
        .when(F.col("validation_verdict") == "DISPUTED", tag("⚠ Disputed", True)),
        F.when(F.col("self_corrected"), tag("🔄 Self-corrected", False)),
        F.when(yes("has_icu"), tag("ICU", False)),
        F.when(yes("has_emergency"), tag("Emergency", False)),
        F.when(yes("has_24_7"), tag("24/7", False)),
        F.when(F.col("confidence") == "low", tag("Low data quality", True)),
        F.when(F.size("contradictions") > 0, tag(F.concat(
            F.lit("⚠ "), F.size("contradictions").cast("string"),
            F.lit(" contradiction(s)")), True)),
    ))
    caps = F.transform(F.slice("key_capabilities", 1, 2),
                       lambda c: tag(F.substring(c, 1, 25), False))
    return F.concat(fixed, caps)


def result_cards(answered: DataFrame) -> DataFrame:
    return answered.select(
        "query_id", "rank", "name",
        F.concat(X.text_or_empty(F.col("city")), F.lit(", "), X.text_or_empty(F.col("state")))
        .alias("location"),
        F.col("trust_score_display").alias("trust"),
        F.initcap(F.coalesce("facility_type", F.lit("facility"))).alias("type"),
        result_tags().alias("tags"),
        F.substring(F.coalesce("citation", F.lit("No citation available")), 1, 200)
        .alias("citation"),
        "phone", "pin_code", "latitude", "longitude", "validation_note", "correction_note",
        "trust_breakdown",
        F.substring("source_text", 1, CARD_CHARS).alias("source_text"),
    )


def answer_summary(queries: DataFrame, answered: DataFrame) -> DataFrame:
    """One sentence per query, also for queries without a result."""
    top = answered.groupBy("query_id").agg(
        F.max("total_found").alias("total_found"),
        F.min_by(F.struct("name", "state", "trust_score_display"), "rank").alias("top"))
    text = F.concat(
        F.lit("Found "), F.col("total_found").cast("string"),
        F.lit(" facilities matching your criteria. Top result: "), F.col("top.name"),
        F.lit(" in "), F.coalesce("top.state", F.lit("India")), F.lit(" with a trust score of "),
        F.col("top.trust_score_display").cast("string"),
        F.lit(". The search was validated against original source text."))
    none = ("No facilities found matching your query. "
            "Try broadening your search criteria.")
    return queries.select("query_id").join(top, "query_id", "left").select(
        "query_id", F.coalesce("total_found", F.lit(0)).cast("bigint").alias("total_found"),
        F.when(F.col("top").isNotNull(), text).otherwise(none).alias("answer"))


def query_trace(queries: DataFrame, answered: DataFrame) -> DataFrame:
    """Candidates, mean trust, verdict counts and the token estimate of every query."""
    scored = F.when(F.col("trust_score") > 0, F.col("trust_score"))
    per_query = answered.groupBy("query_id").agg(
        F.max("total_found").alias("candidates"),
        F.sum(F.round(scored * 10).cast("bigint")).alias("tenths"), F.count(scored).alias("scored"),
        F.count_if(F.col("validation_verdict") == "VERIFIED").alias("verified"),
        F.count_if(F.col("validation_verdict") == "DISPUTED").alias("disputed"),
        F.count_if(F.col("self_corrected")).alias("self_corrected"),
    )
    tokens = (F.size(words_of(F.col("query"))) * 50 + 500).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return queries.select("query_id", tokens.alias("tokens")).join(
        per_query, "query_id", "left").select(
        "query_id", F.coalesce("candidates", zero).cast("bigint").alias("candidates"),
        # scores have one decimal: a mean of whole tenths, halves up, in any order of the rows
        F.coalesce(F.try_divide(F.expr("(2 * tenths + scored) div (2 * nullif(scored, 0))"), F.lit(10.0)),
                   F.lit(0.0)).alias("avg_trust"),
        *[F.coalesce(c, zero).alias(c) for c in ("verified", "disputed", "self_corrected")],
        "tokens")


def gap_cards(gaps: DataFrame) -> DataFrame:
    """Gap rows as result cards; trust is the inverted severity."""
    label = F.upper(F.coalesce("severity_label", F.lit("")))
    display = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("desert_severity"))
    tags = F.array_compact(F.array(
        F.struct(F.concat(F.lit("Desert: "), label).alias("label"),
                 label.isin("CRITICAL", "HIGH").alias("warn")),
        F.when(F.col("facility_count") == 0, F.struct(
            F.lit("Zero facilities").alias("label"), F.lit(True).alias("warn"))),
        F.struct(F.col("specialty").alias("label"), F.lit(False).alias("warn")),
    ))
    fallback = F.concat(F.lit("Only "), F.col("facility_count").cast("string"), F.lit(" of "),
                        F.col("total_facilities_state").cast("string"),
                        F.lit(" expected facilities present"))
    keys = [c for c in ("query_id", "rank") if c in gaps.columns]
    return gaps.select(
        *keys, F.concat_ws(" — ", "state", "specialty").alias("name"), "state",
        F.lit("Desert Zone").alias("facility_type"),
        X.half_even(display, 1).alias("trust_score"), F.lit("high").alias("confidence"),
        F.coalesce(X.blank_to_null(F.col("action")), fallback).alias("citation"),
        tags.alias("tags"), F.lit("NOT_VALIDATED").alias("validation_verdict"),
        F.col("desert_severity").cast("double").alias("desert_severity"),
        F.coalesce("centroid_lat", F.lit(vocab.DEFAULT_LAT)).alias("latitude"),
        F.coalesce("centroid_lng", F.lit(vocab.DEFAULT_LNG)).alias("longitude"),
    )


def gap_result_cards(cards: DataFrame) -> DataFrame:
    """Looked-up gap cards with the columns of result cards."""
    return cards.select(
        "query_id", "rank", "name", F.col("state").alias("location"),
        F.col("trust_score").alias("trust"), F.col("facility_type").alias("type"), "tags",
        F.substring(F.coalesce("citation", F.lit("")), 1, 200).alias("citation"),
        "latitude", "longitude", F.lit("").alias("validation_note"),
        F.lit("").alias("correction_note"), F.lit("").alias("source_text"))


def gap_answers(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """One sentence per gap question: gap count, worst states, critical count."""
    critical = F.exists("tags", lambda t: t.getField("label").contains("CRITICAL"))
    first8 = F.array_sort(F.collect_list(F.when(F.col("rank") <= 8, F.struct("rank", "state"))))
    per_query = cards.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("gaps"),
        F.count_if(critical).alias("critical"),
        F.array_distinct(F.transform(first8, lambda r: r.getField("state"))).alias("states"),
        F.min_by("name", "rank").alias("top_name"),
    )
    text = F.concat(
        F.lit("Found "), F.col("gaps").cast("string"),
        F.lit(" state-specialty gaps in our desert analysis. Most underserved states for "),
        F.trim(F.element_at(F.split("top_name", "—"), -1)), F.lit(": "),
        F.array_join(F.slice("states", 1, 5), ", "), F.lit(". "),
        F.col("critical").cast("string"), F.lit(" zone(s) classified as CRITICAL — "
        "meaning fewer than 10% of expected facilities are present."))
    none = ("No medical desert data found for your query. "
            "The desert analysis table may not have data for this specialty.")
    return questions.select("query_id").join(per_query, "query_id", "left").select(
        "query_id", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"),
        F.when(F.col("top_name").isNotNull(), text).otherwise(none).alias("answer"))
