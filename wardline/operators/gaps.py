"""Coverage gaps per region and specialty, their summaries and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.functions import columns as X, vocab
from wardline.operators import intents
from wardline.sources.layers import cut

TOP_GAPS_PER_QUESTION = 50


def specialty_match(gold: DataFrame, specialties: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds `is_<specialty>` flags; the text is lower-cased once."""
    specialties = vocab.GAP_SPECIALTIES if specialties is None else specialties
    low = gold.withColumn("_low", F.lower("searchable_text"))
    return low.withColumns({
        f"is_{s}": X.any_word("_low", words) for s, words in specialties.items()
    }).drop("_low")


def _confirmed(gold: DataFrame) -> Column:
    return F.col("confidence").isin("high", "medium") if "confidence" in gold.columns \
        else F.lit(True)


def _grid(gold: DataFrame, by: list[str], confirmed: Column,
          specialties: dict[str, list[str]]) -> DataFrame:
    """One aggregate per region, unfolded to a row per specialty, zero counts included."""
    flagged = specialty_match(gold, specialties)
    wide = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_facilities_state"),
        F.bround(F.avg("latitude"), 4).alias("centroid_lat"),
        F.bround(F.avg("longitude"), 4).alias("centroid_lng"),
        *[F.count_if(F.col(f"is_{s}") & confirmed).alias(s) for s in specialties])
    rows = F.inline(F.array(*[
        F.struct(F.lit(s).alias("specialty"), F.col(s).alias("facility_count"))
        for s in specialties]))
    return wide.select(*by, "total_facilities_state", "centroid_lat", "centroid_lng", rows)


def gap_grid(gold: DataFrame, specialties: dict[str, list[str]] | None = None) -> DataFrame:
    """Every state x specialty: counts, ratio, severity, label, message and centroid."""
    specialties = vocab.GAP_SPECIALTIES if specialties is None else specialties
    known = gold.where(F.col("address_state").isNotNull())
    long = _grid(known, ["address_state"], _confirmed(gold), specialties)
    count, total = F.col("facility_count"), F.col("total_facilities_state")
    severity = X.gap_severity(count, total)
    return long.withColumnRenamed("address_state", "state").withColumns({
        "coverage_ratio": X.half_even(count / F.greatest(total, F.lit(1)), 4),
        "desert_severity": severity,
    }).withColumns({
        "severity_label": X.severity_label(F.col("desert_severity")),
        "action": gap_action(),
        "centroid_lat": F.coalesce("centroid_lat", F.lit(vocab.DEFAULT_LAT)),
        "centroid_lng": F.coalesce("centroid_lng", F.lit(vocab.DEFAULT_LNG)),
    }).select("state", "specialty", "facility_count", "total_facilities_state", "coverage_ratio",
              "desert_severity", "severity_label", "action", "centroid_lat", "centroid_lng")


def gap_action() -> Column:
    return F.concat(
        F.when(F.col("desert_severity") > 80, "CRITICAL: ").otherwise(""), F.col("state"),
        F.lit(" has only "), F.col("facility_count").cast("string"), F.lit(" verified "),
        F.col("specialty"), F.lit(" facilities out of "),
        F.col("total_facilities_state").cast("string"), F.lit(" total."))


def gap_order() -> list[Column]:
    return [F.col("desert_severity").desc(), F.col("state"), F.col("specialty")]


def gap_sort(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(*gap_order())


def critical_count(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count_if(F.col("desert_severity") > 80).alias("critical_gaps"))


def pin_gaps(gold: DataFrame, by: list[str] | None = None,
             specialties: dict[str, list[str]] | None = None) -> DataFrame:
    """Facilities per PIN code and city with the specialty, confidence not low."""
    by = by or ["address_zip", "address_city"]
    specialties = vocab.GAP_SPECIALTIES if specialties is None else specialties
    known = gold.where(F.col(by[0]).isNotNull())
    long = _grid(known, by, F.col("confidence") != "low", specialties)
    return long.select(*by, "specialty", "facility_count",
                       F.col("total_facilities_state").alias("total_facilities"))


def state_summary(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("state").agg(
        F.max("desert_severity").alias("max_desert_severity"),
        F.count_if(F.col("desert_severity") > 80).alias("critical_specialty_count"),
        F.max("total_facilities_state").alias("total_facilities"),
        F.max("centroid_lat").alias("centroid_lat"), F.max("centroid_lng").alias("centroid_lng"),
    ).withColumn("overall_severity_label", X.severity_label(F.col("max_desert_severity")))


def gaps_filtered(gaps: DataFrame, state: str | None = None, specialty: str | None = None,
                  min_severity: int = 60, limit: int = 200) -> DataFrame:
    kept = gaps.where(F.col("desert_severity") >= min_severity)
    if state:
        kept = kept.where(F.col("state") == state)
    if specialty:
        kept = kept.where(F.col("specialty") == specialty)
    return kept.orderBy(*gap_order()).limit(limit)


def gaps_like(gaps: DataFrame, patterns: list[str], limit: int = TOP_GAPS_PER_QUESTION) -> DataFrame:
    kept = gaps.where(X.any_word("lower(specialty)", patterns)) if patterns else gaps
    return kept.orderBy(*gap_order()).limit(limit)


def worst_states(summary: DataFrame, limit: int = 30) -> DataFrame:
    return summary.orderBy(F.col("max_desert_severity").desc(), "state").limit(limit)


def gap_payload(gaps: DataFrame, summary: DataFrame, state: str | None = None,
                specialty: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(severe gaps with the number of critical ones, all states worst first)."""
    severe = gaps_filtered(gaps, state, specialty)
    # at most 200 rows are in the window
    critical = F.count_if(F.upper("severity_label") == "CRITICAL").over(Window.partitionBy())
    deserts = severe.select(
        "state", "specialty", F.col("facility_count").alias("count"),
        F.col("total_facilities_state").alias("total"), F.col("severity_label").alias("severity"),
        F.col("desert_severity").alias("score"), "action",
        F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"),
        critical.alias("total_critical"))
    states = summary.orderBy(F.col("max_desert_severity").desc(), "state").select(
        "state", F.lower("overall_severity_label").alias("severity"),
        F.col("critical_specialty_count").alias("critical_count"),
        F.col("total_facilities").alias("facilities"),
        F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"))
    return deserts, states


def top_gaps_per_state(gaps: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("state").orderBy(F.col("desert_severity").desc(), "specialty")
    ranked = gaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    report = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" "), F.col("action"))
    return ranked.select("state", "rank", "specialty", "desert_severity", report.alias("report"))


def top_critical_gaps(gaps: DataFrame, limit: int = 50) -> DataFrame:
    return gaps.orderBy(*gap_order()).limit(limit)


def critical_specialties_list(gaps: DataFrame) -> DataFrame:
    names = F.array_sort(F.collect_set(F.when(F.col("severity_label") == "critical",
                                              F.col("specialty"))))
    return gaps.groupBy("state").agg(
        F.coalesce(X.blank_to_null(F.array_join(names, ", ")), F.lit("none"))
        .alias("critical_specialties"))


def gap_lookup(questions: DataFrame, gaps: DataFrame,
               specialties: list[str] | None = None) -> DataFrame:
    """Gap rows for every gap question, worst 50 each (query_id, rank, gap columns).

    The specialties are those of the gap table unless a list is given. A question means one
    of their subsets, so gaps are ranked once per subset and questions only look theirs up.
    """
    asked = questions.where(intents.is_gap_query(F.col("query"))).withColumn(
        "patterns", intents.specialty_filters(F.col("query")))
    if specialties is None:
        names = F.col("names")
        asked = asked.crossJoin(F.broadcast(gaps.agg(  # one row
            F.array_sort(F.collect_set("specialty")).alias("names"))))
    else:
        names = intents.literal_words(specialties)
    wanted = F.when(F.size("patterns") == 0, names).otherwise(F.filter(
        names, lambda s: F.exists("patterns", lambda p: F.contains(F.lower(s), p))))
    asked = asked.select("query_id", wanted.alias("wanted"))
    member = asked.select("wanted").distinct().select(
        "wanted", F.explode("wanted").alias("specialty"))
    w = Window.partitionBy("wanted").orderBy(*gap_order())
    # at most one list of 50 per subset: stored, so the questions are not shuffled to meet it
    ranked = cut(
        gaps.join(member, "specialty").withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= TOP_GAPS_PER_QUESTION)
    )
    return asked.join(ranked, "wanted").drop("wanted")
