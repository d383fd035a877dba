"""Dashboard aggregates over gold JOIN silver ON name, and map and profile projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import columns as X
from wardline.operators.pairs import first_pairs
from wardline.operators.search import RECORD_COLUMNS
from wardline.operators.silver import null_safe_string
from wardline.sources.layers import cut

MAP_POINTS = 2000


def overview_stats(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Totals over the name join. Both sides are summed per name first: the join then
    meets one row per name instead of every pair, and trust is summed in whole tenths."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    trust = F.col("trust_score")
    g = gold.where(trust.isNotNull()).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(trust >= 80).alias("high"), F.count_if(trust >= 60).alias("medium"),
        F.sum(F.round(trust * 10).cast("bigint")).alias("tenths"),
        yes("has_icu").alias("icu"), yes("has_emergency").alias("emergency"),
        F.count_if(F.col("confidence") == "high").alias("sure"))
    s = silver.groupBy("name", "address_state").agg(F.count(F.lit(1)).alias("m"))

    def pairs(c: str) -> Column:
        return F.coalesce(F.sum(F.col(c) * F.col("m")), F.lit(0)).cast("bigint")

    return g.join(s, "name").agg(
        pairs("n").alias("total_facilities"), pairs("high").alias("high_trust_count"),
        pairs("medium").alias("medium_plus_count"),
        F.round(F.try_divide(pairs("tenths"), pairs("n")) / 10, 1).alias("avg_trust_score"),
        pairs("icu").alias("icu_confirmed"), pairs("emergency").alias("emergency_confirmed"),
        pairs("sure").alias("high_confidence"),
        F.count_distinct("address_state").alias("states_covered"))


def _map_sides(gold: DataFrame, silver: DataFrame, state: str | None,
               keywords: list[str] | None, min_trust: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of the name join that can be on the map, each row with what it tells about the
    keywords: `hit`, it holds one, and `cuts`, the places in keywords at which the other side
    could go on. A pair's text is that of its silver row, a space and that of its gold row."""
    words = list(dict.fromkeys(k.strip() for k in keywords or []))
    cuts = [(k[:i], k[i + 1:]) for k in words for i, c in enumerate(k) if c == " "]

    def known(text: Column, side: str, parts: list[Column]) -> list[Column]:
        if not words:
            return [F.lit(True).alias(f"{side}_hit"), F.array().cast("array<int>").alias(f"{side}_cuts")]
        fits = [F.when(F.coalesce(p, F.lit(False)), F.lit(i)) for i, p in enumerate(parts)]
        return [F.coalesce(X.any_phrase(text, words), F.lit(False)).alias(f"{side}_hit"),
                F.array_compact(F.array(*fits).cast("array<int>")).alias(f"{side}_cuts")]

    citation = F.coalesce(F.get("capabilities", F.lit(0)), F.lit("No capabilities extracted"))
    after = F.lower(F.concat_ws(" ", F.array_join(F.slice("capabilities", 1, 3), " "), citation, "name"))
    before = F.lower(F.array_join(F.slice("specialties", 1, 4), " "))
    g = gold.where(F.col("trust_score") >= min_trust).select(
        "name", F.col("facility_id").alias("gold_id"), "trust_score",
        *known(after, "gold", [F.startswith(after, F.lit(b)) for _, b in cuts]))
    placed = silver.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if state:
        placed = placed.where(F.col("address_state") == state)
    s = placed.select(
        "name", F.col("facility_id").alias("silver_id"),
        *known(before, "silver", [F.endswith(before, F.lit(a)) for a, _ in cuts]))
    return g, s


def _fits() -> Column:
    return F.col("gold_hit") | F.col("silver_hit") | F.arrays_overlap("gold_cuts", "silver_cuts")


def map_points(gold: DataFrame, silver: DataFrame, limit: int = MAP_POINTS,
               state: str | None = None, keywords: list[str] | None = None,
               min_trust: float = 0) -> DataFrame:
    """The most trusted facilities with coordinates that pass the filters: the first `limit`
    rows of the name join by trust and ids. Filters come before the limit.

    A keyword may stand on either side of the join, or across it. Rows of a name fall into few
    classes by what they tell about the keywords; only gold rows of a class that some silver
    class of the name completes can give a pair, and the first `limit` of them give enough."""
    g, s = _map_sides(gold, silver, state, keywords, min_trust)
    order = [F.col("trust_score").desc(), F.col("gold_id"), F.col("silver_id")]
    mine, theirs = ["name", "gold_hit", "gold_cuts"], ["name", "silver_hit", "silver_cuts"]
    joining = g.select(mine).distinct().join(s.select(theirs).distinct(), "name").where(_fits())
    top = cut(g.join(joining.select(mine).distinct(), mine, "left_semi")
              .orderBy(*order[:2]).limit(limit))
    mates = s.join(top.select(mine).distinct(), "name").where(_fits()).select(*mine, "silver_id")
    best = cut(first_pairs(
        top, mates, mine, order[:2], [F.col("silver_id")], limit, "gold_id", "silver_id",
    ).orderBy(*order).limit(limit).select("gold_id", "silver_id"))
    g = gold.select(
        "name", F.col("facility_id").alias("gold_id"), "trust_score", "confidence", "has_icu",
        "has_emergency", "has_24_7", "capabilities", "contradictions")
    s = silver.select(
        F.col("facility_id").alias("silver_id"), "address_state", "address_city",
        "facility_type", "latitude", "longitude", "specialties")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        best.join(g, "gold_id").join(s, "silver_id")
        .select(
            "gold_id", "silver_id", "name", F.col("address_state").alias("state"),
            F.col("address_city").alias("city"), F.col("facility_type").alias("type"),
            F.col("latitude").alias("lat"), F.col("longitude").alias("lng"),
            F.col("trust_score").alias("trust"), "confidence",
            F.slice("specialties", 1, 4).alias("specialties"),
            yes("has_icu").alias("has_icu"), yes("has_emergency").alias("has_emergency"),
            yes("has_24_7").alias("has_24_7"),
            F.slice("capabilities", 1, 3).alias("capabilities"),
            F.coalesce(F.get("capabilities", F.lit(0)), F.lit("No capabilities extracted"))
            .alias("citation"),
            (F.size("contradictions") > 0).alias("has_contradiction"))
    )


def facility_profiles(gold: DataFrame, silver: DataFrame, names: DataFrame) -> DataFrame:
    """Full profile of every named facility: one row per name, the lowest ids on repeats. Record
    columns that are missing, or that silver lacks, are empty texts."""
    record = [c for c in RECORD_COLUMNS if c in silver.columns]
    w_gold = gold.join(names.select("name").distinct(), "name", "left_semi")
    g = w_gold.groupBy("name").agg(F.min_by(F.struct(
        "facility_id", "trust_score", "trust", "confidence", "capabilities",
        "extracted_equipment", "inferred_doctors", "has_icu", "has_emergency", "has_24_7",
        "bed_count", "contradictions", "data_completeness"), "facility_id").alias("g"))
    w_silver = silver.join(names.select("name").distinct(), "name", "left_semi")
    s = w_silver.groupBy("name").agg(F.min_by(F.struct(
        "facility_id", "facility_type", "address_state", "address_city", "address_zip",
        "latitude", "longitude", "description", "specialties", *record), "facility_id").alias("s"))
    text = lambda c: X.text_or_empty(F.col(c))
    said = lambda c: null_safe_string(F.col(f"s.{c}")) if c in record else F.lit("")
    return g.join(s, "name").select(
        "name", text("s.facility_type").alias("facility_type"),
        text("s.address_state").alias("state"), text("s.address_city").alias("city"),
        text("s.address_zip").alias("pin_code"),
        F.coalesce("s.latitude", F.lit(0.0)).alias("latitude"),
        F.coalesce("s.longitude", F.lit(0.0)).alias("longitude"),
        text("s.description").alias("description"), F.col("s.specialties").alias("specialties"),
        F.coalesce("g.trust_score", F.lit(0.0)).alias("trust_score"),
        F.col("g.trust").alias("trust_breakdown"),
        text("g.confidence").alias("confidence_level"),
        F.col("g.capabilities").alias("extracted_capabilities"),
        F.col("g.extracted_equipment").alias("extracted_equipment"),
        F.col("g.inferred_doctors").alias("doctor_count"),
        F.struct(F.col("g.inferred_doctors").alias("doctor_count")).alias("extracted_staff"),
        F.struct("g.has_icu", "g.has_emergency", "g.has_24_7").alias("extracted_availability"),
        F.coalesce("g.bed_count", F.lit(0)).alias("extracted_bed_count"),
        F.col("g.contradictions").alias("contradictions"),
        F.coalesce("g.data_completeness", F.lit(0.0)).alias("data_completeness"),
        *[said(c).alias(c) for c in RECORD_COLUMNS])


def map_filter_summary(gold: DataFrame, silver: DataFrame, state: str | None = None,
                       keywords: list[str] | None = None, min_trust: float = 0) -> DataFrame:
    """Count, mean trust and high-trust count of all facilities the filters leave on the map,
    however many: pairs are counted per name and class, none is formed."""
    g, s = _map_sides(gold, silver, state, keywords, min_trust)
    trust = F.col("trust_score")
    mine = g.groupBy("name", "gold_hit", "gold_cuts").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(trust >= 70).alias("high"),
        F.sum(F.round(trust * 10).cast("bigint")).alias("tenths"))
    theirs = s.groupBy("name", "silver_hit", "silver_cuts").agg(F.count(F.lit(1)).alias("m"))

    def pairs(c: str) -> Column:
        return F.coalesce(F.sum(F.col(c) * F.col("m")), F.lit(0)).cast("bigint")

    sums = mine.join(theirs, "name").where(_fits()).agg(
        pairs("n").alias("visible"), pairs("tenths").alias("tenths"), pairs("high").alias("high_trust"))
    half_up = F.expr("(tenths + 5 * visible) div (10 * visible)")
    return sums.select("visible", F.when(F.col("visible") > 0, half_up).otherwise(0).cast("bigint")
                       .alias("avg_trust"), "high_trust")


def state_breakdown(summary: DataFrame, limit: int = 8) -> DataFrame:
    rank = X.severity_rank(F.col("overall_severity_label"))
    share = F.least(F.lit(100.0), F.col("critical_specialty_count") / F.lit(8.0) * 100)
    return summary.orderBy(rank, "state").limit(limit).select(
        "state", F.upper("overall_severity_label").alias("severity"),
        F.col("critical_specialty_count").alias("critical_count"), share.alias("share"))


def batch_summary(gold: DataFrame, gaps: DataFrame) -> DataFrame:
    """Totals of one batch run: records, trust, critical gaps, failures, text split."""
    trust = F.col("trust_score")
    records = gold.agg(
        F.count(F.lit(1)).alias("enriched"),
        F.round(F.sum(F.round(trust * 10).cast("bigint")) / F.count(trust) / 10, 1)
        .alias("mean_trust"),
        F.count_if(trust >= 70).alias("high_trust"), F.count_if(trust < 30).alias("low_trust"),
        F.count_if(F.col("extraction_error").isNotNull()).alias("failures"),
        F.count_if("has_text").alias("with_text"), F.count_if(~F.col("has_text"))
        .alias("without_text")).withColumn("one", F.lit(1))
    critical = gaps.agg(F.count_if(F.col("desert_severity") > 80).alias("critical_gaps")) \
        .withColumn("one", F.lit(1))
    return records.join(critical, "one").drop("one")


def icu_warning(points: DataFrame) -> DataFrame:
    lists_icu = F.array_contains("specialties", "ICU")
    has_icu = F.coalesce(F.col("has_icu"), F.lit(False))
    return points.withColumn(
        "warning", F.when(~has_icu & lists_icu, "Claims ICU no evidence")
        .when(~has_icu & (F.size("specialties") == 0), "No data"))


def map_clusters(summary: DataFrame) -> DataFrame:
    n = F.col("total_facilities")
    label = F.when(n > 999, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("K"))) \
        .otherwise(n.cast("string"))
    return summary.select("state", "centroid_lat", "centroid_lng", label.alias("count_label"),
                          F.upper("overall_severity_label").alias("severity"),
                          F.col("critical_specialty_count").alias("critical_count"))
