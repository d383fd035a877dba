"""Trust scoring: five sub-scores, five consistency rules, bands and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import columns as X, vocab
from wardline.operators.claims import beds_in

# Penalty points of the consistency rules.
PENALTIES = {"clinic_beds": 15, "surgery_no_anaesthetist": 12, "limited_hours": 10,
             "icu_no_evidence": 10, "one_doctor_team": 15, "one_doctor_24_7": 10}


# Fields whose text the rules search.
RULE_FIELDS = ["description", "capability"]


def rule_text() -> Column:
    return F.concat_ws(" ", *[F.lower(X.text_or_empty(F.col(f))) for f in RULE_FIELDS])


def with_rule_text(claimed: DataFrame) -> DataFrame:
    """Adds `_rule_text` and the beds it names; from the lower-cased fields of the claims step,
    where it has kept them."""
    if "_rule_text" in claimed.columns:
        return claimed
    kept = {f"_{f}" for f in RULE_FIELDS} <= set(claimed.columns)
    text = F.concat_ws(" ", *[F.col(f"_{f}") for f in RULE_FIELDS]) if kept else rule_text()
    return claimed.withColumn("_rule_text", text).withColumn("_beds", beds_in(F.col("_rule_text")))


def rule_messages(text: str, one_doctor_24_7: bool = False) -> dict[str, Column]:
    """Rule name -> message when the rule fires, else null. Unknown claims never fire."""
    beds = F.col("_beds")
    claimed = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_surgery", "has_24_7", "has_icu",
                                                             "has_emergency")}
    rules = {
        "clinic_beds": F.when(
            (F.col("facilityTypeId") == "clinic") & (beds > 50),
            F.format_string("Facility type=clinic but claims %d beds", beds)),
        "surgery_no_anaesthetist": F.when(
            claimed["has_surgery"] & ~X.any_word(text, vocab.ANAESTHETIST_WORDS),
            "Claims surgery capability but no anaesthesiologist mentioned"),
        "limited_hours": F.when(
            claimed["has_24_7"] & X.any_word(text, vocab.LIMITED_HOURS_WORDS),
            "Claims 24/7 but text suggests limited operating hours"),
        "icu_no_evidence": F.when(
            claimed["has_icu"] & ~X.any_word(text, vocab.ICU_EVIDENCE_WORDS)
            & (F.size("extracted_equipment") == 0),
            "Claims ICU but no supporting equipment or text evidence found"),
        "one_doctor_team": F.when(
            (F.col("numberDoctors") == 1) & X.any_word(text, vocab.TEAM_WORDS),
            "numberDoctors=1 but claims team of specialists"),
    }
    if one_doctor_24_7:
        rules["one_doctor_24_7"] = F.when(
            claimed["has_24_7"] & claimed["has_emergency"] & (F.col("numberDoctors") == 1),
            "Claims 24/7 emergency but numberDoctors=1")
    return rules


def with_rules(claimed: DataFrame, one_doctor_24_7: bool = False) -> DataFrame:
    """One `rule_*` message column per rule; the long text is lower-cased once."""
    rules = rule_messages("_rule_text", one_doctor_24_7)
    texted = with_rule_text(claimed).withColumns({f"rule_{n}": m for n, m in rules.items()})
    return texted if "_rule_text" in claimed.columns else texted.drop("_rule_text", "_beds")


def with_trust(claimed: DataFrame, one_doctor_24_7: bool = False) -> DataFrame:
    """Adds `trust` (the five sub-scores), `trust_score` and `contradictions`."""
    ruled = with_rules(claimed, one_doctor_24_7)
    names = [c.removeprefix("rule_") for c in ruled.columns if c.startswith("rule_")]
    penalty = sum((F.when(F.col(f"rule_{n}").isNotNull(), PENALTIES[n]).otherwise(0)
                   for n in names), F.lit(0))
    scored = ruled.withColumns({
        "contradictions": F.array_compact(F.array(*[F.col(f"rule_{n}") for n in names])),
        "trust": F.struct(
            trust_completeness().alias("completeness"),
            F.greatest(F.lit(0.0), F.lit(30.0) - penalty).alias("consistency"),
            trust_verifiability().alias("verifiability"),
            trust_recency().alias("recency"),
            trust_digital().alias("digital"),
        ),
    })
    parts = [F.col(f"trust.{p}") for p in
             ("completeness", "consistency", "verifiability", "recency", "digital")]
    total = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    return scored.withColumn(
        "trust_score", X.half_even(F.least(F.lit(100.0), total), 1)
    ).drop(*[f"rule_{n}" for n in names])


def trust_completeness() -> Column:
    return X.half_even(F.coalesce("data_completeness", F.lit(0.0)) * 25, 1)


def trust_recency() -> Column:
    return F.when(X.is_missing("recency_of_page_update"), 2.0).otherwise(8.0)


def trust_digital() -> Column:
    presence = F.coalesce(F.nanvl(F.col("social_count").cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(10.0), presence * 2.5)


def trust_verifiability() -> Column:
    specifics = F.size("extracted_equipment") + F.size("extracted_procedures")
    return F.least(F.lit(25.0), specifics * F.lit(3.0))


def recency_decay(as_of: str) -> Column:
    """Newer is higher: 10 points, falling by e every twelve months; 0 without a date."""
    updated = F.col("recency_of_page_update").try_cast("date")
    months = F.months_between(F.lit(as_of).cast("date"), updated)
    age = F.when(months > 0, months).otherwise(0.0)
    points = X.half_even(F.lit(10.0) * F.exp(-age / 12), 3)
    return F.when(updated.isNotNull(), points).otherwise(0.0)


def with_verifiability_ratio(claimed: DataFrame, out: str = "verifiability") -> DataFrame:
    """Share of the true claims backed by a standards word in the text, out of 25."""
    texted = claimed.withColumn("_rule_text", rule_text())
    stated, backed = F.lit(0), F.lit(0)
    for claim, words in vocab.STANDARDS.items():
        on = F.coalesce(F.col(claim), F.lit(False))
        stated = stated + on.cast("int")
        backed = backed + (on & X.any_word("_rule_text", words)).cast("int")
    share = F.coalesce(X.half_even(F.try_divide(backed, stated) * 25, 1), F.lit(0.0))
    return texted.withColumn(out, share).drop("_rule_text")


def trust_display(trust: Column, verdict: Column, corrected: Column) -> Column:
    return (
        F.when(corrected, X.half_even(trust * 0.90, 1))
        .when(verdict == "DISPUTED", X.half_even(trust * 0.85, 1))
        .otherwise(trust)
    )


def trust_warning(verdict: Column, corrected: Column) -> Column:
    return (
        F.when(corrected, "Self-corrected — extraction revised after validation")
        .when(verdict == "DISPUTED", "Trust score adjusted — disputed claims not correctable")
    )


def contradicting_evidence(trusted: DataFrame) -> DataFrame:
    """Long form: one row per facility and fired rule."""
    ruled = with_rules(trusted)
    names = [c for c in ruled.columns if c.startswith("rule_")]
    fired = F.filter(F.array(*[
        F.struct(F.lit(c.removeprefix("rule_")).alias("rule"), F.col(c).alias("message"))
        for c in names
    ]), lambda r: r.getField("message").isNotNull())
    return ruled.select("facility_id", F.inline(fired))


def trust_distribution(gold: DataFrame) -> DataFrame:
    bucket = (F.floor(F.col("trust_score") / 10) * 10).cast("bigint").alias("trust_bucket")
    return gold.groupBy("address_state", "facility_type", bucket).agg(
        F.count(F.lit(1)).alias("facilities"))


def low_trust_critical(gold: DataFrame, below: float = 40) -> DataFrame:
    """Low-trust facilities that claim a critical capability."""
    critical = (F.coalesce("has_icu", F.lit(False)) | F.coalesce("has_emergency", F.lit(False))
                | F.coalesce("has_trauma_centre", F.lit(False))
                | F.coalesce("has_neonatal_icu", F.lit(False)))
    return gold.where((F.col("trust_score") < below) & critical)
