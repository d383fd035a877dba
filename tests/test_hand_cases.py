"""Hand-computed cases of the single operators."""

import pytest
from pyspark.sql import functions as F

from wardline.functions import columns as X, vocab
from wardline.operators import (claims, gaps, geo, gold, intents, present, search, silver, trust,
                                validate)


def value(spark, column, **data):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in data.items()) or "x int"
    row = tuple(v for _, v in data.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("text, want", [
    (None, []), ("null", []), ("[]", []), ("", []), ('["oncology","cardiology"]',
     ["oncology", "cardiology"]), ("['a']", ["a"]), ("oncology", ["oncology"]),
    ('{"a":1}', []), ("12", []), ("Has ICU. 20 beds", ["Has ICU. 20 beds"]),
])
def test_parse_list(spark, text, want):
    assert value(spark, X.parse_list(F.col("c")), c=("string", text)) == want


def test_completeness_three_of_eight(raw_rows):
    row = silver.clean_silver(raw_rows(dict(
        description="x", specialties='["a"]', capacity="10", numberDoctors="n/a"))).collect()[0]
    assert row.data_completeness == 0.375
    assert row.numberDoctors is None and row.capacity == 10.0 and row.has_text


def test_clinic_with_too_many_beds(raw_rows):
    row = gold.build_gold(silver.clean_silver(raw_rows(dict(
        facilityTypeId=" Clinic", capability="120 bed", specialties='["x"]',
        equipment='["scope"]', procedure='["scan"]', recency_of_page_update="2024-01-01",
        social_count=2)))).collect()[0]
    # 5 of 8 fields filled: 15.6 points
    assert row.trust.asDict() == dict(completeness=15.6, consistency=15.0, verifiability=6.0,
                                      recency=8.0, digital=5.0)
    assert row.trust_score == 49.6
    assert row.contradictions == ["Facility type=clinic but claims 120 beds"]


def test_surgery_without_anaesthetist(raw_rows):
    procedures = str([f"p{i}" for i in range(10)]).replace("'", '"')
    row = gold.build_gold(silver.clean_silver(raw_rows(dict(
        facilityTypeId="hospital", capability="general surgery", description="text",
        specialties="x", equipment='["e"]', procedure=procedures, numberDoctors="4", capacity="9",
        social_count=10)))).collect()[0]
    assert row.trust_score == 80.0
    assert len(row.contradictions) == 1


def test_everything_missing(raw_rows):
    row = gold.build_gold(silver.clean_silver(raw_rows({}))).collect()[0]
    assert row.trust_score == 32.0 and row.confidence == "insufficient_data"
    assert row.has_icu is None and row.searchable_text == "F0"


def test_consistency_never_negative(raw_rows):
    row = gold.build_gold(silver.clean_silver(raw_rows(dict(
        facilityTypeId="clinic",
        capability="80 bed surgery open 24/7, closes 9pm")))).collect()[0]
    assert row.trust.consistency == 0.0 and len(row.contradictions) == 3


def test_bed_mentions(spark):
    beds = claims.bed_mentions(F.col("c"))
    assert value(spark, beds, c=("string", "20 bed, 30beds")) == 30
    assert value(spark, beds, c=("string", "9" * 22 + " beds")) == 0
    assert value(spark, beds, c=("string", None)) == 0


def test_half_even_and_padding(spark):
    assert value(spark, X.half_even(F.lit(1) / F.lit(32), 4)) == 0.0312
    assert value(spark, F.format_string("%05d", F.lit(123456))) == "123456"


def test_unknown_is_not_no(raw_rows):
    row = claims.with_claims(silver.clean_silver(raw_rows(
        dict(description="Skin clinic."),
        dict(description="Skin clinic.", model_reply='{"has_icu": false}')))) \
        .orderBy("facility_id").select("has_icu", "source_sentence").collect()
    assert row[0].has_icu is None and row[0].source_sentence is None
    assert row[1].has_icu is False


def test_reply_overrides_and_failures(raw_rows):
    df = claims.with_claims(silver.clean_silver(raw_rows(
        dict(description="a", model_reply='```json\n{"properties": {"has_icu": true}}\n```'),
        dict(description="a", model_reply="not json"), dict(description="a"))))
    good, failed = claims.split_failures(df)
    assert [r.facility_id for r in failed.collect()] == ["00001"]
    assert {r.facility_id: r.has_icu for r in good.collect()} == {"00000": True, "00002": None}


def test_evidence_sentence_and_notes(raw_rows):
    row = claims.with_claims(silver.clean_silver(raw_rows(dict(
        description="Welcome all.  We run an Intensive Care ward with 4 beds! Closes 9PM daily.",
    )))).collect()[0]
    assert row.source_sentence == "We run an Intensive Care ward with 4 beds!"
    assert row.operational_notes == "Closes 9PM daily."
    assert row.source_field == "description" and row.confidence == "medium"


@pytest.mark.parametrize("count, total, want", [(0, 3, 95), (1, 100, 75), (2, 100, 45), (5, 100, 20)])
def test_gap_severity(spark, count, total, want):
    assert value(spark, X.gap_severity(F.lit(count), F.lit(total))) == want


def test_gap_grid_keeps_zero_rows_and_unknown_states_out(spark):
    rows = [("Bihar", "x", "high", 1.0, 2.0)] * 4 + [(None, "oncology", "high", 1.0, 2.0)]
    g = spark.createDataFrame(rows, "address_state string, searchable_text string,"
                              " confidence string, latitude double, longitude double")
    grid = {r.specialty: r for r in gaps.gap_grid(g).collect()}
    assert set(grid) == set(vocab.GAP_SPECIALTIES)
    assert grid["oncology"].action == \
        "CRITICAL: Bihar has only 0 verified oncology facilities out of 4 total."


def test_gap_grid_shape_of_a_sample_run(spark):
    """Totals add up, ratios follow counts, severity 95 exactly on zero counts."""
    import random
    rnd = random.Random(7)
    rows = [(f"S{rnd.randrange(23)}", rnd.choice(["cancer ward", "maternity", "none"]),
             rnd.choice(["high", "low"]), 1.0, 2.0) for _ in range(300)]
    g = spark.createDataFrame(rows, "address_state string, searchable_text string,"
                              " confidence string, latitude double, longitude double")
    grid = gaps.gap_grid(g).collect()
    states = {r.state for r in grid}
    assert len(grid) == 6 * len(states)
    assert sum(r.total_facilities_state for r in grid) == 300 * 6
    for r in grid:
        assert r.coverage_ratio == pytest.approx(r.facility_count / r.total_facilities_state,
                                                 abs=5.1e-5)
        assert (r.desert_severity == 95) == (r.facility_count == 0)


def test_haversine(spark):
    km = X.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert round(value(spark, km), 3) == 111.195


def test_query_terms(spark):
    terms = intents.query_terms(F.lit("ICU care for eye in Kerala"),
                                F.array(F.lit("critical care")))
    assert value(spark, terms) == ["icu", "for", "eye", "kerala", "critical"]


def test_gap_intent(spark):
    q = F.lit("Which districts in Rajasthan have no dialysis centre?")
    assert value(spark, intents.is_gap_query(q)) is True
    assert value(spark, intents.specialty_filters(q)) == ["dialysis", "nephrology"]
    assert value(spark, intents.is_gap_query(F.lit("states don't have one"))) is True


@pytest.mark.parametrize("text, claim, supported, evidence", [
    ("24/7 casualty", "has_emergency", True, "casualty"), ("skin clinic", "has_icu", False, None)])
def test_standards(spark, text, claim, supported, evidence):
    df = spark.createDataFrame([(text, claim == "has_icu", claim == "has_emergency", None, None)],
                               "t string, has_icu boolean, has_emergency boolean,"
                               " has_surgery boolean, has_24_7 boolean")
    check = validate.with_standards_check(df, F.col("t")).collect()[0].standards_check[claim]
    assert (check.supported, check.evidence) == (supported, evidence)
    if not supported:
        assert check.standard_note == "Expected one of: ['icu', 'intensive care', 'critical care']"


@pytest.mark.parametrize("verdict, corrected, want", [
    ("DISPUTED", False, 68.0), ("DISPUTED", True, 72.0), ("VERIFIED", False, 80.0)])
def test_display_trust(spark, verdict, corrected, want):
    assert value(spark, trust.trust_display(F.lit(80.0), F.lit(verdict), F.lit(corrected))) == want


@pytest.mark.parametrize("score, band", [(70, "high"), (69.9, "medium"), (40, "medium"), (39.9, "low")])
def test_trust_band(spark, score, band):
    assert value(spark, X.trust_band(F.lit(float(score)))) == band


def test_distance_severity(spark):
    def sev(n, t):
        return value(spark, geo.distance_severity(F.lit(n), F.lit(t)))
    assert [sev(0, None), sev(1, 39.0), sev(1, 50.0), sev(2, 70.0), sev(3, 69.9)] == \
        [95, 75, 60, 20, 45]


def test_min_trust_zero_means_no_filter(spark):
    df = spark.createDataFrame([(10.0,), (None,)], "trust_score double")
    assert df.where(search.filter_min_trust(0)).count() == 1


def test_specialty_labels(raw_rows):
    row = silver.with_specialty_labels(silver.clean_silver(raw_rows(dict(
        specialties='["emergencyMedicine","emergencyMedicine","Radiology"]')))).collect()[0]
    assert row.specialty_labels == ["emergency medicine", "radiology"]
    assert row.specialty_categories == ["Diagnostic", "High-Acuity"]


def test_display_specialties_and_json_text(spark):
    assert value(spark, claims.specialties_display(F.lit("a | b|c |d|e"))) == ["a", "b", "c", "d"]
    assert value(spark, present.coerce_contradictions(F.lit('["x"]'))) == ["x"]
    assert value(spark, present.coerce_contradictions(F.lit("nope"))) == []


def test_translation_need(spark):
    need = intents.needs_translation(F.col("q"), F.col("l"))
    assert value(spark, need, q=("string", "hello"), l=("string", None)) is False
    assert value(spark, need, q=("string", "hello"), l=("string", "hi")) is True
    assert value(spark, need, q=("string", "नमस्ते"), l=("string", "en")) is True
